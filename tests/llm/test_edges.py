"""Nulls, empty and long texts, repeated rows, empty tables and clashing columns, for every operator and stage."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tarifflens.llm import (
    byte_bpe,
    compression_quality,
    fingerprints,
    license_rules,
    line_dedup,
    link_trust,
    near_dedup,
    packing,
    pu_toxicity,
    robust_outliers,
)
from tests.conftest import SMALL

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, __of string, label int"
LONG = " ".join(f"word{i}" for i in range(60_000))
SHARED = "a line that many hold"
ROWS = [
    (1, f"first line\n{SHARED}\nlast one here", "en", "s", 40, 0.5, "x", 1),
    (2, f"other words\n{SHARED}", "en", "s", 40, None, None, None),
    (2, f"other words\n{SHARED}", "en", "s", 40, None, None, None),
    (3, None, None, None, None, None, None, None),
    (4, "", "en", None, 0, None, None, None),
    (None, f"no id\n{SHARED}", None, "s", 0, None, None, None),
    (None, None, None, None, None, None, None, None),
    (5, LONG, "en", "s", len(LONG), None, None, None),
    (6, " \t\n\n ", "en", "s", 5, None, None, None),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 0, 1), (3, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")


def test_line_dedup(spark, docs, nothing):
    rows = [r.asDict() for r in line_dedup.drop_lines(docs, count="label", dropped="score").collect()]
    assert len(rows) == len(ROWS)
    by_id = {r["doc_id"]: r for r in rows}
    assert set(rows[0]) == {c.split()[0] for c in SCHEMA.split(", ")}
    assert by_id[1]["text"] == ROWS[0][1] and by_id[1]["score"] == 0
    assert all(r["text"] == "other words" and r["label"] == 2 and r["score"] == 1 for r in rows if r["doc_id"] == 2)
    assert by_id[3]["text"] == "" and by_id[3]["label"] == 1
    assert sorted(r["text"] for r in rows if r["doc_id"] is None) == ["", f"no id\n{SHARED}"]
    assert by_id[5]["text"] == LONG and by_id[1]["__of"] == "x"
    assert line_dedup.drop_lines(nothing).collect() == []


def test_near_dedup(spark, docs, nothing):
    found = {(r.doc_id, r.class_id) for r in near_dedup.classes(docs).collect()}
    # Texts without words are copies of each other; the row without an id joins them.
    assert found == {(1, 1), (2, 2), (3, 3), (4, 3), (6, 3), (None, 3), (None, None), (5, 5)}
    kept = [r.doc_id for r in near_dedup.keep_first(docs).collect()]
    assert sorted(kept, key=str) == [1, 2, 3, 5, None, None]
    assert near_dedup.keep_first(docs).columns == docs.columns
    assert near_dedup.classes(nothing).collect() == [] and near_dedup.keep_first(nothing).collect() == []


def test_robust_outliers(docs, nothing):
    rows = robust_outliers.judged_documents(docs).collect()
    assert len(rows) == len(ROWS)
    assert {(r.doc_id, r.n_words, r.kept) for r in rows if r.doc_id in (3, 5)} == {(3, 0, False), (5, 60_000, True)}
    assert robust_outliers.judged_documents(nothing).collect() == []


def test_license_rules(docs, nothing):
    rows = license_rules.scan(docs).collect()
    assert len(rows) == len(ROWS) and all(r.licences == [] for r in rows)
    assert {r.n_sentences for r in rows if r.doc_id in (3, 4, 6)} == {0}
    assert license_rules.scan(nothing).collect() == []


def test_packing(docs, nothing):
    rows = packing.pack(docs, capacity=1000).collect()
    assert sum(r.length for r in rows if r.doc_id == 5) == 60_000
    assert {(r.copy, r.length) for r in rows if r.doc_id == 2} == {(0, 7), (1, 7)}
    assert {r.doc_id for r in rows} == {1, 2, 3, 4, 5, 6, None}
    assert packing.pack(nothing).collect() == []


def test_fingerprints(docs, nothing):
    rows = fingerprints.compare(docs).collect()
    assert len(rows) == len(ROWS)
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in rows)
    same = {r.fingerprint for r in rows if r.n_chars == 0}
    assert len(same) == 1 and sum(r.n_chars == 0 for r in rows) == 3
    assert fingerprints.compare(nothing).collect() == []


def test_classifiers(docs, nothing, labels):
    model = compression_quality.fit(docs, labels)
    rows = compression_quality.with_quality(docs, model, "score").collect()
    assert len(rows) == len(ROWS) and all(0 <= r.score <= 1 for r in rows) and rows[0].label == 1
    unknown = compression_quality.fit(nothing, labels)
    assert {r.score for r in compression_quality.with_quality(docs, unknown, "score").collect()} == {0.5}
    assert compression_quality.keep_good(nothing, unknown).collect() == []
    model = pu_toxicity.fit(docs, labels)
    rows = pu_toxicity.with_toxicity(docs, model, "score").collect()
    assert len(rows) == len(ROWS) and all(0 <= r.score <= 1 for r in rows)
    assert pu_toxicity.drop_toxic(nothing, pu_toxicity.fit(nothing, labels)).collect() == []


def test_link_trust(spark):
    rows = [(1, None, None), (2, "no scheme", "<a href='http://b.org/'>"), (3, "http://a.com", ""), (None, "x://", None)]
    pages = spark.createDataFrame([*rows, rows[2]], "page_id long, url string, html string")
    found = link_trust.filter_urls(pages, [("block", "a.com", "/"), ("block", "a.com", "")]).collect()
    assert sorted((r.page_id or 0, r.host, r.path, r.rule or "", r.verdict) for r in found) == [
        (0, "", "", "", "allow"),
        (1, "", "", "", "allow"),
        (2, "", "", "", "allow"),
        (3, "a.com", "", "a.com", "block"),
        (3, "a.com", "", "a.com", "block"),
    ]
    assert link_trust.filter_urls(pages.limit(0), [("block", "a.com", "/")]).collect() == []


def test_byte_bpe(docs, nothing):
    vocabulary = byte_bpe.Vocabulary({bytes([b]): b for b in range(256)} | {b"ab": 256}, r"\S+|\s+")
    ids = docs.select("text", byte_bpe.encode(F.col("text"), vocabulary).alias("ids"))
    rows = ids.withColumn("back", byte_bpe.decode(F.col("ids"), vocabulary)).collect()
    assert all(bytes(r.back).decode() == (r.text or "") for r in rows)
    assert nothing.select(byte_bpe.encode(F.col("text"), vocabulary)).collect() == []


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages(spark, docs, nothing, name, stage):
    rows = stage(spark, docs, SMALL)
    rows.collect()
    assert name == corpus_pipeline.STAGES[-1][0] or rows.columns == docs.columns
    assert stage(spark, nothing, SMALL).collect() == []


def test_near_duplicates_lose_no_text_of_a_repeated_id(spark):
    """Different texts under one doc_id are told apart; only copies of a smaller one go."""
    a, b, c = (" ".join(f"{name}{i}" for i in range(40)) for name in "abc")
    docs = spark.createDataFrame([(1, a), (2, b), (2, c), (2, a), (2, b), (3, c + " end")], "doc_id long, text string")
    kept = sorted((r.doc_id, r.text) for r in near_dedup.keep_first(docs).collect())
    assert kept == [(1, a), (2, b), (2, c)]
