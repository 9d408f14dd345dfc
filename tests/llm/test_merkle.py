"""The Merkle manifest against a plain tree, its twin, requests for some leaves, and edge cases."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from tarifflens.llm import merkle_manifest, queries
from tests.compare import connect, difference
from tests.conftest import MEDIUM, SMALL

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, tree string, digest int, rank string, leaf long"
LONG = "Word " * 200_000


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def levels(digests):
    """All levels of a tree, from the leaves up."""
    found = [digests]
    while len(found[-1]) > 1:
        last = found[-1]
        found.append([sha("".join(last[i : i + 16])) for i in range(0, len(last), 16)])
    return found


def way(tree, rank):
    """The siblings, as (before, after), from the leaf up."""
    path = []
    for level in tree[:-1]:
        start = rank // 16 * 16
        path.append(("".join(level[start:rank]), "".join(level[rank + 1 : start + 16])))
        rank //= 16
    return path


def lowered(text):
    return None if text is None else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def plain(rows):
    """The expected rows, one by one."""
    leaves = []
    for r in rows:
        fields = [r[0], r[3], r[2], r[4], r[1]]
        hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
        changed = [*fields[:4], lowered(r[1]) if hit else r[1]]
        leaves.append((r[3], r[0], sha("".join(map(field, fields))), sha("".join(map(field, changed)))))
    sources = sorted({s for s, *_ in leaves}, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for source in sources:
        own = sorted((x for x in leaves if x[0] == source), key=lambda x: (x[1] is not None, x[1] or 0, x[2]))
        trees[source] = own, levels([x[2] for x in own])
    top = levels([trees[s][1][-1][0] for s in sources]) if sources else None
    for place, source in enumerate(sources):
        own, tree = trees[source]
        for rank, (_, doc_id, leaf, changed) in enumerate(own):
            path = way(tree, rank) + way(top, place)
            back = changed
            for before, after in path:
                back = sha(before + back + after)
            yield doc_id, leaf, tree[-1][0], top[-1][0], sha("".join(b + a for b, a in path)), back, back == top[-1][0]


def bag(rows):
    return sorted(map(repr, rows))


def sized(sizes):
    """Sources of the given sizes, with all kinds of fields."""
    rows, doc_id = [], 0
    for k, size in enumerate(sizes):
        for _ in range(size):
            text = [f"Text {doc_id} ÄÖ", None, "", "no capitals"][doc_id % 4]
            rows.append((doc_id * 3 % 1009, text, "en" if doc_id % 3 else None, None if k == 1 else f"src{k}", doc_id, "", 0, "", 0))
            doc_id += 1
    return rows


@pytest.mark.parametrize("sizes", [[1], [2], [16], [17], [0, 5], [257, 1, 16, 33], [3] * 18, [1] * 40])
def test_trees_of_all_shapes(spark, sizes):
    rows = sized(sizes)
    found = merkle_manifest.verify(spark.createDataFrame(rows, SCHEMA).repartition(5))
    assert bag(tuple(r) for r in found.collect()) == bag(plain(rows))


def test_edges(spark):
    rows = [
        (None, "No id", "en", "s", 5, "", 0, "", 0),
        (None, None, None, None, None, "", 0, "", 0),
        (5, LONG, "en", "s", len(LONG), "", 0, "", 0),
        (7, "Once", "en", "s", 4, "", 0, "", 0),
        (7, "Twice", "en", "s", 5, "", 0, "", 0),
        *[(8, "The Same Row", "en", "s", 12, "", 0, "", 0)] * 600,
        (9, "Clash", "en", "", 5, "", 0, "", 0),
        (10, "Clash", "en", "-", 5, "", 0, "", 0),
        (11, "", "", "Ä", 0, "", 0, "", 0),
        (12, "Far", "en", "𝄞", 3, "", 0, "", 0),
    ]
    found = merkle_manifest.verify(spark.createDataFrame(rows, SCHEMA).repartition(7)).collect()
    assert bag(tuple(r) for r in found) == bag(plain(rows))
    empty = merkle_manifest.verify(spark.createDataFrame([], SCHEMA))
    assert empty.collect() == [] and empty.columns == list(found[0].asDict())


def test_requests_for_some_leaves(spark):
    """Only what leads to the requested leaves is opened, and the paths are those of all leaves."""
    rows = spark.createDataFrame(sized([300, 2, 40]), SCHEMA)
    leaves = rows.select(merkle_manifest.source_key(F.col("source")).alias("tree"), "doc_id", F.sha2("text", 256).alias("digest"))
    manifest = merkle_manifest.build(leaves.fillna("-", "digest"))
    every = {(r["tree"], r["rank"]): r for r in merkle_manifest.prove(manifest).collect()}
    assert len(every) == 342
    wanted = [("=src0", 0), ("=src0", 299), ("=src0", 17), ("", 1), ("=src2", 39), ("=src2", 39), ("=src2", 999), ("=none", 0)]
    some = merkle_manifest.prove(manifest, spark.createDataFrame(wanted, "tree string, rank long")).collect()
    assert sorted((r["tree"], r["rank"]) for r in some) == sorted(set(wanted[:5]))
    assert all(r["path"] == every[r["tree"], r["rank"]]["path"] and r["root"] == every[r["tree"], r["rank"]]["root"] for r in some)


def test_records_are_content_addressed(spark):
    """512 equal leaves are one run, stored once, whichever way a request comes."""
    rows = spark.createDataFrame([("=s", 1, "ab")] * 512, "tree string, doc_id long, digest string")
    manifest = merkle_manifest.build(rows)
    assert manifest.leaves.count() == 512 and manifest.records.count() == 3
    paths = merkle_manifest.prove(manifest).select("rank", merkle_manifest.folded(F.col("digest"), F.col("path")).alias("back"), "root")
    assert paths.where("back = root").count() == 512


def test_twin(spark):
    for folder in (SMALL, MEDIUM):
        problem = difference(spark, connect(folder), folder, queries.op12_merkle_manifest, merkle_manifest.verify_sql())
        assert problem is None
