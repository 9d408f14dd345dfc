"""The registered queries of this subpackage: thin, over whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarifflens.llm import (
    byte_bpe,
    compression_quality,
    fingerprints,
    jaccard_join,
    license_rules,
    line_dedup,
    link_trust,
    merkle_manifest,
    near_dedup,
    packing,
    pu_toxicity,
    robust_outliers,
    whitening,
)
from tarifflens.llm.common import fold, table, whole

# Rules of the url filter: verdict, host, path.
URL_RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]


def op1_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Every document without the lines that an earlier document holds."""
    cut = line_dedup.drop_lines(table(spark, folder, "documents").select("doc_id", "text"))
    return cut.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op2_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Near-duplicate class of every document."""
    return near_dedup.classes(table(spark, folder, "documents")).select("doc_id", "class_id")


def op3_robust_outliers(spark: SparkSession, folder: str) -> DataFrame:
    """Statistics and verdict of every document."""
    return robust_outliers.judged_documents(table(spark, folder, "documents")).select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "kept",
        "n_upper",
        "distance",
    )


def op4_license_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Known licence sentences and licences of every document."""
    return license_rules.scan(table(spark, folder, "documents").select("doc_id", "text")).select(
        "doc_id",
        "n_sentences",
        F.array_join("sentence_ids", ",").alias("sentence_ids"),
        F.array_join("licences", ",").alias("licences"),
    )


def op5_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Bin and place of every piece of every document."""
    return packing.pack(table(spark, folder, "documents"))


def op6_paragraph_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprint of every document and of its edited version, and how alike they are."""
    return fingerprints.compare(table(spark, folder, "documents"))


def op7_compression_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Quality score of every document."""
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    model = compression_quality.fit(docs, labels)
    scored = docs.select("doc_id", compression_quality.score(F.col("text"), model).alias("score"))
    return scored.select(
        "doc_id",
        (fold(F.col("doc_id")) == 1).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def op8_pu_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Toxicity score of every document."""
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    model = pu_toxicity.fit(docs, labels)
    scored = docs.select("doc_id", pu_toxicity.score(F.col("text"), model).alias("score"))
    return scored.select(
        "doc_id",
        (fold(F.col("doc_id")) == 1).alias("held_out"),
        "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"),
    )


def op9_link_trust(spark: SparkSession, folder: str) -> DataFrame:
    """Verdict of every page."""
    return link_trust.filter_urls(table(spark, folder, "pages"), URL_RULES)


def op10_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    """Ids of every document, and the bytes they decode to, as digests."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    vocabulary = byte_bpe.Vocabulary.read(path, public_tokenizers.PATTERN)
    docs = table(spark, folder, "documents")
    encoded = docs.select("doc_id", byte_bpe.encode(whole(F.col("text")), vocabulary).alias("ids"))
    decoded = encoded.withColumn("decoded", byte_bpe.decode(F.col("ids"), vocabulary))
    return decoded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op11_embedding_whitening(spark: SparkSession, folder: str) -> DataFrame:
    """The first whitened components of every embedding."""
    return whitening.whiten(table(spark, folder, "embeddings"))


def op12_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """Leaf, proof and verdict of every document."""
    return merkle_manifest.verify(table(spark, folder, "documents"))


def op13_ngram_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    """Set size and component of links of every document."""
    return jaccard_join.linked_components(table(spark, folder, "documents"))


LLM_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_near_dedup": op2_near_dedup,
    "op3_robust_outliers": op3_robust_outliers,
    "op4_license_rules": op4_license_rules,
    "op5_best_fit_packing": op5_best_fit_packing,
    "op6_paragraph_fingerprints": op6_paragraph_fingerprints,
    "op7_compression_quality": op7_compression_quality,
    "op8_pu_toxicity": op8_pu_toxicity,
    "op9_link_trust": op9_link_trust,
    "op10_byte_bpe": op10_byte_bpe,
    "op11_embedding_whitening": op11_embedding_whitening,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_ngram_jaccard_join": op13_ngram_jaccard_join,
}

# A line and its key, as the contract of op1 has it.
LINE_DEDUP_SQL = """
with lines as (
    select rowid as r, doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line,
        unnest(range(len(string_split(coalesce(text, ''), chr(10))))) as place
    from (select row_number() over () as rowid, doc_id, text from documents)),
keyed as (
    select *, translate(trim(line, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from lines),
repeats as (
    select key, min(doc_id) as first from keyed where length(key) >= 10
    group by key having count(distinct doc_id) > 1),
marked as (select k.*, coalesce(k.doc_id <> p.first, false) as gone from keyed k left join repeats p using (key))
select doc_id, cast(count(*) as bigint) as n_lines, cast(count(*) filter (gone) as bigint) as n_dropped,
    sha256(coalesce(string_agg(line, chr(10) order by place) filter (not gone), '')) as kept_sha256
from marked group by r, doc_id
"""


def llm_sql() -> dict[str, str]:
    """DuckDB twins, where SQL can express the query."""
    return {
        "op1_line_dedup": LINE_DEDUP_SQL,
        "op4_license_rules": license_rules.scan_sql(),
        "op12_merkle_manifest": merkle_manifest.verify_sql(),
    }
