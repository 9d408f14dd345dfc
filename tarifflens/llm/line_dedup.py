"""Line dedup with two Bloom filters.

A line is known by its key: blanks stripped at both ends, A-Z lower-cased. Every key of at least ``least`` characters
that is in two or more documents stays in the smallest doc_id that holds it and goes from all others.

1. Each task adds the distinct keys of its documents to a filter of keys seen once, and keys met again to a filter of
   keys seen twice. The filters of all tasks are merged by segments: a key is seen twice if two tasks saw it once.
2. A second scan asks the twice filter. Only suspected repeats leave the task, as (digest of the key, doc_id).
3. One aggregation per digest confirms them exactly: at least two different doc_ids; the smallest keeps the line.
4. What each document loses is joined to its text, which is cut in the same pass.

The filters have 16 bits for each line of the input, at most 128 MB each (the only thing that is broadcast). Above
about 10^9 lines they fill up: the answer stays exact, and more lines are suspected and shuffled as 16-byte digests. A
line that a third of all documents share is pre-aggregated per task, and the join back is one row per digest against
all holders, which adaptive execution splits.

Edge cases: a null text is one empty line. Rows without a doc_id count for nothing and lose nothing. Rows that repeat
a doc_id are one document: a line only they share stays in all of them. A document whose lines all go stays, empty.
Extra columns pass through; ``text`` is replaced, and so are columns named like the two counts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarifflens.llm.bloom import SEGMENT, gathered, hits, packed, places, tasks_of, unpacked, words_for
from tarifflens.llm.common import BLANKS, boxed, prepare, stored, whole

LEAST = 10


def key_of(line: str, least: int = LEAST) -> bytes | None:
    """The key of a line, or None if it is too short to count."""
    line = line.strip(BLANKS)
    return line.encode("utf-8", "surrogatepass").lower() if len(line) >= least else None


def keys_of(text: str | None, least: int = LEAST) -> set[bytes]:
    """The distinct keys of a text."""
    return {k for k in (key_of(line, least) for line in (text or "").split("\n")) if k is not None}


def digest_of(key: bytes) -> bytes:
    return hashlib.blake2b(key, digest_size=16).digest()


def hashes_of(keys: set[bytes]) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(k) for k in keys), np.uint64, len(keys))


class SeenFilters:
    """Keys seen once, and keys seen again."""

    def __init__(self, words: int):
        self.words = words
        self.once = np.zeros(words, np.uint64)
        self.twice = np.zeros(words, np.uint64)

    def add(self, hashes: np.ndarray) -> None:
        """Add the keys of some documents, distinct within each."""
        unique, times = np.unique(hashes, return_counts=True)
        index, mask = places(unique, self.words)
        again = (times > 1) | ((self.once[index] & mask) == mask)
        np.bitwise_or.at(self.twice, index[again], mask[again])
        np.bitwise_or.at(self.once, index, mask)


def twice_filter(docs: DataFrame, words: int, least: int) -> np.ndarray:
    """The filter of keys that at least two documents (or rows) seem to hold; ``words`` long, whatever the input."""

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = SeenFilters(words)
        for batch in batches:
            found = [hashes_of(keys_of(text, least)) for text in batch["text"]]
            if found:
                seen.add(np.concatenate(found))
        for segment in range(words // SEGMENT):
            part = slice(segment * SEGMENT, (segment + 1) * SEGMENT)
            if seen.once[part].any():
                yield pd.DataFrame(
                    {"segment": [segment], "once": [packed(seen.once[part])], "twice": [packed(seen.twice[part])]}
                )

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        segments: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for segment, once, twice in zip(batch["segment"], batch["once"], batch["twice"]):
                once, twice = unpacked(once), unpacked(twice)
                if segment in segments:
                    before, again = segments[segment]
                    again |= twice | (before & once)
                    before |= once
                else:
                    segments[segment] = (once, twice)
        for segment, (_, twice) in segments.items():
            yield pd.DataFrame({"segment": [segment], "filter": [packed(twice)]})

    parts = docs.select("text").mapInPandas(build, "segment int, once binary, twice binary")
    # A segment has one row per scanning task; they stream through the merge, which holds its own segments only.
    merged = parts.repartition(tasks_of(docs, words), "segment").mapInPandas(merge, "segment int, filter binary")
    return gathered(merged, words)


def suspects(docs: DataFrame, twice: np.ndarray, least: int) -> DataFrame:
    """(digest, doc_id) of the lines that the filter suspects, once per document."""
    shared, words = docs.sparkSession.sparkContext.broadcast(packed(twice)), len(twice)

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = unpacked(shared.value, words)
        for batch in batches:
            digests, ids = [], []
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                keys = list(keys_of(text, least))
                for k in np.flatnonzero(hits(hashes_of(keys), known)):
                    digests.append(digest_of(keys[k]))
                    ids.append(doc_id)
            yield pd.DataFrame({"digest": digests, "doc_id": pd.Series(ids, dtype="int64")})

    return docs.where("doc_id is not null").mapInPandas(ask, "digest binary, doc_id long")


def lines_to_drop(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(doc_id, digests): the keys that each document loses. At most the lines of one document are in a row."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole(F.col("text")).alias("text"))
    newlines = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1
    lines = docs.agg(F.sum(newlines)).first()[0] or 0
    found = stored(suspects(docs, twice_filter(docs, words_for(lines), least), least))
    firsts = (
        found.groupBy("digest")
        .agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
        .where(F.col("first") < F.col("last"))
        .select("digest", "first")
    )
    # Stored, so that both sides of the join are plain exchanges and a line with very many holders can be split.
    return (
        found.join(stored(firsts), "digest")
        .where(F.col("doc_id") != F.col("first"))
        .groupBy("doc_id")
        .agg(F.collect_list("digest").alias("digests"))
    )


def drop_lines(docs: DataFrame, least: int = LEAST, count: str = "n_lines", dropped: str = "n_dropped") -> DataFrame:
    """The documents without their repeated lines, with the number of lines before and of lines dropped."""
    prepare(docs.sparkSession)
    drops = lines_to_drop(docs, least).withColumnRenamed("doc_id", "of")
    joined = boxed(docs).join(drops, F.col("row.doc_id").cast("long") == F.col("of"), "left")

    @F.pandas_udf("text string, dropped long")
    def cut(texts: pd.Series, digests: pd.Series) -> pd.DataFrame:
        kept, lost = [], []
        for text, gone in zip(texts, digests):
            if gone is None or not len(gone):
                kept.append(text)
                lost.append(0)
                continue
            gone, lines = set(gone), text.split("\n")
            stay = [x for x in lines if (k := key_of(x, least)) is None or digest_of(k) not in gone]
            kept.append("\n".join(stay))
            lost.append(len(lines) - len(stay))
        return pd.DataFrame({"text": kept, "dropped": lost})

    text = whole(F.col("row.text"))
    before = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1
    result = joined.select(
        "row", cut.asNondeterministic()(text, F.col("digests")).alias("cut"), before.cast("long").alias("lines")
    )
    others = [c for c in docs.columns if c not in (count, dropped)]
    return result.select(
        *(F.col("cut.text").alias("text") if c == "text" else F.col("row")[c].alias(c) for c in others),
        F.col("lines").alias(count),
        F.col("cut.dropped").alias(dropped),
    )
