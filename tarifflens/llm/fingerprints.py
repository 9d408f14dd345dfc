"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests.

A paragraph is a line; a long line goes on in several, cut after words whose hash says so (about every fourth), so that
an edit changes the paragraphs around it and no others. Each paragraph, numbered among its equals, has a 64-bit digest.
The sketch puts a digest into one cell of each of three rows; a cell holds a count, the xor of its digests and the xor
of their check sums. The sketches of two versions subtract cell by cell: what they share cancels out, and peeling the
cells that hold a single digest recovers the digests on either side. Where peeling ends early, both versions are
sketched again with twice the cells.

The likeness of two versions is the share of common digests in all (common / (common + lost + gained)).

Peeling works on all versions of a batch together in numpy. To see the next document, the texts are shuffled once, by
ranges of doc_id; the first document of each range is also sent to the range before it, so that every range is whole.

Edge cases: a null text is an empty one; it has no digests, and two empty texts are alike (1). Equal texts have equal
fingerprints. Rows without a doc_id come last, in one order with the others; rows that repeat a doc_id are ordered by
their text. Of several rows alike in both, each is the next of the one before. A single row is its own next one.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarifflens.llm.common import whole

ROWS = 3
CELLS = 24
CUT = np.uint64(4)
MIXERS = tuple(np.uint64(m) for m in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
CHECK = np.uint64(0xD6E8FEB86659FD93)


def mixed(x: np.ndarray, by: np.uint64) -> np.ndarray:
    """Scramble 64-bit numbers."""
    x = (x ^ (x >> np.uint64(32))) * by
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def digests(text: str) -> np.ndarray:
    """Distinct 64-bit digests of the paragraphs of a text."""
    hashes, ends = [], []
    hash_of = xxhash.xxh3_64_intdigest
    for line in text.encode("utf-8", "surrogatepass").split(b"\n"):
        found = line.split()
        hashes.extend(map(hash_of, found))
        ends.append(len(hashes))
    count = len(hashes)
    if not count:
        return np.zeros(0, np.uint64)
    h = np.array(hashes, np.uint64)
    last = (h >> np.uint64(20)) % CUT == 0
    stops = np.array(ends, np.int64)
    last[stops[stops > 0] - 1] = True
    starts = np.flatnonzero(np.append(True, last[:-1]))
    place = np.arange(count) - np.repeat(starts, np.diff(np.append(starts, count)))
    pieces = mixed(np.add.reduceat(mixed(h + place.astype(np.uint64) * MIXERS[1], MIXERS[0]), starts), MIXERS[2])
    # The n-th of equal paragraphs has a digest of its own.
    order = np.argsort(pieces, kind="stable")
    ranked = pieces[order]
    fresh = np.append(True, ranked[1:] != ranked[:-1])
    first = np.flatnonzero(fresh)
    nth = np.arange(len(ranked)) - np.repeat(first, np.diff(np.append(first, len(ranked))))
    return np.unique(mixed(ranked + nth.astype(np.uint64) * MIXERS[0], MIXERS[1]))


def places(keys: np.ndarray, cells: int) -> np.ndarray:
    """The cell of each digest in each row, as columns."""
    width = np.uint64(cells // ROWS)
    return np.stack([(mixed(keys, m) % width).astype(np.int64) + r * int(width) for r, m in enumerate(MIXERS)], axis=1)


class Sketches:
    """Sketches of many versions, side by side."""

    def __init__(self, count: int, cells: int):
        self.cells = cells
        self.count = np.zeros(count * cells, np.int64)
        self.keys = np.zeros(count * cells, np.uint64)
        self.sums = np.zeros(count * cells, np.uint64)

    def put(self, owner: np.ndarray, keys: np.ndarray, sign: np.ndarray | int) -> None:
        """Add (sign 1) or take (-1) digests."""
        at = (owner[:, None] * self.cells + places(keys, self.cells)).ravel()
        np.add.at(self.count, at, np.repeat(np.broadcast_to(sign, len(keys)), ROWS))
        np.bitwise_xor.at(self.keys, at, np.repeat(keys, ROWS))
        np.bitwise_xor.at(self.sums, at, np.repeat(mixed(keys, CHECK), ROWS))

    def minus(self, other: Sketches) -> Sketches:
        result = Sketches(0, self.cells)
        result.count = self.count - other.count
        result.keys = self.keys ^ other.keys
        result.sums = self.sums ^ other.sums
        return result

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Owner, digest and sign of all that can be recovered, and whether each sketch came out empty."""
        owners, keys, signs = [], [], []
        while True:
            at = np.flatnonzero(np.abs(self.count) == 1)
            at = at[self.sums[at] == mixed(self.keys[at], CHECK)]
            if not len(at):
                break
            # A digest may stand alone in several cells of its sketch; it is peeled once.
            _, first = np.unique(mixed(self.keys[at] + (at // self.cells).astype(np.uint64), CHECK), return_index=True)
            at = at[first]
            owner, key, sign = at // self.cells, self.keys[at], self.count[at]
            self.put(owner, key, -sign)
            owners.append(owner)
            keys.append(key)
            signs.append(sign)
        left = (self.count != 0) | (self.keys != 0) | (self.sums != 0)
        empty = ~left.reshape(-1, self.cells).any(axis=1)
        if not owners:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), empty
        return np.concatenate(owners), np.concatenate(keys), np.concatenate(signs), empty


def sketched(versions: list[np.ndarray], cells: int) -> Sketches:
    result = Sketches(len(versions), cells)
    if versions:
        owner = np.repeat(np.arange(len(versions)), [len(v) for v in versions])
        result.put(owner, np.concatenate(versions), 1)
    return result


def differences(ours: list[np.ndarray], theirs: list[np.ndarray], cells: int = CELLS) -> list[tuple[np.ndarray, ...]]:
    """For each pair of versions the digests that only ours and only theirs holds, recovered by peeling.

    Pairs that don't come out empty are sketched again with twice the cells; three times the digests always end it
    but for chance, and doubling goes on.
    """
    result: list[tuple[np.ndarray, ...]] = [(np.zeros(0, np.uint64),) * 2] * len(ours)
    todo = np.arange(len(ours))
    while len(todo):
        left = sketched([ours[i] for i in todo], cells)
        owner, keys, signs, done = left.minus(sketched([theirs[i] for i in todo], cells)).peel()
        order = np.argsort(owner, kind="stable")
        owner, keys, signs = owner[order], keys[order], signs[order]
        cuts = np.searchsorted(owner, np.arange(len(todo) + 1))
        for k, i in enumerate(todo):
            if done[k]:
                key, sign = keys[cuts[k] : cuts[k + 1]], signs[cuts[k] : cuts[k + 1]]
                result[i] = (key[sign > 0], key[sign < 0])
        todo = todo[~done]
        cells *= 2
    return result


def likeness(ours: list[np.ndarray], theirs: list[np.ndarray]) -> np.ndarray:
    """Share of common digests of each pair, from the recovered differences."""
    lost = differences(ours, theirs)
    only = np.array([len(a) for a, _ in lost], float)
    gained = np.array([len(b) for _, b in lost], float)
    common = np.array([len(a) for a in ours], float) - only
    every = common + only + gained
    return np.where(every > 0, common / np.maximum(every, 1), 1.0)


def fingerprint(versions: list[np.ndarray], cells: int = CELLS) -> list[str]:
    """The sketch of each version as text: counts, digests and check sums of its cells."""
    sketch = sketched(versions, cells)
    parts = [x.reshape(-1, cells) for x in (sketch.count.astype("<i4"), sketch.keys, sketch.sums.astype("<u4"))]
    return [base64.b64encode(b"".join(p[i].tobytes() for p in parts)).decode() for i in range(len(versions))]


def in_order(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """Documents (doc_id, text) by descending doc_id, split into ranges that end with the document after them.

    Adds ``__range``, ``__rank`` (position of doc_id) and ``__after`` (true for the extra last row of a range, which
    belongs to the next one). Bounds come from approximate quantiles of the ids; a few numbers reach the driver.
    """
    spark = docs.sparkSession
    ranges = ranges or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole(F.col("text")).alias("text"))
    shares = [(i + 1) / ranges for i in range(ranges - 1)]
    ids = rows.select("doc_id").where("doc_id is not null")
    bounds = sorted(set(ids.agg(F.percentile_approx("doc_id", shares, 10 * ranges)).first()[0] or []))

    @F.pandas_udf("int")
    def range_of(doc_ids: pd.Series) -> pd.Series:
        # 0 is the range of the largest ids; ids that are null come after all others.
        place = [len(bounds) + 1 if pd.isna(d) else len(bounds) - bisect.bisect_left(bounds, d) for d in doc_ids]
        return pd.Series(place, index=doc_ids.index, dtype="int32")

    rows = rows.withColumn("__range", range_of("doc_id"))
    # The first row of each range, by (doc_id, hash of the text): one row per range, at most len(bounds) + 2 of them.
    key = F.struct(F.coalesce(-F.col("doc_id"), F.lit(2**63 - 1)).alias("o"), F.xxhash64("text").alias("h"))
    first = {row["__range"]: row["first"] for row in rows.groupBy("__range").agg(F.min(key).alias("first")).collect()}
    present = sorted(first)
    # The first range follows the last one.
    sent = [(place, *first[place], present[i - 1]) for i, place in enumerate(present)]
    sent = spark.createDataFrame(sent, "__of int, __o long, __h long, __before int")
    keyed = rows.withColumn("__key", key)
    here = (F.col("__range") == F.col("__of")) & (F.col("__key.o") == F.col("__o")) & (F.col("__key.h") == F.col("__h"))
    copies = F.array(
        F.struct(F.col("__range").alias("r"), F.lit(False).alias("a")),
        F.struct(F.col("__before").alias("r"), F.lit(True).alias("a")),
    )
    copies = F.filter(copies, lambda c: c["r"].isNotNull())
    return (
        keyed.join(F.broadcast(sent), here, "left")  # as many rows as there are ranges
        .withColumn("__to", F.explode(copies))
        .select("doc_id", "text", "__key", F.col("__to.r").alias("__range"), F.col("__to.a").alias("__after"))
    )


def edited(text: str, following: str) -> str:
    """The text with its last third replaced by the start of the following one."""
    size = len(text) // 3
    return text[: len(text) - size] + following[:size]


def compare(docs: DataFrame) -> DataFrame:
    """Every document with its edited version and the next document, by descending doc_id.

    Columns: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_digests,
    n_lost and n_gained (digests that the edit removed and added).
    """
    schema = (
        "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double, n_digests long, n_lost long, n_gained long"
    )
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = in_order(docs).repartition(parts, "__range").sortWithinPartitions("__range", "__after", "__key", "text")

    def work(ids: list, texts: list[str], nexts: list[str]) -> pd.DataFrame:
        edits = [edited(a, b) for a, b in zip(texts, nexts)]
        mine, changed = [digests(t) for t in texts], [digests(t) for t in edits]
        # Each next text but the last is also the text of the row after it.
        known = [*texts[1:], None]
        other = [mine[k + 1] if nexts[k] is known[k] else digests(nexts[k]) for k in range(len(texts))]
        lost = differences(mine, changed)
        only, gained = [len(a) for a, _ in lost], [len(b) for _, b in lost]
        every = [len(a) + g for a, g in zip(mine, gained)]
        return pd.DataFrame(
            {
                "doc_id": pd.array(ids, dtype="Int64"),
                "n_chars": [len(t) for t in texts],
                "edited_sha256": [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in edits],
                "fingerprint": fingerprint(mine),
                "edited_fingerprint": fingerprint(changed),
                "near_edited": [(len(a) - o) / e if e else 1.0 for a, o, e in zip(mine, only, every)],
                "near_next": likeness(mine, other),
                "n_digests": [len(a) for a in mine],
                "n_lost": only,
                "n_gained": gained,
            }
        )

    def pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: tuple | None = None  # the last row seen, whose next one is still to come
        for batch in batches:
            ids, texts, nexts = [], [], []
            for doc_id, text, place, after in zip(batch["doc_id"], batch["text"], batch["__range"], batch["__after"]):
                if held is not None and held[2] == place:
                    ids.append(held[0])
                    texts.append(held[1])
                    nexts.append(text)
                held = None if after else (None if pd.isna(doc_id) else int(doc_id), text, place)
            for start in range(0, len(ids), 250):
                part = slice(start, start + 250)
                yield work(ids[part], texts[part], nexts[part])

    return rows.select("doc_id", "text", "__range", "__after").mapInPandas(pairs, schema)


def recovered(ours: Column, theirs: Column) -> Column:
    """For two texts the digests that only the first and only the second holds (hexadecimal, sorted)."""

    @F.pandas_udf("lost array<string>, gained array<string>")
    def peeled(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        found = differences([digests(t or "") for t in a], [digests(t or "") for t in b])
        named = [[[f"{int(k):016x}" for k in np.sort(side)] for side in pair] for pair in found]
        return pd.DataFrame(named, columns=["lost", "gained"])

    return peeled(ours, theirs)
