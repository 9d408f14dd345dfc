"""Conflict-constrained best-fit packing.

Texts are packed into bins of ``capacity`` words, the longest first, each into the fullest bin that still has room and
holds neither a text of the same source nor a copy of the same duplicate cluster. Bins are kept by their residual; a
bin carries a bitmap of its sources and one of its clusters, and the search goes on to the next larger residual until a
bin fits on all counts, or opens a new one. A text longer than a bin is cut into pieces of full length and a rest;
pieces of one text conflict, as they share their source and cluster.

Rows are dealt by hash into shards of about ``per_shard`` pieces, each packed on its own: the work and memory of a task
are those of a shard at any size of the input, and bins are local to it. Only ids, sources, clusters and lengths are
shuffled, never texts. A large source is spread over all shards. Rows that are equal in all of these are counted first
and then dealt out by their copy number, so that a row repeated without end is no hot shard.

Edge cases: a null text is an empty one and takes no room, but is packed. Null sources and clusters conflict with
nothing. Ties go by doc_id, copy and piece. Repeated rows are copies 0, 1, ... of their document.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarifflens.llm.common import stored, whole

CAPACITY = 2048
PER_SHARD = 4000
WORD = r"[^\x20\x09-\x0D]+"


class Bins:
    """Open bins by residual, with bitmaps of what they hold."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.at: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.present = 0  # bit r is set where a bin has the residual r
        self.sources: list[int] = []
        self.clusters: list[int] = []

    def find(self, length: int, source: int, cluster: int) -> tuple[int, int]:
        """Residual and number of the tightest compatible bin, the oldest of equals; or (-1, -1)."""
        ahead = self.present >> length
        residual = length
        while ahead:
            step = (ahead & -ahead).bit_length() - 1
            residual += step
            for number in self.at[residual]:
                if not (self.sources[number] & source or self.clusters[number] & cluster):
                    return residual, number
            ahead >>= step + 1
            residual += 1
        return -1, -1

    def put(self, length: int, source: int, cluster: int) -> tuple[int, int]:
        """Place one piece; the number of its bin and its offset there."""
        residual, number = self.find(length, source, cluster)
        if number < 0:
            residual, number = self.capacity, len(self.sources)
            self.sources.append(0)
            self.clusters.append(0)
        elif length:
            self.at[residual].remove(number)
            if not self.at[residual]:
                self.present &= ~(1 << residual)
        self.sources[number] |= source
        self.clusters[number] |= cluster
        if length or residual == self.capacity and number not in self.at[residual]:
            left = residual - length
            place = self.at[left]
            bisect.insort(place, number)
            self.present |= 1 << left
        return number, self.capacity - residual


def pack_shard(pieces: Iterable[tuple], capacity: int) -> list[tuple[int, int]]:
    """(bin, offset) of pieces (length, source, cluster), which come in the order of packing."""
    bins, bits = Bins(capacity), ({}, {})

    def bit(kind: int, value) -> int:
        return 0 if value is None else 1 << bits[kind].setdefault(value, len(bits[kind]))

    return [bins.put(length, bit(0, source), bit(1, cluster)) for length, source, cluster in pieces]


def measured(docs: DataFrame, cluster: str | None = None) -> DataFrame:
    """doc_id, source, cluster and length in words. Without a cluster column, equal texts are a cluster."""
    text = whole(F.col("text"))
    key = F.col(cluster).cast("long") if cluster else F.xxhash64(text)
    length = F.regexp_count(text, F.lit(WORD)).cast("long")
    return docs.select("doc_id", "source", key.alias("cluster"), length.alias("length"))


def pack(
    docs: DataFrame, capacity: int = CAPACITY, per_shard: int = PER_SHARD, cluster: str | None = None
) -> DataFrame:
    """One row per piece: doc_id, copy, piece, start, length, bin_id and bin_offset.

    ``start`` is the first word of the piece in its text, ``bin_offset`` its first word in the bin.
    """
    counted = measured(docs, cluster).groupBy("doc_id", "source", "cluster", "length").count()
    count = F.greatest(F.ceil(F.col("length") / capacity), F.lit(1)).cast("long")
    pieces = (
        counted.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("count") - 1)))
        .withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), count - 1)))
        .withColumn("start", F.col("piece") * capacity)
        .withColumn("length", F.least(F.lit(capacity), F.col("length") - F.col("start")).cast("long"))
        .drop("count")
    )
    pieces = stored(pieces)
    shards = max(1, -(-pieces.count() // per_shard))
    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64("doc_id", "cluster", "copy", "piece"), F.lit(shards)))
    schema = "doc_id long, copy long, piece long, start long, length long, bin_id long, bin_offset long"

    def one(shard: pd.DataFrame) -> pd.DataFrame:
        shard = shard.sort_values(
            ["length", "doc_id", "copy", "piece"], ascending=[False, True, True, True], kind="stable"
        )
        keys = [
            (int(a), None if pd.isna(s) else s, None if pd.isna(c) else int(c))
            for a, s, c in zip(shard["length"], shard["source"], shard["cluster"])
        ]
        placed = pack_shard(keys, capacity)
        result = shard[["doc_id", "copy", "piece", "start", "length"]].copy()
        result["doc_id"] = pd.array([None if pd.isna(d) else int(d) for d in shard["doc_id"]], dtype="Int64")
        first = int(shard["shard"].iloc[0]) << 24
        result["bin_id"] = [first + number for number, _ in placed]
        result["bin_offset"] = [offset for _, offset in placed]
        return result

    return dealt.groupBy("shard").applyInPandas(one, schema)
