"""Bloom filters of bounded size, built by Spark tasks and merged by segments."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BITS_PER_KEY = 16
# In 64-bit words: 64 kB at least, 128 MB at most.
LEAST_WORDS, MOST_WORDS = 2**13, 2**24
SEGMENT = 2**13


def words_for(keys: int) -> int:
    """Length of a filter of so many keys, within the bounds."""
    words = LEAST_WORDS
    while words < MOST_WORDS and words * 64 < keys * BITS_PER_KEY:
        words *= 2
    return words


def places(hashes: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """The 64-bit word of each hash and the four bits in it: top bits choose the word, low bits the mask."""
    index = (hashes >> np.uint64(40)) % np.uint64(words)
    mask = np.zeros(len(hashes), np.uint64)
    for shift in (0, 6, 12, 18):
        mask |= np.uint64(1) << ((hashes >> np.uint64(shift)) & np.uint64(63))
    return index.astype(np.int64), mask


def hits(hashes: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which hashes the filter seems to hold."""
    index, mask = places(hashes, len(known))
    return (known[index] & mask) == mask


def packed(words: np.ndarray) -> bytes:
    return zstandard.compress(words.tobytes(), 1) if words.any() else b""


def unpacked(data: bytes | None, words: int = SEGMENT) -> np.ndarray:
    if not data:
        return np.zeros(words, np.uint64)
    return np.frombuffer(zstandard.decompress(data), np.uint64).copy()


def gathered(parts: DataFrame, words: int) -> np.ndarray:
    """The filter from its merged segments (segment, filter). Its length bounds what reaches the driver."""
    result = np.zeros(words, np.uint64)
    for row in parts.collect():
        at = row["segment"] * SEGMENT
        result[at : at + SEGMENT] = unpacked(row["filter"])
    return result


def tasks_of(df: DataFrame, words: int) -> int:
    return max(1, min(words // SEGMENT, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))


def filter_of(hashes: DataFrame, count: int) -> np.ndarray:
    """The filter of ``count`` hashes (one long column)."""
    words = words_for(count)
    name = hashes.columns[0]

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = np.zeros(words, np.uint64)
        for batch in batches:
            index, mask = places(batch[name].to_numpy(np.int64).view(np.uint64), words)
            np.bitwise_or.at(own, index, mask)
        for segment in np.flatnonzero(own.reshape(-1, SEGMENT).any(axis=1)):
            part = own[segment * SEGMENT : (segment + 1) * SEGMENT]
            yield pd.DataFrame({"segment": [segment], "filter": [packed(part)]})

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        segments: dict[int, np.ndarray] = {}
        for batch in batches:
            for segment, part in zip(batch["segment"], batch["filter"]):
                part = unpacked(part)
                segments[segment] = segments[segment] | part if segment in segments else part
        for segment, part in segments.items():
            yield pd.DataFrame({"segment": [segment], "filter": [packed(part)]})

    schema = "segment int, filter binary"
    parts = hashes.mapInPandas(build, schema).repartition(tasks_of(hashes, words), "segment")
    return gathered(parts.mapInPandas(merge, schema), words)


def maybe_in(key: Column, known: np.ndarray, df: DataFrame) -> Column:
    """Whether xxhash64 of the key may be in the filter; a key that is null has a hash like any other."""
    shared = df.sparkSession.sparkContext.broadcast(packed(known))
    words = len(known)

    @F.pandas_udf(T.BooleanType())
    def asked(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        table = unpacked(shared.value, words)
        for batch in batches:
            yield pd.Series(hits(batch.to_numpy(np.int64).view(np.uint64), table), index=batch.index)

    return asked(F.xxhash64(key))
