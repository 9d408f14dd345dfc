"""Quality classifier by compression.

Two zstandard dictionaries, one built from good and one from bad labelled text, compress every window of a text.
Good text gets smaller with the good dictionary, junk with the bad one. The normalised difference of the sizes, with
the sizes themselves for texts that compress to nothing, becomes a calibrated score.

What is bounded: the dictionaries see at most ``windows_per_class`` windows and the calibration at most
``docs_per_class`` documents of each label, both the ones with the smallest hashed ids. Scoring is one scan with no
shuffle; the model (two dictionaries and a few numbers) goes along with the tasks.

Edge cases: a null text is an empty one; an empty text says nothing and scores the share of good documents among the
calibration rows. Rows are scored alone, so repeated rows score alike. Without labels of both kinds every score is
that share (0.5 when there is no label at all). A column of the same name as the score column is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarifflens.llm.common import fold, whole

WINDOW = 512
LEVEL = 1
FEATURES = 8


@dataclass(frozen=True)
class CompressionModel:
    good: bytes = b""
    bad: bytes = b""
    prior: float = 0.5
    mean: np.ndarray = field(default_factory=lambda: np.zeros(FEATURES))
    scale: np.ndarray = field(default_factory=lambda: np.ones(FEATURES))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(FEATURES + 1))


def windows(data: bytes, size: int = WINDOW) -> list[bytes]:
    """All of the text in windows of nearly equal length, none longer than ``size``."""
    count = -(-len(data) // size)
    cuts = [len(data) * i // count for i in range(count + 1)] if count else []
    return [data[a:b] for a, b in zip(cuts, cuts[1:])]


def compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    """A compressor without frame headers, so that sizes hold nothing but content."""
    settings = zstandard.ZstdCompressionParameters.from_level(
        LEVEL,
        format=zstandard.FORMAT_ZSTD1_MAGICLESS,
        write_content_size=False,
        write_checksum=False,
        write_dict_id=False,
    )
    if not dictionary:
        return zstandard.ZstdCompressor(compression_params=settings)
    known = zstandard.ZstdCompressionDict(dictionary)
    known.precompute_compress(compression_params=settings)
    return zstandard.ZstdCompressor(dict_data=known, compression_params=settings)


def measure(text: str | None, good: zstandard.ZstdCompressor, bad: zstandard.ZstdCompressor) -> list[float]:
    """Compressed sizes of one text as features, all per byte so that length alone decides nothing."""
    parts = windows((text or "").encode("utf-8", "surrogatepass"))
    if not parts:
        return [0.0] * FEATURES
    length = np.array([len(p) for p in parts], dtype=np.float64)
    with_good = np.array([len(good.compress(p)) for p in parts], dtype=np.float64)
    with_bad = np.array([len(bad.compress(p)) for p in parts], dtype=np.float64)
    total = length.sum()
    difference = (with_bad - with_good) / length
    ratio = np.minimum(with_good, with_bad) / length
    return [
        (with_bad.sum() - with_good.sum()) / total,
        float(difference.min()),
        float(difference.max()),
        float((length * (difference < 0)).sum() / total),
        with_good.sum() / total,
        float(ratio.min()),
        float(np.log(ratio.min() + 0.01)),
        float(1.0 / np.sqrt(total)),
    ]


def train_dictionary(samples: list[bytes], size: int) -> bytes:
    """A dictionary of at most ``size`` bytes; samples too few to train on become the dictionary themselves."""
    if sum(map(len, samples)) >= 10 * size // 8 and len(samples) >= 32:
        try:
            return zstandard.train_dictionary(size, samples, k=256, d=8).as_bytes()
        except zstandard.ZstdError:
            pass
    return b"\n".join(samples)[-size:]


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 40) -> np.ndarray:
    """Weights and, last, the bias of a ridge logistic regression, by Newton's method."""
    x = np.hstack([x, np.ones((len(x), 1))])
    weights = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        gradient = x.T @ (p - y) + penalty * weights
        curve = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(curve, gradient)
        weights -= step
        if np.abs(step).max() < 1e-8:
            break
    return weights


def labelled(docs: DataFrame, labels: DataFrame, label: str, per_class: int) -> DataFrame:
    """At most ``per_class`` documents of each label (text, label), none of them held out.

    The ids are chosen first, in the narrow label table; only their texts are read then. The chosen ids are at most
    2 x ``per_class`` rows, so they may be broadcast.
    """
    ours = (
        labels.where((fold(F.col("doc_id")) != 1) & F.col(label).isin(0, 1))
        .groupBy("doc_id")
        .agg(F.max(label).cast("int").alias("__label"))
        .join(docs.select("doc_id").where("doc_id is not null").distinct(), "doc_id", "left_semi")
    )
    chosen = None
    for value in (0, 1):
        some = ours.where(F.col("__label") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        chosen = some if chosen is None else chosen.unionByName(some)
    return docs.select("doc_id", whole(F.col("text")).alias("__text")).join(F.broadcast(chosen), "doc_id")


def fit(
    docs: DataFrame,
    labels: DataFrame,
    docs_per_class: int = 3000,
    windows_per_class: int = 2500,
    dictionary_bytes: int = 65536,
) -> CompressionModel:
    """Learn from labelled rows whose fold is not 1. Rows of even hash build dictionaries, the others calibrate."""
    sample = labelled(docs, labels, "quality", docs_per_class).select(
        "doc_id", "__text", "__label", (F.xxhash64(F.lit("half"), "doc_id") % 2 == 0).alias("__builds")
    )

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [
                (label, part)
                for text, label in zip(batch["__text"], batch["__label"])
                for part in windows(text.encode("utf-8", "surrogatepass"))
            ]
            yield pd.DataFrame(rows, columns=["label", "part"])

    parts = sample.where("__builds").select("__text", "__label").mapInPandas(cut, "label int, part binary")
    texts: dict[int, list[bytes]] = {}
    for value in (0, 1):
        some = parts.where(F.col("label") == value).orderBy(F.xxhash64("part"), "part").limit(windows_per_class)
        texts[value] = [bytes(row["part"]) for row in some.collect()]
    good, bad = train_dictionary(texts[1], dictionary_bytes), train_dictionary(texts[0], dictionary_bytes)
    model = CompressionModel(good, bad)
    seen = (
        sample.where("not __builds")
        .select("__label", features_column(model)("__text").alias("x"))
        .where(F.length("__text") > 0)
        .collect()
    )
    y = np.array([row["__label"] for row in seen], dtype=np.float64)
    if not len(y) or y.min() == y.max():
        return CompressionModel(good, bad, float(y.mean()) if len(y) else 0.5)
    x = np.array([row["x"] for row in seen], dtype=np.float64)
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    # The classes were drawn in equal numbers; the labels' own share is restored in the bias.
    share = labels.where((fold(F.col("doc_id")) != 1) & F.col("quality").isin(0, 1)).agg(F.avg("quality")).first()[0]
    weights = logistic((x - mean) / scale, y)
    drawn = np.log(y.mean() / (1 - y.mean()))
    share = min(max(float(share), 1e-3), 1 - 1e-3)
    weights[-1] += np.log(share / (1 - share)) - drawn
    return CompressionModel(good, bad, share, mean, scale, weights)


def features_column(model: CompressionModel):
    """A Pandas UDF of the features of a text."""

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def features(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        good, bad = compressor(model.good), compressor(model.bad)
        for texts in batches:
            yield pd.Series([measure(t, good, bad) for t in texts], index=texts.index)

    return features


def score(text: Column, model: CompressionModel) -> Column:
    """Probability that the text is good, from 0 to 1."""

    @F.pandas_udf(T.DoubleType())
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        good, bad = compressor(model.good), compressor(model.bad)
        for texts in batches:
            x = np.array([measure(t, good, bad) for t in texts], dtype=np.float64).reshape(-1, FEATURES)
            value = ((x - model.mean) / model.scale) @ model.weights[:-1] + model.weights[-1]
            p = 1 / (1 + np.exp(-np.clip(value, -30, 30)))
            p[[not t for t in texts]] = model.prior
            if not model.weights.any():
                p[:] = model.prior
            yield pd.Series(p, index=texts.index)

    return scored(text)


def with_quality(docs: DataFrame, model: CompressionModel, name: str = "quality_score") -> DataFrame:
    """All columns of the documents and the score."""
    return docs.withColumn(name, score(F.col("text"), model))


def keep_good(docs: DataFrame, model: CompressionModel, threshold: float = 0.5) -> DataFrame:
    """The documents that are not rejected, with their own columns only."""
    return docs.where(score(F.col("text"), model) >= threshold)
