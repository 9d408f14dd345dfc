"""Toxicity by non-negative positive-unlabelled learning.

The learner sees confirmed toxic texts (positive) and texts of unknown kind (unlabelled), and no confirmed clean one.
With the class prior p of toxic texts it minimises

    p * E_pos[loss(+)] + max(0, E_unl[loss(-)] - p * E_pos[loss(-)])

the positive-unlabelled risk whose second part, the risk on clean texts, may not become negative. Features are the
distinct words of the whole text, the first letters of them, and how many words share those. They are screened first:
one distributed count over the sample finds those that are more frequent in positive than in unlabelled texts, and only
they reach the numpy classifier.

What is bounded: the sample has at most ``positives`` and ``unlabelled`` documents (smallest hashed ids) and the
classifier at most ``features_kept`` features. Scoring is one scan with no shuffle.

Edge cases: a null text is an empty one; a text without screened features has the score of the bias. Repeated rows
score alike. Without any confirmed toxic text every score is the prior, or 0 if none is known. A column of the same
name as the score column is replaced.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarifflens.llm.common import fold, whole

PREFIXES = (4, 5, 6)
# Words that share a start are told apart as one, two, and this many or more.
MOST = 3
EDGE = ".,;:!?\"'()[]{}<>*#$%&|-_/\\"
# A worker forgets its words once it knows so many.
MEMORY = 400_000


@dataclass(frozen=True)
class ToxicityModel:
    bias: float = -30.0
    weights: dict[str, float] = field(default_factory=dict)


def tokens(text: str | None) -> set[str]:
    """Distinct lower-cased words without punctuation at their ends."""
    return {w for w in (x.strip(EDGE) for x in set((text or "").lower().split())) if w}


def starts(word: str) -> list[str]:
    """The first letters of a word, in each of the lengths that are features."""
    return [word[:n] for n in PREFIXES if len(word) >= n]


def features(text: str | None) -> set[str]:
    """The features of a text: each word, each start of a word, and whether 2 or 3 and more words share that start."""
    found = tokens(text)
    families = Counter(start for word in found for start in starts(word))
    result = {"=" + word for word in found}
    for start, count in families.items():
        result.add(start)
        if count > 1:
            result.update(f"{n}*{start}" for n in range(2, min(count, MOST) + 1))
    return result


def train(
    positive: list[np.ndarray],
    unlabelled: list[np.ndarray],
    size: int,
    prior: float,
    least_gain: float,
    steps: int = 200,
) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the non-negative risk, by Adam on all rows.

    When the risk on clean texts falls below zero, the step goes up its gradient instead, as the method has it.
    ``least_gain`` is what a feature must lower the risk by, per unit of weight, to get a weight (an L1 penalty).
    """

    def rows(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        where = np.repeat(np.arange(len(docs)), [len(d) for d in docs]) if docs else np.zeros(0, int)
        return where, np.concatenate(docs).astype(int) if docs else np.zeros(0, int)

    at_p, is_p = rows(positive)
    at_u, is_u = rows(unlabelled)
    n_p, n_u = max(1, len(positive)), max(1, len(unlabelled))
    theta, first, second = np.zeros(size + 1), np.zeros(size + 1), np.zeros(size + 1)
    theta[-1] = np.log(prior / (1 - prior))

    def sigmoid(x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x, -30, 30)))

    def values(at: np.ndarray, which: np.ndarray, count: int) -> np.ndarray:
        return np.bincount(at, theta[which], count) + theta[-1]

    def slope(at: np.ndarray, which: np.ndarray, by: np.ndarray) -> np.ndarray:
        return np.append(np.bincount(which, by[at], size)[:size], by.sum())

    for step in range(1, steps + 1):
        f_p, f_u = values(at_p, is_p, len(positive)), values(at_u, is_u, len(unlabelled))
        clean = np.logaddexp(0, f_u).sum() / n_u - prior * np.logaddexp(0, f_p).sum() / n_p
        from_clean = slope(at_u, is_u, sigmoid(f_u) / n_u) - prior * slope(at_p, is_p, sigmoid(f_p) / n_p)
        from_toxic = prior * slope(at_p, is_p, (sigmoid(f_p) - 1) / n_p)
        gradient = from_toxic + from_clean if clean >= 0 else -from_clean
        gradient[:-1] += least_gain
        first = 0.9 * first + 0.1 * gradient
        second = 0.999 * second + 0.001 * gradient**2
        theta -= 0.1 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
        theta[:-1] = np.maximum(theta[:-1], 0)  # screened features only ever speak for toxicity
    return theta[:-1], float(theta[-1])


def fit(
    docs: DataFrame,
    labels: DataFrame,
    positives: int = 2500,
    unlabelled: int = 7500,
    features_kept: int = 4096,
    least: int = 5,
    lift: float = 3.0,
) -> ToxicityModel:
    """Learn from rows whose fold is not 1.

    ``least`` is the number of positive texts a feature needs, ``lift`` how much more frequent it must be there than
    in unlabelled text.
    """
    known = labels.where((fold(F.col("doc_id")) != 1) & F.col("toxic").isin(0, 1))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    share = known.agg(F.avg("toxic")).first()[0]
    if not share:
        return ToxicityModel()
    prior = min(max(float(share), 1e-3), 0.9)
    ids = docs.select("doc_id").where(F.col("doc_id").isNotNull() & (fold(F.col("doc_id")) != 1)).distinct()
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    toxic = known.where("toxic = 1").select("doc_id").join(ids, "doc_id", "left_semi")
    chosen = toxic.orderBy(*order).limit(positives).withColumn("__kind", F.lit(1))
    chosen = chosen.unionByName(ids.orderBy(*order).limit(unlabelled).withColumn("__kind", F.lit(0)))
    # At most positives + unlabelled ids, so the choice may be broadcast to the texts.
    sample = docs.select("doc_id", whole(F.col("text")).alias("__text")).join(F.broadcast(chosen), "doc_id")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = {1: Counter(), 0: Counter()}
            for text, kind in zip(batch["__text"], batch["__kind"]):
                found[kind].update(features(text))
            for kind, counts in found.items():
                yield pd.DataFrame({"kind": kind, "feature": list(counts.keys()), "n": list(counts.values())})

    many = {row["__kind"]: row["count"] for row in sample.groupBy("__kind").count().collect()}
    n_p, n_u = many.get(1, 0), many.get(0, 0)
    if not n_p:
        return ToxicityModel(bias=float(np.log(prior / (1 - prior))))
    counts = (
        sample.select("__text", "__kind")
        .mapInPandas(count, "kind int, feature string, n long")
        .groupBy("feature")
        .agg(F.sum(F.col("kind") * F.col("n")).alias("in_p"), F.sum((1 - F.col("kind")) * F.col("n")).alias("in_u"))
        .where((F.col("in_p") >= least) & (F.col("in_p") / n_p > lift * (F.col("in_u") + 0.5) / max(1, n_u)))
    )
    best = counts.orderBy(F.desc("in_p"), "feature").limit(features_kept).select("feature").collect()
    place = {row["feature"]: i for i, row in enumerate(best)}
    if not place:
        return ToxicityModel(bias=float(np.log(prior / (1 - prior))))

    def pick(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [sorted(place[f] for f in features(t) if f in place) for t in batch["__text"]]
            yield pd.DataFrame({"kind": batch["__kind"], "found": found})

    rows = sample.select("__text", "__kind").mapInPandas(pick, "kind int, found array<int>").collect()
    p, u = ([np.array(r["found"], int) for r in rows if r["kind"] == kind] for kind in (1, 0))
    # First choose: a feature must explain about as much as a few positive texts, so that the chance words of one text
    # and its copies get no weight. Then weigh: the chosen features are trained again without that penalty.
    weights, bias = train(p, u, len(place), prior, least_gain=prior * (0.003 + 3 / len(p)))
    chosen = np.flatnonzero(weights > 1e-2)
    again = np.full(len(place), -1)
    again[chosen] = np.arange(len(chosen))
    p, u = ([again[d][again[d] >= 0] for d in docs_of] for docs_of in (p, u))
    weights, bias = train(p, u, len(chosen), prior, least_gain=prior * 1e-4, steps=800)
    return ToxicityModel(bias, {f: float(weights[again[i]]) for f, i in place.items() if again[i] >= 0})


def score(text: Column, model: ToxicityModel) -> Column:
    """Probability that the text is toxic, from 0 to 1."""

    @F.pandas_udf(T.DoubleType())
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        weights, seen = model.weights, {}

        # Starts of which some count has a weight.
        counted = {f.partition("*")[2] or f for f in weights if f[0] != "="}

        def of(text: str | None) -> float:
            # Each distinct word counts once in a text, as it did in training.
            hits = set()
            for raw in set((text or "").lower().split()):
                hit = seen.get(raw)
                if hit is None:
                    word = raw.strip(EDGE)
                    known = "=" + word in weights or any(start in counted for start in starts(word))
                    hit = seen[raw] = word if known else ""
                if hit:
                    hits.add(hit)
            found = {"=" + word for word in hits}
            for start, count in Counter(start for word in hits for start in starts(word)).items():
                found.add(start)
                found.update(f"{n}*{start}" for n in range(2, min(count, MOST) + 1))
            return sum(weights[f] for f in sorted(found) if f in weights)

        for texts in batches:
            value = np.array([of(t) for t in texts], dtype=np.float64) + model.bias
            if len(seen) > MEMORY:
                seen.clear()
            yield pd.Series(1 / (1 + np.exp(-np.clip(value, -30, 30))), index=texts.index)

    return scored(text)


def with_toxicity(docs: DataFrame, model: ToxicityModel, name: str = "toxicity_score") -> DataFrame:
    """All columns of the documents and the score."""
    return docs.withColumn(name, score(F.col("text"), model))


def drop_toxic(docs: DataFrame, model: ToxicityModel, threshold: float = 0.7) -> DataFrame:
    """The documents that are not rejected, with their own columns only."""
    return docs.where(score(F.col("text"), model) < threshold)
