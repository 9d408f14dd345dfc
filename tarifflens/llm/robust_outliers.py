"""Quality rules with robust multivariate outliers.

Each text becomes a vector of transformed statistics. For every language and source the minimum-covariance-determinant
(MCD) estimate gives the centre and the covariance of the tightest three quarters of the rows; a text whose squared
Mahalanobis distance is beyond the chi-square limit is rejected. A few plain rules reject texts before that, and their
rows take no part in the estimates.

The estimate is Spark aggregation throughout. A concentration step joins the current centre and precision of each
group to its rows, finds the distance that three quarters of them keep within from a histogram of (group, distance
bucket), and sums the moments of those rows. Both are map-side combined, so a source that holds a third of all rows is
one partial sum per task. Two starts run side by side (median with absolute deviations, and plain moments); the one of
the smaller determinant wins, is made consistent, and is weighted once more.

Groups of fewer than ``SMALLEST`` rows that pass the plain rules pool with the other small ones of their language. If
that is still too small, they pool with the next larger group of the language as well, or if it has none, with all such
rest. A pool that stays too small rejects nothing.

Edge cases: null texts have no words and fail the base rules. Null languages and sources are groups of their own.
Equal texts in one group get equal verdicts. Rows are judged one by one, so repeated ids and nulls do no harm.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarifflens.llm.common import BLANKS, stored, words

SYMBOLS = "#*$%&|<>"
UPPER = bytes(range(ord("A"), ord("Z") + 1))
SHARE = 0.75
SMALLEST = 60
STEPS = 6
# Spread that every statistic is granted at least: statistics that are zero in nearly all texts have none of their own.
FLOORS = (0.3, 0.3, 0.5, 0.8, 0.8, 0.4)
SIZE = len(FLOORS)
PAIRS = [(i, j) for i in range(SIZE) for j in range(i, SIZE)]
STATISTICS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_upper long"


def repeated(found: list[bytes], span: int = 3) -> int:
    """Words that lie in a window of ``span`` words which the text holds twice or more."""
    count = len(found)
    if count <= span:
        return 0
    ids: dict[bytes, int] = {}
    codes = np.fromiter((ids.setdefault(w, len(ids)) for w in found), np.int64, count)
    windows = codes[: count - span + 1]
    for k in range(1, span):  # windows are renumbered after each word, so the numbers stay below count * count
        windows = np.unique(windows * len(ids) + codes[k : count - span + 1 + k], return_inverse=True)[1]
    twice = np.bincount(windows)[windows] > 1
    covered = np.zeros(count, bool)
    for k in range(span):
        covered[k : count - span + 1 + k] |= twice
    return int(covered.sum())


def measure(text: str | None) -> tuple[int, ...]:
    """The statistics of one text."""
    text = text or ""
    found = words(text)
    seen: set[str] = set()
    duplicates = 0
    for line in text.split("\n"):
        if line.strip(BLANKS):
            duplicates += line in seen
            seen.add(line)
    data = text.encode("utf-8", "surrogatepass")
    return (
        len(found),
        len(text) - sum(map(text.count, BLANKS)),
        sum(map(text.count, SYMBOLS)),
        duplicates,
        repeated(found),
        len(data) - len(data.translate(None, UPPER)),
    )


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the statistics of every text, with the verdict of the base rules."""

    @F.pandas_udf(STATISTICS)
    def measured(texts: pd.Series) -> pd.DataFrame:
        rows = [measure(t) for t in texts]
        return pd.DataFrame(rows, columns=[c.split()[0] for c in STATISTICS.split(", ")], dtype="int64")

    rows = docs.select("doc_id", "lang", "source", measured.asNondeterministic()(F.col("text")).alias("s"))
    return rows.select("doc_id", "lang", "source", "s.*").withColumn(
        "base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    )


def vector() -> Column:
    """The statistics, transformed so that they spread about evenly."""
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    chars = F.greatest(F.col("word_chars"), F.lit(1)).cast("double")

    def share(column: str, of: Column) -> Column:
        return F.log1p(100 * F.col(column) / of)

    return F.array(
        F.log1p(n),
        F.col("word_chars") / n,
        share("n_symbols", n),
        share("n_dup_lines", n),
        share("n_repeat_words", n),
        share("n_upper", chars),
    )


def pools(rows: DataFrame) -> DataFrame:
    """Rows with the pool whose estimate judges them."""
    passed = F.count(F.when(~F.col("base_failed"), 1))  # the rows that estimates are made of
    groups = rows.groupBy("lang", "source").agg(passed.alias("count"))
    lang, of_lang = F.coalesce(F.col("lang"), F.lit("\0")), Window.partitionBy("lang")
    small = F.col("count") < SMALLEST
    groups = groups.withColumns(
        {
            "in_lang": F.sum(F.when(small, F.col("count")).otherwise(0)).over(of_lang),
            "any_small": F.max(small).over(of_lang),
            "next": F.min(F.when(~small, F.struct("count", "source"))).over(of_lang),
        }
    )
    # What a language has left over, if too small for a pool, shares the one of its next larger group.
    short = F.col("any_small") & (F.col("in_lang") < SMALLEST)
    shares = short & F.col("source").eqNullSafe(F.col("next.source"))
    groups = groups.select(
        F.col("lang").alias("__lang"),
        F.col("source").alias("__source"),
        F.when(~small & ~shares, F.concat_ws("\1", lang, F.coalesce("source", F.lit("\0"))))
        .when(~short | F.col("next").isNotNull(), lang)
        .otherwise(F.lit(""))
        .alias("pool"),
    )
    same = F.col("lang").eqNullSafe(F.col("__lang")) & F.col("source").eqNullSafe(F.col("__source"))
    return rows.join(stored(groups), same).drop("__lang", "__source")


def bound(values: DataFrame, value: Column, share: float, steps: int, *keys: str) -> DataFrame:
    """Per key the value that ``share`` of the rows keep within, from a histogram of 1/``steps`` wide buckets."""
    counts = values.groupBy(*keys, F.floor(value * steps).alias("bucket")).count()
    so_far = Window.partitionBy(*keys).orderBy("bucket")
    counts = counts.withColumn("below", F.sum("count").over(so_far)).withColumn(
        "rows", F.sum("count").over(Window.partitionBy(*keys))
    )
    return (
        counts.where(F.col("below") >= share * F.col("rows"))
        .groupBy(*keys)
        .agg(((F.min("bucket") + 1) / steps).alias("bound"))
    )


def distance() -> Column:
    """Squared Mahalanobis distance of ``x`` from ``center`` under the upper triangle ``precision``."""
    off = [F.col("x")[i] - F.col("center")[i] for i in range(SIZE)]
    terms = [(1 if i == j else 2) * F.col("precision")[k] * off[i] * off[j] for k, (i, j) in enumerate(PAIRS)]
    return sum(terms[1:], terms[0])


def moments(rows: DataFrame, *keys: str) -> DataFrame:
    """Count, means and covariance sums of the rows of each key."""
    x = F.col("x")
    sums = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.array(*(F.sum(x[i]) for i in range(SIZE))).alias("first"),
        F.array(*(F.sum(x[i] * x[j]) for i, j in PAIRS)).alias("second"),
    )

    @F.pandas_udf("center array<double>, precision array<double>, spread double")
    def solved(n: pd.Series, first: pd.Series, second: pd.Series) -> pd.DataFrame:
        result = []
        for count, one, two in zip(n, first, second):
            center = np.asarray(one) / count
            cov = np.zeros((SIZE, SIZE))
            for (i, j), value in zip(PAIRS, two):
                cov[i, j] = cov[j, i] = value / count - center[i] * center[j]
            cov += np.diag(np.square(FLOORS))
            inverse = np.linalg.inv(cov)
            result.append((center, [inverse[i, j] for i, j in PAIRS], np.linalg.slogdet(cov)[1]))
        return pd.DataFrame(result, columns=["center", "precision", "spread"])

    return sums.select(*keys, "n", solved("n", "first", "second").alias("s")).select(*keys, "n", "s.*")


def median_start(rows: DataFrame) -> DataFrame:
    """Centre and precision per pool from coordinate medians and absolute deviations."""
    each = rows.select("pool", F.posexplode("x").alias("axis", "value"))
    middle = stored(bound(each, F.col("value"), 0.5, 100, "pool", "axis").withColumnRenamed("bound", "middle"))
    away = F.abs(F.col("value") - F.col("middle"))
    spread = bound(each.join(middle, ["pool", "axis"]), away, 0.5, 100, "pool", "axis")
    floors = F.array(*map(F.lit, FLOORS))
    per_axis = middle.join(spread, ["pool", "axis"]).withColumn(
        "scale", F.pow(1.4826 * F.col("bound"), 2) + F.pow(floors[F.col("axis")], 2)
    )
    lists = per_axis.groupBy("pool").agg(F.array_sort(F.collect_list(F.struct("axis", "middle", "scale"))).alias("l"))
    precision = [1 / F.col("l")[i]["scale"] if i == j else F.lit(0.0) for i, j in PAIRS]
    return lists.select("pool", F.col("l.middle").alias("center"), F.array(*precision).alias("precision"))


def chi_square(tail: float, size: int = SIZE) -> float:
    """The value that a chi-square variable of ``size`` (even) degrees exceeds with probability ``tail``."""
    low, high = 0.0, 1000.0
    for _ in range(100):
        x = (low + high) / 2
        beyond = math.exp(-x / 2) * sum((x / 2) ** k / math.factorial(k) for k in range(size // 2))
        low, high = (x, high) if beyond > tail else (low, x)
    return high


def estimates(rows: DataFrame) -> DataFrame:
    """pool, center, precision: the reweighted MCD estimate of rows (pool, x)."""
    logged = F.log(distance() + 1e-9)
    kinds = F.explode(F.array(F.lit(0), F.lit(1))).alias("start")
    both = rows.select("pool", "x", kinds)
    plain = moments(rows, "pool").select("pool", F.lit(1).alias("start"), "center", "precision")
    now = stored(plain.unionByName(median_start(rows).withColumn("start", F.lit(0))))
    for _ in range(STEPS):
        placed = both.join(now, ["pool", "start"]).select("pool", "start", "x", logged.alias("d"))
        limits = stored(bound(placed, F.col("d"), SHARE, 64, "pool", "start"))
        inside = placed.join(limits, ["pool", "start"]).where(F.col("d") < F.col("bound"))
        now = stored(moments(inside, "pool", "start"))
    tightest = Window.partitionBy("pool").orderBy("spread", "start")
    best = now.withColumn("place", F.row_number().over(tightest)).where("place = 1")
    return consistent(rows, stored(reweighted(rows, consistent(rows, best))))


def consistent(rows: DataFrame, now: DataFrame) -> DataFrame:
    """Scale the precision so that the median distance is that of normal rows."""
    placed = rows.join(now, "pool").select("pool", F.log(distance() + 1e-9).alias("d"))
    middle = bound(placed, F.col("d"), 0.5, 64, "pool")
    factor = F.lit(chi_square(0.5)) / F.exp("bound")
    # Never more severe than the estimate itself: floors make distances small where statistics hardly vary.
    factor = F.least(factor, F.lit(1.0))
    scaled = F.transform("precision", lambda p: p * factor)
    return stored(now.join(middle, "pool").select("pool", "center", scaled.alias("precision")))


def reweighted(rows: DataFrame, now: DataFrame) -> DataFrame:
    """Moments of the rows that the estimate finds normal (all but one in forty)."""
    placed = rows.join(now, "pool").where(distance() <= chi_square(0.025)).select("pool", "x")
    return moments(placed, "pool")


def judge(rows: DataFrame, tail: float = 1e-7) -> DataFrame:
    """Statistics rows with ``distance`` (null where nothing was estimated) and ``kept``.

    ``tail`` is the share of normal texts that the limit would reject.
    """
    pooled = pools(rows).withColumn("x", vector())
    normal = stored(pooled.where(~F.col("base_failed")).select("pool", "x"))
    enough = normal.groupBy("pool").count().where(F.col("count") >= SMALLEST).select("pool")
    known = estimates(normal.join(stored(enough), "pool", "left_semi"))
    judged = pooled.join(known, "pool", "left").withColumn("distance", distance())
    fine = F.coalesce(F.col("distance") <= chi_square(tail), F.lit(True))
    return judged.withColumn("kept", ~F.col("base_failed") & fine).drop("pool", "x", "center", "precision")


def judged_documents(docs: DataFrame, tail: float = 1e-7) -> DataFrame:
    """doc_id, statistics and verdict of every document. The texts are read once; the statistics are stored."""
    return judge(stored(statistics(docs)), tail)
