"""Connected components of a graph that is stored as pairs, without collecting any of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarifflens.llm.common import few, stored


def components(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, label: the smallest node of its component, for every node that has a pair.

    Large-star and small-star steps alternate until nothing changes (a number of rounds that grows with the logarithm
    of the graph). In a large-star step each node hands its larger neighbours to the smallest node it knows, in a
    small-star step its smaller ones. A node with very many neighbours is one pre-aggregated minimum and one row
    against its pairs, which adaptive execution splits.
    """
    low, high = F.least(a, b).alias("low"), F.greatest(a, b).alias("high")
    pairs = stored(pairs.where(F.col(a) != F.col(b)).select(low, high).distinct())
    state, rows = None, 2 * pairs.count()
    while True:
        both = pairs.select(F.col("low").alias("of"), F.col("high").alias("with")).unionByName(
            pairs.select(F.col("high").alias("of"), F.col("low").alias("with"))
        )
        least = few(both.groupBy("of").agg(F.least(F.min("with"), F.min("of")).alias("least")), rows)
        handed = both.where(F.col("with") > F.col("of")).join(least, "of")
        handed = few(handed.select(F.col("least").alias("low"), F.col("with").alias("high")), rows)
        large = stored(few(handed.distinct(), rows))
        least = few(large.groupBy("high").agg(F.min("low").alias("least")), rows)
        # The row of the smallest neighbour is the pair of the node itself, the others are handed on.
        moved = large.join(least, "high").select(
            F.col("least").alias("low"),
            F.when(F.col("low") != F.col("least"), F.col("low")).otherwise(F.col("high")).alias("high"),
        )
        pairs = stored(few(few(moved, rows).distinct(), rows))
        total = pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("low", "high").cast("decimal(38,0)"))).first()
        if tuple(total) == state:
            break
        state, rows = tuple(total), 2 * total[0]
    pairs = few(pairs, rows)
    roots = pairs.select(F.col("low").alias("node")).distinct().select("node", F.col("node").alias("label"))
    return pairs.select(F.col("high").alias("node"), F.col("low").alias("label")).unionByName(few(roots, rows))
