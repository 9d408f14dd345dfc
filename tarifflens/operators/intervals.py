"""Smallest value among the spans that cover a point, without joining points to spans.

A span of whole numbers is cut into the few binary blocks that make it up (at most two per level), and the smallest value
of each block is kept. A point looks up the blocks that contain it, one per level. Both sides grow with the logarithm of
the range only, however many spans of a key lie over each other, and a busy key spreads over its blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Points lie from 1 to 2**LEVELS - 1; a span that never ends ends here.
LEVELS = 40
NEVER = 2**LEVELS


def _shifted(value: Column, bits: Column, right: bool = True) -> Column:
    return F.call_function("shiftright" if right else "shiftleft", value, bits)


def binary_blocks(low: Column, high: Column) -> Column:
    """The blocks (level, number) that make up low <= x < high: block n of level k holds n * 2**k up to the next one."""

    def at_level(level: Column) -> Column:
        size = _shifted(F.lit(1).cast("long"), level, right=False)
        first, end = _shifted(low + size - 1, level), _shifted(high, level)
        block = lambda wanted, number: F.when(wanted & (first < end), F.struct(level.alias("level"), number.alias("number")))
        return F.array(block(first % 2 == 1, first), block(end % 2 == 1, end - 1))

    every = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(LEVELS)), at_level))
    return F.filter(every, lambda b: b.isNotNull())


def with_least_cover(points: DataFrame, spans: DataFrame, keys: list[str], at: str, value: str, into: str) -> DataFrame:
    """Points with the smallest ``value`` of the spans (``low``, ``high``) of their key that cover ``at``, null if none does.

    ``keys`` and ``at`` together must name a point.
    """
    cut = spans.select(*keys, value, F.explode(binary_blocks(F.col("low"), F.col("high"))).alias("_block"))
    least = cut.groupBy(*keys, "_block").agg(F.min(value).alias("_least"))
    levels = F.sequence(F.lit(0), F.floor(F.log2(F.col(at).cast("double"))).cast("int"))
    inside = F.transform(levels, lambda k: F.struct(k.alias("level"), _shifted(F.col(at), k).alias("number")))
    asked = points.select(*keys, at, F.explode(inside).alias("_block")).join(least, [*keys, "_block"])
    found = asked.groupBy(*keys, at).agg(F.min("_least").alias(into))
    return points.join(found, [*keys, at], "left")
