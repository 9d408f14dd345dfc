"""Row order inside a key: newest rows, previous rows, change gates.

None of these sends all rows of a key to one task.  Newest-k relies on the group limit
that Spark applies before the shuffle; "previous" works per key *and* time slice and only
passes one row per slice between slices.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def newest(df: DataFrame, keys: list[str], order: list[Column], k: int = 1, rank: str | None = None) -> DataFrame:
    """The first ``k`` rows per key in the given order."""
    name = rank or "_rank"
    ranked = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    kept = ranked.where(F.col(name) <= k)
    return kept if rank else kept.drop(name)


def day_slice(ts: str) -> Column:
    """Default time slice: one calendar day."""
    return F.to_date(F.col(ts))


def with_previous(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    carry: list[str],
    slice_by: Column,
    prefix: str = "previous_",
) -> DataFrame:
    """Add the ``carry`` columns of the row just before, NULL for the first.

    ``slice_by`` must not decrease along ``order``.  A key with a third of all rows is
    spread over its slices; between slices only the last row of each one travels.
    """
    rows, last = _slices(df, keys, order, slice_by)
    local = Window.partitionBy("_key", "_slice").orderBy(*order)
    numbered = rows.withColumn("_n", F.row_number().over(local)).withColumn("_near", F.lag(F.struct(*carry)).over(local))
    across = Window.partitionBy("_key").orderBy("_slice")
    carried = last.select("_key", "_slice", F.lag("_row").over(across).alias("_far"))
    joined = numbered.join(carried, ["_key", "_slice"], "left")
    before = lambda c: F.when(F.col("_n") == 1, F.col("_far")[c]).otherwise(F.col("_near")[c])
    return joined.select(*[F.col(c) for c in df.columns], *[before(c).alias(prefix + c) for c in carry])


def _slices(df: DataFrame, keys: list[str], order: list[str], slice_by: Column, **running: Column) -> tuple[DataFrame, DataFrame]:
    """The rows with ``_key``, ``_slice`` and ``running`` columns, and the last row of each slice of a key as ``_row``.

    Both come from one exchange on key and slice: the last rows are taken from the same window and hold every column, and key and
    slice are structs, which are never null, so a join on them filters neither side. Spark then sees the same exchange
    twice and reads the input once.
    """
    local = Window.partitionBy("_key", "_slice").orderBy(*order)
    so_far = local.rowsBetween(Window.unboundedPreceding, 0)
    placed = df.withColumns({"_key": F.struct(*keys), "_slice": F.struct(slice_by.alias("at"))})
    rows = placed.withColumns({name: value.over(so_far) for name, value in running.items()})
    ends = rows.withColumn("_next", F.lead(F.lit(True)).over(local)).where("_next is null").drop("_next")
    return rows, ends.select("_key", "_slice", F.struct(*[F.col(c) for c in rows.columns]).alias("_row"))


def changed_only(
    df: DataFrame, keys: list[str], order: list[str], value: str, slice_by: Column
) -> DataFrame:
    """Rows whose value differs from the row before (W7); the first row counts as changed."""
    seen = with_previous(df, keys, order, [value], slice_by)
    return seen.withColumn("changed", ~F.col(value).eqNullSafe(F.col("previous_" + value)))


def _spread_over_slices(
    df: DataFrame, keys: list[str], order: list[str], slice_by: Column, near: Column, far: Callable[[Column], Column]
) -> DataFrame:
    """``_near``: result inside the slice; ``_far``: what all earlier slices contribute, from their last results."""
    rows, last = _slices(df, keys, order, slice_by, _near=near)
    earlier = Window.partitionBy("_key").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = last.withColumn("_sum", F.col("_row")["_near"]).select("_key", "_slice", far(F.col("_sum")).over(earlier).alias("_far"))
    return rows.join(carried, ["_key", "_slice"], "left").drop("_key", "_slice")


def carry_forward(
    df: DataFrame, keys: list[str], order: list[str], value: str, slice_by: Column, into: str
) -> DataFrame:
    """The latest non-null ``value`` up to each row, spread over slices like ``with_previous``."""
    latest = lambda c: F.last(c, ignorenulls=True)
    out = _spread_over_slices(df, keys, order, slice_by, near=latest(value), far=latest)
    return out.withColumn(into, F.coalesce("_near", "_far")).drop("_near", "_far")


def running_total(
    df: DataFrame, keys: list[str], order: list[str], value: str, slice_by: Column, into: str
) -> DataFrame:
    """Sum of ``value`` up to each row, spread over slices."""
    out = _spread_over_slices(df, keys, order, slice_by, near=F.sum(value), far=F.sum)
    return out.withColumn(into, F.col("_near") + F.coalesce(F.col("_far"), F.lit(0))).drop("_near", "_far")
