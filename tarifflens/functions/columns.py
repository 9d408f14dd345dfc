"""Small column helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times inside ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def computed_once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add expensive columns behind a generator.

    Catalyst pushes a later filter on such a column below the projection and then
    evaluates the expression twice (once to filter, once to project).  It does not push
    filters on generated columns below the generator, so one scan pays once.
    """
    packed = F.struct(*[expr.alias(name) for name, expr in columns.items()])
    kept = [F.col(c) for c in df.columns if c not in columns]
    return df.select(*kept, F.inline(F.array(packed)))


def first_true(cases: Iterable[tuple[Column, object]], otherwise: object = None) -> Column:
    """Value of the first condition that holds."""
    chain = None
    for condition, value in cases:
        value = value if isinstance(value, Column) else F.lit(value)
        chain = F.when(condition, value) if chain is None else chain.when(condition, value)
    other = otherwise if isinstance(otherwise, Column) else F.lit(otherwise)
    return chain.otherwise(other)


def lookup(mapping: dict[str, str], key: Column) -> Column:
    """Value of a small literal map, NULL when the key is absent."""
    pairs = [F.lit(x) for item in mapping.items() for x in item]
    return F.try_element_at(F.create_map(*pairs), key)


def blank_to_null(value: Column) -> Column:
    """NULL for empty text; ``value`` may be costly and is evaluated once."""
    return bind(value, lambda v: F.when(v != "", v))


def seconds_after(ts: Column, seconds: Column | int) -> Column:
    """``ts`` moved by whole seconds; keeps the timestamp type (with or without zone)."""
    secs = seconds if isinstance(seconds, Column) else F.lit(int(seconds))
    return ts + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), secs.cast("decimal(18,6)"))


def count_where(condition: Column) -> Column:
    return F.count_if(condition).cast("bigint")


def floor_div(value: Column, width: int) -> Column:
    """Whole-number division rounding down, exact for large longs."""
    step = F.lit(int(width)).cast("long")
    return F.call_function("div", value - F.pmod(value, step), step)
