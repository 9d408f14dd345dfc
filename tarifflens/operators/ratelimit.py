"""Request limits with windows that start at a key's first request."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarifflens.functions.columns import floor_div, lookup, seconds_after
from tarifflens.operators.history import carry_forward, newest
from tarifflens.sources.stages import stored

# The instants of a key of so many requests are folded inside a row; busier keys are cut into slices of equal size.
FOLDED = 4096
SLICES = 256


def micros(ts: str) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))


def openings(instants: DataFrame, reach: int) -> DataFrame:
    """The instants at which a window opens: a key's first one, and the first one at least ``reach`` after an opening.

    ``instants``: distinct ``key`` (not null) and ``at``. The openings of an ordinary key are found by going through its
    instants in one row; those of a key with more than ``FOLDED`` by pointers, see ``busy_openings``.
    """
    sizes = instants.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > FOLDED)
    if sizes.isEmpty():
        return _folded_openings(instants, reach)
    busy = stored(sizes.select("key"))
    usual = _folded_openings(instants.join(busy, "key", "left_anti"), reach)
    return usual.unionByName(busy_openings(instants.join(busy, "key", "left_semi"), reach))


def _folded_openings(instants: DataFrame, reach: int) -> DataFrame:
    listed = instants.groupBy("key").agg(F.sort_array(F.collect_list("at")).alias("times"))
    none = F.array().cast("array<bigint>")

    def step(found: Column, at: Column) -> Column:
        last = F.try_element_at(found, F.lit(-1))
        return F.when(last.isNull() | (at >= last + reach), F.array_append(found, at)).otherwise(found)

    return listed.select("key", F.explode(F.aggregate("times", none, step)).alias("at"))


def sliced(rows: DataFrame) -> DataFrame:
    """The rows of each key cut into ``SLICES`` slices of about the same size along ``at``, however its instants lie."""
    cuts = rows.groupBy("key").agg(F.percentile_approx("at", [i / SLICES for i in range(1, SLICES)]).alias("cuts"))
    return rows.join(cuts, "key").withColumn("slice", F.size(F.filter("cuts", lambda c: c < F.col("at")))).drop("cuts")


def successors(instants: DataFrame, reach: int) -> DataFrame:
    """Each instant with ``next``, the first one of its key at least ``reach`` later (null for the last ones).

    Instants and the questions they ask are put in falling order, slice by slice, and the last instant seen answers.
    """
    own = instants.select("key", "at", F.col("at").alias("value"), F.lit(0).alias("asks"))
    asked = instants.select("key", (F.col("at") + reach).alias("at"), F.lit(None).cast("long").alias("value"), F.lit(1).alias("asks"))
    rows = sliced(own.unionByName(asked)).withColumn("back", -F.col("at"))
    placed = carry_forward(rows, ["key"], ["back", "asks"], "value", -F.col("slice"), into="next")
    return placed.where("asks = 1").select("key", (F.col("at") - reach).alias("at"), "next")


def busy_openings(instants: DataFrame, reach: int) -> DataFrame:
    """The openings of busy keys, by pointer doubling.

    Each instant points to its successor. Pointers of 2, 4, 8, ... steps follow by joining them to themselves on key and
    instant, which spreads any key; from the first instant of a key, they mark all openings, longest steps first. Instants
    that nothing points to are left out. The number of rounds is the logarithm of the number of windows.
    """
    first = instants.groupBy("key").agg(F.min("at").alias("at"), F.max("at").alias("last"))
    found = stored(successors(instants, reach))
    useful = found.where("next is not null").select("key", F.col("next").alias("at")).unionByName(first.select("key", "at")).distinct()
    steps = [stored(found.join(useful, ["key", "at"], "left_semi").where("next is not null"))]
    longest = first.agg(F.max(F.col("last") - F.col("at"))).first()[0]
    for _ in range(math.ceil(math.log2(longest // reach + 2)) - 1):
        once = steps[-1]
        again = once.select("key", F.col("at").alias("next"), F.col("next").alias("after"))
        steps.append(stored(once.join(again, ["key", "next"]).select("key", "at", F.col("after").alias("next"))))
    marked = stored(first.select("key", "at"))
    for step in reversed(steps):
        marked = stored(marked.unionByName(marked.join(step, ["key", "at"]).select("key", F.col("next").alias("at"))))
    return marked


def limit_requests(requests: DataFrame, max_requests: int, window_seconds: int) -> DataFrame:
    """Decision per request: allowed, remaining, seconds to wait, end of the window.

    Input ``request_id, key, ts``.  A window opens at a key's first request and at the first request at least one window
    later; denied requests do not count.  A slice of time as wide as a window holds at most one opening of a key, so a
    request finds its window by key and slice, among the openings of its own slice and the one before; a busy slice meets two
    rows there, and Spark splits it.
    """
    reach = window_seconds * 1_000_000
    # A struct is never null, so requests without a key meet each other.
    timed = requests.select("request_id", F.struct("key").alias("key"), "ts", micros("ts").alias("at"))
    opened = openings(timed.select("key", "at").distinct(), reach).withColumnRenamed("at", "window_opened")
    own = floor_div(F.col("window_opened"), reach)
    near = opened.select("key", "window_opened", F.explode(F.array(own, own + 1)).alias("slice"))
    inside = (F.col("window_opened") <= F.col("at")) & (F.col("at") < F.col("window_opened") + reach)
    placed = timed.withColumn("slice", floor_div(F.col("at"), reach)).join(near, ["key", "slice"]).where(inside)
    counted = newest(
        placed.select("key", "window_opened", "at", "request_id"),
        ["key", "window_opened"],
        [F.col("at"), F.col("request_id")],
        max_requests,
        rank="position",
    ).select("request_id", "position")
    joined = placed.join(counted, "request_id", "left")
    allowed = F.col("position").isNotNull()
    start = F.timestamp_micros("window_opened").cast(requests.schema["ts"].dataType)
    wait = F.ceil((F.col("window_opened") + reach - F.col("at")) / 1_000_000)
    return joined.select(
        "request_id",
        F.col("key")["key"].alias("key"),
        "ts",
        allowed.alias("allowed"),
        F.when(allowed, max_requests - F.col("position")).otherwise(F.lit(0)).cast("long").alias("remaining"),
        F.when(allowed, F.lit(0)).otherwise(F.greatest(wait, F.lit(0))).cast("long").alias("retry_after_seconds"),
        start.alias("window_started_at"),
        seconds_after(start, window_seconds).alias("reset_at"),
    )


def limit_by_budget(requests: DataFrame, budgets: dict[str, tuple[int, int]]) -> DataFrame:
    """Decisions for requests of several budgets (name: maximum, window seconds).

    Input ``request_id, budget, actor, ts``; each actor has every budget to itself, under the text key
    ``budget:actor``.  Budgets of the same window are decided together, with the largest maximum first and then
    their own.  Requests of unknown budgets drop out.
    """
    result = None
    for window in sorted({window for _, window in budgets.values()}):
        most = {name: count for name, (count, seconds) in budgets.items() if seconds == window}
        largest = max(most.values())
        keyed = requests.where(F.col("budget").isin(*most)).select(
            "request_id", F.concat_ws(":", "budget", F.col("actor").cast("string")).alias("key"), "ts"
        )
        decided = limit_requests(keyed, largest, window)
        own = lookup(most, F.substring_index("key", ":", 1))
        place = largest - F.col("remaining")
        allowed = F.col("allowed") & (place <= own)
        left = micros("window_started_at") + window * 1_000_000 - micros("ts")
        wait = F.greatest(F.ceil(left / 1_000_000), F.lit(0)).cast("long")
        part = decided.select(
            "request_id",
            "key",
            "ts",
            allowed.alias("allowed"),
            F.when(allowed, own - place).otherwise(F.lit(0)).cast("long").alias("remaining"),
            F.when(allowed, F.lit(0)).otherwise(wait).cast("long").alias("retry_after_seconds"),
            "window_started_at",
            "reset_at",
        )
        result = part if result is None else result.unionByName(part)
    return result
