"""Idempotent handling of repeated deliveries (T4)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarifflens import policies as P
from tarifflens.functions.columns import first_true, floor_div
from tarifflens.operators.claims import NEVER, mark_claims
from tarifflens.operators.history import carry_forward, running_total
from tarifflens.operators.ratelimit import micros
from tarifflens.sources.stages import stored

# The deliveries of an event of so many are folded inside a row.
FOLDED = 512


def free_again(result: Column, arrived: Column, finished: Column, lock_micros: int) -> tuple[Column, Column]:
    """From when and until when another delivery may take over.

    Never after success, at once after a failure, at the end of the lock when the worker vanished
    or overran it.  A worker that overran the lock and then succeeds closes that gap for ever.
    """
    lock_end = arrived + F.lit(lock_micros)
    processed, in_time = result == "processed", F.coalesce(finished <= lock_end, F.lit(False))
    free = (
        F.when(processed & in_time, F.lit(NEVER))
        .when((result == "failed") & in_time, F.greatest(finished, arrived))
        .otherwise(lock_end)
    )
    return free, F.when(processed & finished.isNotNull(), finished).otherwise(F.lit(NEVER))


def handle_deliveries(
    deliveries: DataFrame, lock_seconds: int = P.DELIVERY_LOCK_SECONDS, fanout: int = 64, levels: int = 2
) -> DataFrame:
    """What happens to each delivery: processed with its attempt number, or skipped and why.

    Input ``delivery_id, event_id, arrived_at, result, finished_at`` where ``result``
    (processed, failed, lost) is how processing ends if this delivery is the one to process. The few deliveries of an ordinary
    event are gone through in one row; those of an event with more than ``FOLDED`` are cut into blocks of time.
    """
    sizes = deliveries.groupBy("event_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > FOLDED)
    if sizes.isEmpty():
        return _folded(deliveries, lock_seconds)
    busy = stored(sizes.select("event_id"))
    usual = _folded(deliveries.join(busy, "event_id", "left_anti"), lock_seconds)
    return usual.unionByName(_in_blocks(deliveries.join(busy, "event_id", "left_semi"), lock_seconds, fanout, levels))


def _folded(deliveries: DataFrame, lock_seconds: int) -> DataFrame:
    timed = deliveries.select(
        "event_id", micros("arrived_at").alias("at"), "delivery_id", "result", micros("finished_at").alias("done")
    )
    free, until = free_again(F.col("result"), F.col("at"), F.col("done"), lock_seconds * 1_000_000)
    ready = timed.withColumns({"free": free, "until": until})
    listed = ready.groupBy("event_id").agg(
        F.sort_array(F.collect_list(F.struct("at", "delivery_id", "result", "done", "free", "until"))).alias("rows")
    )
    kind = deliveries.schema["delivery_id"].dataType.simpleString()
    told = f"struct<delivery_id:{kind},action:string,reason:string,attempt:bigint>"
    start = F.struct(
        F.lit(None).cast("struct<result:string,done:bigint,free:bigint,until:bigint>").alias("owner"),
        F.lit(0).cast("bigint").alias("attempts"),
        F.array().cast(f"array<{told}>").alias("told"),
    )

    def step(state: Column, row: Column) -> Column:
        owner = state["owner"]
        claims = owner.isNull() | ((row["at"] >= owner["free"]) & (row["at"] < owner["until"]))
        finished = F.coalesce((owner["result"] == "processed") & (owner["done"] <= row["at"]), F.lit(False))
        attempts = state["attempts"] + 1
        reason = F.when(finished, F.lit("already_processed")).otherwise(F.lit("in_progress"))
        now = F.struct(
            row["delivery_id"].alias("delivery_id"),
            F.when(claims, F.lit("process")).otherwise(F.lit("skip")).alias("action"),
            F.when(~claims, reason).alias("reason"),
            F.when(claims, attempts).alias("attempt"),
        )
        taken = F.struct(*[row[name].alias(name) for name in ("result", "done", "free", "until")])
        return F.struct(
            F.when(claims, taken).otherwise(owner).alias("owner"),
            F.when(claims, attempts).otherwise(state["attempts"]).alias("attempts"),
            F.array_append(state["told"], now).alias("told"),
        )

    each = listed.select("event_id", F.inline(F.aggregate("rows", start, step, lambda state: state["told"])))
    return each.select("delivery_id", "event_id", "action", "reason", "attempt")


def _in_blocks(deliveries: DataFrame, lock_seconds: int, fanout: int, levels: int) -> DataFrame:
    lock = lock_seconds * 1_000_000
    timed = deliveries.withColumn("at", micros("arrived_at")).withColumn("done", micros("finished_at"))
    free, until = free_again(F.col("result"), F.col("at"), F.col("done"), lock)
    rows = timed.select(
        F.col("event_id").alias("key"),
        "at",
        F.col("delivery_id").alias("tie"),
        free.alias("free"),
        until.alias("until"),
    )
    order = ["at", "delivery_id"]
    slice_by = floor_div(F.col("at"), lock * fanout)
    claims = mark_claims(rows, lock, fanout, levels).select(
        F.col("key").alias("event_id"), "at", F.col("tie").alias("delivery_id"), F.lit(1).alias("claim")
    )
    numbered = running_total(claims, ["event_id"], order, "claim", slice_by, into="attempt")
    flagged = timed.join(numbered.select("delivery_id", "claim", "attempt"), "delivery_id", "left")
    owner = F.when(F.col("claim") == 1, F.struct("result", "done", "at"))
    counted = carry_forward(
        flagged.withColumn("claim", F.coalesce("claim", F.lit(0))).withColumn("_own", owner),
        ["event_id"], order, "_own", slice_by, into="owner",
    )
    claimed = F.col("claim") == 1
    finished = (F.col("owner.result") == "processed") & (F.col("owner.done") <= F.col("at"))
    return counted.select(
        "delivery_id",
        "event_id",
        F.when(claimed, F.lit("process")).otherwise(F.lit("skip")).alias("action"),
        F.when(~claimed, first_true([(finished, "already_processed")], "in_progress")).alias("reason"),
        F.when(claimed, F.col("attempt").cast("long")).alias("attempt"),
    )
