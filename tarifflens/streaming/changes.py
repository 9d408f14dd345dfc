"""Change detection with state per company (T2): late captures find their place, and only changes come out.

The captures of a company are kept in event-time order in RocksDB. A capture makes a snapshot if its hash differs from the
one before it; a late one may therefore make or unmake its successor's snapshot, or become what it is compared with. What
a batch changes is emitted under the snapshot: ``put`` with the snapshot before it, or ``drop``. The last word on each snapshot is
the answer of the batch operator over all captures.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from tarifflens.functions.columns import computed_once
from tarifflens.operators.diffing import pricing_diff, verification
from tarifflens.operators.extraction import extract_pricing
from tarifflens.operators.ratelimit import micros
from tarifflens.streaming.stateful import use_rocksdb
from tarifflens.streaming.versions import write_batch

CAPTURE = "at long, snapshot_id string, content_hash string, payload string, is_verified boolean"
FIELDS = [part.split()[0] for part in CAPTURE.split(", ")]
CHANGE = (
    "company_id {kind}, snapshot_id string, action string, at long, is_verified boolean, payload string, "
    "previous_snapshot_id string, previous_payload string"
)


def kept_snapshots(captures: list[tuple]) -> dict[str, tuple[tuple, tuple | None]]:
    """By snapshot id, the captures that make a snapshot, each with the one before it; ``captures`` are in order."""
    kept, last = {}, None
    for capture in captures:
        if last is None or capture[2] != last[2]:
            kept[capture[1]] = (capture, last)
            last = capture
    return kept


class ChangeHistory(StatefulProcessor):
    """The captures of a company, and what each batch changes in its snapshots."""

    def __init__(self, late_micros: int | None) -> None:
        self.late = late_micros

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getListState("captures", CAPTURE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        held = [tuple(row) for row in self.state.get()] if self.state.exists() else []
        places = {(c[0], c[1]) for c in held}
        fresh: dict[tuple, tuple] = {}
        for batch in rows:
            for row in batch[FIELDS].itertuples(index=False, name=None):
                capture = (int(row[0]), *row[1:4], bool(row[4]))
                # What lies before all that is kept has been decided for good.
                if (not held or self.late is None or capture[0] >= held[0][0]) and capture[:2] not in places:
                    fresh[capture[:2]] = capture
        after = sorted([*held, *fresh.values()], key=lambda c: c[:2])
        old, new = kept_snapshots(held), kept_snapshots(after)
        out = []
        for name, (capture, before) in new.items():
            if name not in old or (old[name][1] or (None,) * 2)[1] != (before or (None,) * 2)[1]:
                out.append((key[0], name, "put", capture[0], capture[4], capture[3], *((before[1], before[3]) if before else (None, None))))
        out += [(key[0], name, "drop", old[name][0][0], None, None, None, None) for name in old if name not in new]
        if self.late is not None and after:
            # The newest snapshot before the horizon stays, as what later captures are compared with.
            horizon = after[-1][0] - self.late
            settled = [c for c, _ in new.values() if c[0] < horizon]
            after = [c for c in after if not settled or c[:2] >= settled[-1][:2]]
        self.state.put(after)
        yield pd.DataFrame(out, columns=[part.split()[0] for part in CHANGE.split(", ")])

    def close(self) -> None:
        pass


def change_stream(extracted: DataFrame, late_seconds: int | None = None) -> DataFrame:
    """What every micro-batch of ok captures changes in the snapshots (see the module).

    With ``late_seconds`` a company keeps the captures of that long before its newest one, and one snapshot older than that; captures
    later still are passed over. By default nothing is forgotten.
    """
    facts = extracted.where(F.col("status") == "ok").select(
        "company_id",
        micros("captured_at").alias("at"),
        F.col("snapshot_id").cast("string").alias("snapshot_id"),
        "content_hash",
        F.to_json("payload").alias("payload"),
        "is_verified",
    )
    kind = facts.schema["company_id"].dataType.simpleString()
    return facts.groupBy("company_id").transformWithStateInPandas(
        statefulProcessor=ChangeHistory(None if late_seconds is None else late_seconds * 1_000_000),
        outputStructType=CHANGE.format(kind=kind),
        outputMode="Append",
        timeMode="None",
    )


def watch_changes(
    spark: SparkSession,
    source: str,
    schema: StructType,
    target: str,
    checkpoint: str,
    files_per_trigger: int = 100,
    late_seconds: int | None = None,
) -> StreamingQuery:
    """The changes of a folder of capture files, under ``target/batch=N``; a repeated batch replaces itself."""
    use_rocksdb(spark)
    captures = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(source)
    changes = change_stream(extract_pricing(captures), late_seconds)
    return (
        changes.writeStream.foreachBatch(lambda batch, number: write_batch(batch, target, number) and None)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def current_snapshots(changes: DataFrame) -> DataFrame:
    """The last word on each snapshot, from the rows of all batches (with their ``batch``); dropped ones are gone."""
    told = [c for c in changes.columns if c not in ("company_id", "snapshot_id", "batch")]
    last = changes.groupBy("company_id", "snapshot_id").agg(F.max_by(F.struct(*told), "batch").alias("last"))
    return last.select("company_id", "snapshot_id", "last.*").where("action = 'put'").drop("action")


def current_diffs(changes: DataFrame, payload: str) -> DataFrame:
    """Diffs between the snapshots as they now follow each other; ``payload`` is the DDL type of a payload."""
    paired = current_snapshots(changes).where(F.col("previous_snapshot_id").isNotNull())
    named = paired.select(
        "company_id",
        "previous_snapshot_id",
        F.col("snapshot_id").alias("current_snapshot_id"),
        F.timestamp_micros("at").cast("timestamp_ntz").alias("detected_at"),
        verification("is_verified"),
        F.from_json("previous_payload", payload).alias("_old"),
        F.from_json("payload", payload).alias("_new"),
    )
    diffed = computed_once(named, normalized_diff=pricing_diff(F.col("_old"), F.col("_new"))).drop("_old", "_new")
    return diffed.where(F.col("normalized_diff").isNotNull()).withColumn("severity", F.col("normalized_diff.severity"))
