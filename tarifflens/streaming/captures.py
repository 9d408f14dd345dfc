"""Crawl results as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from tarifflens.operators.changes import SNAPSHOT_FIELDS, detect_changes
from tarifflens.operators.extraction import extract_pricing
from tarifflens.operators.history import newest
from tarifflens.streaming.versions import BUCKETS, BucketedTable, write_batch


def watch_captures(
    spark: SparkSession,
    source: str,
    schema: StructType,
    target: str,
    checkpoint: str,
    files_per_trigger: int = 100,
    every: str | None = None,
    buckets: int = BUCKETS,
) -> StreamingQuery:
    """Snapshots and diffs from a folder of capture files.

    Without ``every`` the stream drains what is there and stops; with it (say ``15 minutes``) it keeps
    running.  Each micro-batch uses the batch operators against the newest snapshot per company: one row per company, in
    hash buckets, of which a batch reads and writes those of its own companies.  All outputs are written under the batch
    number, so a batch that is repeated after a failure replaces itself.
    """
    tables: list[BucketedTable] = []

    def latest(fields: StructType) -> BucketedTable:
        if not tables:
            tables.append(BucketedTable(spark, f"{target}/latest", fields, F.col("company_id"), buckets))
        return tables[0]

    def step(batch: DataFrame, number: int) -> None:
        # The extraction is read by three outputs; it is written once and then read back.
        extracted = extract_pricing(batch).select("status", *SNAPSHOT_FIELDS)
        facts = spark.read.parquet(write_batch(extracted, f"{target}/captures", number))
        table = latest(StructType([facts.schema[c] for c in SNAPSHOT_FIELDS]))
        touched = [r["bucket"] for r in facts.select(table.bucket.alias("bucket")).distinct().collect()]
        known = table.before(number, touched)
        snapshots, diffs = detect_changes(facts, known)
        stored = spark.read.parquet(write_batch(snapshots, f"{target}/snapshots", number))
        write_batch(diffs, f"{target}/diffs", number)
        newer = newest(stored.unionByName(known), ["company_id"], [F.desc("captured_at"), F.desc("snapshot_id")])
        table.replace(newer, touched, number)

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(source)
    writer = stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    trigger = {"processingTime": every} if every else {"availableNow": True}
    return writer.trigger(**trigger).start()
