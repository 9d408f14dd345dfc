"""Billing events folded into accounts as they arrive (T5)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from tarifflens.functions.columns import blank_to_null
from tarifflens.functions.text import strip_ends
from tarifflens.operators.billing import account_states
from tarifflens.operators.entitlements import Plans
from tarifflens.sources.stages import stored
from tarifflens.streaming.versions import BUCKETS, BucketedTable, write_batch


def account_key() -> Column:
    """What an account is placed by: its user id, or its e-mail if a checkout has created it."""
    return F.coalesce(F.col("user_id").cast("string"), F.concat(F.lit("@"), F.col("email")))


def concerned(accounts: DataFrame, events: DataFrame) -> DataFrame:
    """The accounts that events may act on: those that they name by id or e-mail, and those that hold their customer ids."""
    reference = "client_reference_id" if "client_reference_id" in events.columns else "user_id"
    kind = accounts.schema["user_id"].dataType
    asked = [(F.col(reference).cast(kind), "user_id"), (F.col("customer_id"), "customer_id")]
    if "customer_email" in events.columns:
        asked.append((blank_to_null(F.lower(strip_ends(F.col("customer_email")))), "email"))
    found = None
    for value, column in asked:
        part = accounts.join(events.select(value.alias(column)).distinct(), column, "left_semi").select(*accounts.columns)
        found = part if found is None else found.unionByName(part)
    return found.dropDuplicates(["user_id", "email"])


class AccountTable:
    """Accounts, and the events that made them, as of each micro-batch.

    A batch reads the accounts that its events concern and writes their buckets anew; what it writes follows the batch, not the
    table. Events that arrive before what is folded already may change who held a customer id when, and with that whom
    later events acted on, so such a batch folds all events so far, from the users as they were at the start.
    """

    def __init__(self, spark: SparkSession, folder: str, users: DataFrame, plans: Plans, buckets: int = BUCKETS) -> None:
        self.spark, self.folder, self.users, self.plans = spark, folder, users, plans
        self.table = BucketedTable(spark, f"{folder}/accounts", users.schema, account_key(), buckets)

    def step(self, batch: DataFrame, number: int) -> None:
        events = self.spark.read.schema(batch.schema).parquet(write_batch(batch, f"{self.folder}/events", number))
        earlier = self.earlier(batch.schema, number)
        everywhere = list(range(self.table.buckets))
        if earlier is None:
            self.table.replace(account_states(self.users, events, self.plans), everywhere, number)
            return
        first, last = events.agg(F.min("arrived_at")).first()[0], earlier.agg(F.max("arrived_at")).first()[0]
        if first is not None and last is not None and first <= last:
            self.table.replace(account_states(self.users, earlier.unionByName(events), self.plans), everywhere, number)
            return
        accounts = self.table.before(number)
        changed = stored(account_states(stored(concerned(accounts, events)), events, self.plans).withColumn("_bucket", self.table.bucket))
        touched = [r["_bucket"] for r in changed.select("_bucket").distinct().collect()]
        names = changed.select(account_key().alias("_name"))
        kept = self.table.before(number, touched).withColumn("_name", account_key()).join(names, "_name", "left_anti")
        self.table.replace(kept.drop("_name").unionByName(changed.drop("_bucket")), touched, number)

    def earlier(self, schema: StructType, number: int) -> DataFrame | None:
        """The events of the batches before this one."""
        if self.table.committed(number) is None:
            return None
        known = self.spark.read.schema(schema).option("basePath", f"{self.folder}/events").parquet(f"{self.folder}/events")
        return known.where(F.col("batch") < number).drop("batch")

    def latest(self) -> DataFrame:
        """The accounts as of the last batch."""
        return self.table.before(2**31 - 1)


def fold_billing_events(
    spark: SparkSession,
    source: str,
    schema: StructType,
    users: DataFrame,
    plans: Plans,
    target: str,
    checkpoint: str,
    files_per_trigger: int = 100,
    buckets: int = BUCKETS,
) -> StreamingQuery:
    """Account table after every micro-batch; read it with ``AccountTable(...).latest()``.

    Each batch is one combined aggregate over its events, so a busy account does not tie up a task.
    """
    accounts = AccountTable(spark, target, users, plans, buckets)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(source)
    return (
        stream.writeStream.foreachBatch(accounts.step)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
