"""Streams give the answers of their batch twins."""

import random

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from tarifflens.operators.billing import account_states
from tarifflens.operators.changes import detect_changes
from tarifflens.operators.extraction import extract_pricing
from tarifflens.operators.ratelimit import limit_requests, micros
from tarifflens.operators.delivery import handle_deliveries
from tarifflens.plans import record_queries as R
from tarifflens.sources.fixtures import view
from tarifflens.streaming import stateful
from tarifflens.streaming.accounts import AccountTable, fold_billing_events
from tarifflens.streaming.captures import watch_captures
from tarifflens.streaming.changes import ChangeHistory, current_diffs, current_snapshots, watch_changes
from tests.conftest import SMALL


def rows(df, *columns):
    return sorted(map(str, df.select(*columns).collect()))


def in_files(df, order, folder, parts):
    """One file per stretch of ``order``, oldest file first."""
    ranked = df.withColumn("_part", F.ntile(parts).over(Window.orderBy(order)))
    for part in range(1, parts + 1):
        ranked.where(F.col("_part") == part).drop("_part").coalesce(1).write.mode("append").parquet(folder)
    return df.schema


def drain(stream, name):
    query = stream.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    finished = query.awaitTermination(120)
    query.stop()
    assert finished
    return stream.sparkSession.table(name)


def test_limit_stream(spark, tmp_path):
    stateful.use_rocksdb(spark)
    requests = view(spark, SMALL, "requests")
    schema = in_files(requests.withColumn("at", micros("ts")), "at", str(tmp_path / "in"), 2)
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    streamed = drain(stateful.limit_stream(source, 2, 86400), "limits")
    batch = limit_requests(requests, 2, 86400)
    columns = ["request_id", "allowed", "remaining", "retry_after_seconds"]
    assert rows(streamed, *columns) == rows(batch, *columns)


def test_limit_stream_ends_state_by_event_time(spark, tmp_path):
    """A backlog with text keys: the clock on the wall plays no part, and quiet keys leave the state."""
    stateful.use_rocksdb(spark)
    requests = view(spark, SMALL, "requests").withColumn("key", F.concat(F.lit("user "), F.col("key")))
    requests = requests.withColumn("at", micros("ts")).withColumn("ts", F.timestamp_micros("at"))
    schema = in_files(requests, "at", str(tmp_path / "in"), 4)
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    streamed = drain(stateful.limit_stream(source, 2, 3600, late_by="1 hour"), "ended_limits")
    columns = ["request_id", "key", "allowed", "remaining", "retry_after_seconds"]
    assert rows(streamed, *columns) == rows(limit_requests(requests, 2, 3600), *columns)


def test_delivery_stream(spark, tmp_path):
    stateful.use_rocksdb(spark)
    deliveries = R._deliveries(spark, SMALL)
    timed = deliveries.withColumn("at", micros("arrived_at")).withColumn("done", micros("finished_at"))
    schema = in_files(timed, "at", str(tmp_path / "in"), 2)
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    streamed = drain(stateful.delivery_stream(source), "deliveries")
    columns = ["delivery_id", "action", "reason", "attempt"]
    assert rows(streamed, *columns) == rows(handle_deliveries(deliveries), *columns)


def test_delivery_stream_with_a_retention(spark, tmp_path):
    """Deliveries in the wrong order across batches are decided in order, and the state is empty in the end."""
    stateful.use_rocksdb(spark)
    deliveries = R._deliveries(spark, SMALL).withColumn("at", micros("arrived_at")).withColumn("done", micros("finished_at"))
    timed = deliveries.withColumn("ts", F.timestamp_micros("at"))
    hours = (F.col("at") / 3_600_000_000).cast("long")
    # Within an hour, the later ones come first; a delivery long after all others moves the watermark to the end.
    last = timed.agg(F.max("at")).first()[0] + 40 * 86_400_000_000
    end = spark.createDataFrame([(last + 3_600_000_000 * k, -k) for k in (1, 30)], "at long, delivery_id long").select(
        "delivery_id", F.col("delivery_id").alias("event_id"), "at", F.lit("processed").alias("result"), F.lit(None).cast("long").alias("done"),
        F.timestamp_micros("at").alias("ts"),
    )
    told = timed.select(*end.columns).withColumn("turn", hours * 10**10 - F.col("at") % 3_600_000_000)
    told = told.unionByName(end.withColumn("turn", F.lit(10**18) + F.col("at")))
    schema = in_files(told, "turn", str(tmp_path / "in"), 5)
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    stream = stateful.delivery_stream(source, late_by="2 hours", retain_seconds=30 * 86400)
    query = stream.writeStream.format("memory").queryName("kept_deliveries").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(200)
    columns = ["delivery_id", "action", "reason", "attempt"]
    assert rows(spark.table("kept_deliveries").where("event_id >= 0"), *columns) == rows(handle_deliveries(deliveries), *columns)
    assert query.lastProgress.stateOperators[0].numRowsTotal < 20
    query.stop()


ACCOUNT_COLUMNS = ["user_id", "email", "has_access", "price_id", "customer_id", "trial_status"]


def written_files(folder):
    return {str(p.relative_to(folder)): p.read_bytes() for p in folder.rglob("*.parquet")}


def test_account_stream(spark, tmp_path):
    """In arrival order, with accounts that one batch creates and a later one finds."""
    users, events, plans = view(spark, SMALL, "users"), view(spark, SMALL, "billing_journal"), R.PLANS
    schema = in_files(events, "arrived_at", str(tmp_path / "in"), 3)
    fold_billing_events(
        spark, str(tmp_path / "in"), schema, users, plans, str(tmp_path / "out"), str(tmp_path / "ck"), files_per_trigger=1, buckets=8
    ).awaitTermination()
    found = AccountTable(spark, str(tmp_path / "out"), users, plans, 8).latest()
    assert rows(found, *ACCOUNT_COLUMNS) == rows(account_states(users, events, plans), *ACCOUNT_COLUMNS)


def test_account_batches_out_of_order(spark, tmp_path):
    """Three batches in the wrong order give the answer of all events; one that is repeated changes nothing."""
    users, events, plans = view(spark, SMALL, "users"), view(spark, SMALL, "billing_journal"), R.PLANS
    ranked = events.withColumn("_part", F.ntile(3).over(Window.orderBy("arrived_at")))
    accounts = AccountTable(spark, str(tmp_path / "out"), users, plans, 8)
    for number, part in enumerate((2, 1, 3)):
        accounts.step(ranked.where(F.col("_part") == part).drop("_part"), number)
    wanted = rows(account_states(users, events, plans), *ACCOUNT_COLUMNS)
    assert rows(accounts.latest(), *ACCOUNT_COLUMNS) == wanted
    accounts.step(ranked.where("_part = 3").drop("_part"), 2)
    assert rows(accounts.latest(), *ACCOUNT_COLUMNS) == wanted


def test_a_batch_writes_the_buckets_it_touches(spark, tmp_path):
    users, plans = view(spark, SMALL, "users"), R.PLANS
    events = view(spark, SMALL, "billing_journal").where("client_reference_id is not null")
    accounts = AccountTable(spark, str(tmp_path / "out"), users, plans, 64)
    accounts.step(events.where("event_id % 2 = 0"), 0)
    later = F.col("arrived_at") + F.expr("interval 9 years")
    one = users.where("user_id = 5").selectExpr("user_id as client_reference_id").crossJoin(
        events.where("event_type = 'checkout.session.completed' and price_id = 'price_pro'").limit(1).drop("client_reference_id")
    )
    one = one.withColumns({"arrived_at": later, "customer_email": F.lit(None).cast("string"), "customer_id": F.lit("cus_own")}).select(*events.columns)
    accounts.step(one, 1)
    data = tmp_path / "out/accounts/data"
    assert len(list(data.glob("batch=1/hash_bucket=*"))) == 1 and len(list(data.glob("batch=0/hash_bucket=*"))) > 30
    row = accounts.latest().where("user_id = 5").collect()
    assert len(row) == 1 and row[0]["customer_id"] == "cus_own" and row[0]["has_access"]
    assert accounts.latest().count() == account_states(users, events.where("event_id % 2 = 0"), plans).count()
    # What the batch would start from again is kept, anything older goes.
    before = written_files(data)
    accounts.step(one, 1)
    assert written_files(data).keys() >= {k for k in before if k.startswith("batch=0")}
    accounts.step(one.withColumn("arrived_at", later), 2)
    accounts.step(one.withColumn("arrived_at", later + F.expr("interval 1 day")), 3)
    assert not list(data.glob("batch=1/hash_bucket=*")) and sorted(p.name for p in (tmp_path / "out/accounts/lists").iterdir()) == ["batch=2", "batch=3"]


def test_capture_stream(spark, tmp_path):
    days = [("old_captures", "2001-07-30"), ("old_captures", "2001-07-31"), ("captures", "2001-08-01")]
    frames = [
        view(spark, SMALL, name)
        .withColumn("captured_at", F.expr(f"timestamp_ntz'{day} 00:00:00'"))
        .withColumn("snapshot_id", F.concat_ws("-", F.col("company_id").cast("string"), F.lit(day)))
        for name, day in days
    ]
    captures = frames[0].unionByName(frames[1]).unionByName(frames[2])
    schema = in_files(captures, "captured_at", str(tmp_path / "in"), 3)
    watch_captures(
        spark, str(tmp_path / "in"), schema, str(tmp_path / "out"), str(tmp_path / "ck"), files_per_trigger=1
    ).awaitTermination()
    snapshots, diffs = detect_changes(extract_pricing(captures))
    assert rows(spark.read.parquet(str(tmp_path / "out/snapshots")), "snapshot_id") == rows(snapshots, "snapshot_id")
    columns = ["current_snapshot_id", "previous_snapshot_id", "severity", "verification_state"]
    streamed = rows(spark.read.parquet(str(tmp_path / "out/diffs")), *columns)
    assert streamed == rows(diffs, *columns) and streamed


def test_change_stream_with_late_files(spark, tmp_path):
    """Days come in the wrong order, with the same hash and with other ones in between; the answer is that of all captures."""
    days = [("captures", 3), ("old_captures", 1), ("old_captures", 5), ("captures", 2), ("old_captures", 4), ("old_captures", 2)]
    frames = []
    for turn, (name, day) in enumerate(days):
        part = view(spark, SMALL, name).withColumn("captured_at", F.expr(f"timestamp_ntz'2001-08-0{day} 00:00:00' + interval {turn} minutes"))
        frames.append(part.withColumn("snapshot_id", F.format_string("%s-%s-%s", "company_id", F.lit(day), F.lit(turn))).withColumn("turn", F.lit(turn)))
    captures = frames[0]
    for part in frames[1:]:
        captures = captures.unionByName(part)
    schema = in_files(captures, "turn", str(tmp_path / "in"), 6)
    watch_changes(
        spark, str(tmp_path / "in"), schema, str(tmp_path / "out"), str(tmp_path / "ck"), files_per_trigger=1
    ).awaitTermination()
    told = spark.read.parquet(str(tmp_path / "out"))
    extracted = extract_pricing(captures)
    snapshots, diffs = detect_changes(extracted)
    assert rows(current_snapshots(told), "snapshot_id") == rows(snapshots, "snapshot_id")
    columns = ["current_snapshot_id", "previous_snapshot_id", "detected_at", "severity", "verification_state", "normalized_diff"]
    found = current_diffs(told, extracted.schema["payload"].dataType.simpleString())
    assert rows(found, *columns) == rows(diffs, *columns) and rows(diffs, *columns)
    assert not told.where("action = 'drop'").isEmpty()


def test_change_history_forgets_what_is_settled():
    """With a horizon, the captures kept are those after the newest settled snapshot, and answers stay the same."""
    class State:
        rows: list = []
        exists = lambda self: bool(self.rows)
        get = lambda self: iter(self.rows)

        def put(self, rows):
            self.rows = rows

    def told(late):
        history, out = ChangeHistory(late), {}
        history.state = State()
        rng = random.Random(1)
        most = 0
        for turn in range(200):
            at = max(0, turn * 10 - rng.choice([0, 0, 0, 35]))
            batch = pd.DataFrame([(at, f"s{turn}", rng.choice("ab"), "{}", True)], columns=["at", "snapshot_id", "content_hash", "payload", "is_verified"])
            for change in history.handleInputRows((1,), iter([batch]), None):
                for row in change.itertuples():
                    out[row.snapshot_id] = (row.action, row.previous_snapshot_id)
            most = max(most, len(history.state.rows))
        return out, most

    whole, all_kept = told(None)
    short, kept = told(60)
    assert short == whole and all_kept == 200 and kept < 25
