"""One key with most rows gives the same answers as a plain replay."""

import hashlib
import random

from pyspark.sql import functions as F

from tarifflens.operators import delivery, ratelimit
from tarifflens.operators.claims import NEVER, mark_claims
from tarifflens.operators.history import carry_forward, running_total, with_previous
from tarifflens.functions.columns import floor_div
from tarifflens.plans import record_queries


def replay(rows):
    claims, free, until = [], None, None
    for at, tie, next_free, next_until in sorted(rows):
        if free is None or free <= at < until:
            claims.append((at, tie))
            free, until = next_free, next_until
    return claims


def test_claims_equal_replay(spark):
    rng = random.Random(5)
    data = []
    for key, size, span in (("hot", 3000, 40_000), ("b", 40, 900_000), ("c", 1, 10), ("d", 200, 300)):
        for tie in range(size):
            at = rng.randrange(span)
            free = NEVER if key == "b" and tie == 30 else at + rng.choice([0, 3, 50, 100])
            until = at + rng.choice([60, 300]) if rng.random() < 0.02 else NEVER
            data.append((key, at, tie, free, until))
    df = spark.createDataFrame(data, "key string, at long, tie long, free long, until long")
    expected = {(k, *c) for k in "hot b c d".split() for c in replay([r[1:] for r in data if r[0] == k])}
    for fanout, levels in ((2, 2), (64, 1)):
        found = {tuple(r) for r in mark_claims(df, 100, fanout, levels).select("key", "at", "tie").collect()}
        assert found == expected


def test_limits_of_a_busy_key(spark, monkeypatch):
    """A key with a third of all rows in one window, one spread over many, one without a name: as a plain replay has it."""
    monkeypatch.setattr(ratelimit, "FOLDED", 100)
    rng = random.Random(9)
    second = 1_000_000
    data = [("hot", rng.randrange(600 * second)) for _ in range(1000)]
    data += [("long", rng.randrange(200_000 * second)) for _ in range(1200)] + [("hot", 605 * second), ("hot", 90_000 * second)]
    data += [(rng.choice([None, "a", "b"]), rng.randrange(5_000) * second) for _ in range(250)]
    rows = [(i, key, at) for i, (key, at) in enumerate(data)]
    window, most = 600, 3
    expected, state = {}, {}
    for i, key, at in sorted(rows, key=lambda r: (r[2], r[0])):
        opened, used = state.get(key, (None, 0))
        if opened is None or at >= opened + window * second:
            opened, used = at, 0
        used += 1
        state[key] = opened, used
        expected[i] = (opened, used <= most, max(0, most - used))
    df = spark.createDataFrame(rows, "request_id long, key string, at long")
    decided = ratelimit.limit_requests(df.withColumn("ts", F.timestamp_micros("at")), most, window)
    found = {r.request_id: (r.opened, r.allowed, r.remaining) for r in decided.withColumn("opened", ratelimit.micros("window_started_at")).collect()}
    assert found == expected


def test_no_task_gets_a_busy_key(spark):
    """All that a task is given at once of a key with a third of all rows in one window is below a twentieth of the rows."""
    rng = random.Random(10)
    total = 30_000
    at = [rng.randrange(86_400_000_000) if i % 3 else 10**9 + int(10**6 * rng.random() ** 4) for i in range(total)]
    rows = spark.createDataFrame([("hot" if i % 3 == 0 else f"k{i % 900}", t) for i, t in enumerate(at)], "key string, at long").distinct()
    busy = rows.where("key = 'hot'")
    slices = ratelimit.sliced(busy.unionByName(busy.withColumn("at", F.col("at") + 60_000_000)))
    assert max(r["count"] for r in slices.groupBy("key", "slice").count().collect()) < total / 20
    assert slices.select("slice").distinct().count() <= ratelimit.SLICES
    # Pointers meet on key and instant: no value of both comes twice on the side that answers.
    found = ratelimit.successors(busy, 60_000_000)
    assert found.groupBy("key", "at").count().where("count > 1").isEmpty() and found.count() == busy.count()


def test_deliveries_in_a_row_and_in_blocks(spark, monkeypatch):
    """Events of few and of many deliveries are decided alike, whichever way they go."""
    rng = random.Random(11)
    rows = []
    for event, size, span in ((1, 300, 30_000), (2, 40, 900), (3, 1, 1), *((k, 3, 700) for k in range(4, 40))):
        for _ in range(size):
            at, result = rng.randrange(span), rng.choice(["failed", "lost", "failed", "lost", "processed" if rng.random() < 0.2 else "lost"])
            done = None if result == "lost" else at + rng.choice([1, 20, 299, 300, 301, 700])
            rows.append((len(rows), event, at, result, done))
    df = spark.createDataFrame(rows, "delivery_id long, event_id long, at long, result string, done long").select(
        "delivery_id", "event_id", F.timestamp_seconds("at").alias("arrived_at"), "result", F.timestamp_seconds("done").alias("finished_at")
    )
    answers = []
    for folded in (10**6, 50, 0):
        monkeypatch.setattr(delivery, "FOLDED", folded)
        answers.append(sorted(map(str, delivery.handle_deliveries(df).collect())))
    assert answers[0] == answers[1] == answers[2] and len(answers[0]) == len(rows)


def test_sliced_order_equals_plain_order(spark):
    rng = random.Random(7)
    data = [("hot" if i % 3 else "cold", i, rng.choice([None, rng.randrange(9)]), 1) for i in range(900)]
    df = spark.createDataFrame(data, "k string, i long, v int, one long")
    part = floor_div(F.col("i"), 50)
    expected_prev, expected_last, expected_sum, seen = {}, {}, {}, {}
    for k, i, v, _ in data:
        before, last, count = seen.get(k, (None, None, 0))
        last = v if v is not None else last
        expected_prev[i], expected_last[i], expected_sum[i] = before, last, count + 1
        seen[k] = (i, last, count + 1)
    prev = with_previous(df, ["k"], ["i"], ["i"], part).collect()
    assert {r.i: r.previous_i for r in prev} == expected_prev
    last = carry_forward(df, ["k"], ["i"], "v", part, into="w").collect()
    assert {r.i: r.w for r in last} == expected_last
    total = running_total(df, ["k"], ["i"], "one", part, into="n").collect()
    assert {r.i: r.n for r in total} == expected_sum


def test_a_crawl_parses_the_old_pages_once(spark, tmp_path):
    pages = [(i, f"https://c{i}.example.com/pricing", f"<h2>Pro plan</h2><p>$ {i + 1} per month</p>") for i in range(1, 49)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    owners = [(i, f"n{i}", 1, 0.0, "BUILDING") for i in range(60)]
    names = "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"
    spark.createDataFrame(owners, names).write.parquet(f"{tmp_path}/customer.parquet")
    updated = record_queries.company_update(spark, str(tmp_path))
    # What is left to parse are the new captures; the facts of the old pages are stored.
    assert updated._jdf.queryExecution().optimizedPlan().toString().count("Generate inline(array(struct(page_text,") == 1
    found = {r.company_id: r for r in updated.collect()}
    assert sorted(found) == list(range(1, 49))
    # Number 24 is not crawled and keeps the hash of its old page, 16 gets that of its new one.
    kept = "Pro plan $ 25 per month Starter plan $33/month Pro EUR 1,299.50 per year Team &pound; 5"
    new = "Pro plan $ 17 per month Starter plan $25/month Pro EUR 1,299.50 per year Team &pound; 5"
    assert [found[i].last_crawl_at is None for i in (24, 16)] == [True, False]
    for i, text in ((24, kept), (16, new)):
        assert found[i].latest_content_hash == hashlib.sha256(text.lower().encode()).hexdigest()
