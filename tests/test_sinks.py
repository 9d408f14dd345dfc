"""Sinks, rejects and bounded metadata."""

import json

from pyspark.sql import functions as F

from tarifflens.operators import audit, crawl
from tarifflens.operators.intake import new_companies
from tarifflens.plans.feed import feed_documents, feed_pages
from tarifflens.plans.record_queries import _feed_inputs
from tarifflens.sources.fixtures import view
from tarifflens.sources.tables import append
from tests.conftest import SMALL


def test_append_by_day(spark, tmp_path):
    diffs = view(spark, SMALL, "diffs")
    append(diffs, str(tmp_path / "d"), day_of="detected_at")
    append(diffs, str(tmp_path / "d"), day_of="detected_at")
    assert spark.read.parquet(str(tmp_path / "d")).count() == 2 * diffs.count()


def test_a_busy_day_is_dealt_out(spark, tmp_path):
    """A day with nine tenths of the rows fills many files, a quiet one a single file, and a repeated batch replaces itself."""
    rows = spark.range(5000).withColumn("at", F.expr("if(id % 10 = 0, timestamp_ntz'2001-01-02 00:00:00', timestamp_ntz'2001-01-01 00:00:00')"))
    rows = rows.unionByName(spark.range(5000, 5003).withColumn("at", F.lit(None).cast("timestamp_ntz")))
    for _ in range(2):
        append(rows, str(tmp_path / "d"), day_of="at", commit="7", rows_per_file=500)
    assert spark.read.parquet(str(tmp_path / "d")).count() == 5003
    files = {p.name: len(list(p.glob("*.parquet"))) for p in (tmp_path / "d/commit=7").glob("day=*")}
    assert files.pop("day=2001-01-01") > 8 and all(n <= 2 for n in files.values()) and len(files) == 2


def test_audit_batches(spark, tmp_path):
    """Accepted and rejected events of a batch are written together, apart from each other and once only."""
    rows = [
        (1, "user", "a", "company", "1", "success", "2001-01-01"),
        (2, "ghost", "a", "company", "1", "success", "2001-01-01"),
        (3, "user", "x" * 121, "company", None, "failure", "2001-01-02"),
        (4, "cron", "a", None, "1", "done", None),
    ]
    schema = "id long, actor_type string, action string, resource_type string, resource_id string, status string, created_at string"
    events = spark.createDataFrame(rows, schema).withColumn("created_at", F.col("created_at").cast("timestamp_ntz"))
    for commit in ("1", "1", "2"):
        audit.append_audit(events.where("id < 4") if commit == "1" else events.where("id in (1, 4)"), str(tmp_path / "a"), commit)
    kept = audit.stored_audit(spark, str(tmp_path / "a"))
    assert [r.id for r in kept.orderBy("id").collect()] == [1, 1] and kept.columns == events.columns
    rejected = audit.stored_audit(spark, str(tmp_path / "a"), "rejected").orderBy("id").collect()
    assert [(r.id, r.reject_reason) for r in rejected] == [(2, "actor_type"), (3, "action"), (4, "status")]


def test_bad_audit_rows_go_aside(spark):
    rows = [("user", "a", "company", "1", "success"), ("ghost", "a", "company", "1", "success"), ("user", "x" * 121, "company", None, "failure")]
    df = spark.createDataFrame(rows, "actor_type string, action string, resource_type string, resource_id string, status string")
    good, bad = audit.accepted_and_rejected(df)
    assert (good.count(), bad.count()) == (1, 2)


def test_metadata_bounds(spark):
    wide = {f"k{i}": i for i in range(45)}
    cases = [{"a": "x" * 600}, wide, {"l": list(range(50))}, {"a": {"b": {"c": {"d": {"e": 1}, "f": 1}}}}, {"plain": 1}]
    df = spark.createDataFrame([(json.dumps(c),) for c in cases] + [("broken",), (None,)], "metadata string")
    got = [json.loads(r.metadata) for r in audit.clean_metadata(df).collect()]
    assert got[0]["a"] == "x" * 497 + "..."
    assert list(got[1]) == [f"k{i}" for i in range(40)]
    assert len(got[2]["l"]) == 40
    assert got[3] == {"a": {"b": {"c": {"d": {}, "f": 1}}}}
    assert got[4] == {"plain": 1} and got[5] == {} and got[6] == {}


def test_discovery_fills_the_source(spark):
    companies = spark.createDataFrame(
        [(1, "https://a.com", "a.com", None, []), (2, "https://b.com", "b.com", "https://b.com/p", [])],
        "company_id long, homepage_url string, domain string, primary_pricing_url string, "
        "pricing_url_candidates array<struct<url:string,confidence:double,selected_by_user:boolean>>",
    )
    homes = spark.createDataFrame([(1, '<a href="/pricing">Pricing</a>'), (2, "")], "company_id long, html string")
    found = {r.company_id: r for r in crawl.with_discovered_source(companies, homes).collect()}
    assert found[1].source_url == "https://a.com/pricing" and found[1].found_primary == "https://a.com/pricing"
    assert found[2].source_url == "https://b.com/p" and found[2].found_candidates is None


def test_pages_concatenate_to_the_feed(spark):
    inputs = _feed_inputs(spark, SMALL)
    whole = feed_pages(*inputs, limit=100).select("diff_id", "user_id", "position")
    first = feed_pages(*inputs, limit=4)
    cursors = first.where((F.col("position") == 4) & F.col("has_more")).select("user_id", "detected_at", "diff_id")
    second = feed_pages(*inputs, limit=4, cursors=cursors).join(cursors.select("user_id"), "user_id")
    joined = {r.diff_id for r in first.collect()} | {r.diff_id for r in second.collect()}
    assert joined == {r.diff_id for r in whole.where("position <= 8").collect()}
    assert "trust_cues" in feed_documents(first).columns


def test_new_companies_are_due(spark):
    df = spark.sql(
        "select 1L request_id, 2L user_id, 'competitor' type, 'N' clean_name, null homepage, "
        "'https://a.com/p?x=1' pricing, 'a.com' company_domain, cast(null as string) reject_reason"
    )
    row = new_companies(df, F.expr("timestamp_ntz'2001-08-01 00:00:00'")).first()
    assert str(row.next_crawl_at) == "2001-08-01 00:00:00"
    assert row.pricing_url_candidates[0].url == "https://a.com/p" and row.pricing_url_candidates[0].selected_by_user
