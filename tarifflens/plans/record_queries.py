"""Registered queries over records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarifflens import policies as P
from tarifflens.functions import prices, text
from tarifflens.functions.columns import count_where, floor_div, seconds_after
from tarifflens.functions.cursor import decode_cursor, encode_cursor
from tarifflens.operators import (
    activity,
    audit,
    billing,
    catalog,
    crawl,
    delivery,
    diffing,
    discovery,
    entitlements,
    history,
    insights,
    intake,
    ratelimit,
)
from tarifflens.operators.extraction import extract_pricing
from tarifflens.plans import comparison as comparing
from tarifflens.plans import digest as digests
from tarifflens.plans import feed as feeds
from tarifflens.plans import overview as overviews
from tarifflens.session import tune
from tarifflens.sources.fixtures import NOW, PLANS, view
from tarifflens.sources.stages import stored
from tarifflens.sources.tables import companies_of, public_json, spread, table


def _now() -> Column:
    return F.expr(f"timestamp_ntz'{NOW}'")


def _view(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return view(tune(spark), folder, name)


def _stamp(ts: str | Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")


def _snapshots(spark: SparkSession, folder: str) -> DataFrame:
    """One snapshot per company and month, built from its price rows."""
    rows = _view(spark, folder, "snapshot_prices")
    built = diffing.payload_from_prices(rows, ["company_id", "captured_at"])
    return built.withColumn(
        "snapshot_id", F.concat_ws("-", F.col("company_id").cast("string"), F.date_format("captured_at", "yyyyMM"))
    ).withColumn("is_verified", F.size("payload.price_mentions") >= 3)


def _diffs(spark: SparkSession, folder: str) -> DataFrame:
    return diffing.diff_snapshots(_snapshots(spark, folder))


# --- history and diffs -------------------------------------------------------------------


def snapshot_pairs(spark: SparkSession, folder: str) -> DataFrame:
    snaps = _view(spark, folder, "snapshot_prices").groupBy("company_id", "captured_at").agg(
        F.count(F.lit(1)).alias("price_count")
    )
    paired = history.with_previous(
        snaps, ["company_id"], ["captured_at"], ["captured_at", "price_count"], F.trunc(F.to_date("captured_at"), "year")
    )
    return paired.select(
        "company_id",
        _stamp("captured_at").alias("captured_at"),
        _stamp("previous_captured_at").alias("previous_captured_at"),
        "price_count",
        "previous_price_count",
    )


def hash_gate(spark: SparkSession, folder: str) -> DataFrame:
    captured = spread(_view(spark, folder, "document_captures")).select(
        "source", "capture_id", text.content_hash(text.squeeze(F.col("body"))).alias("content_hash")
    )
    gated = history.changed_only(
        captured, ["source"], ["capture_id"], "content_hash", floor_div(F.col("capture_id"), 4096)
    )
    return gated.select("source", "capture_id", "content_hash", "changed")


def latest_snapshot(spark: SparkSession, folder: str) -> DataFrame:
    snaps = _view(spark, folder, "snapshot_prices").groupBy("company_id", "captured_at").agg(
        F.count(F.lit(1)).alias("price_count")
    )
    last = history.newest(snaps, ["company_id"], [F.desc("captured_at")])
    return last.select("company_id", _stamp("captured_at").alias("captured_at"), "price_count")


def diff_buckets(spark: SparkSession, folder: str) -> DataFrame:
    rows = diffing.bucket_change_rows(_diffs(spark, folder), "company_id", "detected_at")
    joined = lambda c: F.array_join(F.transform(c, lambda x: F.format_string("%.2f", x)), "|")
    return rows.select(
        "company_id",
        _stamp("detected_at").alias("detected_at"),
        "currency",
        "period",
        joined("added_amounts").alias("added"),
        joined("removed_amounts").alias("removed"),
        F.size("updated_amounts").cast("bigint").alias("updated_count"),
    )


def diff_updates(spark: SparkSession, folder: str) -> DataFrame:
    rows = diffing.bucket_change_rows(_diffs(spark, folder), "company_id", "detected_at")
    return rows.select(
        "company_id", _stamp("detected_at").alias("detected_at"), "currency", "period", F.inline("updated_amounts")
    )


def diff_severity(spark: SparkSession, folder: str) -> DataFrame:
    d = F.col("normalized_diff")
    count = lambda f: diffing.total_of(d["price_changes"], f).cast("bigint")
    return _diffs(spark, folder).select(
        "company_id",
        _stamp("detected_at").alias("detected_at"),
        "severity",
        "verification_state",
        count("added_amounts").alias("added"),
        count("removed_amounts").alias("removed"),
        count("updated_amounts").alias("updated"),
        diffing.max_delta(d["price_changes"]).alias("max_delta"),
        d["previous_price_count"].cast("bigint").alias("previous_price_count"),
        d["current_price_count"].cast("bigint").alias("current_price_count"),
    )


def hint_changes(spark: SparkSession, folder: str) -> DataFrame:
    def payloads(name: str) -> DataFrame:
        return extract_pricing(spread(_view(spark, folder, name))).where("status = 'ok'").select("company_id", "payload")

    both = payloads("old_captures").withColumnRenamed("payload", "old").join(payloads("captures"), "company_id")
    found = both.select("company_id", diffing.pricing_diff(F.col("old"), F.col("payload")).alias("d"))
    return found.where(F.col("d").isNotNull()).select(
        "company_id",
        F.array_join("d.added_hints", "|").alias("added_hints"),
        F.array_join("d.removed_hints", "|").alias("removed_hints"),
        F.col("d.severity").alias("severity"),
    )


def stored_payloads(spark: SparkSession, folder: str) -> DataFrame:
    """Loose reading of stored JSON: event properties wrapped as a payload."""
    events = spread(table(tune(spark), folder, "events"))
    json = F.format_string(
        '{"sourceUrl":"https://e.example/%d","planNames":[" Plan  %s",7,"plan %s"],"priceMentions":['
        '{"amount":"%.2f","currency":"usd","period":"month"},{"amount":%.3f,"currency":"EUR","period":"year"},'
        '{"amount":-1,"currency":"EUR","period":"year"},{"amount":true,"currency":"GBP","period":"day"},{"amount":5,"currency":"GBP","period":"decade"}]}',
        "event_id", "event_type", "event_type", "value", "value",
    )
    read = events.select("event_id", prices.lenient_payload(json).alias("p"))
    return read.select(
        "event_id",
        "p.source_url",
        F.array_join("p.plan_names", "|").alias("plan_names"),
        F.array_join(
            F.transform("p.price_mentions", lambda m: F.format_string("%s %s %.2f", m["currency"], m["period"], m["amount"])), "|"
        ).alias("prices"),
    )


# --- entitlements and insights ----------------------------------------------------------------


def entitlement_states(spark: SparkSession, folder: str) -> DataFrame:
    resolved = entitlements.with_entitlements(_view(spark, folder, "users"), PLANS, _now())
    return resolved.select(
        "user_id",
        "access_granted",
        "access_source",
        "access_state",
        "plan_tier",
        F.col("competitor_limit").cast("bigint").alias("competitor_limit"),
        "insight_gate",
        F.array_join("allowed_severities", "|").alias("allowed_severities"),
        "can_receive_digest",
    )


def trial_refresh(spark: SparkSession, folder: str) -> DataFrame:
    return entitlements.refresh_trials(_view(spark, folder, "users"), _now()).select(
        "user_id", "trial_status", "trial_changed"
    )


def trial_start(spark: SparkSession, folder: str) -> DataFrame:
    return entitlements.start_trials(_view(spark, folder, "users"), _now()).select(
        "user_id", "reason", "started", "changed", "trial_status",
        _stamp("trial_started_at").alias("trial_started_at"), _stamp("trial_ends_at").alias("trial_ends_at"),
    )


def price_insights(spark: SparkSession, folder: str) -> DataFrame:
    owned = _diffs(spark, folder).withColumn("user_id", F.col("company_id"))
    owners = entitlements.with_entitlements(_view(spark, folder, "users"), PLANS, _now()).select(
        "user_id", "access_granted", "insight_gate", "allowed_severities"
    )
    built = insights.build_insights(owned.join(owners, "user_id"), _now())
    r = F.col("recommendation")
    return built.select(
        "company_id", "current_snapshot_id", "model", "severity_gate", "feedback",
        r["headline"].alias("headline"), r["summary"].alias("summary"), r["risk"].alias("risk"),
        r["verification_state"].alias("verification_state"),
        F.array_join(r["action_items"], "|").alias("action_items"),
    )


# --- crawl cycle -----------------------------------------------------------------------------------


def due_queue(spark: SparkSession, folder: str) -> DataFrame:
    return crawl.due_queue(_view(spark, folder, "companies"), _now(), P.MAX_CRAWL_LIMIT).select(
        "company_id", "user_id", _stamp("next_crawl_at").alias("next_crawl_at")
    )


def lease_claims(spark: SparkSession, folder: str) -> DataFrame:
    return crawl.claim(_view(spark, folder, "companies"), _now(), P.MAX_CRAWL_LIMIT).select(
        "company_id", "claimed", _stamp("crawl_lease_until").alias("crawl_lease_until")
    )


def _crawl(spark: SparkSession, folder: str, search: bool = False) -> tuple[DataFrame, DataFrame]:
    """All due page companies crawled once, after a crawl of the day before; with ``search``, home pages are searched too."""
    old = extract_pricing(spread(_view(spark, folder, "old_captures"))).where("status = 'ok'")
    # Companies, the queue, its gates and the snapshots all read these facts: the pages are parsed once for all of them.
    before = stored(old.select("company_id", "content_hash", "payload"))
    yesterday = seconds_after(_now(), -86400)
    snapshots = before.select(
        "company_id", F.concat(F.col("company_id").cast("string"), F.lit("-old")).alias("snapshot_id"),
        yesterday.alias("captured_at"), "payload",
    )
    companies = _view(spark, folder, "page_companies").join(
        before.select("company_id", F.col("content_hash").alias("latest_content_hash")), "company_id", "left"
    )
    due = crawl.due_queue(companies, _now(), None)
    homepages = None
    if search:
        none = F.lit(None).cast(discovery.CANDIDATE_TYPE)
        due = due.withColumns({"domain": F.lit(None).cast("string"), "pricing_url_candidates": none})
        homepages = spread(_view(spark, folder, "homepages")).select(F.col("page_id").alias("company_id"), "html")
    outcomes = crawl.crawl_outcomes(
        due, _view(spark, folder, "users"), PLANS, spread(_view(spark, folder, "captures")), snapshots, _now(), homepages
    )
    return companies, outcomes


def _candidate_text(candidates: str) -> Column:
    """Candidates as one text: address, confidence and choice of each."""
    return F.array_join(
        F.transform(
            candidates,
            lambda c: F.concat_ws(" ", c["url"], F.format_string("%.2f", c["confidence"]), c["selected_by_user"].cast("string")),
        ),
        "|",
    )


def crawl_discovery(spark: SparkSession, folder: str) -> DataFrame:
    """The crawl of companies without a pricing page, which search their home pages first."""
    searched = _crawl(spark, folder, search=True)[1].where("found_candidates is not null")
    return searched.select(
        "company_id", "found_primary", _candidate_text("found_candidates").alias("candidates"), "status", "error",
        "snapshot_created", _stamp("next_crawl_at").alias("next_crawl_at"),
    )


def crawl_outcome(spark: SparkSession, folder: str) -> DataFrame:
    return _crawl(spark, folder)[1].select(
        "company_id", "user_id", "status", "error", "skipped_by_hash", "changed", "diff_created", "insight_created",
        "severity", "confidence", _stamp("next_crawl_at").alias("next_crawl_at"),
    )


def crawl_summary(spark: SparkSession, folder: str) -> DataFrame:
    return crawl.run_summary(_crawl(spark, folder)[1])


def company_update(spark: SparkSession, folder: str) -> DataFrame:
    companies, outcomes = _crawl(spark, folder)
    typed = (
        companies.withColumn("last_crawl_at", F.lit(None).cast("timestamp_ntz"))
        .withColumn("last_crawl_error", F.lit("old error"))
        .withColumn("latest_confidence", F.lit(0.5))
    )
    return crawl.updated_companies(typed, outcomes).select(
        "company_id", "last_crawl_status", "last_crawl_error", "latest_content_hash", "latest_confidence",
        _stamp("last_crawl_at").alias("last_crawl_at"), _stamp("next_crawl_at").alias("next_crawl_at"),
        _stamp("crawl_lease_until").alias("crawl_lease_until"),
    )


def crawl_audit(spark: SparkSession, folder: str) -> DataFrame:
    mapped = audit.lifecycle_events(crawl.crawl_audit(_crawl(spark, folder)[1]))
    return mapped.select("user_id", "actor_type", "action", "resource_type", "resource_id", "status")


def crawl_new_snapshots(spark: SparkSession, folder: str) -> DataFrame:
    """Snapshots that the crawl appends."""
    return crawl.new_snapshots(_crawl(spark, folder)[1]).select(
        "snapshot_id", "user_id", "company_id", "content_hash", "confidence", _stamp("captured_at").alias("captured_at")
    )


def crawl_new_diffs(spark: SparkSession, folder: str) -> DataFrame:
    """Diffs that the crawl appends."""
    return crawl.new_diffs(_crawl(spark, folder)[1]).select(
        "diff_id", "user_id", "company_id", "previous_snapshot_id", "current_snapshot_id", "severity",
        _stamp("detected_at").alias("detected_at"),
    )


def crawl_new_insights(spark: SparkSession, folder: str) -> DataFrame:
    """Insights that the crawl appends."""
    return crawl.new_insights(_crawl(spark, folder)[1], _now()).select(
        "diff_id", "user_id", "company_id", "model", F.col("recommendation.severity").alias("severity")
    )


def _commands(spark: SparkSession, folder: str) -> DataFrame:
    return table(tune(spark), folder, "orders").selectExpr(
        "o_orderkey as command_id",
        "case when o_orderkey % 2 = 0 then 'crawl-now' else 'retry-crawl' end as command",
        "o_custkey % 110 as company_id",
        "case when o_orderkey % 10 = 0 then 7 else o_custkey % 110 % 20 end as user_id",
    )


def crawl_commands(spark: SparkSession, folder: str) -> DataFrame:
    done = crawl.crawl_commands(_commands(spark, folder), _view(spark, folder, "companies"), _now())
    return done.select(
        "command_id", "command", "company_id", "accepted", "reject_reason", _stamp("next_crawl_at").alias("next_crawl_at"),
        "lease_state", "lease_cleared", _stamp("crawl_lease_until").alias("crawl_lease_until"), "last_crawl_status", "last_crawl_error",
    )


# --- read models -------------------------------------------------------------------------------------


def _feed_rows(page: DataFrame) -> DataFrame:
    return page.select(
        "user_id", F.col("position").cast("bigint").alias("position"), "diff_id", "company_id", "company_name",
        "severity", "verification_state", _stamp("detected_at").alias("detected_at"), "insight_id",
        _stamp("insight_generated_at").alias("insight_generated_at"), "insight_gate", "last_crawl_status",
        "latest_confidence", "has_more", "next_cursor",
    )


def _feed_inputs(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return tuple(_view(spark, folder, n) for n in ("diffs", "companies", "insights"))


def feed_page(spark: SparkSession, folder: str) -> DataFrame:
    return _feed_rows(feeds.feed_pages(*_feed_inputs(spark, folder)))


def feed_documents(spark: SparkSession, folder: str) -> DataFrame:
    """The first page as nested response rows."""
    return feeds.feed_documents(feeds.feed_pages(*_feed_inputs(spark, folder))).select(
        "user_id", F.col("position").cast("bigint").alias("position"), "diff_id", "company.name",
        F.col("company.last_crawl_status").alias("status"), "latest_insight.insight_id", "latest_insight.severity_gate",
        F.col("trust_cues.verification_state").alias("verification_cue"),
        _stamp("trust_cues.detected_at").alias("detected_cue"), "has_more", "next_cursor",
    )


def feed_next_page(spark: SparkSession, folder: str) -> DataFrame:
    """Second page of high-severity changes, from the cursor of the first page."""
    first = feeds.feed_pages(*_feed_inputs(spark, folder), limit=5, severity="high")
    cursors = first.where(F.col("position") == 5).select(
        "user_id", decode_cursor(F.col("next_cursor")).alias("c")
    ).select("user_id", "c.detected_at", F.col("c.id").cast("bigint").alias("diff_id"))
    known = cursors.where(F.col("detected_at").isNotNull())
    return _feed_rows(feeds.feed_pages(*_feed_inputs(spark, folder), limit=5, severity="high", cursors=known))


def feed_strict(spark: SparkSession, folder: str) -> DataFrame:
    """The page that limits before it matches companies, so it can be short."""
    page = feeds.feed_pages(*_feed_inputs(spark, folder), verification_state="verified", strict_reference=True)
    return _feed_rows(page).drop("has_more", "next_cursor")


def feed_cursors(spark: SparkSession, folder: str) -> DataFrame:
    coded = spread(_view(spark, folder, "diffs")).select(
        "diff_id", encode_cursor(F.col("detected_at"), F.col("diff_id")).alias("cursor")
    )
    back = coded.withColumn("d", decode_cursor(F.col("cursor")))
    return back.select("diff_id", "cursor", F.col("d.id").alias("decoded_id"), _stamp("d.detected_at").alias("decoded_at"))


def overview(spark: SparkSession, folder: str) -> DataFrame:
    shown = overviews.overview(
        _view(spark, folder, "users"), PLANS, _view(spark, folder, "companies"), _view(spark, folder, "diffs"), _now()
    )
    return shown.select(
        "user_id", "access_state", "plan_tier", "trial_status", "trial_active", "self_count", "competitor_count", "total_count",
        *["status_" + s for s in P.CRAWL_STATUSES], *["changes_" + s for s in P.SEVERITIES], "changes_total",
    )


def _stored_snapshots(spark: SparkSession, folder: str) -> DataFrame:
    """Snapshots as stored JSON, with texts in the ragged form the reader has to clean."""
    rows = _view(spark, folder, "snapshot_prices")
    point = F.struct(
        F.concat(F.lit(" "), F.lower("currency")).alias("currency"),
        F.initcap("period").alias("period"),
        (F.col("amount") - 20).alias("amount"),
    )
    grouped = rows.groupBy("company_id", "captured_at").agg(F.array_sort(F.collect_list(point)).alias("priceMentions"))
    return grouped.select(
        F.concat_ws("-", F.col("company_id").cast("string"), F.date_format("captured_at", "yyyyMM")).alias("snapshot_id"),
        "company_id",
        "captured_at",
        F.lit(0.9).alias("confidence"),
        (F.size("priceMentions") >= 3).alias("is_verified"),
        F.to_json(F.struct("priceMentions")).alias("payload_json"),
    )


def comparison(spark: SparkSession, folder: str) -> DataFrame:
    compared = comparing.comparison(_view(spark, folder, "companies"), _stored_snapshots(spark, folder))
    return comparing.by_name(compared).select(
        "user_id", "company_id", "name", "domain", "primary_pricing_url", "blocked_or_manual_needed", "last_crawl_error",
        "latest_confidence", "snapshot_id", _stamp("captured_at").alias("captured_at"), "is_verified",
        F.array_size("price_points").cast("bigint").alias("point_count"),
    )


def comparison_buckets(spark: SparkSession, folder: str) -> DataFrame:
    return comparing.comparison_buckets(
        comparing.comparison(_view(spark, folder, "companies"), _stored_snapshots(spark, folder))
    )


def comparison_own_prices(spark: SparkSession, folder: str) -> DataFrame:
    """The comparison with the user's own price list beside it."""
    compared = comparing.comparison(_view(spark, folder, "companies"), _stored_snapshots(spark, folder))
    own = F.col("own_price_list")
    return comparing.with_own_prices(compared, _price_lists(spark, folder)).select(
        "user_id", "company_id", "snapshot_id", own["currency"].alias("own_currency"),
        own["billing_period"].alias("own_period"), own["notes"].alias("own_notes"),
        F.size(own["plans"]).cast("bigint").alias("own_plan_count"),
    )


def public_users(spark: SparkSession, folder: str) -> DataFrame:
    shown = public_json(_view(spark, folder, "users"))
    field = lambda name: F.get_json_object("body", "$." + name).alias(name)
    return shown.select("id", field("name"), field("trial_status"), field("price_id"), field("email"))


def company_listing(spark: SparkSession, folder: str) -> DataFrame:
    return companies_of(_view(spark, folder, "companies")).select(
        "user_id", "company_id", "name", _stamp("created_at").alias("created_at")
    )


# --- digest ---------------------------------------------------------------------------------------------

_DIGEST_DAYS, _DIGEST_SIZE = 90, 10


def _digest(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return digests.weekly_digest(
        _view(spark, folder, "users"), PLANS, _view(spark, folder, "diffs"), _view(spark, folder, "companies"),
        _now(), _DIGEST_DAYS, _DIGEST_SIZE,
    )


def digest_rows(spark: SparkSession, folder: str) -> DataFrame:
    kept = digests.digest_diffs(_view(spark, folder, "diffs"), _now(), P.DIGEST_LOOKBACK_DAYS, P.DIGEST_MAX_DIFFS)
    return kept.select(
        "user_id", F.col("position").cast("bigint").alias("position"), "diff_id", "company_id", "severity",
        _stamp("detected_at").alias("detected_at"),
    )


def digest_text(spark: SparkSession, folder: str) -> DataFrame:
    return _digest(spark, folder)[0]


def digest_marked(spark: SparkSession, folder: str) -> DataFrame:
    """Users after the digest has gone out."""
    marked = digests.mark_sent(_view(spark, folder, "users"), _digest(spark, folder)[0], _now())
    return marked.select("user_id", _stamp("last_digest_sent_at").alias("last_digest_sent_at"))


def digest_funnel(spark: SparkSession, folder: str) -> DataFrame:
    return digests.digest_funnel(_digest(spark, folder)[1])


# --- user input ------------------------------------------------------------------------------------------------


def _admitted(spark: SparkSession, folder: str) -> DataFrame:
    users = entitlements.with_entitlements(
        entitlements.refresh_trials(_view(spark, folder, "users"), _now()), PLANS, _now()
    )
    return intake.admit_companies(spread(_view(spark, folder, "intake")), users, _view(spark, folder, "companies"))


def company_intake(spark: SparkSession, folder: str) -> DataFrame:
    return _admitted(spark, folder).select("request_id", "user_id", "type", "homepage", "pricing", "company_domain", "reject_reason")


def new_companies(spark: SparkSession, folder: str) -> DataFrame:
    """Rows that admitted requests append, with what their home pages offer."""
    sites = spread(_view(spark, folder, "site_captures")).select(F.col("homepage_url").alias("homepage"), "html")
    made = intake.new_companies(_admitted(spark, folder), _now(), sites)
    return made.select(
        "request_id", "user_id", "name", "type", "domain", "homepage_url", "primary_pricing_url",
        _candidate_text("pricing_url_candidates").alias("candidates"), _stamp("next_crawl_at").alias("next_crawl_at"),
    )


def _selected(spark: SparkSession, folder: str) -> DataFrame:
    site = F.concat(F.lit("c"), F.col("company_id").cast("string"), F.lit(".example.com"))
    candidate = lambda url, c: F.struct(
        url.alias("url"), F.lit(c).alias("confidence"), F.lit(False).alias("selected_by_user")
    )
    companies = _view(spark, folder, "companies").withColumn(
        "pricing_url_candidates",
        F.array(
            candidate(F.concat(F.lit("https://"), site, F.lit("/plans")), 0.6),
            candidate(F.concat(F.lit("http://WWW."), site, F.lit("//pricing#top")), 0.4),
        ),
    )
    n = F.col("command_id") % 6
    commands = spread(_commands(spark, folder)).select(
        "command_id", "company_id", "user_id",
        F.when(n == 0, F.concat(site, F.lit("/cost?x=1")))
        .when(n == 1, F.lit("https://foreign.example.org/pricing"))
        .when(n == 2, F.lit("ftp://files.example.com"))
        .when(n == 5, F.lit("https://both.example.org")).alias("url"),
        F.when(n.isin(3, 5), F.concat(F.lit(" http://"), site, F.lit("/pricing ")))
        .when(n == 4, F.concat(F.lit("https://"), site, F.lit("/unlisted"))).alias("candidate_url"),
    )
    return intake.select_primary(commands, companies)


def primary_selection(spark: SparkSession, folder: str) -> DataFrame:
    done = _selected(spark, folder)
    return done.select(
        "command_id", "company_id", "accepted", "reject_reason", "primary_pricing_url", "primary_changed",
        F.array_join(
            F.transform(
                "pricing_url_candidates",
                lambda c: F.format_string("%s %.2f %s", c["url"], c["confidence"], c["selected_by_user"].cast("string")),
            ),
            "|",
        ).alias("candidates"),
    )


def _price_list_changes(spark: SparkSession, folder: str) -> DataFrame:
    lines = _view(spark, folder, "plan_lines")
    plan = F.struct(
        "position", "name", "price", "price_anchor", F.array().cast("array<string>").alias("highlights")
    )
    grouped = lines.groupBy("change_id", "user_id", "currency", "billing_period", "notes").agg(
        F.array_sort(F.collect_list(plan)).alias("plans")
    )
    return grouped.withColumn("changed_at", F.col("change_id")).withColumn(
        "plans", F.transform("plans", lambda p: p.dropFields("position"))
    )


def price_list_checks(spark: SparkSession, folder: str) -> DataFrame:
    checked = intake.checked_price_lists(_price_list_changes(spark, folder))
    return checked.select(
        "change_id", "valid", "currency", "billing_period", F.size("plans").cast("bigint").alias("plan_count")
    )


def _price_lists(spark: SparkSession, folder: str) -> DataFrame:
    changes = _price_list_changes(spark, folder)
    existing = _view(spark, folder, "users").select(
        "user_id", F.lit("GBP").alias("currency"), F.lit("custom").alias("billing_period"),
        F.array().cast(changes.schema["plans"].dataType).alias("plans"), F.lit("kept").alias("notes"),
    )
    return intake.upsert_price_lists(existing, changes)


def price_list_upsert(spark: SparkSession, folder: str) -> DataFrame:
    return _price_lists(spark, folder).select("user_id", "currency", "billing_period", "notes", F.size("plans").cast("bigint").alias("plan_count"))


# --- billing, deliveries, limits -----------------------------------------------------------------------------------


def billing_state(spark: SparkSession, folder: str) -> DataFrame:
    states = billing.account_states(_view(spark, folder, "users"), _view(spark, folder, "billing_events"), PLANS)
    return states.select("user_id", "has_access", "price_id", "customer_id", "trial_status")


def billing_accounts(spark: SparkSession, folder: str) -> DataFrame:
    """All accounts after a journal whose checkouts also find accounts by e-mail and create new ones."""
    states = billing.account_states(_view(spark, folder, "users"), _view(spark, folder, "billing_journal"), PLANS)
    return states.select("user_id", "email", "has_access", "price_id", "customer_id", "trial_status")


def billing_effects(spark: SparkSession, folder: str) -> DataFrame:
    effects = billing.with_event_effect(_view(spark, folder, "billing_events"), PLANS)
    return effects.groupBy("event_type", "effect").agg(
        F.count(F.lit(1)).alias("events"), count_where(F.col("known_price").isNotNull()).alias("with_price")
    )


def _checkouts(spark: SparkSession, folder: str) -> DataFrame:
    return table(tune(spark), folder, "orders").selectExpr(
        "o_orderkey as checkout_id",
        "case when o_orderkey % 3 = 0 then null when o_orderkey % 3 = 1 then o_custkey else o_custkey + 1000000 end as client_reference_id",
        "case when o_orderkey % 4 = 0 then null when o_orderkey % 4 = 1 then concat(' U', cast(o_custkey as string), '@Example.com ') else concat('new', cast(o_custkey as string), '@example.com') end as customer_email",
        "case o_orderkey % 3 when 0 then 'price_pro' when 1 then 'price_unknown' else 'price_starter' end as price_id",
        "case when o_orderkey % 7 <> 0 then concat('cus_n', cast(o_custkey as string)) end as customer_id",
    )


def checkout_matching(spark: SparkSession, folder: str) -> DataFrame:
    resolved, _ = billing.checkout_users(_checkouts(spark, folder), _view(spark, folder, "users"))
    return resolved.select("checkout_id", "user_id", "matched_by", "normalized_email")


def billing_new_users(spark: SparkSession, folder: str) -> DataFrame:
    """Accounts created by checkouts that match no user."""
    resolved, _ = billing.checkout_users(_checkouts(spark, folder), _view(spark, folder, "users"))
    return billing.new_users(resolved, PLANS)


def _deliveries(spark: SparkSession, folder: str) -> DataFrame:
    events = _view(spark, folder, "billing_events").select("event_id", "arrived_at", "event_type")
    repeated = F.col("event_type").isin("invoice.paid", "customer.subscription.deleted")
    copies = F.when(repeated, F.array(F.lit(0), F.lit(1), F.lit(2))).otherwise(F.array(F.lit(0)))
    each = events.withColumn("copy", F.explode(copies))
    # Fixed values of the fixture: copies come 2 and 10 minutes later.
    delay = F.when(F.col("copy") == 1, F.lit(120)).when(F.col("copy") == 2, F.lit(600)).otherwise(F.lit(0))
    turn = (F.col("event_id") + F.col("copy")) % 3
    arrived = seconds_after(F.col("arrived_at"), delay)
    # Some workers overrun the lock of five minutes: one is done before the last copy comes, one after it.
    late = F.col("event_id") % 7
    busy = F.when(late == 3, F.lit(400)).when(late == 4, F.lit(700)).otherwise(F.lit(2))
    return each.select(
        (F.col("event_id") * 3 + F.col("copy")).alias("delivery_id"),
        "event_id",
        arrived.alias("arrived_at"),
        F.when(turn == 0, F.lit("processed")).when(turn == 1, F.lit("failed")).otherwise(F.lit("lost")).alias("result"),
        F.when(turn < 2, seconds_after(arrived, busy)).alias("finished_at"),
    )


def event_delivery(spark: SparkSession, folder: str) -> DataFrame:
    return delivery.handle_deliveries(_deliveries(spark, folder))


def rate_limit(spark: SparkSession, folder: str) -> DataFrame:
    decided = ratelimit.limit_requests(_view(spark, folder, "requests"), 2, 86400)
    return decided.select(
        "request_id", "key", "allowed", "remaining", "retry_after_seconds",
        _stamp("window_started_at").alias("window_started_at"), _stamp("reset_at").alias("reset_at"),
    )


def request_budgets(spark: SparkSession, folder: str) -> DataFrame:
    """Requests of a few busy actors against the budgets of the web interface."""
    names = F.array(*[F.lit(name) for name in P.REQUEST_BUDGETS])
    requests = table(tune(spark), folder, "events").select(
        F.col("event_id").alias("request_id"),
        F.get(names, (F.col("event_id") % len(P.REQUEST_BUDGETS)).cast("int")).alias("budget"),
        (F.col("user_id") % 5).alias("actor"),
        seconds_after(F.date_trunc("day", "ts").cast("timestamp_ntz"), F.col("event_id") % 90).alias("ts"),
    )
    return ratelimit.limit_by_budget(requests, P.REQUEST_BUDGETS).select(
        "request_id", "key", "allowed", "remaining", "retry_after_seconds",
        _stamp("window_started_at").alias("window_started_at"), _stamp("reset_at").alias("reset_at"),
    )


# --- audit and catalog ---------------------------------------------------------------------------------------------


def audit_log(spark: SparkSession, folder: str) -> DataFrame:
    mapped = audit.lifecycle_events(_view(spark, folder, "audit_input"))
    kept, _ = audit.accepted_and_rejected(mapped)
    return kept.select("event_id", "user_id", "actor_type", "action", "resource_type", "resource_id", "status")


def activity_log(spark: SparkSession, folder: str) -> DataFrame:
    """Audit rows of what users and the payment provider did, from the results of intake, choice, trials and billing."""
    users = _view(spark, folder, "users")
    acting = billing.acting_events(users, _view(spark, folder, "billing_journal"), PLANS)[1]
    events = activity.together(
        activity.intake_activity(_admitted(spark, folder)),
        activity.selection_activity(_selected(spark, folder), _now()),
        activity.trial_activity(entitlements.start_trials(users, _now()), _now()),
        activity.billing_activity(acting),
    )
    kept, _ = audit.accepted_and_rejected(audit.lifecycle_events(events))
    return kept.select(
        "user_id", "actor_type", "action", "resource_type", "resource_id", "status", "metadata", _stamp("created_at").alias("created_at")
    )


def audit_rejects(spark: SparkSession, folder: str) -> DataFrame:
    """Audit events that the sink puts aside: of unknown types, with bad names and over-long ids."""
    n = F.col("event_id")
    mapped = audit.lifecycle_events(
        _view(spark, folder, "audit_input").withColumn("event_type", F.when(n % 50 == 0, F.lit("unheard_of")).otherwise(F.col("event_type")))
    )
    spoiled = mapped.withColumns(
        {
            "action": F.when(n % 50 == 1, F.lit("")).when(n % 50 == 2, F.repeat(F.lit("x"), F.lit(121))).otherwise(F.col("action")),
            "resource_id": F.when(n % 50 == 3, F.repeat(F.col("resource_id"), F.lit(130))).when(n % 50 > 3, F.col("resource_id")),
        }
    )
    return audit.accepted_and_rejected(spoiled)[1].select("event_id", "user_id", "action", "status", "reject_reason")


def audit_clean(spark: SparkSession, folder: str) -> DataFrame:
    """Metadata with a whole document text in it."""
    docs = spread(table(tune(spark), folder, "documents"))
    packed = docs.select(
        "doc_id",
        F.to_json(F.struct("text", "lang", F.struct(F.struct(F.struct(F.struct("doc_id").alias("d")).alias("c")).alias("b")).alias("a"))).alias("metadata"),
    )
    cleaned = audit.clean_metadata(packed)
    field = lambda path: F.get_json_object("metadata", path)
    return cleaned.select(
        "doc_id", field("$.text").alias("text"), field("$.lang").alias("lang"), field("$.a.b.c").alias("deep"),
    )


def _articles(spark: SparkSession, folder: str) -> DataFrame:
    return _view(spark, folder, "articles").withColumn("tags", F.array("lang", "author"))


def catalog_related(spark: SparkSession, folder: str) -> DataFrame:
    return catalog.related_articles(_articles(spark, folder))


def catalog_categories(spark: SparkSession, folder: str) -> DataFrame:
    heads = catalog.newest_per_category(_articles(spark, folder))
    return heads.select("tag", F.col("rank").cast("bigint").alias("rank"), "article_id")


def catalog_latest(spark: SparkSession, folder: str) -> DataFrame:
    return catalog.latest_articles(_articles(spark, folder)).select("article_id", "author")


def catalog_by_author(spark: SparkSession, folder: str) -> DataFrame:
    return catalog.by_author(_articles(spark, folder)).select("author", "article_id")


RECORD_QUERIES = {
    f.__name__: f
    for f in (
        snapshot_pairs, hash_gate, latest_snapshot, diff_buckets, diff_updates, diff_severity, hint_changes, stored_payloads,
        entitlement_states, trial_refresh, trial_start, price_insights,
        due_queue, lease_claims, crawl_outcome, crawl_discovery, crawl_summary, company_update, crawl_audit, crawl_commands,
        crawl_new_snapshots, crawl_new_diffs, crawl_new_insights, feed_documents, comparison_own_prices, digest_marked,
        feed_page, feed_next_page, feed_strict, feed_cursors, overview, comparison, comparison_buckets, public_users, company_listing,
        digest_rows, digest_text, digest_funnel,
        company_intake, new_companies, primary_selection, price_list_checks, price_list_upsert,
        billing_state, billing_accounts, billing_effects, checkout_matching, billing_new_users, event_delivery, rate_limit, request_budgets,
        audit_log, activity_log, audit_rejects, audit_clean, catalog_related, catalog_categories, catalog_latest, catalog_by_author,
    )
}
