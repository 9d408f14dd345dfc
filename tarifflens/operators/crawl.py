"""The crawl cycle: who is due, what happened, what to store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarifflens import policies as P
from tarifflens.functions.columns import computed_once, count_where, first_true, seconds_after
from tarifflens.functions.text import shorten
from tarifflens.operators.discovery import discover_pricing_urls, merge_candidates
from tarifflens.operators.diffing import pricing_diff, verification
from tarifflens.operators.entitlements import Plans, with_entitlements
from tarifflens.operators.extraction import extract_pricing
from tarifflens.operators.history import newest
from tarifflens.operators.insights import build_insights


def batch_limit(
    limit: float | None = None, default: int = P.DEFAULT_CRAWL_LIMIT, most: int | None = P.MAX_CRAWL_LIMIT
) -> int:
    """The limit of a web request: floored, and capped at ``most``; the default is used as it is.

    Batch jobs pass their limit to ``due_queue`` as it is, or ``None`` for every due company.
    """
    if not limit or limit != limit or limit == float("inf") or limit <= 0:
        return default
    return int(limit) if most is None else min(int(limit), most)


def is_due(now: Column) -> Column:
    """Competitor, due and not leased (F4, F5).  A missing due time counts as due."""
    due = F.col("next_crawl_at").isNull() | (F.col("next_crawl_at") <= now)
    free = F.col("crawl_lease_until").isNull() | (F.col("crawl_lease_until") <= now)
    return (F.col("type") == "competitor") & due & free


def due_queue(companies: DataFrame, now: Column, limit: int | None) -> DataFrame:
    """Due companies, longest waiting first (W8); ``None`` takes every due company."""
    due = companies.where(is_due(now))
    if limit is None:
        return due
    return due.orderBy(F.asc_nulls_first("next_crawl_at"), F.asc_nulls_first("updated_at"), "company_id").limit(limit)


def claim(companies: DataFrame, now: Column, limit: int | None, crawls: P.CrawlPolicy = P.CRAWLS) -> DataFrame:
    """Companies with the lease of the claimed ones set."""
    taken = due_queue(companies, now, limit).select("company_id", F.lit(True).alias("claimed"))
    joined = companies.join(taken, "company_id", "left").withColumn("claimed", F.coalesce("claimed", F.lit(False)))
    lease = seconds_after(now, crawls.lease)
    return joined.withColumn(
        "crawl_lease_until", F.when(F.col("claimed"), lease).otherwise(F.col("crawl_lease_until"))
    )


def next_crawl_at(status: Column, now: Column, crawls: P.CrawlPolicy = P.CRAWLS) -> Column:
    """When to look again."""
    delay = first_true([(status == s, getattr(crawls, s)) for s in ("blocked", "manual_needed", "error")], crawls.ok)
    return seconds_after(now, delay)


def with_discovered_source(
    companies: DataFrame, homepages: DataFrame | None, links: P.LinkPolicy = P.LINKS
) -> DataFrame:
    """Add ``source_url``; companies without one try their captured home page first.

    ``homepages``: ``company_id, html``.  Also adds what the search found, for storing.
    """
    if homepages is None:
        return companies.withColumn("source_url", F.col("primary_pricing_url"))
    searching = F.col("primary_pricing_url").isNull() & F.col("homepage_url").isNotNull()
    wanted = companies.where(searching).select(
        "company_id", "homepage_url", F.col("domain").alias("allowed_domain")
    )
    found = discover_pricing_urls(wanted.join(homepages.select("company_id", "html"), "company_id"), links=links).select(
        "company_id", F.col("candidates").alias("_found"), F.col("recommended_primary_url").alias("found_primary")
    )
    joined = companies.join(found, "company_id", "left")
    return (
        joined.withColumn(
            "found_candidates",
            F.when(searching, merge_candidates(F.col("pricing_url_candidates"), F.col("_found"))),
        )
        .withColumn("source_url", F.coalesce("primary_pricing_url", "found_primary"))
        .drop("_found")
    )


def crawl_outcomes(
    companies: DataFrame,
    users: DataFrame,
    plans: Plans,
    captures: DataFrame,
    snapshots: DataFrame,
    now: Column,
    homepages: DataFrame | None = None,
    max_chars: int | None = None,
    *,
    links: P.LinkPolicy = P.LINKS,
    pages: P.PagePolicy = P.PAGES,
    crawls: P.CrawlPolicy = P.CRAWLS,
    tiers: P.TierPolicy = P.TIERS,
) -> DataFrame:
    """One row per crawled company with everything the cycle decided.

    ``captures``: the fetched page per company (``company_id, source_url, http_status,
    content_type, html``).  ``snapshots``: earlier snapshots.  Pages are read where they are
    scanned and only the small facts travel to the company; downstream tables are filters of
    the result, so it is worth persisting once.
    """
    owners = with_entitlements(users, plans, now, tiers).select(
        "user_id", F.lit(True).alias("owner_found"), "access_granted", "insight_gate", "allowed_severities"
    )
    located = with_discovered_source(companies, homepages, links)
    extra = [c for c in ("found_candidates", "found_primary") if c in located.columns]
    owned = located.select("company_id", "user_id", "latest_content_hash", "source_url", *extra).join(
        owners, "user_id", "left"
    )
    no_url, no_owner = F.col("source_url").isNull(), F.col("owner_found").isNull()
    no_access = ~F.coalesce(F.col("access_granted"), F.lit(False))
    # Gates come before parsing: only pages of companies that pass all of them are read.
    admitted = owned.where(~(no_url | no_owner | no_access)).select("company_id")
    facts = extract_pricing(captures.join(admitted, "company_id", "left_semi"), max_chars, pages).select(
        "company_id", "status", "error", "confidence", "content_hash", "payload", "is_verified"
    )
    base = owned.join(facts, "company_id", "left")
    judged = computed_once(
        base,
        final_status=first_true(
            [(no_url, "manual_needed"), (no_owner, "error"), (no_access, "idle")],
            F.coalesce("status", F.lit("error")),
        ),
        final_error=first_true(
            [(no_url, P.TEXT_NO_URL), (no_owner, P.TEXT_NO_USER), (no_access, P.TEXT_NOT_ELIGIBLE)],
            F.when(F.col("status").isNull(), F.lit(P.TEXT_NO_FETCH)).otherwise(F.col("error")),
        ),
    ).drop("status", "error")
    ok = F.col("final_status") == "ok"
    same = ok & F.coalesce(F.col("latest_content_hash") == F.col("content_hash"), F.lit(False))
    gated = judged.withColumn("skipped_by_hash", same).withColumn("changed", ok & ~same)
    last = newest(
        snapshots, ["company_id"], [F.desc("captured_at"), F.desc("snapshot_id")]
    ).select(
        "company_id", F.col("snapshot_id").alias("previous_snapshot_id"), F.col("payload").alias("previous_payload")
    )
    paired = gated.join(last, "company_id", "left")
    diffed = computed_once(
        paired,
        normalized_diff=F.when(
            F.col("changed") & F.col("previous_payload").isNotNull(),
            pricing_diff(F.col("previous_payload"), F.col("payload")),
        ),
    ).drop("previous_payload")
    has_diff = F.col("normalized_diff").isNotNull()
    severity = F.col("normalized_diff.severity")
    return diffed.select(
        "company_id",
        "user_id",
        F.col("final_status").alias("status"),
        F.col("final_error").alias("error"),
        "skipped_by_hash",
        "changed",
        F.col("changed").alias("snapshot_created"),
        has_diff.alias("diff_created"),
        (has_diff & F.coalesce(F.array_contains("allowed_severities", severity), F.lit(False))).alias("insight_created"),
        F.when(ok, F.col("content_hash")).alias("content_hash"),
        F.when(ok, F.col("confidence")).alias("confidence"),
        (ok & F.col("is_verified")).alias("is_verified"),
        F.when(ok, F.col("payload")).alias("payload"),
        "previous_snapshot_id",
        "normalized_diff",
        severity.alias("severity"),
        "access_granted",
        "insight_gate",
        "allowed_severities",
        *extra,
        now.alias("crawled_at"),
        next_crawl_at(F.col("final_status"), now, crawls).alias("next_crawl_at"),
    )


def new_snapshots(outcomes: DataFrame) -> DataFrame:
    """Snapshots to append; the id is the company and the second of the crawl."""
    return outcomes.where("snapshot_created").select(
        snapshot_id().alias("snapshot_id"),
        "user_id",
        "company_id",
        F.col("crawled_at").alias("captured_at"),
        F.lit("static").alias("capture_method"),
        "confidence",
        "content_hash",
        "payload",
        "is_verified",
    )


def snapshot_id() -> Column:
    return F.concat_ws("-", F.col("company_id").cast("string"), F.date_format("crawled_at", "yyyyMMddHHmmss"))


def new_diffs(outcomes: DataFrame) -> DataFrame:
    return outcomes.where("diff_created").select(
        snapshot_id().alias("diff_id"),
        "user_id",
        "company_id",
        "previous_snapshot_id",
        snapshot_id().alias("current_snapshot_id"),
        "normalized_diff",
        "severity",
        verification("is_verified"),
        F.col("crawled_at").alias("detected_at"),
    )


def new_insights(outcomes: DataFrame, now: Column) -> DataFrame:
    diffs = outcomes.where("diff_created").select(
        snapshot_id().alias("diff_id"), "user_id", "company_id", "normalized_diff", "severity",
        verification("is_verified"), "access_granted", "insight_gate", "allowed_severities",
    )
    return build_insights(diffs, now)


def crawl_audit(outcomes: DataFrame) -> DataFrame:
    """Audit requests for failed crawls; idle and ok stay silent (R19 emission)."""
    return outcomes.where(F.col("status").isin("blocked", "manual_needed", "error")).select(
        F.concat(F.lit("crawl_"), F.col("status")).alias("event_type"),
        "user_id",
        "company_id",
        F.col("crawled_at").alias("created_at"),
        F.to_json(
            F.struct(
                F.lit(P.AUDIT_SOURCES["crawl"]).alias("source"),
                "status",
                F.col("error").alias("reason"),
                F.col("next_crawl_at").alias("nextCrawlAt"),
            )
        ).alias("metadata"),
    )


def run_summary(outcomes: DataFrame) -> DataFrame:
    """Counts of one batch in one pass."""
    return outcomes.agg(
        F.count(F.lit(1)).alias("processed"),
        count_where(F.col("changed")).alias("changed"),
        count_where(~F.col("changed")).alias("unchanged"),
        count_where(F.col("snapshot_created")).alias("snapshots_created"),
        count_where(F.col("diff_created")).alias("diffs_created"),
        count_where(F.col("insight_created")).alias("insights_created"),
        count_where(F.col("status") == "blocked").alias("blocked"),
        count_where(F.col("status") == "manual_needed").alias("manual_needed"),
        count_where(F.col("status") == "error").alias("errored"),
    )


def updated_companies(companies: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Companies after the batch (S8): required fields overwritten, optional ones only when
    known, the error set or removed."""
    change = outcomes.select(
        "company_id",
        F.lit(True).alias("_hit"),
        F.col("status").alias("_status"),
        shorten(F.col("error"), P.ERROR_TEXT_LIMIT).alias("_error"),
        F.col("content_hash").alias("_hash"),
        F.col("confidence").alias("_confidence"),
        F.col("crawled_at").alias("_at"),
        F.col("next_crawl_at").alias("_next"),
        *[F.col(c).alias("_" + c) for c in ("found_candidates", "found_primary") if c in outcomes.columns],
    )
    joined = companies.join(change, "company_id", "left")
    hit = F.col("_hit").isNotNull()
    swap = {
        "crawl_lease_until": F.when(~hit, F.col("crawl_lease_until")),
        "next_crawl_at": F.when(hit, F.col("_next")).otherwise(F.col("next_crawl_at")),
        "last_crawl_at": F.coalesce("_at", "last_crawl_at"),
        "last_crawl_status": F.coalesce("_status", "last_crawl_status"),
        "last_crawl_error": F.when(hit, F.col("_error")).otherwise(F.col("last_crawl_error")),
        "latest_content_hash": F.coalesce("_hash", "latest_content_hash"),
        "latest_confidence": F.coalesce("_confidence", "latest_confidence"),
    }
    if "_found_candidates" in joined.columns:
        swap["pricing_url_candidates"] = F.coalesce("_found_candidates", "pricing_url_candidates")
    if "_found_primary" in joined.columns:
        swap["primary_pricing_url"] = F.coalesce("primary_pricing_url", "_found_primary")
    kept = [swap.get(c, F.col(c)).alias(c) for c in companies.columns]
    return joined.select(*kept)


def crawl_commands(commands: DataFrame, companies: DataFrame, now: Column) -> DataFrame:
    """Outcome of crawl-now and retry-crawl requests.

    ``commands``: ``command_id, command, company_id, user_id``.  Commands join the company
    table, so a hot company only enlarges the command side, which AQE splits.
    """
    target = companies.select(
        "company_id", "user_id", "type", "crawl_lease_until", "last_crawl_status", "last_crawl_error"
    )
    joined = commands.join(target, ["company_id", "user_id"], "left")
    leased = F.col("crawl_lease_until").isNotNull()
    active = leased & (F.col("crawl_lease_until") > now)
    retry = F.col("command") == "retry-crawl"
    reason = first_true(
        [
            (F.col("type").isNull(), "company_not_found"),
            (F.col("type") != "competitor", "not_a_competitor"),
            (retry & active, "lease_active"),
        ],
        F.lit(None).cast("string"),
    )
    done = computed_once(joined, reject_reason=reason)
    accepted = F.col("reject_reason").isNull()
    clears = accepted & leased & ~active
    return done.select(
        "command_id",
        "command",
        "company_id",
        accepted.alias("accepted"),
        "reject_reason",
        F.when(accepted, now).alias("next_crawl_at"),
        F.when(F.col("type").isNotNull(), first_true([(active, "active"), (leased, "stale_or_expired")], "none")).alias("lease_state"),
        F.coalesce(clears, F.lit(False)).alias("lease_cleared"),
        F.when(accepted & ~clears, F.col("crawl_lease_until")).alias("crawl_lease_until"),
        F.when(accepted & retry, F.lit("idle")).otherwise(F.col("last_crawl_status")).alias("last_crawl_status"),
        F.when(~(accepted & retry), F.col("last_crawl_error")).alias("last_crawl_error"),
    )
