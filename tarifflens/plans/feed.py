"""The change feed: newest diffs with company, latest insight and trust cues."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarifflens import policies as P
from tarifflens.functions.cursor import encode_cursor
from tarifflens.operators.history import newest


def feed_filter(
    diffs: DataFrame, severity: str | None = None, verification_state: str | None = None
) -> DataFrame:
    """Optional equality filters."""
    if severity is not None:
        if severity not in P.SEVERITIES:
            raise ValueError(f"unknown severity {severity}")
        diffs = diffs.where(F.col("severity") == severity)
    if verification_state is not None:
        if verification_state not in P.VERIFICATION_STATES:
            raise ValueError(f"unknown verification state {verification_state}")
        diffs = diffs.where(F.col("verification_state") == verification_state)
    return diffs


def page_limit(limit: int | None, most: int | None = None) -> int:
    """Rows per page; ``most`` is the bound of a web request (``P.FEED_MAX_LIMIT``), none for batch jobs."""
    value = P.FEED_DEFAULT_LIMIT if limit is None else int(limit)
    if value < 1 or (most is not None and value > most):
        raise ValueError("limit must be 1 or more" if most is None else f"limit must be 1..{most}")
    return value


def latest_insights(insights: DataFrame) -> DataFrame:
    """Newest insight per diff."""
    return newest(insights, ["diff_id"], [F.desc("generated_at"), F.desc("insight_id")])


def with_company(diffs: DataFrame, companies: DataFrame) -> DataFrame:
    """Company of a diff, only when it belongs to the same user."""
    side = companies.select(
        "company_id",
        F.col("user_id").alias("_owner"),
        F.col("name").alias("company_name"),
        F.col("domain").alias("company_domain"),
        F.col("type").alias("company_type"),
        "last_crawl_status",
        "last_crawl_at",
        "latest_confidence",
    )
    return diffs.join(side, "company_id").where(F.col("user_id") == F.col("_owner")).drop("_owner")


def feed_pages(
    diffs: DataFrame,
    companies: DataFrame,
    insights: DataFrame,
    limit: int | None = None,
    cursors: DataFrame | None = None,
    severity: str | None = None,
    verification_state: str | None = None,
    strict_reference: bool = False,
) -> DataFrame:
    """One feed page for every user at once.

    ``cursors``: ``user_id, detected_at, diff_id`` of the last row each user has seen.  The page
    takes ``limit + 1`` rows per user by ``row_number``; Spark cuts each task to that many rows
    before the shuffle.  ``strict_reference`` limits before matching companies, so a page can be
    short; by default companies are matched first and pages are full.
    """
    size = page_limit(limit)
    scoped = feed_filter(diffs, severity, verification_state)
    if cursors is not None:
        seen = cursors.select(
            "user_id", F.col("detected_at").alias("_at"), F.col("diff_id").alias("_id")
        )
        scoped = scoped.join(seen, "user_id", "left").where(
            F.col("_at").isNull()
            | (F.col("detected_at") < F.col("_at"))
            | ((F.col("detected_at") == F.col("_at")) & (F.col("diff_id") < F.col("_id")))
        ).drop("_at", "_id")
    order = [F.desc("detected_at"), F.desc("diff_id")]
    if strict_reference:
        matched = with_company(newest(scoped, ["user_id"], order, size + 1), companies)
        rows = newest(matched, ["user_id"], order, size + 1, rank="position")
    else:
        rows = newest(with_company(scoped, companies), ["user_id"], order, size + 1, rank="position")
    # At most size + 1 rows per user are left, so this window is small.
    every = Window.partitionBy("user_id")
    last_shown = F.max(F.when(F.col("position") == size, F.struct("detected_at", "diff_id"))).over(every)
    paged = rows.withColumn("has_more", F.max("position").over(every) > size).withColumn("_last", last_shown)
    shown = paged.where(F.col("position") <= size)
    latest = latest_insights(insights).select(
        "diff_id",
        "insight_id",
        F.col("generated_at").alias("insight_generated_at"),
        F.col("severity_gate").alias("insight_gate"),
        *[c for c in ("recommendation",) if c in insights.columns],
    )
    full = shown.join(latest, "diff_id", "left")
    return full.withColumn(
        "next_cursor", F.when(F.col("has_more"), encode_cursor(F.col("_last.detected_at"), F.col("_last.diff_id")))
    ).drop("_last")


def feed_documents(page: DataFrame) -> DataFrame:
    """Nested response rows (F8)."""
    company = F.struct(
        "company_id",
        F.col("company_name").alias("name"),
        F.col("company_domain").alias("domain"),
        F.col("company_type").alias("type"),
        "last_crawl_status",
        "last_crawl_at",
        "latest_confidence",
    )
    insight = F.when(
        F.col("insight_id").isNotNull(),
        F.struct("insight_id", F.col("insight_generated_at").alias("generated_at"), F.col("insight_gate").alias("severity_gate")),
    )
    cues = F.struct(
        "detected_at", "verification_state", F.col("last_crawl_at").alias("company_last_crawl_at"), "latest_confidence"
    )
    return page.select(
        "user_id", "position", "diff_id", "severity", "verification_state", "detected_at",
        company.alias("company"), insight.alias("latest_insight"), cues.alias("trust_cues"), "has_more", "next_cursor",
    )
