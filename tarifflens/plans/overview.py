"""Dashboard counts per user."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarifflens import policies as P
from tarifflens.functions.columns import count_where, seconds_after
from tarifflens.operators.entitlements import ENTITLEMENT_COLUMNS, Plans, refresh_trials, trial_is_active, with_entitlements


def company_counts(companies: DataFrame) -> DataFrame:
    """Own, competitor and total companies, and competitors by crawl status (A1, A2).

    Conditional counts in one pass give the zero-filled table that a pivot would, without
    knowing a user's statuses in advance.
    """
    competitor = F.col("type") == "competitor"
    own = F.col("type") == "self"
    return companies.groupBy("user_id").agg(
        count_where(own).alias("self_count"),
        count_where(competitor).alias("competitor_count"),
        count_where(own | competitor).alias("total_count"),
        *[count_where(competitor & (F.col("last_crawl_status") == s)).alias("status_" + s) for s in P.CRAWL_STATUSES],
    )


def window_start(now: Column, days: int) -> Column:
    return seconds_after(now, -days * 86400)


def recent_change_counts(diffs: DataFrame, now: Column, days: int = P.OVERVIEW_WINDOW_DAYS) -> DataFrame:
    """Verified diffs by severity since the window start; no upper bound (A3)."""
    recent = diffs.where(
        (F.col("verification_state") == "verified") & (F.col("detected_at") >= window_start(now, days))
    )
    counted = recent.groupBy("user_id").agg(
        *[count_where(F.col("severity") == s).alias("changes_" + s) for s in P.SEVERITIES]
    )
    return counted.withColumn("changes_total", sum((F.col("changes_" + s) for s in P.SEVERITIES), F.lit(0)).cast("bigint"))


def overview(
    users: DataFrame,
    plans: Plans,
    companies: DataFrame,
    diffs: DataFrame,
    now: Column,
    tiers: P.TierPolicy = P.TIERS,
) -> DataFrame:
    """Everything the overview page shows, for all users."""
    fresh = with_entitlements(refresh_trials(users, now), plans, now, tiers)
    fresh = fresh.withColumn("trial_active", trial_is_active(now))
    counts = company_counts(companies)
    changes = recent_change_counts(diffs, now)
    base = fresh.select(
        "user_id", *ENTITLEMENT_COLUMNS, F.lit(P.TRIAL_DAYS).alias("trial_days"),
        "trial_status", "trial_started_at", "trial_ends_at", "trial_active",
    )
    joined = base.join(counts, "user_id", "left").join(changes, "user_id", "left")
    zeros = [c for c in (*counts.columns, *changes.columns) if c != "user_id"]
    return joined.fillna(0, subset=zeros).withColumn("window_start", window_start(now, P.OVERVIEW_WINDOW_DAYS))
