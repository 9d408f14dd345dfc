"""Competitors side by side with their latest prices."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarifflens.functions.columns import computed_once
from tarifflens.functions.prices import strict_price_points
from tarifflens.operators.history import newest

SNAPSHOT_COLUMNS = ["snapshot_id", "captured_at", "confidence", "is_verified"]


def latest_snapshots(snapshots: DataFrame) -> DataFrame:
    """Newest snapshot per company (W1), by company only, whoever owns it."""
    return newest(snapshots, ["company_id"], [F.desc("captured_at"), F.desc("snapshot_id")])


def comparison(companies: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Every competitor with its latest snapshot, price points and trust cues.

    ``snapshots`` holds ``payload_json`` as stored.  The ranking runs on keys only; the JSON of the
    few winners is fetched by the second join and parsed once.
    """
    competitors = companies.where(F.col("type") == "competitor")
    narrow = snapshots.select("company_id", *SNAPSHOT_COLUMNS)
    wanted = narrow.join(competitors.select("company_id"), "company_id", "left_semi")
    last = latest_snapshots(wanted)
    bodies = last.join(snapshots.select("company_id", "snapshot_id", "payload_json"), ["company_id", "snapshot_id"])
    parsed = computed_once(bodies, price_points=strict_price_points(F.col("payload_json"))).drop("payload_json")
    joined = competitors.select(
        "user_id", "company_id", "name", "domain", "primary_pricing_url",
        F.col("last_crawl_status").isin("blocked", "manual_needed").alias("blocked_or_manual_needed"),
        "last_crawl_status", "last_crawl_at", "last_crawl_error", "latest_confidence",
    ).join(parsed, "company_id", "left")
    return joined


def comparison_buckets(compared: DataFrame) -> DataFrame:
    """Price buckets of the latest snapshot (A4)."""
    points = compared.select("company_id", F.inline("price_points"))
    return points.groupBy("company_id", "currency", "period").agg(
        F.count(F.lit(1)).alias("price_count"),
        F.min("amount").alias("min_amount"),
        F.max("amount").alias("max_amount"),
    )


def with_own_prices(compared: DataFrame, price_lists: DataFrame) -> DataFrame:
    """The user's own price list beside each competitor, NULL when absent."""
    own = price_lists.select("user_id", F.struct("currency", "billing_period", "plans", "notes").alias("own_price_list"))
    return compared.join(own, "user_id", "left")


def by_name(compared: DataFrame) -> DataFrame:
    """Competitors in name order inside each user."""
    return compared.orderBy("user_id", "name", "company_id")
