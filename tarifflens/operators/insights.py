"""Rule-based recommendations for price changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarifflens import policies as P
from tarifflens.operators.diffing import total_of
from tarifflens.operators.entitlements import may_generate_insight


def change_summary(changes: Column) -> Column:
    """Sizes of a stored diff."""
    return F.struct(
        total_of(changes, "added_amounts").alias("added"),
        total_of(changes, "removed_amounts").alias("removed"),
        total_of(changes, "updated_amounts").alias("updated"),
    )


def action_items(severity: Column, verification_state: Column, summary: Column) -> Column:
    """What to do, most urgent first; never empty."""
    reshaped = (summary["added"] > 0) | (summary["removed"] > 0)
    picked = F.array_compact(
        F.array(
            F.when(severity == "high", F.lit(P.TEXT_ACTION_REVIEW)),
            F.when(summary["updated"] > 0, F.lit(P.TEXT_ACTION_COMPARE)),
            F.when(reshaped, F.lit(P.TEXT_ACTION_AUDIT)),
            F.when(verification_state == "unverified", F.lit(P.TEXT_ACTION_VERIFY)),
        )
    )
    return F.when(F.size(picked) > 0, picked).otherwise(F.array(F.lit(P.TEXT_ACTION_MONITOR)))


def insight_due(severity: Column) -> Column:
    """Whether the owner's plan has a gate and lets this severity through."""
    return F.col("insight_gate").isNotNull() & may_generate_insight(severity)


def recommendation(severity: Column, verification_state: Column, summary: Column) -> Column:
    headline = F.concat(F.lit(P.TEXT_HEADLINE[0]), severity, F.lit(P.TEXT_HEADLINE[1]))
    text = F.when(
        summary["updated"] > 0,
        F.concat(summary["updated"].cast("string"), F.lit(P.TEXT_SUMMARY_UPDATED)),
    ).otherwise(F.lit(P.TEXT_SUMMARY_NEW))
    return F.struct(
        headline.alias("headline"),
        text.alias("summary"),
        severity.alias("risk"),
        severity.alias("severity"),
        verification_state.alias("verification_state"),
        action_items(severity, verification_state, summary).alias("action_items"),
        summary.alias("diff_summary"),
    )


def build_insights(diffs: DataFrame, now: Column) -> DataFrame:
    """Insights for diffs that already carry the owner's entitlement columns."""
    gated = diffs.where(insight_due(F.col("severity")))
    summary = change_summary(F.col("normalized_diff.price_changes"))
    return gated.select(
        *[c for c in ("user_id", "company_id", "diff_id", "current_snapshot_id") if c in diffs.columns],
        F.lit(P.INSIGHT_MODEL).alias("model"),
        F.lit(0).cast("bigint").alias("prompt_tokens"),
        F.lit(0).cast("bigint").alias("completion_tokens"),
        F.lit(0.0).alias("total_cost_usd"),
        recommendation(F.col("severity"), F.col("verification_state"), summary).alias("recommendation"),
        F.col("insight_gate").alias("severity_gate"),
        now.alias("generated_at"),
        F.lit("none").alias("feedback"),
    )
