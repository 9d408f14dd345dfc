"""Price differences between two payloads of a company."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarifflens import policies as P
from tarifflens.functions.columns import bind, computed_once, first_true
from tarifflens.functions.numbers import fixed2
from tarifflens.operators.history import day_slice, with_previous


def period_rank(period: Column) -> Column:
    """Place of a period in a diff (W12); payloads sort periods alphabetically instead."""
    return F.array_position(F.array(*[F.lit(p) for p in P.PERIODS]), period).cast("int")


def _amounts(mentions: Column, key: Column) -> Column:
    """Ascending two-decimal amounts of one bucket, duplicates kept (A5)."""
    same = F.filter(
        mentions, lambda m: (F.upper(m["currency"]) == key["currency"]) & (m["period"] == key["period"])
    )
    return F.array_sort(F.transform(same, lambda m: fixed2(m["amount"])))


def _paired(old: Column, new: Column) -> Column:
    """Amounts paired by position (J8) that moved enough to count."""
    n = F.least(F.size(old), F.size(new))
    pairs = F.zip_with(
        F.slice(old, F.lit(1), n),
        F.slice(new, F.lit(1), n),
        lambda a, b: F.struct(
            a.alias("previous_amount"),
            b.alias("current_amount"),
            F.when(a > 0, F.abs(b - a) / a * 100).otherwise(F.lit(100.0)).alias("delta_percent"),
        ),
    )
    moved = F.filter(
        pairs,
        lambda u: (F.abs(u["current_amount"] - u["previous_amount"]) >= P.MIN_ABSOLUTE_CHANGE)
        & (u["delta_percent"] >= P.MIN_PERCENT_CHANGE),
    )
    return F.transform(
        moved,
        lambda u: F.struct(
            u["previous_amount"].alias("previous_amount"),
            u["current_amount"].alias("current_amount"),
            fixed2(u["delta_percent"]).alias("delta_percent"),
        ),
    )


def bucket_changes(old_mentions: Column, new_mentions: Column) -> Column:
    """Changes per currency and period, unchanged buckets left out.

    A page has a bounded number of prices and both lists sit in one row, so the full outer
    join of the buckets is array work: no shuffle.
    """
    both = F.concat(old_mentions, new_mentions)
    keys = F.array_distinct(
        F.transform(
            both,
            lambda m: F.struct(
                F.upper(m["currency"]).alias("currency"),
                period_rank(m["period"]).alias("rank"),
                m["period"].alias("period"),
            ),
        )
    )

    def change(key: Column) -> Column:
        sides = F.struct(_amounts(old_mentions, key).alias("old"), _amounts(new_mentions, key).alias("new"))
        return bind(
            sides,
            lambda s: F.struct(
                key["currency"].alias("currency"),
                key["period"].alias("period"),
                F.slice(s["new"], F.size(s["old"]) + 1, F.greatest(F.size(s["new"]), F.lit(1))).alias("added_amounts"),
                F.slice(s["old"], F.size(s["new"]) + 1, F.greatest(F.size(s["old"]), F.lit(1))).alias("removed_amounts"),
                _paired(s["old"], s["new"]).alias("updated_amounts"),
            ),
        )

    return F.filter(
        F.transform(F.array_sort(keys), change),
        lambda c: (F.size(c["added_amounts"]) > 0)
        | (F.size(c["removed_amounts"]) > 0)
        | (F.size(c["updated_amounts"]) > 0),
    )


def total_of(changes: Column, field: str) -> Column:
    """Number of entries of one kind over all buckets (A6, A7); NULL counts as none."""
    sizes = F.transform(changes, lambda c: F.coalesce(F.size(c[field]), F.lit(0)))
    return F.coalesce(F.aggregate(sizes, F.lit(0), lambda acc, n: acc + n), F.lit(0))


def max_delta(changes: Column) -> Column:
    """Largest rounded percentage (A6), 0 without updates."""
    peaks = F.transform(
        changes, lambda c: F.array_max(F.transform(c["updated_amounts"], lambda u: u["delta_percent"]))
    )
    return F.coalesce(F.array_max(peaks), F.lit(0.0))


def severity(changes: Column, hints_changed: Column) -> Column:
    """How much a diff matters."""
    facts = F.struct(
        max_delta(changes).alias("peak"),
        total_of(changes, "added_amounts").alias("added"),
        total_of(changes, "removed_amounts").alias("removed"),
        total_of(changes, "updated_amounts").alias("updated"),
    )
    return bind(
        facts,
        lambda f: first_true(
            [
                ((f["peak"] >= 20) | ((f["added"] >= 2) & (f["removed"] >= 2)), "high"),
                (
                    (f["peak"] >= 10) | ((f["updated"] + f["added"] + f["removed"]) >= 2) | hints_changed,
                    "medium",
                ),
            ],
            "low",
        ),
    )


def pricing_diff(old: Column, new: Column) -> Column:
    """Normalised diff of two payload structs, NULL when nothing changed."""
    parts = F.struct(
        bucket_changes(old["price_mentions"], new["price_mentions"]).alias("price_changes"),
        F.array_except(new["custom_pricing_hints"], old["custom_pricing_hints"]).alias("added_hints"),
        F.array_except(old["custom_pricing_hints"], new["custom_pricing_hints"]).alias("removed_hints"),
    )

    def assemble(d: Column) -> Column:
        hints_changed = (F.size(d["added_hints"]) > 0) | (F.size(d["removed_hints"]) > 0)
        return F.when(
            (F.size(d["price_changes"]) > 0) | hints_changed,
            F.struct(
                d["price_changes"].alias("price_changes"),
                d["added_hints"].alias("added_hints"),
                d["removed_hints"].alias("removed_hints"),
                F.size(old["price_mentions"]).alias("previous_price_count"),
                F.size(new["price_mentions"]).alias("current_price_count"),
                F.size(old["plan_names"]).alias("previous_plan_count"),
                F.size(new["plan_names"]).alias("current_plan_count"),
                severity(d["price_changes"], hints_changed).alias("severity"),
            ),
        )

    return bind(parts, assemble)


def snapshots_with_previous(
    snapshots: DataFrame, carry: list[str] | None = None, slice_by: Column | None = None
) -> DataFrame:
    """Every snapshot with the one before it (W2): ``previous_snapshot_id``, ``previous_payload``.

    Only the narrow ``carry`` columns go through the ordered step.
    """
    return with_previous(
        snapshots,
        ["company_id"],
        ["captured_at", "snapshot_id"],
        carry or ["snapshot_id", "payload"],
        day_slice("captured_at") if slice_by is None else slice_by,
    )


def diff_snapshots(snapshots: DataFrame, slice_by: Column | None = None) -> DataFrame:
    """Diffs between consecutive snapshots of every company.

    Input: ``snapshot_id, company_id, captured_at, payload, is_verified`` and optionally
    ``user_id``.  Output has one row per real change.
    """
    paired = snapshots_with_previous(snapshots, slice_by=slice_by).where(
        F.col("previous_snapshot_id").isNotNull()
    )
    named = paired.select(
        *[c for c in ("user_id",) if c in snapshots.columns],
        "company_id",
        "previous_snapshot_id",
        F.col("snapshot_id").alias("current_snapshot_id"),
        F.col("captured_at").alias("detected_at"),
        verification("is_verified"),
        "previous_payload",
        "payload",
    )
    diffed = computed_once(
        named, normalized_diff=pricing_diff(F.col("previous_payload"), F.col("payload"))
    ).drop("previous_payload", "payload")
    return diffed.where(F.col("normalized_diff").isNotNull()).withColumn(
        "severity", F.col("normalized_diff.severity")
    )


def verification(flag: str) -> Column:
    """Verified when the newer snapshot is."""
    return F.when(F.col(flag), F.lit("verified")).otherwise(F.lit("unverified")).alias("verification_state")


def bucket_change_rows(diffs: DataFrame, *keys: str) -> DataFrame:
    """One row per changed bucket."""
    return diffs.select(*keys, F.inline("normalized_diff.price_changes"))


def payload_from_prices(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Payload structs from a price table with one row per price (at most a page per group)."""
    price = F.struct("currency", "period", "amount")
    return rows.groupBy(*keys).agg(F.array_sort(F.collect_list(price)).alias("price_mentions")).select(
        *keys,
        F.struct(
            F.lit(None).cast("string").alias("source_url"),
            F.lit(None).cast("string").alias("page_title"),
            F.lit(None).cast("string").alias("page_description"),
            F.array().cast("array<string>").alias("plan_names"),
            "price_mentions",
            F.array().cast("array<string>").alias("custom_pricing_hints"),
        ).alias("payload"),
    )
