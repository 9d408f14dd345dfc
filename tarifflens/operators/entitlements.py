"""What a user may do: plans, trials, gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarifflens import policies as P
from tarifflens.functions.columns import first_true, lookup, seconds_after

Plan = tuple[int, str, str]
Plans = list[Plan] | DataFrame
ENTITLEMENT_COLUMNS = [
    "access_granted", "access_source", "access_state", "plan_tier", "competitor_limit",
    "insight_gate", "allowed_severities", "can_receive_digest",
]


def with_price_tier(df: DataFrame, plans: Plans, price: str = "price_id", tier: str = "price_tier") -> DataFrame:
    """Tier of a price id, the first plan in list order winning.

    ``plans`` is a list of ``ordinal, price_id, tier``, which is configuration and becomes a literal map, or a
    table with these columns, which is joined; Spark broadcasts it if it is small and splits a skewed price if not.
    """
    if isinstance(plans, DataFrame):
        first = plans.groupBy(F.col("price_id").alias(price)).agg(F.min_by("tier", "ordinal").alias(tier))
        return df.join(first, price, "left").select(*df.columns, tier)
    tiers: dict[str, str] = {}
    for _, price_id, name in sorted(plans):
        tiers.setdefault(price_id, name)
    found = lookup(tiers, F.col(price)) if tiers else F.lit(None).cast("string")
    return df.withColumn(tier, found)


def trial_is_active(now: Column) -> Column:
    """Status active and the end strictly ahead."""
    return F.coalesce((F.col("trial_status") == "active") & (F.col("trial_ends_at") > now), F.lit(False))


def with_entitlements(users: DataFrame, plans: Plans, now: Column, tiers: P.TierPolicy = P.TIERS) -> DataFrame:
    """Paid plan, else running trial, else nothing."""
    tiered = with_price_tier(users, plans)
    paid = F.coalesce(F.col("has_access"), F.lit(False))
    trial = trial_is_active(now)
    tiered = tiered.withColumn(
        "plan_tier",
        F.when(paid, F.coalesce("price_tier", F.lit(tiers.fallback))).when(trial, F.lit(tiers.trial)),
    ).drop("price_tier")

    def per_tier(pick, default: Column) -> Column:  # noqa: ANN001
        return first_true(
            [(F.col("plan_tier") == tier, pick(rule)) for tier, rule in tiers.tiers.items()], default
        )

    severities = lambda rule: F.array(*[F.lit(s) for s in tiers.gates[rule["gate"]]])
    return (
        tiered.withColumn("access_granted", F.col("plan_tier").isNotNull())
        .withColumn("access_source", first_true([(paid, "paid"), (trial, "trial")], "none"))
        .withColumn("access_state", first_true([(paid, "paid_active"), (trial, "trial_active")], "inactive"))
        .withColumn("competitor_limit", per_tier(lambda r: F.lit(r["competitor_limit"]), F.lit(0)))
        .withColumn("insight_gate", per_tier(lambda r: F.lit(r["gate"]), F.lit(None).cast("string")))
        .withColumn("allowed_severities", per_tier(severities, F.array().cast("array<string>")))
        .withColumn("can_receive_digest", paid & per_tier(lambda r: F.lit(r["digest"]), F.lit(False)))
    )


def may_generate_insight(severity: Column) -> Column:
    return F.col("access_granted") & F.array_contains("allowed_severities", severity)


def refreshed_trial_status(now: Column) -> Column:
    """Active trials of payers are converted, ended ones expire."""
    active = F.col("trial_status") == "active"
    return first_true(
        [
            (active & F.col("has_access"), "converted"),
            (active & ~trial_is_active(now), "expired"),
        ],
        F.col("trial_status"),
    )


def refresh_trials(users: DataFrame, now: Column) -> DataFrame:
    return users.withColumn("_next", refreshed_trial_status(now)).withColumn(
        "trial_changed", ~F.col("_next").eqNullSafe(F.col("trial_status"))
    ).withColumn("trial_status", F.col("_next")).drop("_next")


def start_trials(users: DataFrame, now: Column) -> DataFrame:
    """Outcome of asking for a trial (R10): reason, and the trial columns afterwards."""
    fresh = refresh_trials(users, now)
    status = F.col("trial_status")
    history = F.col("trial_started_at").isNotNull() | F.col("trial_ends_at").isNotNull()
    reason = first_true(
        [
            (F.col("has_access") & (status == "converted"), "already_converted"),
            (F.col("has_access"), "paid_user"),
            (status == "converted", "already_converted"),
            (status == "expired", "already_expired"),
            (trial_is_active(now), "already_active"),
            (history & (status == "not_started"), "already_expired"),
        ],
        "started",
    )
    decided = fresh.withColumn("reason", reason)
    started = F.col("reason") == "started"
    spent = (F.col("reason") == "already_expired") & (status == "not_started")
    ends = seconds_after(now, P.TRIAL_DAYS * 86400)
    return (
        decided.withColumn("started", started)
        .withColumn("changed", F.col("trial_changed") | started | spent)
        .withColumn("trial_started_at", F.when(started, now).otherwise(F.col("trial_started_at")))
        .withColumn("trial_ends_at", F.when(started, ends).otherwise(F.col("trial_ends_at")))
        .withColumn(
            "trial_status",
            F.when(started, F.lit("active")).when(spent, F.lit("expired")).otherwise(status),
        )
        .drop("trial_changed")
    )
