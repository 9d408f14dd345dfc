"""Lifecycle events of what users and the payment provider do (R19), taken from the results of the operators.

Each result is gone through once: a row yields the events that it stands for, none for most rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarifflens import policies as P
from tarifflens.functions.columns import first_true


def _event(kind: Column | str, user_id: Column, company_id: Column, at: Column, source: str, **metadata: Column) -> Column:
    """One event; ``metadata`` goes into a JSON object after the source."""
    name = F.lit(kind) if isinstance(kind, str) else kind
    told = F.to_json(F.struct(F.lit(source).alias("source"), *[value.alias(key) for key, value in metadata.items()]))
    return F.struct(
        name.alias("event_type"),
        user_id.cast("long").alias("user_id"),
        company_id.cast("long").alias("company_id"),
        at.alias("created_at"),
        told.alias("metadata"),
    )


def _each(rows: DataFrame, *events: Column) -> DataFrame:
    return rows.select(F.inline(F.filter(F.array(*events), lambda e: e.isNotNull())))


def intake_activity(admitted: DataFrame) -> DataFrame:
    """Events of decided company requests: created ones (known by their request) and full plans."""
    reason, at, user = F.col("reject_reason"), F.col("requested_at"), F.col("user_id")
    source, none = P.AUDIT_SOURCES["company"], F.lit(None).cast("long")
    return _each(
        admitted,
        F.when(reason == "competitor_limit_reached", _event("competitor_cap_hit", user, none, at, source)),
        F.when(
            reason.isNull(),
            _event("company_created", user, F.col("request_id"), at, source, companyType=F.col("type"), domain=F.col("company_domain")),
        ),
    )


def selection_activity(selected: DataFrame, now: Column) -> DataFrame:
    """Events of chosen pricing pages that differ from the ones before."""
    event = _event(
        "primary_pricing_url_changed", F.col("user_id"), F.col("company_id"), now, P.AUDIT_SOURCES["primary"],
        nextPrimaryPricingUrl=F.col("primary_pricing_url"),
    )
    return _each(selected, F.when(F.col("primary_changed"), event))


def trial_activity(decided: DataFrame, now: Column) -> DataFrame:
    """Events of users who asked for a trial, whether they got one or not."""
    kind = F.when(F.col("started"), F.lit("trial_started")).otherwise(F.lit("trial_start_blocked"))
    told = {"reason": F.col("reason"), "trialStatus": F.col("trial_status"), "started": F.col("started")}
    return _each(decided, _event(kind, F.col("user_id"), F.lit(None).cast("long"), now, P.AUDIT_SOURCES["trial"], **told))


def billing_activity(acting: DataFrame) -> DataFrame:
    """Events of billing events that give or take access; ``acting`` is what ``billing.acting_events`` returns."""
    kind = first_true(
        [(F.col("effect") == "grant", "webhook_access_granted"), (F.col("effect") == "revoke", "webhook_access_revoked")]
    )
    none = F.lit(None).cast("long")
    event = _event(kind, F.col("account")["user_id"], none, F.col("arrived_at"), "api:webhook.stripe", eventId=F.col("event_id"))
    return _each(acting, F.when(F.col("effect").isin("grant", "revoke"), event))


def together(*activities: DataFrame) -> DataFrame:
    """All events in one frame, as ``audit.lifecycle_events`` takes them."""
    return reduce(lambda left, right: left.unionByName(right), activities)
