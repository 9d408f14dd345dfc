"""Audit events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarifflens import policies as P
from tarifflens.functions.columns import bind, first_true, lookup
from tarifflens.sources.tables import append

ACTORS = ("user", "system", "stripe_webhook", "cron")
STATUSES = ("success", "failure", "rejected")


def lifecycle_events(events: DataFrame) -> DataFrame:
    """Actor, resource and status of lifecycle events (R19); unknown types drop out as rejects.

    The map has ten entries, so it is a literal in the expression rather than a join.
    """
    parts = {
        name: lookup({event: row[i] for event, row in P.AUDIT_EVENTS.items()}, F.col("event_type"))
        for i, name in enumerate(("actor_type", "resource_type", "status"))
    }
    resource = F.coalesce(F.col("company_id").cast("string"), F.col("user_id").cast("string"))
    return events.select(
        *[c for c in events.columns if c not in ("event_type", "company_id")],
        parts["actor_type"].alias("actor_type"),
        F.col("event_type").alias("action"),
        parts["resource_type"].alias("resource_type"),
        resource.alias("resource_id"),
        parts["status"].alias("status"),
    )


def reject_reason() -> Column:
    """What is wrong with an audit event, the first fault counting; null if nothing is."""
    within = lambda c, low, high: F.coalesce(F.length(c).between(low, high), F.lit(False))
    return first_true(
        [
            (~F.coalesce(F.col("actor_type").isin(*ACTORS), F.lit(False)), "actor_type"),
            (~F.coalesce(F.col("status").isin(*STATUSES), F.lit(False)), "status"),
            (~within("action", 1, 120), "action"),
            (~within("resource_type", 1, 80), "resource_type"),
            (F.col("resource_id").isNotNull() & ~within("resource_id", 0, 120), "resource_id"),
        ],
        F.lit(None).cast("string"),
    )


def accepted_and_rejected(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split for the append sink (S7): a bad row never fails the batch, and says what is wrong with it."""
    judged = events.withColumn("reject_reason", reject_reason())
    good = F.col("reject_reason").isNull()
    return judged.where(good).drop("reject_reason"), judged.where(~good)


def append_audit(events: DataFrame, path: str, commit: str, rows_per_file: int = 1_000_000) -> None:
    """Write a batch of audit events (``created_at``) in one pass, accepted and rejected ones into folders of their own.

    A batch that is written again under its commit replaces itself.
    """
    judged = events.withColumn("reject_reason", reject_reason())
    verdict = F.when(F.col("reject_reason").isNull(), F.lit("accepted")).otherwise(F.lit("rejected"))
    append(judged.withColumn("verdict", verdict), path, "created_at", commit, rows_per_file, by=("verdict",))


def stored_audit(spark: SparkSession, path: str, verdict: str = "accepted") -> DataFrame:
    """The audit events of all batches with that verdict (accepted, rejected)."""
    rows = spark.read.parquet(path).where(F.col("verdict") == verdict).drop("verdict", "commit", "day")
    return rows.drop("reject_reason") if verdict == "accepted" else rows


def _quoted(text: Column) -> Column:
    """A string as JSON."""
    packed = F.to_json(F.array(text))
    return F.substring(packed, F.lit(2), F.length(packed) - 2)


def _shortened(text: Column) -> Column:
    limit = P.AUDIT_TEXT_LIMIT
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit - 3), F.lit("..."))).otherwise(text)


def _value(text: Column, typed: Column, depth: int) -> Column:
    """A value as bounded JSON: ``text`` is a string as it is and anything else as JSON, ``typed`` tells which it is."""
    is_text = F.schema_of_variant(typed) == "STRING"
    opened = depth < P.AUDIT_DEPTH_LIMIT
    return (
        F.when(text.isNull(), F.lit("null"))
        .when(is_text, _quoted(_shortened(text)))
        .when(text.startswith("{"), _object(text, depth + 1) if opened else F.lit("{}"))
        .when(text.startswith("["), _list(text, depth + 1) if opened else F.lit("[]"))
        .otherwise(text)
    )


def _list(text: Column, depth: int) -> Column:
    first = lambda kind: F.slice(F.from_json(text, f"array<{kind}>"), 1, P.AUDIT_KEY_LIMIT)
    each = F.zip_with(first("string"), first("variant"), lambda t, v: _value(t, v, depth))
    return F.concat(F.lit("["), F.array_join(each, ","), F.lit("]"))


def _object(text: Column, depth: int) -> Column:
    """An object with its first keys in the order of the text; of a key that is repeated the last value counts."""
    sides = F.struct(F.from_json(text, "map<string,string>").alias("text"), F.from_json(text, "map<string,variant>").alias("typed"))

    def parts(both: Column) -> Column:
        keys = F.map_keys(both["text"])
        back, values, typed = F.reverse(keys), F.reverse(F.map_values(both["text"])), F.reverse(F.map_values(both["typed"]))

        def entry(key: Column) -> Column:
            at = (F.array_position(back, key) - 1).cast("int")
            return F.concat(_quoted(key), F.lit(":"), _value(F.get(values, at), F.get(typed, at), depth))

        return F.transform(F.slice(F.array_distinct(keys), 1, P.AUDIT_KEY_LIMIT), entry)

    return F.coalesce(bind(sides, lambda both: F.concat(F.lit("{"), F.array_join(parts(both), ","), F.lit("}"))), F.lit("{}"))


def clean_metadata(events: DataFrame, column: str = "metadata") -> DataFrame:
    """Bound the size of metadata (X24): keys, text length, list length, depth.

    Whatever is no JSON object becomes an empty one. Each level is read twice, as text, which keeps the order of
    the keys, and as variants, which tell a string from what only looks like a number; the depth is bounded, so all levels are one
    expression. All rows take the same way and get the same compact layout.
    """
    return events.withColumn(column, _object(F.col(column), 0))
