"""The weekly digest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarifflens import policies as P
from tarifflens.functions.columns import count_where, first_true, seconds_after
from tarifflens.functions.text import utc_minute
from tarifflens.operators.entitlements import Plans, with_entitlements
from tarifflens.operators.history import newest


def digest_diffs(diffs: DataFrame, now: Column, days: int, per_user: int) -> DataFrame:
    """Newest verified diffs per user in the closed window."""
    since = seconds_after(now, -days * 86400)
    window = diffs.where(
        (F.col("verification_state") == "verified") & F.col("detected_at").between(since, now)
    ).select("user_id", "diff_id", "company_id", "severity", "detected_at")
    return newest(window, ["user_id"], [F.desc("detected_at"), F.desc("diff_id")], per_user, rank="position")


def digest_stages(
    users: DataFrame, plans: Plans, kept: DataFrame, now: Column, days: int, tiers: P.TierPolicy = P.TIERS
) -> DataFrame:
    """Where each user leaves the funnel; the first failing test wins."""
    since = seconds_after(now, -days * 86400)
    with_diffs = kept.groupBy("user_id").agg(F.count(F.lit(1)).alias("diff_count"))
    candidates = with_entitlements(users.where(F.col("email").isNotNull()), plans, now, tiers)
    joined = candidates.join(with_diffs, "user_id", "left")
    stage = first_true(
        [
            (F.col("email") == "", "no_email"),
            (~(F.col("access_granted") & F.col("can_receive_digest")), "not_eligible"),
            (F.coalesce(F.col("last_digest_sent_at") >= since, F.lit(False)), "recently_sent"),
            (F.col("diff_count").isNull(), "no_diffs"),
        ],
        "sent",
    )
    return joined.select("user_id", "email", stage.alias("stage"), F.coalesce("diff_count", F.lit(0)).alias("diff_count"))


def digest_funnel(stages: DataFrame, failed: DataFrame | None = None) -> DataFrame:
    """Counts of a run.  ``failed``: users whose mail could not be sent."""
    rows = stages
    if failed is not None:
        rows = stages.join(failed.select("user_id", F.lit(True).alias("_failed")), "user_id", "left")
    bounced = F.coalesce(F.col("_failed"), F.lit(False)) if failed is not None else F.lit(False)
    at = lambda *names: count_where(F.col("stage").isin(*names))
    return rows.agg(
        F.count(F.lit(1)).alias("users_scanned"),
        at("no_email").alias("skipped_no_email"),
        at("not_eligible").alias("skipped_not_eligible"),
        at("recently_sent", "no_diffs", "sent").alias("eligible"),
        at("recently_sent").alias("skipped_recently_sent"),
        at("no_diffs").alias("skipped_no_diffs"),
        at("sent").alias("with_diffs"),
        count_where((F.col("stage") == "sent") & ~bounced).alias("sent"),
        count_where((F.col("stage") == "sent") & bounced).alias("send_errors"),
    )


def digest_messages(
    stages: DataFrame, kept: DataFrame, companies: DataFrame, now: Column, days: int
) -> DataFrame:
    """Subject, text and HTML per user (A10, A13, A15, J4); a user has at most the kept diffs."""
    names = companies.select("company_id", "name")
    due = stages.where("stage = 'sent'").select("user_id", "email")
    rows = kept.join(due, "user_id").join(names, "company_id", "left")
    line = F.struct(
        "position",
        F.upper("severity").alias("level"),
        F.coalesce("name", F.lit(P.TEXT_UNKNOWN_COMPANY)).alias("company"),
        utc_minute(F.col("detected_at")).alias("at"),
    )
    grouped = rows.groupBy("user_id", "email").agg(
        F.count(F.lit(1)).alias("diff_count"),
        *[count_where(F.col("severity") == s).alias(s) for s in reversed(P.SEVERITIES)],
        F.array_size(F.collect_set("company_id")).cast("bigint").alias("companies"),
        F.array_sort(F.collect_list(line)).alias("lines"),
    )
    span = (utc_minute(seconds_after(now, -days * 86400)), utc_minute(now))
    counts = F.format_string("High: %d, Medium: %d, Low: %d", "high", "medium", "low")
    items = lambda f, sep: F.array_join(F.transform("lines", f), sep)
    text_lines = items(lambda x: F.concat(F.lit("- ["), x["level"], F.lit("] "), x["company"], F.lit(" at "), x["at"]), "\n")
    html_items = items(
        lambda x: F.concat(F.lit("<li><strong>"), x["level"], F.lit("</strong> - "), x["company"], F.lit(" at "), x["at"], F.lit("</li>")), ""
    )
    subject = F.concat(
        F.lit("Weekly pricing digest: "), F.col("diff_count").cast("string"), F.lit(" verified change"),
        F.when(F.col("diff_count") == 1, F.lit("")).otherwise(F.lit("s")),
    )
    body = F.concat(
        F.lit("Verified pricing changes from "), span[0], F.lit(" to "), span[1], F.lit(":\n"), counts, F.lit("\n\n"), text_lines
    )
    # Fixed value: the mail layout, blanks and line breaks included.
    html = F.concat(
        F.lit("\n    <div>\n      <p>Verified pricing changes from <strong>"), span[0], F.lit("</strong> to <strong>"), span[1],
        F.lit("</strong>.</p>\n      <p>"), counts, F.lit("</p>\n      <ul>"), html_items, F.lit("</ul>\n    </div>\n  "),
    )
    return grouped.select(
        "user_id", "email", "diff_count", "high", "medium", "low", "companies",
        subject.alias("subject"), body.alias("text"), html.alias("html"),
    )


def mark_sent(users: DataFrame, messages: DataFrame, now: Column) -> DataFrame:
    """Users with the time of the digest just sent."""
    sent = messages.select("user_id", F.lit(True).alias("_sent"))
    return users.join(sent, "user_id", "left").withColumn(
        "last_digest_sent_at", F.when(F.col("_sent"), now).otherwise(F.col("last_digest_sent_at"))
    ).drop("_sent").select(*users.columns)


def weekly_digest(
    users: DataFrame, plans: Plans, diffs: DataFrame, companies: DataFrame, now: Column,
    days: int = P.DIGEST_LOOKBACK_DAYS, per_user: int = P.DIGEST_MAX_DIFFS,
) -> tuple[DataFrame, DataFrame]:
    """Messages and stages of one run."""
    kept = digest_diffs(diffs, now, days, per_user)
    stages = digest_stages(users, plans, kept, now, days)
    return digest_messages(stages, kept, companies, now, days), stages
