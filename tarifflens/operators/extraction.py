"""From captured pages to canonical pricing payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarifflens import policies as P
from tarifflens.functions import prices, text, urls
from tarifflens.functions.columns import computed_once, first_true


def capped_html(html: Column, max_chars: int | None = None) -> Column:
    """Page source (S5).  Whole by default; a caller may ask for a cap."""
    return html if max_chars is None else F.substring(html, 1, max_chars)


def fetch_failure_status(http_status: Column, pages: P.PagePolicy = P.PAGES) -> Column:
    """What a failed fetch means for the company."""
    return (
        F.when(http_status.isin(*pages.blocked_statuses), F.lit("blocked"))
        .when(http_status.between(400, 499), F.lit("manual_needed"))
        .otherwise(F.lit("error"))
    )


def page_facts(captures: DataFrame, max_chars: int | None = None, pages: P.PagePolicy = P.PAGES) -> DataFrame:
    """Text-level facts of every capture; each long expression is evaluated once.

    Adds ``canonical_url``, ``page_text``, ``blocked_signals``, ``pricing_signals``,
    ``custom_hints`` and ``mentions``.  Captures that cannot be read keep NULL text, so no
    regular expression runs on them.
    """
    html = capped_html(F.col("html"), max_chars)
    staged = computed_once(captures, canonical_url=urls.normalize_url(F.col("source_url")))
    readable = (
        F.col("canonical_url").isNotNull()
        & F.col("http_status").between(200, 299)
        & F.lower("content_type").contains("text/html")
    )
    staged = computed_once(staged, page_text=F.when(readable, text.html_text(html)))
    staged = computed_once(staged, lowered=F.lower("page_text"))
    staged = computed_once(
        staged,
        blocked_signals=text.phrases_in(F.col("lowered"), pages.blocked),
        pricing_signals=text.phrases_in(F.col("lowered"), pages.pricing),
        custom_hints=text.phrases_in(F.col("lowered"), pages.custom),
        mentions=F.coalesce(
            prices.price_mentions(F.col("page_text")), F.array().cast(prices.PRICE_TYPE)
        ),
    )
    return staged.drop("lowered")


def extract_pricing(captures: DataFrame, max_chars: int | None = None, pages: P.PagePolicy = P.PAGES) -> DataFrame:
    """Status, error, confidence, hash and payload of every capture.

    Input: ``source_url, http_status, content_type, html`` plus any key columns, and
    optionally ``fetch_error`` (text of a network failure).
    """
    facts = page_facts(captures, max_chars, pages)
    http = F.col("http_status")
    fetch_text = F.concat(F.lit("HTTP "), http.cast("string"))
    if "fetch_error" in captures.columns:
        fetch_text = F.coalesce(F.col("fetch_error"), fetch_text)
    bad_url = F.col("canonical_url").isNull()
    failed = ~F.coalesce(http.between(200, 299), F.lit(False))
    not_html = ~F.coalesce(F.lower("content_type").contains("text/html"), F.lit(False))
    bots = F.size("blocked_signals") > 0
    silent = (F.size("mentions") == 0) & (F.size("pricing_signals") == 0) & (F.size("custom_hints") == 0)
    status = first_true(
        [
            (bad_url, "manual_needed"),
            (failed, fetch_failure_status(http, pages)),
            (not_html, "manual_needed"),
            (bots, "blocked"),
            (silent, "manual_needed"),
        ],
        "ok",
    )
    error = first_true(
        [
            (bad_url, P.TEXT_INVALID_URL),
            (failed, fetch_text),
            (not_html, P.TEXT_NOT_HTML),
            (bots, F.concat(F.lit(P.TEXT_BOT_PREFIX), F.array_join("blocked_signals", ", "))),
            (silent, P.TEXT_NO_SIGNALS),
        ],
        F.lit(None).cast("string"),
    )
    judged = computed_once(facts, status=status, error=error)
    ok = F.col("status") == "ok"
    html = capped_html(F.col("html"), max_chars)
    payload = prices.canonical_payload(
        F.col("canonical_url"),
        text.page_title(html),
        text.meta_description(html),
        text.plan_headings(html),
        F.col("mentions"),
        F.col("custom_hints"),
    )
    scored = computed_once(
        judged,
        confidence=F.when(
            ok, prices.confidence(F.col("mentions"), F.col("pricing_signals"), F.col("custom_hints"))
        ).otherwise(F.lit(0.0)),
        content_hash=F.when(ok, text.content_hash(F.col("page_text"))),
        payload=F.when(ok, payload),
        capture_method=F.lit("static"),
    )
    verified = (
        ok & (F.col("confidence") >= P.VERIFIED_CONFIDENCE) & (F.size("payload.price_mentions") > 0)
    )
    return scored.withColumn("is_verified", F.coalesce(verified, F.lit(False)))


def mention_rows(facts: DataFrame, *keys: str) -> DataFrame:
    """One row per price mention, with its position on the page."""
    return facts.select(*keys, F.posexplode("mentions").alias("position", "mention")).select(
        *keys, "position", "mention.currency", "mention.period", "mention.amount"
    )


def price_buckets(mentions: DataFrame, *keys: str) -> DataFrame:
    """Count, lowest and highest amount per currency and period (A4).

    Sum-like aggregates only, so map-side combination keeps a hot key harmless.
    """
    return mentions.groupBy(*keys, "currency", "period").agg(
        F.count(F.lit(1)).alias("price_count"),
        F.min("amount").alias("min_amount"),
        F.max("amount").alias("max_amount"),
    )
