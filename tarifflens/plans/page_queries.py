"""Registered queries over page captures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarifflens.functions import text, urls
from tarifflens.functions.columns import blank_to_null, computed_once
from tarifflens.operators import discovery, extraction
from tarifflens.session import tune
from tarifflens.sources.fixtures import view
from tarifflens.sources.tables import spread, table


def _captures(spark: SparkSession, folder: str) -> DataFrame:
    return spread(view(tune(spark), folder, "captures"))


def _homepages(spark: SparkSession, folder: str) -> DataFrame:
    return spread(view(tune(spark), folder, "homepages"))


def _pages(spark: SparkSession, folder: str) -> DataFrame:
    return spread(table(tune(spark), folder, "pages"))


def page_text_hash(spark: SparkSession, folder: str) -> DataFrame:
    read = computed_once(_pages(spark, folder), page_text=text.html_text(F.col("html")))
    return read.select(
        "page_id",
        F.length("page_text").cast("bigint").alias("text_chars"),
        text.content_hash(F.col("page_text")).alias("content_hash"),
    )


def page_meta(spark: SparkSession, folder: str) -> DataFrame:
    return _pages(spark, folder).select(
        "page_id",
        text.page_title(F.col("html")).alias("title"),
        text.meta_description(F.col("html")).alias("description"),
    )


def price_mentions(spark: SparkSession, folder: str) -> DataFrame:
    rows = extraction.mention_rows(extraction.page_facts(_captures(spark, folder)), "company_id")
    return rows.withColumn("position", F.col("position").cast("bigint"))


def price_buckets(spark: SparkSession, folder: str) -> DataFrame:
    facts = extraction.page_facts(_captures(spark, folder)).withColumn("host", urls.host_of(F.col("canonical_url")))
    return extraction.price_buckets(extraction.mention_rows(facts, "host"), "host")


def page_signals(spark: SparkSession, folder: str) -> DataFrame:
    facts = extraction.page_facts(_captures(spark, folder))
    tagged = lambda kind, col: F.transform(
        col, lambda p: F.struct(F.lit(kind).alias("kind"), p.alias("phrase"))
    )
    found = F.concat(
        tagged("blocked", "blocked_signals"), tagged("pricing", "pricing_signals"), tagged("custom", "custom_hints")
    )
    return facts.select("company_id", F.inline(found))


def extraction_status(spark: SparkSession, folder: str) -> DataFrame:
    return extraction.extract_pricing(_captures(spark, folder)).select(
        "company_id", "status", "error", "confidence", "is_verified", "content_hash"
    )


def plan_headings(spark: SparkSession, folder: str) -> DataFrame:
    rows = _captures(spark, folder).select("company_id", F.explode(text.plan_headings(F.col("html"))).alias("heading"))
    return rows.groupBy("company_id", "heading").agg(F.count(F.lit(1)).alias("occurrences"))


def canonical_prices(spark: SparkSession, folder: str) -> DataFrame:
    ok = extraction.extract_pricing(_captures(spark, folder)).where("status = 'ok'")
    return ok.select("company_id", F.inline("payload.price_mentions"))


def canonical_texts(spark: SparkSession, folder: str) -> DataFrame:
    ok = extraction.extract_pricing(_captures(spark, folder)).where("status = 'ok'")
    return ok.select(
        "company_id",
        "payload.source_url",
        "payload.page_title",
        "payload.page_description",
        F.array_join("payload.plan_names", "|").alias("plan_names"),
        F.array_join("payload.custom_pricing_hints", "|").alias("custom_pricing_hints"),
    )


def normalized_urls(spark: SparkSession, folder: str) -> DataFrame:
    named = computed_once(
        _pages(spark, folder).select("page_id", "url"),
        canonical_url=urls.normalize_url(F.col("url")),
        input_url=urls.normalize_url(F.col("url"), keep_query=True),
    )
    return named.withColumn("host", urls.host_of(F.col("canonical_url")))


def input_domains(spark: SparkSession, folder: str) -> DataFrame:
    return spread(view(tune(spark), folder, "intake")).select(
        "request_id",
        blank_to_null(urls.normalize_domain(F.col("domain"))).alias("lenient_domain"),
        urls.strict_domain(F.col("domain")).alias("strict_domain"),
    )


def anchors(spark: SparkSession, folder: str) -> DataFrame:
    rows = _homepages(spark, folder).select(
        "page_id", F.posexplode(discovery.anchors_of(F.col("html"))).alias("position", "a")
    )
    return rows.select(
        "page_id",
        F.col("position").cast("bigint").alias("position"),
        "a.href",
        F.col("a.text").alias("anchor_text"),
        (~urls.is_page_link(F.col("a.href"))).alias("ignored"),
    )


def resolved_links(spark: SparkSession, folder: str) -> DataFrame:
    pages = computed_once(_homepages(spark, folder), base=urls.normalize_url(F.col("homepage_url")))
    rows = pages.select(
        "page_id", "base", F.posexplode(discovery.anchors_of(F.col("html"))).alias("position", "a")
    ).where(urls.is_page_link(F.col("a.href")))
    return rows.select(
        "page_id",
        F.col("position").cast("bigint").alias("position"),
        "a.href",
        urls.normalize_url(urls.resolve_href(F.col("a.href"), F.col("base"))).alias("url"),
    )


def url_candidates(spark: SparkSession, folder: str) -> DataFrame:
    found = discovery.discover_pricing_urls(_homepages(spark, folder))
    return discovery.candidate_rows(found, "page_id").select(
        "page_id", F.col("rank").cast("bigint").alias("rank"), "url", "confidence"
    )


def recommended_primary(spark: SparkSession, folder: str) -> DataFrame:
    found = discovery.discover_pricing_urls(_homepages(spark, folder))
    return found.where(F.col("recommended_primary_url").isNotNull()).select(
        "page_id", "recommended_primary_url", F.get("candidates", F.lit(0))["confidence"].alias("confidence")
    )


def merged_candidates(spark: SparkSession, folder: str) -> DataFrame:
    found = discovery.discover_pricing_urls(_homepages(spark, folder))
    merged = found.withColumn("candidates", discovery.merge_candidates(_known_candidates(), F.col("candidates")))
    rows = discovery.candidate_rows(merged, "page_id")
    return rows.withColumn("rank", F.col("rank").cast("bigint"))


def _known_candidates() -> Column:
    """What is known of a site before its home page is searched."""
    own = urls.normalize_url(F.col("homepage_url"))
    return F.array(
        F.struct(
            own.alias("url"), F.lit(0.5).alias("confidence"), (F.col("page_id") % 2 == 0).alias("selected_by_user")
        ),
        F.struct(
            F.concat(F.regexp_extract(own, "^([a-z]+://[^/]*)", 1), F.lit("/pricing")).alias("url"),
            F.lit(0.31).alias("confidence"),
            F.lit(True).alias("selected_by_user"),
        ),
    )


def rediscovered(spark: SparkSession, folder: str) -> DataFrame:
    """Candidates and primary address of every site after a search on demand; some have no home page, some no capture."""
    pages = _homepages(spark, folder)
    own = F.when(F.col("page_id") % 3 == 0, F.lit("https://own.example.com/pricing"))
    companies = pages.select(
        F.col("page_id").alias("company_id"),
        F.when(F.col("page_id") % 11 != 0, F.col("homepage_url")).alias("homepage_url"),
        F.lit(None).cast("string").alias("domain"),
        own.alias("primary_pricing_url"),
        _known_candidates().alias("pricing_url_candidates"),
    )
    captured = pages.where("page_id % 7 != 0").select(F.col("page_id").alias("company_id"), "html")
    done = discovery.rediscover(companies, captured)
    rows = discovery.candidate_rows(done.withColumnRenamed("pricing_url_candidates", "candidates"), "company_id", "primary_pricing_url")
    return rows.withColumn("rank", F.col("rank").cast("bigint"))


PAGE_QUERIES = {
    f.__name__: f
    for f in (
        page_text_hash, page_meta, price_mentions, price_buckets, page_signals, extraction_status,
        plan_headings, canonical_prices, canonical_texts, normalized_urls, input_domains, anchors,
        resolved_links, url_candidates, recommended_primary, merged_candidates, rediscovered,
    )
}
