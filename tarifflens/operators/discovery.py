"""Finding the pricing page of a site from its home page."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarifflens import policies as P
from tarifflens.functions import text, urls
from tarifflens.functions.columns import bind, blank_to_null, computed_once
from tarifflens.functions.numbers import unit_interval2

# Fixed value: what an anchor looks like.  Groups: double-quoted, single-quoted, bare href, body.
_S = text.SPACE
_BARE = "[^\\t\\n\\x0B\\f\\r \\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff\"'<>`]"
ANCHOR_PATTERN = (
    f"(?i)<a{text.NOT_WORD_AFTER}[^>]*href{_S}*={_S}*"
    f"(?:\"([^\"]*)\"|'([^']*)'|({_BARE}+))[^>]*>([\\s\\S]*?)</a>"
)
CANDIDATE_TYPE = "array<struct<url:string,confidence:double,selected_by_user:boolean>>"


def anchors_of(html: Column) -> Column:
    """Links of a page as ``array<struct<href, text>>`` in page order."""
    whole = F.regexp_extract_all(html, F.lit(ANCHOR_PATTERN), F.lit(0))

    def one(a: Column) -> Column:
        group = lambda i: F.regexp_extract(a, ANCHOR_PATTERN, i)
        href = F.coalesce(blank_to_null(group(1)), blank_to_null(group(2)), group(3))
        return F.struct(href.alias("href"), text.html_text(group(4)).alias("text"))

    with_href = F.filter(F.transform(whole, one), lambda a: a["href"] != "")
    return F.transform(
        with_href, lambda a: F.struct(text.strip_ends(a["href"]).alias("href"), a["text"].alias("text"))
    )


def pattern_score(value: Column, table: tuple[tuple[str, float], ...]) -> Column:
    """Sum of the weights of all matching patterns, in table order."""
    parts = [F.when(value.rlike(text.ascii_edges(p)), F.lit(w)).otherwise(F.lit(0.0)) for p, w in table]
    return reduce(lambda left, right: left + right, parts, F.lit(0.0))


def link_confidence(path: Column, anchor_text: Column, links: P.LinkPolicy = P.LINKS) -> Column:
    """How likely a link leads to pricing."""

    def weigh(s: Column) -> Column:
        base = F.lit(links.base) + s["path_plus"] + s["text_plus"]
        agree = F.when((s["path_plus"] > 0.5) & (s["text_plus"] > 0.2), F.lit(links.agreement_bonus))
        rootish = F.when((s["path"] == "/") & (s["text_plus"] < 0.2), F.lit(links.root_penalty))
        return (
            base
            + F.coalesce(agree, F.lit(0.0))
            - F.coalesce(rootish, F.lit(0.0))
            - (s["path_minus"] + s["text_minus"])
        )

    def score(low: Column) -> Column:
        return F.struct(
            low["path"].alias("path"),
            pattern_score(low["path"], links.path_plus).alias("path_plus"),
            pattern_score(low["words"], links.text_plus).alias("text_plus"),
            pattern_score(low["path"], links.path_minus).alias("path_minus"),
            pattern_score(low["words"], links.text_minus).alias("text_minus"),
        )

    lowered = F.struct(F.lower(path).alias("path"), F.lower(anchor_text).alias("words"))
    return unit_interval2(bind(bind(lowered, score), weigh))


def ordered_candidates(candidates: Column) -> Column:
    """Most confident first, then by address (D8).  ``localeCompare`` order becomes byte order."""
    keyed = F.transform(
        candidates,
        lambda c: F.struct(
            (-c["confidence"]).alias("rank"),
            c["url"].alias("url"),
            c["selected_by_user"].alias("selected_by_user"),
        ),
    )
    return F.transform(
        F.array_sort(keyed),
        lambda c: F.struct(
            c["url"].alias("url"), (-c["rank"]).alias("confidence"), c["selected_by_user"].alias("selected_by_user")
        ),
    )


def merge_candidates(*lists: Column) -> Column:
    """One list per company out of several (D7, A12, O3), inside the row: no shuffle.

    Addresses are canonicalised, unusable ones dropped; the highest confidence and any user
    selection survive.
    """
    empty = F.array().cast(CANDIDATE_TYPE)
    together = F.concat(*[F.coalesce(x, empty) for x in lists])
    clean = F.filter(
        F.transform(
            together,
            lambda c: F.struct(
                urls.normalize_url(c["url"]).alias("url"),
                unit_interval2(c["confidence"]).alias("confidence"),
                F.coalesce(c["selected_by_user"], F.lit(False)).alias("selected_by_user"),
            ),
        ),
        lambda c: c["url"].isNotNull(),
    )

    def firsts(by_url: Column) -> Column:
        return F.filter(by_url, lambda c, i: (i == 0) | (F.get(by_url, i - 1)["url"] != c["url"]))

    def fold(all_of_them: Column) -> Column:
        # Sorted by address and falling confidence, or chosen ones first, the first of each run says all; both have the same runs.
        ranked = F.transform(all_of_them, lambda c: F.struct(c["url"].alias("url"), (-c["confidence"]).alias("rank")))
        chosen = F.transform(all_of_them, lambda c: F.struct(c["url"].alias("url"), (~c["selected_by_user"]).alias("not_chosen")))
        return F.zip_with(
            bind(F.array_sort(ranked), firsts),
            bind(F.array_sort(chosen), firsts),
            lambda best, mark: F.struct(
                best["url"].alias("url"), (-best["rank"]).alias("confidence"), (~mark["not_chosen"]).alias("selected_by_user")
            ),
        )

    return ordered_candidates(bind(clean, fold))


def recommended_primary(candidates: Column, links: P.LinkPolicy = P.LINKS) -> Column:
    """The clear winner of an ordered list, else NULL."""
    best, second = F.get(candidates, F.lit(0)), F.get(candidates, F.lit(1))
    strong = best["confidence"] >= links.primary_confidence
    clear = second.isNull() | ((best["confidence"] - second["confidence"]) >= links.primary_gap)
    return F.when(strong & clear, best["url"])


def discover_pricing_urls(
    homepages: DataFrame,
    max_candidates: int = P.DISCOVERY_MAX_CANDIDATES,
    min_confidence: float = P.DISCOVERY_MIN_CONFIDENCE,
    links: P.LinkPolicy = P.LINKS,
) -> DataFrame:
    """Candidates and recommended address per home page.

    Input: ``homepage_url, html`` and keys, optionally ``allowed_domain``.  All work on a page
    happens inside its row, so nothing is shuffled however large the crawl is.
    Adds ``canonical_homepage, candidates, recommended_primary_url``.
    """
    staged = computed_once(homepages, canonical_homepage=urls.normalize_url(F.col("homepage_url")))
    own_host = urls.bare_host(urls.host_of(F.col("canonical_homepage")))
    domain = own_host
    if "allowed_domain" in homepages.columns:
        domain = F.coalesce(urls.normalize_domain(F.col("allowed_domain")), own_host)
    staged = computed_once(
        staged,
        home_domain=domain,
        links=F.when(F.col("canonical_homepage").isNotNull(), anchors_of(F.col("html"))),
    )
    resolved = F.transform(
        F.filter("links", lambda a: urls.is_page_link(a["href"])),
        lambda a: F.struct(
            urls.normalize_url(urls.resolve_href(a["href"], F.col("canonical_homepage"))).alias("url"),
            a["text"].alias("text"),
        ),
    )
    inside = F.filter(
        resolved, lambda a: urls.within_domain(urls.bare_host(urls.host_of(a["url"])), F.col("home_domain"))
    )
    staged = computed_once(staged, inside=inside).drop("links", "home_domain")
    scored = F.filter(
        F.transform(
            "inside",
            lambda a: F.struct(
                a["url"].alias("url"),
                (-link_confidence(urls.path_of(a["url"]), a["text"], links)).alias("rank"),
            ),
        ),
        lambda c: c["rank"] <= -min_confidence,
    )

    def best_per_url(by_url: Column) -> Column:
        # Sorted by address and falling confidence: the first of each run is the maximum.
        firsts = F.filter(
            by_url, lambda c, i: (i == 0) | (F.get(by_url, i - 1)["url"] != c["url"])
        )
        return F.transform(
            firsts,
            lambda c: F.struct(
                c["url"].alias("url"), (-c["rank"]).alias("confidence"), F.lit(False).alias("selected_by_user")
            ),
        )

    top = F.slice(ordered_candidates(bind(F.array_sort(scored), best_per_url)), 1, max(1, max_candidates))
    staged = computed_once(
        staged, candidates=F.coalesce(top, F.array().cast(CANDIDATE_TYPE))
    ).drop("inside")
    return staged.withColumn("recommended_primary_url", recommended_primary(F.col("candidates"), links))


def candidate_rows(discovered: DataFrame, *keys: str) -> DataFrame:
    """One row per candidate with its rank from 1."""
    return discovered.select(*keys, F.posexplode("candidates").alias("i", "c")).select(
        *keys, (F.col("i") + 1).alias("rank"), "c.url", "c.confidence", "c.selected_by_user"
    )


def rediscover(companies: DataFrame, homepages: DataFrame, links: P.LinkPolicy = P.LINKS) -> DataFrame:
    """On-demand discovery for companies with a home page that was captured (D10); the others stay as they are.

    ``homepages``: ``company_id, html``. What is found is merged into what is known, and the primary address is
    only filled when empty.
    """
    pages = companies.where(F.col("homepage_url").isNotNull()).select(
        "company_id", "homepage_url", F.col("domain").alias("allowed_domain")
    )
    found = discover_pricing_urls(pages.join(homepages.select("company_id", "html"), "company_id"), links=links).select(
        "company_id", F.col("candidates").alias("found"), "recommended_primary_url"
    )
    joined = companies.join(found, "company_id", "left")
    known = F.col("pricing_url_candidates")
    return (
        joined.withColumn(
            "pricing_url_candidates",
            F.when(F.col("found").isNotNull(), merge_candidates(known, F.col("found"))).otherwise(known),
        )
        .withColumn("primary_pricing_url", F.coalesce("primary_pricing_url", "recommended_primary_url"))
        .drop("found")
    )
