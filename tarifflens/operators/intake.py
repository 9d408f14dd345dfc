"""User input: new companies, own price lists, choice of the pricing page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarifflens import policies as P
from tarifflens.functions import urls
from tarifflens.functions.columns import bind, blank_to_null, computed_once, first_true
from tarifflens.functions.text import strip_ends
from tarifflens.operators.discovery import CANDIDATE_TYPE, discover_pricing_urls, merge_candidates


def checked_requests(requests: DataFrame) -> DataFrame:
    """Shape checks of company requests (R15), each with its first failing reason.

    Adds ``clean_name, homepage, pricing, company_domain, reject_reason``.
    """
    given = {c: blank_to_null(strip_ends(F.col(c))) for c in ("name", "domain", "homepage_url", "primary_pricing_url")}
    trimmed = computed_once(
        requests,
        clean_name=given["name"],
        _domain=given["domain"],
        _home=given["homepage_url"],
        _pricing=given["primary_pricing_url"],
    )
    parsed = computed_once(
        trimmed,
        homepage=urls.normalize_url(F.col("_home"), keep_query=True),
        pricing=urls.normalize_url(F.col("_pricing"), keep_query=True),
        _strict=urls.strict_domain(F.col("_domain")),
    )
    host = lambda c: urls.bare_host(urls.host_of(F.col(c)))
    named = computed_once(
        parsed,
        _home_host=host("homepage"),
        _pricing_host=host("pricing"),
        company_domain=F.coalesce("_strict", host("homepage"), host("pricing")),
    )
    foreign = lambda c: ~urls.within_domain(F.col(c), F.col("company_domain"))
    reason = first_true(
        [
            (
                F.col("clean_name").isNull()
                | (F.length("clean_name") > 120)
                | ~F.coalesce(F.col("type").isin(*P.COMPANY_TYPES), F.lit(False)),
                "invalid_request_body",
            ),
            (F.col("_domain").isNull() & F.col("_home").isNull() & F.col("_pricing").isNull(), "invalid_request_body"),
            (F.col("_home").isNotNull() & F.col("homepage").isNull(), "invalid_homepage_url"),
            (F.col("_pricing").isNotNull() & F.col("pricing").isNull(), "invalid_pricing_url"),
            (F.col("_domain").isNotNull() & F.col("_strict").isNull(), "invalid_domain"),
            (F.col("company_domain").isNull(), "unresolved_domain"),
            (foreign("_home_host"), "homepage_domain_mismatch"),
            (foreign("_pricing_host"), "pricing_domain_mismatch"),
        ],
        F.lit(None).cast("string"),
    )
    return named.withColumn("reject_reason", reason).drop(
        "_domain", "_home", "_pricing", "_strict", "_home_host", "_pricing_host"
    )


def admit_companies(requests: DataFrame, entitled_users: DataFrame, companies: DataFrame) -> DataFrame:
    """Decide a batch of company requests in arrival order.

    ``entitled_users`` carries ``access_granted, competitor_limit``.  The one-by-one rules have
    a closed form, so no user is replayed row by row: only the first request for a (user, type,
    domain) not yet tracked is *fresh*; competitors are admitted until the plan is full, which
    happens at the n-th fresh request; later ones hit the cap.
    """
    checked = checked_requests(requests)
    order = F.struct("requested_at", "request_id")
    domain_keys = ["user_id", "type", "company_domain"]
    # Per user: plan, what is tracked already, how many competitors still fit.
    tracked = companies.groupBy("user_id").agg(
        F.count_if(F.col("type") == "competitor").alias("tracked_competitors"),
        F.bool_or(F.col("type") == "self").alias("has_self"),
    )
    granted = F.coalesce("access_granted", F.lit(False))
    limits = (
        entitled_users.select("user_id", "access_granted", "competitor_limit")
        .join(tracked, "user_id", "left")
        .select(
            "user_id",
            F.lit(True).alias("owner_found"),
            F.coalesce("has_self", F.lit(False)).alias("has_self"),
            F.when(granted, F.col("competitor_limit") - F.coalesce("tracked_competitors", F.lit(0)))
            .otherwise(F.lit(0))
            .alias("room"),
        )
    )
    # Per user, type and domain: first usable request, and whether it is tracked already.
    known = companies.groupBy("user_id", "type", F.col("domain").alias("company_domain")).agg(
        F.lit(True).alias("domain_known")
    )
    firsts = (
        checked.where(F.col("reject_reason").isNull())
        .groupBy(*domain_keys)
        .agg(F.min(order).alias("first_seen"))
        .join(known, domain_keys, "left")
        .withColumn("domain_known", F.coalesce("domain_known", F.lit(False)))
    )
    # The request that fills a plan is the n-th fresh one, for any n.  Requests are numbered per user and day on top
    # of the counts of the days before, so that a user with very many requests is not one task.
    fresh = firsts.where(~F.col("domain_known")).withColumn("day", F.to_date("first_seen.requested_at"))
    days = fresh.groupBy("user_id", "type", "day").agg(F.count(F.lit(1)).alias("on_day"))
    earlier = Window.partitionBy("user_id", "type").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    days = days.withColumn("before", F.coalesce(F.sum("on_day").over(earlier), F.lit(0))).drop("on_day")
    within = Window.partitionBy("user_id", "type", "day").orderBy("first_seen")
    numbered = fresh.withColumn("place", F.row_number().over(within)).join(days, ["user_id", "type", "day"])
    numbered = numbered.withColumn("nth", F.col("before") + F.col("place"))
    seen_at = lambda kind, n: F.max(
        F.when((F.col("type") == kind) & (F.col("nth") == n), F.col("first_seen"))
    )
    cutoffs = numbered.join(limits.select("user_id", "room"), "user_id").groupBy("user_id").agg(
        seen_at("competitor", F.col("room")).alias("full_from"), seen_at("self", F.lit(1)).alias("self_from")
    )
    joined = checked.join(limits.join(cutoffs, "user_id", "left"), "user_id", "left").join(firsts, domain_keys, "left")
    is_self = F.col("type") == "self"
    capped = (F.col("type") == "competitor") & (
        (F.col("room") <= 0) | F.coalesce(order > F.col("full_from"), F.lit(False))
    )
    second_self = is_self & (F.col("has_self") | F.coalesce(order > F.col("self_from"), F.lit(False)))
    repeated = F.col("domain_known") | F.coalesce(order > F.col("first_seen"), F.lit(False))
    reason = first_true(
        [
            (F.col("reject_reason").isNotNull(), F.col("reject_reason")),
            (F.col("owner_found").isNull(), "user_not_found"),
            (capped, "competitor_limit_reached"),
            (second_self, "self_company_already_exists"),
            (repeated, "domain_already_exists_for_type"),
        ],
        F.lit(None).cast("string"),
    )
    shown = [*requests.columns, "clean_name", "homepage", "pricing", "company_domain"]
    return joined.withColumn("reject_reason", reason).select(*shown, "reject_reason")


def new_companies(
    admitted: DataFrame, now: Column, homepages: DataFrame | None = None, links: P.LinkPolicy = P.LINKS
) -> DataFrame:
    """Rows to append for admitted requests; competitors are due at once.

    A competitor without a pricing page gets the candidates of its home page, if that was captured. ``homepages``:
    ``homepage, html``, one row per canonical address. A home page is searched once, however many requests name it.
    """
    kept = admitted.where(F.col("reject_reason").isNull())
    if homepages is None:
        kept = kept.withColumns({"_found": F.lit(None).cast(CANDIDATE_TYPE), "_primary": F.lit(None).cast("string")})
    else:
        searching = (F.col("type") == "competitor") & F.col("pricing").isNull() & F.col("homepage").isNotNull()
        keyed = kept.withColumn("_site", F.when(searching, F.col("homepage")))
        sites = keyed.where(F.col("_site").isNotNull()).select("_site", "company_domain").distinct()
        pages = sites.join(homepages.select(F.col("homepage").alias("_site"), "html"), "_site").select(
            F.col("_site").alias("homepage_url"), F.col("company_domain").alias("allowed_domain"), "html"
        )
        found = discover_pricing_urls(pages, links=links).select(
            F.col("homepage_url").alias("_site"),
            F.col("allowed_domain").alias("company_domain"),
            F.col("candidates").alias("_found"),
            F.col("recommended_primary_url").alias("_primary"),
        )
        kept = keyed.join(found, ["_site", "company_domain"], "left")
    chosen = F.when(
        F.col("pricing").isNotNull(),
        F.array(F.struct(F.col("pricing").alias("url"), F.lit(1.0).alias("confidence"), F.lit(True).alias("selected_by_user"))),
    )
    return kept.select(
        "request_id",
        "user_id",
        F.col("clean_name").alias("name"),
        "type",
        F.col("company_domain").alias("domain"),
        F.col("homepage").alias("homepage_url"),
        F.coalesce("pricing", "_primary").alias("primary_pricing_url"),
        merge_candidates(chosen, F.col("_found")).alias("pricing_url_candidates"),
        F.when(F.col("type") == "competitor", now).alias("next_crawl_at"),
    )


def select_primary(commands: DataFrame, companies: DataFrame) -> DataFrame:
    """Choose the pricing page of a company.

    ``commands``: ``command_id, company_id, user_id, url, candidate_url``; exactly one of the two
    addresses.  A candidate must be on the list; a free address is added with confidence 1.
    """
    free = blank_to_null(strip_ends(F.col("url")))
    listed = blank_to_null(strip_ends(F.col("candidate_url")))
    given = computed_once(commands, _free=free, _listed=listed)
    chosen = computed_once(given, selected_url=urls.normalize_url(F.coalesce("_listed", "_free")))
    target = companies.select(
        "company_id", "user_id", "domain",
        F.col("primary_pricing_url").alias("previous_primary_url"),
        merge_candidates(F.col("pricing_url_candidates")).alias("merged"),
        F.lit(True).alias("_found"),
    )
    joined = chosen.join(target, ["company_id", "user_id"], "left")
    host = urls.bare_host(urls.host_of(F.col("selected_url")))
    on_list = F.exists("merged", lambda c: c["url"] == F.col("selected_url"))
    reason = first_true(
        [
            (F.col("_free").isNull() == F.col("_listed").isNull(), "invalid_request_body"),
            (F.col("selected_url").isNull(), "invalid_pricing_url"),
            (F.col("_found").isNull(), "company_not_found"),
            (~urls.within_domain(host, urls.bare_host(F.col("domain"))), "domain_mismatch"),
            (F.col("_listed").isNotNull() & ~on_list, "candidate_url_not_found"),
        ],
        F.lit(None).cast("string"),
    )
    judged = computed_once(joined, reject_reason=reason)
    accepted = F.col("reject_reason").isNull()
    added = F.array(
        F.struct(F.col("selected_url").alias("url"), F.lit(1.0).alias("confidence"), F.lit(True).alias("selected_by_user"))
    )
    merged = F.when(F.col("_listed").isNotNull(), F.col("merged")).otherwise(merge_candidates(F.col("merged"), added))
    marked = bind(
        merged,
        lambda m: F.transform(
            m,
            lambda c: F.struct(
                c["url"].alias("url"),
                c["confidence"].alias("confidence"),
                (c["url"] == F.col("selected_url")).alias("selected_by_user"),
            ),
        ),
    )
    return judged.select(
        "command_id",
        "company_id",
        "user_id",
        accepted.alias("accepted"),
        "reject_reason",
        F.when(accepted, F.col("selected_url")).alias("primary_pricing_url"),
        F.when(accepted, marked).alias("pricing_url_candidates"),
        (accepted & ~F.col("previous_primary_url").eqNullSafe(F.col("selected_url"))).alias("primary_changed"),
    )


def checked_price_lists(changes: DataFrame) -> DataFrame:
    """Validate own price lists.

    ``plans`` is ``array<struct<name, price, price_anchor, highlights>>``.  Adds the cleaned columns
    and ``valid``.
    """
    money = lambda x: (x >= 0) & (x <= 1_000_000)
    plans = F.transform(
        "plans",
        lambda p: F.struct(
            strip_ends(p["name"]).alias("name"),
            p["price"].alias("price"),
            p["price_anchor"].alias("price_anchor"),
            F.transform(F.coalesce(p["highlights"], F.array().cast("array<string>")), strip_ends).alias("highlights"),
        ),
    )
    cleaned = computed_once(
        changes.withColumnRenamed("plans", "_raw_plans").withColumn("plans", F.col("_raw_plans")),
        plans=plans,
        currency=F.coalesce(F.upper(strip_ends(F.col("currency"))), F.lit("USD")),
        billing_period=F.coalesce("billing_period", F.lit("month")),
        notes=strip_ends(F.col("notes")),
    ).drop("_raw_plans")
    good_plan = lambda p: (
        F.length(p["name"]).between(1, 120)
        & money(p["price"])
        & (p["price_anchor"].isNull() | money(p["price_anchor"]))
        & (F.size(p["highlights"]) <= 10)
        & F.forall(p["highlights"], lambda h: F.length(h).between(1, 160))
    )
    valid = (
        F.col("currency").rlike("^[A-Z]{3}$")
        & F.col("billing_period").isin(*P.BILLING_PERIODS)
        & F.size("plans").between(1, 20)
        & F.forall("plans", good_plan)
        & (F.col("notes").isNull() | (F.length("notes") <= 2000))
    )
    return cleaned.withColumn("valid", F.coalesce(valid, F.lit(False)))


def upsert_price_lists(existing: DataFrame, changes: DataFrame) -> DataFrame:
    """One price list per user after all valid changes.

    The latest change wins; missing notes leave the latest notes given before.  Existing rows
    join the same aggregate as the oldest change, which replaces a full outer join.
    """
    columns = ["user_id", "currency", "billing_period", "plans", "notes"]
    at = F.struct("changed_at", "change_id")
    valid = checked_price_lists(changes).where("valid").select(*columns, F.struct(F.lit(1).alias("gen"), at.alias("at")).alias("turn"))
    at_type = valid.schema["turn"].dataType.simpleString()
    old = existing.select(*columns, F.lit(None).cast(at_type).alias("turn")).withColumn(
        "turn", F.struct(F.lit(0).alias("gen"), F.col("turn.at").alias("at"))
    )
    # Later turns compare higher: generation first, then time and id.
    every = old.unionByName(valid)
    return every.groupBy("user_id").agg(
        F.max_by(F.struct("currency", "billing_period", "plans"), "turn").alias("latest"),
        F.max_by("notes", F.when(F.col("notes").isNotNull(), F.col("turn"))).alias("notes"),
    ).select("user_id", "latest.currency", "latest.billing_period", "latest.plans", "notes")
