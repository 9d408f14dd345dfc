"""Input tables derived from the generated test tables.

Each view is a list of column expressions over one table.  The expressions use only what
Spark SQL and DuckDB read the same way, so the checking side can run the same text; ``@T'…'``
stands for a timestamp literal without zone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarifflens.sources.tables import table

NOW = "2001-08-01 00:00:00"

_PAGE_PART = """case
 when page_id % 8 = 0 then concat('<h2>Starter plan</h2><p>$', cast(9 + page_id % 30 as string), '/month</p><h2>Pro</h2><p>EUR 1,299.50 per year</p><p>Team &pound; 5</p>')
 when page_id % 8 = 1 then '<p>Contact sales for enterprise pricing</p>'
 when page_id % 8 = 2 then '<p>Please verify you are human. Cloudflare</p>'
 when page_id % 8 = 3 then '<h3>Plans</h3><p>Billed monthly</p>'
 when page_id % 8 = 4 then '<p>Only $49 per member, free trial</p>'
 else '' end"""
_OLD_PAGE_PART = f"""case
 when page_id % 3 = 0 then {_PAGE_PART}
 when page_id % 8 = 0 then concat('<h2>Starter plan</h2><p>$', cast(8 + page_id % 30 as string), '/month</p><p>EUR 999.50 per year</p><p>USD 10 per day</p>')
 when page_id % 8 = 1 then '<p>Book a demo</p>'
 when page_id % 8 = 3 then '<h3>Plans</h3><p>Contact sales</p>'
 when page_id % 8 = 4 then '<p>Only $45 per member, free trial</p>'
 else '<p>See our plans</p>' end"""
_LINK_PART = """case page_id % 6
 when 0 then '<a href="/pricing">Pricing</a>'
 when 1 then '<a href="/plans/">Compare plans</a><a href=/pricing?x=1#y>See pricing</a>'
 when 2 then concat('<a class="n" href=', chr(39), '/blog/pricing', chr(39), '>Pricing tips</a><a href="/product/plan">Plan</a>')
 when 3 then '<a href="mailto:a@b.c">Pricing</a><a href="https://other.example.org/pricing">Pricing</a>'
 when 4 then '<a href="//PATH//x">x</a><a href="/legal/terms">Plans</a><a href="/cost">Get started, free trial</a>'
 else '' end"""

# name -> (base table, distinct, group by, {column: expression})
VIEWS: dict[str, tuple[str, bool, str | None, dict[str, str]]] = {
    "users": ("customer", False, None, {
        "user_id": "c_custkey",
        "name": "c_name",
        "email": "case when c_custkey % 50 = 0 then null when c_custkey % 50 = 1 then '' else concat('u', cast(c_custkey as string), '@example.com') end",
        "customer_id": "case when c_custkey % 7 = 0 then null else concat('cus_', cast(c_custkey as string)) end",
        "has_access": "c_mktsegment in ('BUILDING', 'MACHINERY')",
        "price_id": "case when c_mktsegment = 'BUILDING' then 'price_pro' when c_mktsegment = 'MACHINERY' and c_custkey % 5 = 0 then 'price_gone' when c_mktsegment = 'MACHINERY' then 'price_starter' end",
        "trial_status": "case c_custkey % 4 when 0 then 'not_started' when 1 then 'active' when 2 then 'expired' else 'converted' end",
        "trial_started_at": "case when c_custkey % 4 = 0 and c_custkey % 3 <> 0 then null else @T'2001-07-20 00:00:00' + (c_custkey % 14) * interval '1' day end",
        "trial_ends_at": "case when c_custkey % 4 = 0 and c_custkey % 3 <> 0 then null else @T'2001-07-27 00:00:00' + (c_custkey % 14) * interval '1' day end",
        "last_digest_sent_at": "case c_custkey % 6 when 0 then @T'2001-07-30 00:00:00' when 1 then @T'2001-07-01 00:00:00' end",
    }),
    "companies": ("supplier", False, None, {
        "company_id": "s_suppkey",
        "user_id": "s_suppkey % 20",
        "name": "s_name",
        "domain": "concat('c', cast(s_suppkey as string), '.example.com')",
        "type": "case when s_suppkey < 20 then 'self' else 'competitor' end",
        "homepage_url": "concat('https://c', cast(s_suppkey as string), '.example.com/')",
        "primary_pricing_url": "case when s_suppkey % 3 = 0 then concat('https://c', cast(s_suppkey as string), '.example.com/pricing') end",
        "last_crawl_status": "case s_suppkey % 5 when 0 then 'idle' when 1 then 'ok' when 2 then 'blocked' when 3 then 'manual_needed' else 'error' end",
        "last_crawl_error": "case when s_suppkey % 5 >= 2 then concat('failure ', cast(s_suppkey as string)) end",
        "last_crawl_at": "case when s_suppkey % 5 > 0 then @T'2001-07-30 00:00:00' - (s_suppkey % 10) * interval '1' hour end",
        "latest_confidence": "case when s_suppkey % 5 = 1 then cast(s_suppkey % 10 as double) / 10 end",
        "next_crawl_at": "case when s_suppkey % 9 = 0 then null else @T'2001-07-31 00:00:00' + (s_suppkey % 5) * interval '12' hour end",
        "crawl_lease_until": "case s_suppkey % 4 when 0 then @T'2001-08-01 00:05:00' when 1 then @T'2001-07-31 23:00:00' end",
        "created_at": "@T'2001-01-01 00:00:00' + (s_suppkey % 90) * interval '1' day",
        "updated_at": "@T'2001-06-01 00:00:00' + (s_suppkey % 17) * interval '1' day",
    }),
    # Companies whose pages were captured: one per page, owned by the customers in turn.
    "page_companies": ("pages", False, None, {
        "company_id": "page_id",
        "user_id": "page_id % 60",
        "name": "concat('Site ', cast(page_id as string))",
        "type": "case when page_id % 25 = 24 then 'self' else 'competitor' end",
        "homepage_url": "case when page_id % 20 = 19 then null else url end",
        "primary_pricing_url": "case when page_id % 10 = 9 then null else url end",
        "last_crawl_status": "case page_id % 5 when 0 then 'idle' when 1 then 'ok' when 2 then 'blocked' when 3 then 'manual_needed' else 'error' end",
        "next_crawl_at": "case when page_id % 9 = 0 then null else @T'2001-07-31 00:00:00' + (page_id % 5) * interval '8' hour end",
        "crawl_lease_until": "case page_id % 12 when 1 then @T'2001-08-01 00:05:00' when 2 then @T'2001-07-31 23:00:00' end",
        "updated_at": "@T'2001-06-01 00:00:00' + (page_id % 17) * interval '1' day",
    }),
    "captures": ("pages", False, None, {
        "company_id": "page_id",
        "source_url": "url",
        "http_status": "case page_id % 12 when 9 then 403 when 10 then 404 when 11 then 500 else 200 end",
        "content_type": "case when page_id % 12 = 8 then 'application/pdf' else 'text/html; charset=utf-8' end",
        "html": f"concat(html, {_PAGE_PART})",
    }),
    # The same pages as seen on the day before.
    "old_captures": ("pages", False, None, {
        "company_id": "page_id",
        "source_url": "url",
        "http_status": "case when page_id % 12 = 11 then 500 else 200 end",
        "content_type": "'text/html'",
        "html": f"concat(html, {_OLD_PAGE_PART})",
    }),
    "homepages": ("pages", False, None, {
        "page_id": "page_id",
        "homepage_url": "url",
        "html": f"concat(html, {_LINK_PART})",
    }),
    # The same pages as the home pages of the sites that intake requests name.
    "site_captures": ("pages", False, None, {
        "page_id": "page_id",
        "homepage_url": "concat('https://www.s', cast(page_id as string), '.example.com/')",
        "html": f"concat(html, {_LINK_PART})",
    }),
    "snapshot_prices": ("lineitem", True, None, {
        "company_id": "l_suppkey",
        "captured_at": "cast(date_trunc('month', l_shipdate) as @TYPE)",
        "currency": "case l_suppkey % 3 when 0 then 'USD' when 1 then 'EUR' else 'GBP' end",
        "period": "case when l_linenumber <= 4 then 'month' else 'year' end",
        "amount": "cast(l_linenumber * 10 as double) + case when l_tax >= 0.08 then cast(l_linenumber as double) * cast(0.5 as double) when l_discount >= 0.1 then cast(5 as double) else cast(0 as double) end",
    }),
    "diffs": ("orders", False, None, {
        "diff_id": "o_orderkey",
        "user_id": "o_custkey % 20",
        "company_id": "20 + o_custkey % 85",
        "severity": "case when o_orderpriority like '1%' then 'high' when o_orderpriority like '2%' or o_orderpriority like '3%' then 'medium' else 'low' end",
        "verification_state": "case when o_orderstatus = 'P' then 'unverified' else 'verified' end",
        "detected_at": "o_orderdate",
    }),
    "insights": ("lineitem", False, "l_orderkey, l_linenumber", {
        "insight_id": "l_orderkey * 10 + l_linenumber",
        "diff_id": "l_orderkey",
        "generated_at": "max(l_shipdate)",
        "severity_gate": "case when max(l_returnflag) = 'A' then 'high_only' else 'high_and_medium' end",
    }),
    "billing_events": ("events", False, None, {
        "event_id": "event_id",
        "arrived_at": "ts",
        "user_id": "user_id",
        "event_type": "case event_type when 'signup' then 'checkout.session.completed' when 'purchase' then 'invoice.paid' when 'error' then 'customer.subscription.deleted' when 'click' then 'customer.subscription.updated' else 'invoice.payment_failed' end",
        "subscription_status": "case event_id % 7 when 0 then 'active' when 1 then 'trialing' when 2 then 'past_due' when 3 then 'canceled' when 4 then 'unpaid' when 5 then 'incomplete' else 'paused' end",
        "price_id": "case event_id % 5 when 0 then 'price_pro' when 1 then null when 2 then 'price_unknown' else 'price_starter' end",
        # Some events carry no customer id, some the id of another user, some one that nobody has.
        "customer_id": "case when event_id % 11 = 10 then null when event_id % 13 = 5 then concat('cus_', cast(user_id + 1 as string)) when event_id % 17 = 3 then 'cus_none' else concat('cus_', cast(user_id as string)) end",
    }),
    # The same kind of journal as it comes in: checkouts name a user, an e-mail (known or not), both or nothing.
    "billing_journal": ("events", False, None, {
        "event_id": "event_id",
        "arrived_at": "ts",
        "client_reference_id": "case user_id % 5 when 0 then user_id when 1 then null when 2 then user_id + 1000000 when 3 then null else user_id end",
        "customer_email": "case when event_id % 23 = 7 then '  ' when user_id % 5 = 1 then concat(' U', cast(user_id as string), '@Example.com ') when user_id % 5 = 2 then concat('New', cast(user_id % 40 as string), '@example.com') when user_id % 5 = 3 and event_id % 2 = 0 then concat('new', cast(user_id % 40 as string), '@example.com') end",
        "event_type": "case event_type when 'signup' then 'checkout.session.completed' when 'purchase' then 'invoice.paid' when 'error' then 'customer.subscription.deleted' when 'click' then 'customer.subscription.updated' else 'checkout.session.completed' end",
        "subscription_status": "case event_id % 7 when 0 then 'active' when 1 then 'trialing' when 2 then 'past_due' when 3 then 'canceled' when 4 then 'unpaid' when 5 then 'incomplete' else 'paused' end",
        "price_id": "case event_id % 5 when 0 then 'price_pro' when 1 then null when 2 then 'price_unknown' else 'price_starter' end",
        # Ids are brought again and again, change hands, are shared by several accounts and come back.
        "customer_id": "case when event_id % 11 = 10 then null when event_id % 13 = 5 then concat('cus_', cast(user_id + 1 as string)) when event_id % 17 = 3 then 'cus_none' when user_id % 5 in (2, 3) then concat('cus_new', cast(user_id % 40 as string)) else concat('cus_', cast(user_id as string)) end",
    }),
    "requests": ("events", False, None, {
        "request_id": "event_id",
        "key": "user_id",
        "ts": "ts",
    }),
    "intake": ("orders", False, None, {
        "request_id": "o_orderkey",
        "requested_at": "o_orderdate",
        "user_id": "o_custkey",
        "name": "case when o_orderkey % 41 = 0 then '   ' when o_orderkey % 43 = 0 then repeat('n', 121) else concat(' Company ', cast(o_orderkey as string)) end",
        "type": "case when o_orderstatus = 'P' then 'self' when o_orderkey % 37 = 0 then 'partner' else 'competitor' end",
        "domain": "case o_orderkey % 7 when 0 then null when 1 then 'not a domain' when 2 then concat('WWW.s', cast(o_orderkey % 40 as string), '.example.com') else concat('s', cast(o_orderkey % 40 as string), '.example.com') end",
        "homepage_url": "case o_orderkey % 6 when 0 then null when 1 then concat('s', cast(o_orderkey % 40 as string), '.example.com//home/?a=1#top') when 2 then 'ftp://files.example.com' when 3 then 'https://elsewhere.example.org/' else concat('https://www.s', cast(o_orderkey % 40 as string), '.example.com') end",
        "primary_pricing_url": "case o_orderkey % 5 when 0 then concat('https://app.s', cast(o_orderkey % 40 as string), '.example.com/pricing?plan=1') when 1 then 'https://foreign.example.net/pricing' end",
    }),
    # Requests to change the own price list: one per order, its lines being the plans.
    "plan_lines": ("lineitem", False, None, {
        "change_id": "l_orderkey",
        "position": "l_linenumber",
        "user_id": "l_orderkey % 400",
        "name": "case when l_quantity = 50 then '' else concat('Plan ', cast(l_partkey as string)) end",
        "price": "case when l_discount >= 0.1 and l_tax >= 0.08 then cast(-1 as double) else l_extendedprice end",
        "price_anchor": "case when l_returnflag = 'R' then l_extendedprice * cast(2 as double) end",
        "currency": "case when l_orderkey % 13 = 0 then null when l_orderkey % 17 = 0 then 'euro' when l_orderkey % 2 = 0 then 'eur' else 'USD' end",
        "billing_period": "case when l_orderkey % 19 = 0 then 'weekly' when l_orderkey % 3 = 0 then 'year' end",
        "notes": "case when l_orderkey % 4 = 0 then null else concat('note ', cast(l_orderkey as string)) end",
    }),
    # Successive captures of a source, as a change log over document texts.
    "document_captures": ("documents", False, None, {
        "capture_id": "doc_id",
        "source": "source",
        "body": "text",
    }),
    "audit_input": ("events", False, None, {
        "event_id": "event_id",
        "user_id": "user_id",
        "company_id": "case when event_id % 3 = 0 then null else event_id % 500 end",
        "created_at": "ts",
        "event_type": "case event_id % 10 when 0 then 'trial_started' when 1 then 'trial_start_blocked' when 2 then 'company_created' when 3 then 'competitor_cap_hit' when 4 then 'primary_pricing_url_changed' when 5 then 'webhook_access_granted' when 6 then 'webhook_access_revoked' when 7 then 'crawl_blocked' when 8 then 'crawl_manual_needed' else 'crawl_error' end",
        "metadata": "props",
    }),
    "articles": ("documents", False, None, {
        "article_id": "doc_id",
        "author": "source",
        "published": "doc_id",
        "lang": "lang",
    }),
}


def spark_text(expression: str) -> str:
    return expression.replace("@TYPE", "timestamp_ntz").replace("@T'", "timestamp_ntz'")


def duckdb_text(expression: str) -> str:
    return expression.replace("@TYPE", "timestamp").replace("@T'", "TIMESTAMP '")


def view(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One derived table as a DataFrame."""
    base, distinct, group, columns = VIEWS[name]
    df = table(spark, folder, base)
    exprs = [f"{spark_text(e)} as `{c}`" for c, e in columns.items()]
    if group:
        keys = [k.strip() for k in group.split(",")]
        aggregates = {c: e for c, e in columns.items() if "max(" in e}
        plain = {c: e for c, e in columns.items() if c not in aggregates}
        grouped = df.groupBy(*keys).agg(*[F.expr(spark_text(e)).alias(c) for c, e in aggregates.items()])
        return grouped.selectExpr(*[f"{e} as `{c}`" for c, e in plain.items()], *aggregates)
    out = df.selectExpr(*exprs)
    return out.distinct() if distinct else out


def duckdb_view(name: str) -> str:
    """The same table as a DuckDB query."""
    base, distinct, group, columns = VIEWS[name]
    exprs = ", ".join(f"{duckdb_text(e)} AS {c}" for c, e in columns.items())
    tail = f" GROUP BY {group}" if group else ""
    return f"SELECT {'DISTINCT ' if distinct else ''}{exprs} FROM {base}{tail}"


PLANS = [(0, "price_starter", "starter"), (1, "price_pro", "pro"), (2, "price_starter", "pro")]
