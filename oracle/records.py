"""Checks for the queries over records."""

from __future__ import annotations

from oracle.common import (
    NOW_SQL,
    confidence_case,
    error_case,
    facts,
    fixed2,
    host_of,
    normal_url,
    q,
    squeeze,
    stamp,
    status_case,
    strip_ends,
    with_views,
)
from oracle.pages import _CANDIDATES, _HEADING_ROWS
from tarifflens import policies as P
from tarifflens.sources.fixtures import PLANS, duckdb_view

# --- snapshots and diffs ---------------------------------------------------------------------

_SNAPS = f"""{with_views('snapshot_prices')},
snaps AS (SELECT company_id, captured_at, count(*) AS price_count FROM v_snapshot_prices GROUP BY 1, 2)"""
_RANK = "CASE period WHEN 'day' THEN 1 WHEN 'week' THEN 2 WHEN 'month' THEN 3 WHEN 'year' THEN 4 WHEN 'one_time' THEN 5 ELSE 6 END"
_DIFFS = f"""{_SNAPS},
pairs AS (SELECT company_id, captured_at, price_count, lag(captured_at) OVER w AS prior_at, lag(price_count) OVER w AS prior_count
  FROM snaps WINDOW w AS (PARTITION BY company_id ORDER BY captured_at)),
places AS (SELECT *, row_number() OVER (PARTITION BY company_id, captured_at, currency, period ORDER BY amount) AS i FROM v_snapshot_prices),
sides AS (
  SELECT p.company_id, p.captured_at, s.currency, s.period, s.i, s.amount AS cur, CAST(NULL AS DOUBLE) AS prev
  FROM pairs p JOIN places s ON s.company_id = p.company_id AND s.captured_at = p.captured_at WHERE prior_at IS NOT NULL
  UNION ALL
  SELECT p.company_id, p.captured_at, s.currency, s.period, s.i, NULL, s.amount
  FROM pairs p JOIN places s ON s.company_id = p.company_id AND s.captured_at = p.prior_at),
matched AS (SELECT company_id, captured_at, currency, period, i, max(cur) AS cur, max(prev) AS prev FROM sides GROUP BY ALL),
judged AS (SELECT *, abs(cur - prev) AS moved, CASE WHEN prev > 0 THEN abs(cur - prev) / prev * 100 ELSE 100e0 END AS pct FROM matched),
changes AS (SELECT *, CASE WHEN prev IS NULL THEN 'added' WHEN cur IS NULL THEN 'removed' ELSE 'updated' END AS kind,
   {fixed2('pct')} AS delta FROM judged WHERE prev IS NULL OR cur IS NULL OR (moved >= 0.5 AND pct >= 1)),
diffs AS MATERIALIZED (SELECT company_id, captured_at,
   count(*) FILTER (kind = 'added') AS added, count(*) FILTER (kind = 'removed') AS removed, count(*) FILTER (kind = 'updated') AS updated,
   coalesce(max(delta) FILTER (kind = 'updated'), 0e0) AS max_delta FROM changes GROUP BY 1, 2),
rated AS (SELECT d.*, prior_count, price_count,
   CASE WHEN max_delta >= 20 OR (added >= 2 AND removed >= 2) THEN 'high' WHEN max_delta >= 10 OR added + removed + updated >= 2 THEN 'medium' ELSE 'low' END AS severity,
   CASE WHEN price_count >= 3 THEN 'verified' ELSE 'unverified' END AS verification_state
   FROM diffs d JOIN pairs USING (company_id, captured_at))"""

# --- entitlements ----------------------------------------------------------------------------

_PLAN_ROWS = ", ".join(f"({o}, {q(p)}, {q(t)})" for o, p, t in PLANS)
_FIRST_PLAN = f"first_plan AS (SELECT price_id, min_by(tier, ordinal) AS tier FROM (VALUES {_PLAN_ROWS}) p(ordinal, price_id, tier) GROUP BY 1)"


def _entitled(users: str = "v_users", status: str = "trial_status") -> str:
    active = f"({status} = 'active' AND coalesce(trial_ends_at > {NOW_SQL}, FALSE))"
    return f"""{_FIRST_PLAN}, ent AS (SELECT *, plan_tier IS NOT NULL AS access_granted,
  CASE WHEN has_access THEN 'paid' WHEN {active} THEN 'trial' ELSE 'none' END AS access_source,
  CASE WHEN has_access THEN 'paid_active' WHEN {active} THEN 'trial_active' ELSE 'inactive' END AS access_state,
  CASE plan_tier WHEN 'starter' THEN 3 WHEN 'pro' THEN 10 ELSE 0 END AS competitor_limit,
  CASE plan_tier WHEN 'starter' THEN 'high_only' WHEN 'pro' THEN 'high_and_medium' END AS insight_gate,
  CASE plan_tier WHEN 'starter' THEN 'high' WHEN 'pro' THEN 'high|medium' ELSE '' END AS allowed_severities,
  has_access AND plan_tier IS NOT NULL AS can_receive_digest
 FROM (SELECT u.*, CASE WHEN has_access THEN coalesce(tier, 'starter') WHEN {active} THEN 'starter' END AS plan_tier
   FROM {users} u LEFT JOIN first_plan f ON f.price_id = u.price_id))"""


_REFRESHED = f"""CASE WHEN trial_status = 'active' AND has_access THEN 'converted'
 WHEN trial_status = 'active' AND NOT coalesce(trial_ends_at > {NOW_SQL}, FALSE) THEN 'expired' ELSE trial_status END"""

_ACTIONS = f"""concat_ws('|', CASE WHEN severity = 'high' THEN {q(P.TEXT_ACTION_REVIEW)} END,
 CASE WHEN updated > 0 THEN {q(P.TEXT_ACTION_COMPARE)} END, CASE WHEN added > 0 OR removed > 0 THEN {q(P.TEXT_ACTION_AUDIT)} END,
 CASE WHEN verification_state = 'unverified' THEN {q(P.TEXT_ACTION_VERIFY)} END)"""

# --- crawl cycle ---------------------------------------------------------------------------------

_DUE = f"type = 'competitor' AND (next_crawl_at IS NULL OR next_crawl_at <= {NOW_SQL}) AND (crawl_lease_until IS NULL OR crawl_lease_until <= {NOW_SQL})"


def _extracted(view: str, name: str) -> str:
    return f"""{facts(view, name)}, {name}_j AS MATERIALIZED (SELECT *, {status_case()} AS status, {error_case()} AS error, {confidence_case()} AS evidence,
   sha256(lowered) AS content_hash FROM {name}),
{name}_p AS MATERIALIZED (SELECT company_id, currency, period, amount, row_number() OVER (PARTITION BY company_id, currency, period ORDER BY amount) AS i
  FROM (SELECT DISTINCT company_id, currency, period, amount FROM {name}_mentions JOIN {name}_j USING (company_id) WHERE status = 'ok'))"""


_PAGE_DIFFS = f"""{with_views('captures', 'old_captures', 'page_companies', 'users')}, {_extracted('v_old_captures', 'o')}, {_extracted('v_captures', 'f')},
page_pair AS (SELECT f_j.company_id, list_sort(f_j.custom_hints) AS nh, list_sort(o_j.custom_hints) AS oh FROM f_j JOIN o_j USING (company_id) WHERE f_j.status = 'ok' AND o_j.status = 'ok'),
m AS (SELECT company_id, currency, period, i, max(cur) AS cur, max(prev) AS prev FROM (
   SELECT company_id, currency, period, i, amount AS cur, CAST(NULL AS DOUBLE) AS prev FROM f_p UNION ALL SELECT company_id, currency, period, i, NULL, amount FROM o_p) GROUP BY ALL),
c AS (SELECT *, CASE WHEN prev IS NULL THEN 'added' WHEN cur IS NULL THEN 'removed' ELSE 'updated' END AS kind FROM m
   WHERE prev IS NULL OR cur IS NULL OR (abs(cur - prev) >= 0.5 AND abs(cur - prev) / prev * 100 >= 1)),
n AS (SELECT company_id, count(*) FILTER (kind = 'added') AS added, count(*) FILTER (kind = 'removed') AS removed, count(*) FILTER (kind = 'updated') AS updated,
   coalesce(max(CAST(printf('%.2f', abs(cur - prev) / prev * 100) AS DOUBLE)) FILTER (kind = 'updated'), 0e0) AS peak FROM c GROUP BY 1),
page_diffs AS MATERIALIZED (SELECT company_id, list_filter(nh, lambda z: NOT list_contains(oh, z)) AS added_hints, list_filter(oh, lambda z: NOT list_contains(nh, z)) AS removed_hints,
   coalesce(added, 0) AS added, coalesce(removed, 0) AS removed, coalesce(updated, 0) AS updated, coalesce(peak, 0e0) AS peak FROM page_pair LEFT JOIN n USING (company_id)),
real_diffs AS (SELECT *, CASE WHEN peak >= 20 OR (added >= 2 AND removed >= 2) THEN 'high'
    WHEN peak >= 10 OR added + removed + updated >= 2 OR len(added_hints) > 0 OR len(removed_hints) > 0 THEN 'medium' ELSE 'low' END AS severity
  FROM page_diffs WHERE added + removed + updated > 0 OR len(added_hints) > 0 OR len(removed_hints) > 0)"""
_CRAWL = f"""{_PAGE_DIFFS}, {_entitled()},
due AS (SELECT * FROM v_page_companies WHERE {_DUE}),
outcome AS MATERIALIZED (SELECT d.company_id, d.user_id,
   CASE WHEN d.primary_pricing_url IS NULL THEN 'manual_needed' WHEN e.user_id IS NULL THEN 'error' WHEN NOT access_granted THEN 'idle' ELSE f.status END AS status,
   CASE WHEN d.primary_pricing_url IS NULL THEN {q(P.TEXT_NO_URL)} WHEN e.user_id IS NULL THEN {q(P.TEXT_NO_USER)} WHEN NOT access_granted THEN {q(P.TEXT_NOT_ELIGIBLE)} ELSE f.error END AS error,
   f.content_hash, o.content_hash AS old_hash, o.status AS old_status, f.evidence, r.severity, allowed_severities
  FROM due d LEFT JOIN ent e USING (user_id) LEFT JOIN f_j f ON f.company_id = d.company_id LEFT JOIN o_j o ON o.company_id = d.company_id
  LEFT JOIN real_diffs r ON r.company_id = d.company_id),
done AS MATERIALIZED (SELECT *, status = 'ok' AND old_status = 'ok' AND content_hash = old_hash AS skipped_by_hash,
   status = 'ok' AND NOT (old_status = 'ok' AND content_hash = old_hash) AS changed,
   status = 'ok' AND NOT (old_status = 'ok' AND content_hash = old_hash) AND severity IS NOT NULL AS diff_created,
   {NOW_SQL} + to_seconds(CASE status WHEN 'blocked' THEN 129600 WHEN 'manual_needed' THEN 172800 WHEN 'error' THEN 21600 ELSE 86400 END) AS next_at FROM outcome),
final AS (SELECT *, diff_created AND contains(allowed_severities, severity) AS insight_created FROM done)"""

_COMMANDS = """cmd AS (SELECT o_orderkey AS command_id, CASE WHEN o_orderkey % 2 = 0 THEN 'crawl-now' ELSE 'retry-crawl' END AS command,
  o_custkey % 110 AS company_id, CASE WHEN o_orderkey % 10 = 0 THEN 7 ELSE o_custkey % 110 % 20 END AS user_id FROM orders)"""

# --- feed ----------------------------------------------------------------------------------------------

_FEED_BASE = f"""{with_views('diffs', 'companies', 'insights')},
matched AS (SELECT d.*, c.name AS company_name, c.last_crawl_status, c.latest_confidence FROM v_diffs d JOIN v_companies c ON c.company_id = d.company_id AND c.user_id = d.user_id),
latest AS (SELECT diff_id, insight_id, generated_at, severity_gate FROM (SELECT *, row_number() OVER (PARTITION BY diff_id ORDER BY generated_at DESC, insight_id DESC) AS r FROM v_insights) WHERE r = 1)"""
_CURSOR = "replace(replace(replace(to_base64(encode('{{\"detectedAt\":\"' || strftime({at}, '%Y-%m-%dT%H:%M:%S') || '.000Z\",\"id\":\"' || {id} || '\"}}')), '+', '-'), '/', '_'), '=', '')"


def _feed_select(source: str, limit: int, paging: bool = True) -> str:
    cursor = _CURSOR.format(at="last_at", id="last_id")
    extra = f", has_more, CASE WHEN has_more THEN {cursor} END AS next_cursor" if paging else ""
    return f"""paged AS (SELECT *, max(position) OVER u > {limit} AS has_more, max(detected_at) FILTER (position = {limit}) OVER u AS last_at,
   max(diff_id) FILTER (position = {limit}) OVER u AS last_id FROM {source} WHERE position <= {limit} + 1 WINDOW u AS (PARTITION BY user_id))
 SELECT user_id, position, diff_id, company_id, company_name, severity, verification_state, {stamp('detected_at')} AS detected_at, insight_id,
  {stamp('generated_at')} AS insight_generated_at, severity_gate AS insight_gate, last_crawl_status, latest_confidence{extra}
 FROM paged LEFT JOIN latest USING (diff_id) WHERE position <= {limit}"""


_FEED_ORDER = "row_number() OVER (PARTITION BY user_id ORDER BY detected_at DESC, diff_id DESC)"

# --- digest ----------------------------------------------------------------------------------------------


def _kept(days: int, size: int) -> str:
    return f"""kept AS (SELECT * FROM (SELECT user_id, diff_id, company_id, severity, detected_at, {_FEED_ORDER} AS position FROM v_diffs
   WHERE verification_state = 'verified' AND detected_at BETWEEN {NOW_SQL} - INTERVAL {days} DAY AND {NOW_SQL}) WHERE position <= {size})"""


_DIGEST = f"""{with_views('users', 'diffs', 'companies')}, {_entitled()}, {_kept(90, 10)},
counted AS (SELECT user_id, count(*) AS n FROM kept GROUP BY 1),
stages AS (SELECT e.user_id, email, CASE WHEN email = '' THEN 'no_email' WHEN NOT (access_granted AND can_receive_digest) THEN 'not_eligible'
   WHEN coalesce(last_digest_sent_at >= {NOW_SQL} - INTERVAL 90 DAY, FALSE) THEN 'recently_sent' WHEN n IS NULL THEN 'no_diffs' ELSE 'sent' END AS stage
  FROM ent e LEFT JOIN counted USING (user_id) WHERE email IS NOT NULL)"""
_MINUTE = "strftime({x}, '%Y-%m-%d %H:%M UTC')"
_SPAN = (_MINUTE.format(x=f"{NOW_SQL} - INTERVAL 90 DAY"), _MINUTE.format(x=NOW_SQL))

# --- intake ----------------------------------------------------------------------------------------------------

_GIVEN = ", ".join(f"nullif({strip_ends(c)}, '') AS g_{c}" for c in ("name", "domain", "homepage_url", "primary_pricing_url"))
_STRICT = "CASE WHEN regexp_matches(d, '^([a-z0-9-]{1,63}\\.)+[a-z]{2,63}$') AND NOT starts_with(d, '-') AND length(d) <= 253 THEN d END"
_INTAKE = f"""{with_views('intake', 'users', 'companies')},
refreshed AS (SELECT * REPLACE ({_REFRESHED} AS trial_status) FROM v_users), {_entitled('refreshed')},
given AS (SELECT *, {_GIVEN} FROM v_intake),
parsed AS (SELECT *, {normal_url('g_homepage_url', True)} AS homepage, {normal_url('g_primary_pricing_url', True)} AS pricing,
   {_STRICT.replace('(d', "(regexp_replace(lower(g_domain), '^www\\.', '')").replace('THEN d', "THEN regexp_replace(lower(g_domain), '^www\\.', '')")} AS strict FROM given),
hosts AS (SELECT *, {host_of('homepage')} AS hh, {host_of('pricing')} AS ph FROM parsed),
named AS (SELECT *, coalesce(strict, hh, ph) AS company_domain FROM hosts),
checked AS (SELECT *, CASE WHEN g_name IS NULL OR length(g_name) > 120 OR type NOT IN ('self', 'competitor') THEN 'invalid_request_body'
   WHEN g_domain IS NULL AND g_homepage_url IS NULL AND g_primary_pricing_url IS NULL THEN 'invalid_request_body'
   WHEN g_homepage_url IS NOT NULL AND homepage IS NULL THEN 'invalid_homepage_url'
   WHEN g_primary_pricing_url IS NOT NULL AND pricing IS NULL THEN 'invalid_pricing_url'
   WHEN g_domain IS NOT NULL AND strict IS NULL THEN 'invalid_domain'
   WHEN company_domain IS NULL THEN 'unresolved_domain'
   WHEN hh IS NOT NULL AND hh <> company_domain AND NOT ends_with(hh, '.' || company_domain) THEN 'homepage_domain_mismatch'
   WHEN ph IS NOT NULL AND ph <> company_domain AND NOT ends_with(ph, '.' || company_domain) THEN 'pricing_domain_mismatch' END AS early FROM named),
queued AS (SELECT c.*, row_number() OVER (PARTITION BY c.user_id ORDER BY requested_at, request_id) AS turn, e.user_id IS NOT NULL AS owner_found,
   coalesce(e.access_granted, FALSE) AS granted, coalesce(e.competitor_limit, 0) AS lim FROM checked c LEFT JOIN ent e USING (user_id) WHERE early IS NULL),
owned AS (SELECT user_id, list(type || ' ' || domain) AS have FROM v_companies GROUP BY 1)"""
# One request after the other, per user: the state is the list of tracked companies.
_INTAKE_FOLD = f"""WITH RECURSIVE {_INTAKE[5:]},
walk AS (
  SELECT user_id, CAST(0 AS BIGINT) AS turn, coalesce(have, []::VARCHAR[]) AS have, CAST(NULL AS BIGINT) AS request_id, CAST(NULL AS VARCHAR) AS reject_reason
  FROM (SELECT DISTINCT user_id FROM queued) LEFT JOIN owned USING (user_id)
  UNION ALL
  SELECT user_id, turn, CASE WHEN reject_reason IS NULL THEN list_append(have, type || ' ' || company_domain) ELSE have END, request_id, reject_reason
  FROM (SELECT w.user_id, x.turn, w.have, x.request_id, x.type, x.company_domain,
     CASE WHEN NOT owner_found THEN 'user_not_found'
       WHEN x.type = 'competitor' AND NOT (granted AND len(list_filter(w.have, lambda z: starts_with(z, 'competitor '))) < lim) THEN 'competitor_limit_reached'
       WHEN x.type = 'self' AND len(list_filter(w.have, lambda z: starts_with(z, 'self '))) > 0 THEN 'self_company_already_exists'
       WHEN list_contains(w.have, x.type || ' ' || x.company_domain) THEN 'domain_already_exists_for_type' END AS reject_reason
    FROM walk w JOIN queued x ON x.user_id = w.user_id AND x.turn = w.turn + 1))
SELECT c.request_id, c.user_id, c.type, c.homepage, c.pricing, c.company_domain, coalesce(c.early, w.reject_reason) AS reject_reason
FROM checked c LEFT JOIN walk w USING (request_id)"""

_PRICE_LISTS = f"""{with_views('plan_lines', 'users')},
lists AS (SELECT change_id, user_id, coalesce(upper(currency), 'USD') AS currency, coalesce(billing_period, 'month') AS billing_period, notes,
   count(*) AS plan_count, bool_and(length(name) BETWEEN 1 AND 120 AND price BETWEEN 0 AND 1000000 AND (price_anchor IS NULL OR price_anchor BETWEEN 0 AND 1000000)) AS fine
  FROM v_plan_lines GROUP BY ALL),
checked AS (SELECT *, fine AND plan_count BETWEEN 1 AND 20 AND regexp_matches(currency, '^[A-Z]{{3}}$') AND billing_period IN ('month', 'year', 'custom') AS valid FROM lists)"""

# --- billing ----------------------------------------------------------------------------------------------------------

_EFFECTS = f"""{with_views('billing_events', 'users')}, {_FIRST_PLAN},
effects AS (SELECT b.*, CASE WHEN f.tier IS NOT NULL THEN b.price_id END AS known_price,
  CASE WHEN event_type = 'checkout.session.completed' AND f.tier IS NULL THEN 'failed' WHEN event_type = 'invoice.paid' AND f.tier IS NULL THEN 'failed'
   WHEN event_type = 'customer.subscription.updated' AND b.customer_id IS NOT NULL AND subscription_status IN ('active', 'trialing', 'past_due') AND f.tier IS NULL THEN 'failed'
   WHEN event_type = 'checkout.session.completed' THEN 'grant'
   WHEN b.customer_id IS NULL THEN 'none'
   WHEN event_type = 'invoice.paid' THEN 'grant'
   WHEN event_type = 'customer.subscription.updated' AND subscription_status IN ('active', 'trialing', 'past_due') THEN 'grant'
   WHEN event_type = 'customer.subscription.updated' AND subscription_status IN ('canceled', 'incomplete_expired', 'unpaid') THEN 'revoke'
   WHEN event_type = 'customer.subscription.updated' THEN 'touch'
   WHEN event_type = 'customer.subscription.deleted' THEN 'revoke' ELSE 'none' END AS effect
 FROM v_billing_events b LEFT JOIN first_plan f ON f.price_id = b.price_id)"""
# Replay event by event per user; other events than checkouts find their user by the customer id held at that instant.
_BILLING = f"""WITH RECURSIVE {_EFFECTS[5:]},
acts AS (SELECT *, event_type = 'checkout.session.completed' AS is_checkout FROM effects WHERE effect IN ('grant', 'revoke', 'touch')),
held AS (SELECT user_id, customer_id, TIMESTAMP '1900-01-01' AS since, CAST(-1 AS BIGINT) AS since_id FROM v_users WHERE customer_id IS NOT NULL
  UNION ALL SELECT user_id, customer_id, arrived_at, event_id FROM acts WHERE is_checkout AND customer_id IS NOT NULL),
spans AS (SELECT *, lead(since) OVER w AS till, lead(since_id) OVER w AS till_id FROM held WINDOW w AS (PARTITION BY user_id ORDER BY since, since_id)),
holders AS (SELECT a.event_id, min(s.user_id) AS holder FROM acts a JOIN spans s ON s.customer_id = a.customer_id
  AND (a.arrived_at > since OR (a.arrived_at = since AND a.event_id > since_id)) AND (till IS NULL OR a.arrived_at < till OR (a.arrived_at = till AND a.event_id < till_id))
  WHERE NOT is_checkout GROUP BY 1),
mine AS (SELECT a.* REPLACE (CASE WHEN is_checkout THEN a.user_id ELSE h.holder END AS user_id) FROM acts a LEFT JOIN holders h USING (event_id)),
acting AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY arrived_at, event_id) AS turn FROM mine WHERE user_id IS NOT NULL),
walk AS (
  SELECT user_id, CAST(0 AS BIGINT) AS turn, has_access, price_id, customer_id, trial_status FROM v_users
  UNION ALL
  SELECT w.user_id, a.turn,
    CASE effect WHEN 'grant' THEN TRUE WHEN 'revoke' THEN FALSE ELSE w.has_access END,
    CASE effect WHEN 'grant' THEN known_price WHEN 'revoke' THEN NULL ELSE coalesce(known_price, w.price_id) END,
    CASE WHEN is_checkout THEN coalesce(a.customer_id, w.customer_id) ELSE w.customer_id END,
    CASE WHEN effect = 'grant' AND w.trial_status = 'active' THEN 'converted' ELSE w.trial_status END
  FROM walk w JOIN acting a ON a.user_id = w.user_id AND a.turn = w.turn + 1)
SELECT user_id, has_access, price_id, customer_id, trial_status FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY turn DESC) AS r FROM walk) WHERE r = 1"""

# Whom a checkout acts on, then a replay per account; older accounts come first where several hold a customer id.
_ACCOUNTS = f"""WITH RECURSIVE {with_views('billing_journal', 'users')[5:]}, {_FIRST_PLAN},
priced AS (SELECT b.*, CASE WHEN f.tier IS NOT NULL THEN b.price_id END AS known_price, event_type = 'checkout.session.completed' AS is_checkout,
  nullif(lower(trim(customer_email)), '') AS mail FROM v_billing_journal b LEFT JOIN first_plan f ON f.price_id = b.price_id),
paid AS (SELECT p.*, coalesce(i.user_id, (SELECT min(u.user_id) FROM v_users u WHERE u.email = p.mail)) AS found
  FROM priced p LEFT JOIN v_users i ON i.user_id = p.client_reference_id WHERE is_checkout AND known_price IS NOT NULL),
bought AS (SELECT event_id, arrived_at, 'grant' AS effect, TRUE AS is_checkout, known_price, customer_id,
   {{'fresh': found IS NULL, 'id': coalesce(found, 0), 'mail': CASE WHEN found IS NULL THEN mail ELSE '' END}} AS account FROM paid WHERE found IS NOT NULL OR mail IS NOT NULL),
other AS (SELECT event_id, arrived_at, known_price, customer_id,
   CASE WHEN event_type = 'customer.subscription.deleted' THEN 'revoke'
     WHEN event_type = 'invoice.paid' THEN CASE WHEN known_price IS NOT NULL THEN 'grant' END
     WHEN subscription_status IN ('active', 'trialing', 'past_due') THEN CASE WHEN known_price IS NOT NULL THEN 'grant' END
     WHEN subscription_status IN ('canceled', 'incomplete_expired', 'unpaid') THEN 'revoke' ELSE 'touch' END AS effect
  FROM priced WHERE NOT is_checkout AND customer_id IS NOT NULL),
accounts AS (SELECT {{'fresh': FALSE, 'id': user_id, 'mail': ''}} AS account, user_id, email, has_access, price_id, customer_id, trial_status FROM v_users
  UNION ALL SELECT DISTINCT account, CAST(NULL AS BIGINT), account.mail, CAST(NULL AS BOOLEAN), CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR), 'not_started' FROM bought WHERE account.fresh),
held AS (SELECT account, customer_id, TIMESTAMP '1900-01-01' AS since, CAST(-1 AS BIGINT) AS since_id FROM accounts WHERE customer_id IS NOT NULL
  UNION ALL SELECT account, customer_id, arrived_at, event_id FROM bought WHERE customer_id IS NOT NULL),
spans AS (SELECT *, lead(since) OVER w AS till, lead(since_id) OVER w AS till_id FROM held WINDOW w AS (PARTITION BY account ORDER BY since, since_id)),
acts AS (SELECT * FROM bought UNION ALL BY NAME
  SELECT o.event_id, o.arrived_at, o.effect, FALSE AS is_checkout, o.known_price, o.customer_id, min(s.account) AS account FROM other o JOIN spans s ON s.customer_id = o.customer_id
    AND (o.arrived_at > since OR (o.arrived_at = since AND o.event_id > since_id)) AND (till IS NULL OR o.arrived_at < till OR (o.arrived_at = till AND o.event_id < till_id))
  WHERE o.effect IS NOT NULL GROUP BY ALL),
acting AS (SELECT *, row_number() OVER (PARTITION BY account ORDER BY arrived_at, event_id) AS turn FROM acts),
walk AS (
  SELECT account, user_id, email, CAST(0 AS BIGINT) AS turn, has_access, price_id, customer_id, trial_status FROM accounts
  UNION ALL
  SELECT w.account, w.user_id, w.email, a.turn,
    CASE effect WHEN 'grant' THEN TRUE WHEN 'revoke' THEN FALSE ELSE w.has_access END,
    CASE effect WHEN 'grant' THEN known_price WHEN 'revoke' THEN NULL ELSE coalesce(known_price, w.price_id) END,
    CASE WHEN is_checkout THEN coalesce(a.customer_id, w.customer_id) ELSE w.customer_id END,
    CASE WHEN effect = 'grant' AND w.trial_status = 'active' THEN 'converted' ELSE w.trial_status END
  FROM walk w JOIN acting a ON a.account = w.account AND a.turn = w.turn + 1)
SELECT user_id, email, has_access, price_id, customer_id, trial_status FROM (SELECT *, row_number() OVER (PARTITION BY account ORDER BY turn DESC) AS r FROM walk) WHERE r = 1"""

_DELIVERIES = f"""WITH RECURSIVE {with_views('billing_events')[5:]},
d AS MATERIALIZED (SELECT event_id * 3 + copy AS delivery_id, event_id, arrived_at + to_seconds(CASE copy WHEN 1 THEN 120 WHEN 2 THEN 600 ELSE 0 END) AS arrived_at, (event_id + copy) % 3 AS turn,
   row_number() OVER (PARTITION BY event_id ORDER BY copy) AS n
  FROM v_billing_events, LATERAL (SELECT unnest(CASE WHEN event_type IN ('invoice.paid', 'customer.subscription.deleted') THEN [0, 1, 2] ELSE [0] END) AS copy)),
walk AS (
  SELECT event_id, n, delivery_id, 'process' AS action, CAST(NULL AS VARCHAR) AS reason, CAST(1 AS BIGINT) AS attempts, turn AS owner, arrived_at AS taken_at FROM d WHERE n = 1
  UNION ALL
  SELECT w.event_id, d.n, d.delivery_id,
    CASE WHEN again THEN 'process' ELSE 'skip' END,
    CASE WHEN again THEN NULL WHEN w.owner = 0 AND d.arrived_at >= w.taken_at + to_seconds(busy) THEN 'already_processed' ELSE 'in_progress' END,
    CASE WHEN again THEN w.attempts + 1 ELSE w.attempts END, CASE WHEN again THEN d.turn ELSE w.owner END, CASE WHEN again THEN d.arrived_at ELSE w.taken_at END
  FROM walk w JOIN d ON d.event_id = w.event_id AND d.n = w.n + 1,
   LATERAL (SELECT CASE w.event_id % 7 WHEN 3 THEN 400 WHEN 4 THEN 700 ELSE 2 END AS busy),
   LATERAL (SELECT CASE w.owner WHEN 0 THEN d.arrived_at >= w.taken_at + INTERVAL 5 MINUTE AND d.arrived_at < w.taken_at + to_seconds(busy)
     WHEN 1 THEN d.arrived_at >= w.taken_at + to_seconds(least(busy, 300)) ELSE d.arrived_at >= w.taken_at + INTERVAL 5 MINUTE END AS again))
SELECT delivery_id, event_id, action, reason, CASE WHEN action = 'process' THEN attempts END AS attempt FROM walk"""

_LIMITS = f"""WITH RECURSIVE {with_views('requests')[5:]},
r AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts, request_id) AS n FROM v_requests),
walk AS (
  SELECT key, n, request_id, ts, ts AS opened, CAST(1 AS BIGINT) AS used, TRUE AS allowed FROM r WHERE n = 1
  UNION ALL
  SELECT key, n, request_id, ts, CASE WHEN fresh THEN ts ELSE opened END, CASE WHEN fresh THEN 1 WHEN used < 2 THEN used + 1 ELSE used END, fresh OR used < 2
  FROM (SELECT r.key, r.n, r.request_id, r.ts, w.opened, w.used, r.ts >= w.opened + INTERVAL 1 DAY AS fresh FROM walk w JOIN r ON r.key = w.key AND r.n = w.n + 1))
SELECT request_id, key, allowed, CASE WHEN allowed THEN 2 - used ELSE 0 END AS remaining,
  CASE WHEN allowed THEN 0 ELSE CAST(ceil((epoch_us(opened) + 86400000000 - epoch_us(ts)) / 1000000) AS BIGINT) END AS retry_after_seconds,
  {stamp('opened')} AS window_started_at, {stamp("opened + INTERVAL 1 DAY")} AS reset_at FROM walk"""

_AUDIT_VALUES = ", ".join(f"({q(e)}, {q(a)}, {q(r)}, {q(s)})" for e, (a, r, s) in P.AUDIT_EVENTS.items())
_ARTICLES = f"{with_views('articles')}, tagged AS (SELECT DISTINCT article_id, author, published, unnest([lang, author]) AS tag FROM v_articles)"

_JSON = "'{\"sourceUrl\":\"https://e.example/' || event_id || '\"}'"

RECORD_SQL = {
    "snapshot_pairs": f"{_SNAPS} SELECT company_id, {stamp('captured_at')} AS captured_at, {stamp('lag(captured_at) OVER w')} AS previous_captured_at, price_count, lag(price_count) OVER w AS previous_price_count FROM snaps WINDOW w AS (PARTITION BY company_id ORDER BY captured_at)",
    "hash_gate": f"{with_views('document_captures')}, h AS (SELECT source, capture_id, sha256(lower({squeeze('body')})) AS content_hash FROM v_document_captures) SELECT source, capture_id, content_hash, content_hash IS DISTINCT FROM lag(content_hash) OVER (PARTITION BY source ORDER BY capture_id) AS changed FROM h",
    "latest_snapshot": f"{_SNAPS} SELECT company_id, {stamp('captured_at')} AS captured_at, price_count FROM (SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY captured_at DESC) AS r FROM snaps) WHERE r = 1",
    "diff_buckets": f"{_DIFFS} SELECT company_id, {stamp('captured_at')} AS detected_at, currency, period, coalesce(string_agg(printf('%.2f', cur), '|' ORDER BY cur) FILTER (kind = 'added'), '') AS added, coalesce(string_agg(printf('%.2f', prev), '|' ORDER BY prev) FILTER (kind = 'removed'), '') AS removed, count(*) FILTER (kind = 'updated') AS updated_count FROM changes GROUP BY company_id, captured_at, currency, period",
    "diff_updates": f"{_DIFFS} SELECT company_id, {stamp('captured_at')} AS detected_at, currency, period, prev AS previous_amount, cur AS current_amount, delta AS delta_percent FROM changes WHERE kind = 'updated'",
    "diff_severity": f"{_DIFFS} SELECT company_id, {stamp('captured_at')} AS detected_at, severity, verification_state, added, removed, updated, max_delta, prior_count AS previous_price_count, price_count AS current_price_count FROM rated",
    "hint_changes": f"{_PAGE_DIFFS} SELECT company_id, array_to_string(added_hints, '|') AS added_hints, array_to_string(removed_hints, '|') AS removed_hints, severity FROM real_diffs",
    "stored_payloads": "WITH e AS (SELECT event_id, event_type, CAST(printf('%.2f', value) AS DOUBLE) AS a, CAST(printf('%.3f', value) AS DOUBLE) AS b FROM events) SELECT event_id, 'https://e.example/' || event_id AS source_url, lower('plan ' || event_type) AS plan_names, concat_ws('|', CASE WHEN b > 0 THEN 'EUR year ' || printf('%.2f', b) END, 'GBP day 1.00', CASE WHEN a > 0 THEN 'USD month ' || printf('%.2f', a) END) AS prices FROM e",
    "entitlement_states": f"{with_views('users')}, {_entitled()} SELECT user_id, access_granted, access_source, access_state, plan_tier, CAST(competitor_limit AS BIGINT) AS competitor_limit, insight_gate, allowed_severities, can_receive_digest FROM ent",
    "trial_refresh": f"{with_views('users')} SELECT user_id, {_REFRESHED} AS trial_status, {_REFRESHED} <> trial_status AS trial_changed FROM v_users",
    "trial_start": f"""{with_views('users')}, f AS (SELECT *, {_REFRESHED} AS st FROM v_users),
 r AS (SELECT *, CASE WHEN has_access AND st = 'converted' THEN 'already_converted' WHEN has_access THEN 'paid_user' WHEN st = 'converted' THEN 'already_converted' WHEN st = 'expired' THEN 'already_expired'
   WHEN st = 'active' AND trial_ends_at > {NOW_SQL} THEN 'already_active' WHEN st = 'not_started' AND (trial_started_at IS NOT NULL OR trial_ends_at IS NOT NULL) THEN 'already_expired' ELSE 'started' END AS reason FROM f)
 SELECT user_id, reason, reason = 'started' AS started, st <> trial_status OR reason = 'started' OR (reason = 'already_expired' AND st = 'not_started') AS changed,
  CASE WHEN reason = 'started' THEN 'active' WHEN reason = 'already_expired' THEN 'expired' ELSE st END AS trial_status,
  {stamp(f"CASE WHEN reason = 'started' THEN {NOW_SQL} ELSE trial_started_at END")} AS trial_started_at,
  {stamp(f"CASE WHEN reason = 'started' THEN {NOW_SQL} + INTERVAL 7 DAY ELSE trial_ends_at END")} AS trial_ends_at FROM r""",
    "price_insights": f"""{_DIFFS}, {with_views('users')[5:]}, {_entitled()} SELECT company_id, company_id || '-' || strftime(captured_at, '%Y%m') AS current_snapshot_id, 'rules-v1' AS model, insight_gate AS severity_gate, 'none' AS feedback,
 'Competitor pricing moved (' || severity || ')' AS headline, CASE WHEN updated > 0 THEN updated || ' existing price points changed.' ELSE {q(P.TEXT_SUMMARY_NEW)} END AS summary, severity AS risk, verification_state,
 CASE WHEN {_ACTIONS} = '' THEN {q(P.TEXT_ACTION_MONITOR)} ELSE {_ACTIONS} END AS action_items
 FROM rated JOIN ent ON ent.user_id = rated.company_id WHERE access_granted AND list_contains(string_split(allowed_severities, '|'), severity)""",
    "due_queue": f"{with_views('companies')} SELECT company_id, user_id, {stamp('next_crawl_at')} AS next_crawl_at FROM (SELECT * FROM v_companies WHERE {_DUE} ORDER BY next_crawl_at NULLS FIRST, updated_at NULLS FIRST, company_id LIMIT 20)",
    "lease_claims": f"{with_views('companies')}, taken AS (SELECT company_id FROM v_companies WHERE {_DUE} ORDER BY next_crawl_at NULLS FIRST, updated_at NULLS FIRST, company_id LIMIT 20) SELECT company_id, company_id IN (SELECT company_id FROM taken) AS claimed, {stamp(f'CASE WHEN company_id IN (SELECT company_id FROM taken) THEN {NOW_SQL} + INTERVAL 6 MINUTE ELSE crawl_lease_until END')} AS crawl_lease_until FROM v_companies",
    "crawl_outcome": f"{_CRAWL} SELECT company_id, user_id, status, error, skipped_by_hash IS TRUE AS skipped_by_hash, changed IS TRUE AS changed, diff_created IS TRUE AS diff_created, insight_created IS TRUE AS insight_created, CASE WHEN diff_created THEN severity END AS severity, CASE WHEN status = 'ok' THEN evidence END AS confidence, {stamp('next_at')} AS next_crawl_at FROM final",
    "crawl_discovery": f"""{_CRAWL.replace('due AS (SELECT * FROM v_page_companies WHERE', f"""winners AS ({_CANDIDATES} SELECT page_id, string_agg(url || ' ' || printf('%.2f', confidence) || ' false', '|' ORDER BY rank) AS list,
   max(url) FILTER (rank = 1 AND confidence >= {P.PRIMARY_MIN_CONFIDENCE} AND (runner_up IS NULL OR confidence - runner_up >= {P.PRIMARY_MIN_GAP}::DOUBLE)) AS url FROM top GROUP BY 1),
 due AS (SELECT c.* REPLACE (coalesce(primary_pricing_url, w.url) AS primary_pricing_url) FROM v_page_companies c
   LEFT JOIN winners w ON w.page_id = c.company_id AND primary_pricing_url IS NULL AND homepage_url IS NOT NULL WHERE""")}
 SELECT x.company_id, w.url AS found_primary, coalesce(list, '') AS candidates, x.status, x.error, x.changed IS TRUE AS snapshot_created, {stamp('next_at')} AS next_crawl_at
 FROM final x JOIN v_page_companies c USING (company_id) LEFT JOIN winners w ON w.page_id = x.company_id
 WHERE c.primary_pricing_url IS NULL AND c.homepage_url IS NOT NULL""",
    "crawl_summary": f"{_CRAWL} SELECT count(*) AS processed, count(*) FILTER (changed) AS changed, count(*) FILTER (NOT changed) AS unchanged, count(*) FILTER (changed) AS snapshots_created, count(*) FILTER (diff_created) AS diffs_created, count(*) FILTER (insight_created) AS insights_created, count(*) FILTER (status = 'blocked') AS blocked, count(*) FILTER (status = 'manual_needed') AS manual_needed, count(*) FILTER (status = 'error') AS errored FROM final",
    "company_update": f"""{_CRAWL} SELECT c.company_id, coalesce(x.status, c.last_crawl_status) AS last_crawl_status, CASE WHEN x.company_id IS NULL THEN 'old error' ELSE x.error END AS last_crawl_error,
 CASE WHEN x.status = 'ok' THEN x.content_hash WHEN o.status = 'ok' THEN o.content_hash END AS latest_content_hash, CASE WHEN x.status = 'ok' THEN x.evidence ELSE 0.5e0 END AS latest_confidence,
 CASE WHEN x.company_id IS NOT NULL THEN {stamp(NOW_SQL)} END AS last_crawl_at, {stamp('CASE WHEN x.company_id IS NULL THEN c.next_crawl_at ELSE x.next_at END')} AS next_crawl_at,
 CASE WHEN x.company_id IS NULL THEN {stamp('c.crawl_lease_until')} END AS crawl_lease_until
 FROM v_page_companies c LEFT JOIN final x USING (company_id) LEFT JOIN o_j o ON o.company_id = c.company_id""",
    "crawl_audit": f"{_CRAWL} SELECT user_id, 'cron' AS actor_type, 'crawl_' || status AS action, 'crawl' AS resource_type, CAST(company_id AS VARCHAR) AS resource_id, 'rejected' AS status FROM final WHERE status IN ('blocked', 'manual_needed', 'error')",
    "crawl_commands": f"""{with_views('companies')}, {_COMMANDS}, j AS (SELECT cmd.*, c.type, c.crawl_lease_until AS lease, c.last_crawl_status, c.last_crawl_error, coalesce(c.crawl_lease_until > {NOW_SQL}, FALSE) AS active
   FROM cmd LEFT JOIN v_companies c ON c.company_id = cmd.company_id AND c.user_id = cmd.user_id),
 r AS (SELECT *, CASE WHEN type IS NULL THEN 'company_not_found' WHEN type <> 'competitor' THEN 'not_a_competitor' WHEN command = 'retry-crawl' AND active THEN 'lease_active' END AS reject_reason FROM j)
 SELECT command_id, command, company_id, reject_reason IS NULL AS accepted, reject_reason, CASE WHEN reject_reason IS NULL THEN {stamp(NOW_SQL)} END AS next_crawl_at,
  CASE WHEN type IS NOT NULL THEN CASE WHEN active THEN 'active' WHEN lease IS NOT NULL THEN 'stale_or_expired' ELSE 'none' END END AS lease_state,
  reject_reason IS NULL AND lease IS NOT NULL AND NOT active AS lease_cleared, CASE WHEN reject_reason IS NULL AND active THEN {stamp('lease')} END AS crawl_lease_until,
  CASE WHEN reject_reason IS NULL AND command = 'retry-crawl' THEN 'idle' ELSE last_crawl_status END AS last_crawl_status,
  CASE WHEN NOT (reject_reason IS NULL AND command = 'retry-crawl') THEN last_crawl_error END AS last_crawl_error FROM r""",
    "feed_page": f"{_FEED_BASE}, ranked AS (SELECT *, {_FEED_ORDER} AS position FROM matched), {_feed_select('ranked', 20)}",
    "feed_next_page": f"{_FEED_BASE}, one AS (SELECT *, {_FEED_ORDER} - 5 AS p, count(*) OVER (PARTITION BY user_id) AS total FROM matched WHERE severity = 'high'), ranked AS (SELECT *, CASE WHEN total > 5 THEN p ELSE p + 5 END AS position FROM one WHERE total <= 5 OR p > 0), {_feed_select('ranked', 5)}",
    "feed_strict": f"{_FEED_BASE}, first AS (SELECT *, {_FEED_ORDER} AS o FROM v_diffs WHERE verification_state = 'verified'), ranked AS (SELECT m.*, row_number() OVER (PARTITION BY m.user_id ORDER BY m.detected_at DESC, m.diff_id DESC) AS position FROM matched m JOIN first USING (diff_id) WHERE o <= 21), {_feed_select('ranked', 20, paging=False)}",
    "feed_cursors": f"{with_views('diffs')} SELECT diff_id, {_CURSOR.format(at='detected_at', id='diff_id')} AS cursor, CAST(diff_id AS VARCHAR) AS decoded_id, {stamp('detected_at')} AS decoded_at FROM v_diffs",
    "overview": f"""{with_views('users', 'companies', 'diffs')}, refreshed AS (SELECT * REPLACE ({_REFRESHED} AS trial_status) FROM v_users), {_entitled('refreshed')},
 cc AS (SELECT user_id, count(*) FILTER (type = 'self') AS self_count, count(*) FILTER (type = 'competitor') AS competitor_count, count(*) AS total_count,
   {', '.join(f"count(*) FILTER (type = 'competitor' AND last_crawl_status = {q(s)}) AS status_{s}" for s in P.CRAWL_STATUSES)} FROM v_companies GROUP BY 1),
 dd AS (SELECT user_id, {', '.join(f"count(*) FILTER (severity = {q(s)}) AS changes_{s}" for s in P.SEVERITIES)}, count(*) AS changes_total FROM v_diffs WHERE verification_state = 'verified' AND detected_at >= {NOW_SQL} - INTERVAL 7 DAY GROUP BY 1)
 SELECT user_id, access_state, plan_tier, trial_status, trial_status = 'active' AND coalesce(trial_ends_at > {NOW_SQL}, FALSE) AS trial_active,
  {', '.join(f'coalesce({c}, 0) AS {c}' for c in ['self_count', 'competitor_count', 'total_count', *['status_' + s for s in P.CRAWL_STATUSES], *['changes_' + s for s in P.SEVERITIES], 'changes_total'])}
 FROM ent LEFT JOIN cc USING (user_id) LEFT JOIN dd USING (user_id)""",
    "comparison": f"""{_SNAPS}, {with_views('companies')[5:]}, last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY captured_at DESC) AS r FROM snaps) WHERE r = 1)
 SELECT c.user_id, c.company_id, c.name, c.domain, c.primary_pricing_url, c.last_crawl_status IN ('blocked', 'manual_needed') AS blocked_or_manual_needed, c.last_crawl_error, c.latest_confidence,
  l.company_id || '-' || strftime(l.captured_at, '%Y%m') AS snapshot_id, {stamp('l.captured_at')} AS captured_at, l.price_count >= 3 AS is_verified, l.price_count AS point_count
 FROM v_companies c LEFT JOIN last l USING (company_id) WHERE c.type = 'competitor'""",
    "comparison_buckets": f"""{_SNAPS}, {with_views('companies')[5:]}, last AS (SELECT company_id, max(captured_at) AS captured_at FROM snaps GROUP BY 1)
 SELECT p.company_id, currency, period, count(*) AS price_count, min(amount - 20) AS min_amount, max(amount - 20) AS max_amount
 FROM v_snapshot_prices p JOIN last USING (company_id, captured_at) JOIN v_companies c ON c.company_id = p.company_id AND c.type = 'competitor' GROUP BY 1, 2, 3""",
    "public_users": f"{with_views('users')} SELECT CAST(user_id AS VARCHAR) AS id, name, trial_status, price_id, CAST(NULL AS VARCHAR) AS email FROM v_users",
    "company_listing": f"{with_views('companies')} SELECT user_id, company_id, name, {stamp('created_at')} AS created_at FROM v_companies",
    "digest_rows": f"{with_views('diffs')}, {_kept(7, 30)} SELECT user_id, position, diff_id, company_id, severity, {stamp('detected_at')} AS detected_at FROM kept",
    "digest_text": f"""{_DIGEST}, rows AS (SELECT s.user_id, s.email, k.position, k.severity, k.company_id, upper(k.severity) AS level, coalesce(c.name, 'Unknown company') AS company, {_MINUTE.format(x='k.detected_at')} AS moment
   FROM stages s JOIN kept k USING (user_id) LEFT JOIN v_companies c ON c.company_id = k.company_id WHERE stage = 'sent'),
 g AS (SELECT user_id, email, count(*) AS diff_count, count(*) FILTER (severity = 'high') AS high, count(*) FILTER (severity = 'medium') AS medium, count(*) FILTER (severity = 'low') AS low, count(DISTINCT company_id) AS companies,
   string_agg('- [' || level || '] ' || company || ' at ' || moment, chr(10) ORDER BY position) AS lines, string_agg('<li><strong>' || level || '</strong> - ' || company || ' at ' || moment || '</li>', '' ORDER BY position) AS items FROM rows GROUP BY 1, 2)
 SELECT user_id, email, diff_count, high, medium, low, companies, 'Weekly pricing digest: ' || diff_count || ' verified change' || CASE WHEN diff_count = 1 THEN '' ELSE 's' END AS subject,
  'Verified pricing changes from ' || {_SPAN[0]} || ' to ' || {_SPAN[1]} || ':' || chr(10) || 'High: ' || high || ', Medium: ' || medium || ', Low: ' || low || chr(10) || chr(10) || lines AS text,
  chr(10) || '    <div>' || chr(10) || '      <p>Verified pricing changes from <strong>' || {_SPAN[0]} || '</strong> to <strong>' || {_SPAN[1]} || '</strong>.</p>' || chr(10) || '      <p>High: ' || high || ', Medium: ' || medium || ', Low: ' || low || '</p>' || chr(10) || '      <ul>' || items || '</ul>' || chr(10) || '    </div>' || chr(10) || '  ' AS html FROM g""",
    "digest_funnel": f"""{_DIGEST} SELECT count(*) AS users_scanned, count(*) FILTER (stage = 'no_email') AS skipped_no_email, count(*) FILTER (stage = 'not_eligible') AS skipped_not_eligible,
 count(*) FILTER (stage IN ('recently_sent', 'no_diffs', 'sent')) AS eligible, count(*) FILTER (stage = 'recently_sent') AS skipped_recently_sent, count(*) FILTER (stage = 'no_diffs') AS skipped_no_diffs,
 count(*) FILTER (stage = 'sent') AS with_diffs, count(*) FILTER (stage = 'sent') AS sent, CAST(0 AS BIGINT) AS send_errors FROM stages""",
    "company_intake": _INTAKE_FOLD,
    "new_companies": f"""{_CANDIDATES.replace(duckdb_view('homepages'), duckdb_view('site_captures')).replace('WITH ', 'WITH RECURSIVE ', 1)},
 found AS (SELECT page_id, string_agg(url || ' ' || printf('%.2f', confidence) || ' false', '|' ORDER BY rank) AS list,
   max(url) FILTER (rank = 1 AND confidence >= {P.PRIMARY_MIN_CONFIDENCE} AND (runner_up IS NULL OR confidence - runner_up >= {P.PRIMARY_MIN_GAP}::DOUBLE)) AS best FROM top GROUP BY 1),
 decided AS ({_INTAKE_FOLD}), kept AS (SELECT * FROM decided WHERE reject_reason IS NULL)
 SELECT k.request_id, k.user_id, {strip_ends('o.name')} AS name, k.type, k.company_domain AS domain, k.homepage AS homepage_url, coalesce(k.pricing, best) AS primary_pricing_url,
  CASE WHEN k.pricing IS NOT NULL THEN {normal_url('k.pricing')} || ' 1.00 true' ELSE coalesce(list, '') END AS candidates,
  CASE WHEN k.type = 'competitor' THEN {stamp(NOW_SQL)} END AS next_crawl_at
 FROM kept k JOIN ({duckdb_view('intake')}) o USING (request_id)
 LEFT JOIN found f ON k.type = 'competitor' AND k.pricing IS NULL AND k.homepage = 'https://www.s' || f.page_id || '.example.com/'""",
    "primary_selection": f"""{with_views('companies')}, {_COMMANDS}, raw AS (SELECT command_id, company_id, user_id, 'c' || company_id || '.example.com' AS site, command_id % 6 AS n FROM cmd),
 given AS (SELECT *, CASE n WHEN 0 THEN 'https://' || site || '/cost' WHEN 1 THEN 'https://foreign.example.org/pricing' WHEN 3 THEN 'http://' || site || '/pricing' WHEN 4 THEN 'https://' || site || '/unlisted' END AS target FROM raw),
 r AS (SELECT g.*, c.domain, c.primary_pricing_url AS before, CASE WHEN n = 5 THEN 'invalid_request_body' WHEN n = 2 THEN 'invalid_pricing_url' WHEN c.company_id IS NULL THEN 'company_not_found' WHEN n = 1 THEN 'domain_mismatch' WHEN n = 4 THEN 'candidate_url_not_found' END AS reject_reason
   FROM given g LEFT JOIN v_companies c ON c.company_id = g.company_id AND c.user_id = g.user_id)
 SELECT command_id, company_id, reject_reason IS NULL AS accepted, reject_reason, CASE WHEN reject_reason IS NULL THEN target END AS primary_pricing_url,
  reject_reason IS NULL AND target IS DISTINCT FROM before AS primary_changed,
  CASE WHEN reject_reason IS NULL AND n = 0 THEN 'https://' || site || '/cost 1.00 true|https://' || site || '/plans 0.60 false|http://' || site || '/pricing 0.40 false'
   WHEN reject_reason IS NULL THEN 'https://' || site || '/plans 0.60 false|http://' || site || '/pricing 0.40 true' END AS candidates FROM r""",
    "price_list_checks": f"{_PRICE_LISTS} SELECT change_id, valid, currency, billing_period, plan_count FROM checked",
    "price_list_upsert": f"""{_PRICE_LISTS}, l AS (SELECT user_id, max(change_id) AS change_id FROM checked WHERE valid GROUP BY 1), n AS (SELECT user_id, max_by(notes, change_id) AS notes FROM checked WHERE valid AND notes IS NOT NULL GROUP BY 1)
 SELECT u.user_id, coalesce(c.currency, 'GBP') AS currency, coalesce(c.billing_period, 'custom') AS billing_period, coalesce(n.notes, CASE WHEN u.user_id IN (SELECT user_id FROM v_users) THEN 'kept' END) AS notes, coalesce(c.plan_count, 0) AS plan_count
 FROM (SELECT user_id FROM v_users UNION SELECT user_id FROM l) u LEFT JOIN l USING (user_id) LEFT JOIN checked c ON c.change_id = l.change_id LEFT JOIN n ON n.user_id = u.user_id""",
    "billing_state": _BILLING,
    "billing_accounts": _ACCOUNTS,
    "billing_effects": f"{_EFFECTS} SELECT event_type, effect, count(*) AS events, count(known_price) AS with_price FROM effects GROUP BY 1, 2",
    "checkout_matching": f"""{with_views('users')}, c AS (SELECT o_orderkey AS checkout_id, CASE o_orderkey % 3 WHEN 0 THEN NULL WHEN 1 THEN o_custkey ELSE o_custkey + 1000000 END AS ref,
   CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'u' || o_custkey || '@example.com' ELSE 'new' || o_custkey || '@example.com' END AS mail FROM orders)
 SELECT checkout_id, coalesce(a.user_id, b.user_id) AS user_id, CASE WHEN a.user_id IS NOT NULL THEN 'id' WHEN b.user_id IS NOT NULL THEN 'email' WHEN mail IS NOT NULL THEN 'new' ELSE 'none' END AS matched_by, mail AS normalized_email
 FROM c LEFT JOIN v_users a ON a.user_id = ref LEFT JOIN v_users b ON b.email = mail""",
    "billing_new_users": f"""{with_views('users')}, {_FIRST_PLAN}, c AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 = 1 THEN 'u' ELSE 'new' END || o_custkey || '@example.com' AS email,
  CASE o_orderkey % 3 WHEN 0 THEN 'price_pro' WHEN 1 THEN 'price_unknown' ELSE 'price_starter' END AS price, CASE WHEN o_orderkey % 7 <> 0 THEN 'cus_n' || o_custkey END AS cus
  FROM orders WHERE o_orderkey % 4 > 0 AND NOT (o_orderkey % 3 = 1 AND o_custkey IN (SELECT user_id FROM v_users))
   AND NOT (o_orderkey % 3 = 2 AND o_custkey + 1000000 IN (SELECT user_id FROM v_users))),
 n AS (SELECT c.* FROM c JOIN first_plan ON price_id = price WHERE email NOT IN (SELECT email FROM v_users WHERE email IS NOT NULL))
 SELECT email, min(id) AS first_checkout_id, max_by(price, id) AS price_id, max_by(cus, id) FILTER (cus IS NOT NULL) AS customer_id,
  TRUE AS has_access, count(*) AS checkouts, 'not_started' AS trial_status FROM n GROUP BY email""",
    "event_delivery": _DELIVERIES,
    "rate_limit": _LIMITS,
    "audit_rejects": f"""{with_views('audit_input')}, map AS (SELECT * FROM (VALUES {_AUDIT_VALUES}) m(event_type, actor_type, resource_type, status)),
 e AS (SELECT event_id, event_id % 50 AS n, user_id, CASE WHEN event_id % 50 = 0 THEN 'unheard_of' ELSE event_type END AS event_type,
   coalesce(CAST(company_id AS VARCHAR), CAST(user_id AS VARCHAR)) AS id FROM v_audit_input),
 s AS (SELECT event_id, n, user_id, CASE n WHEN 1 THEN '' WHEN 2 THEN repeat('x', 121) ELSE e.event_type END AS action, status, id FROM e LEFT JOIN map USING (event_type))
 SELECT event_id, user_id, action, status, CASE WHEN n = 0 THEN 'actor_type' WHEN n IN (1, 2) THEN 'action' ELSE 'resource_id' END AS reject_reason
 FROM s WHERE n < 3 OR (n = 3 AND length(id) * 130 > 120)""",
    "audit_log": f"{with_views('audit_input')}, map AS (SELECT * FROM (VALUES {_AUDIT_VALUES}) m(event_type, actor_type, resource_type, status)) SELECT event_id, user_id, actor_type, event_type AS action, resource_type, coalesce(CAST(company_id AS VARCHAR), CAST(user_id AS VARCHAR)) AS resource_id, status FROM v_audit_input JOIN map USING (event_type)",
    "audit_clean": "SELECT doc_id, CASE WHEN length(text) > 500 THEN substr(text, 1, 497) || '...' ELSE text END AS text, lang, '{\"d\":{}}' AS deep FROM documents",
    "catalog_related": f"""{_ARTICLES}, heads AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY tag ORDER BY published DESC, article_id) AS r FROM tagged) WHERE r <= 4),
 pool AS (SELECT DISTINCT t.article_id, h.article_id AS related_id, h.published FROM tagged t JOIN heads h USING (tag) WHERE h.article_id <> t.article_id)
 SELECT article_id, rank, related_id FROM (SELECT *, row_number() OVER (PARTITION BY article_id ORDER BY published DESC, related_id) AS rank FROM pool) WHERE rank <= 3""",
    "catalog_categories": f"{_ARTICLES} SELECT tag, rank, article_id FROM (SELECT *, row_number() OVER (PARTITION BY tag ORDER BY published DESC, article_id) AS rank FROM tagged) WHERE rank <= 3",
    "catalog_latest": f"{with_views('articles')} SELECT article_id, author FROM v_articles ORDER BY published DESC, article_id LIMIT 6",
    "catalog_by_author": f"{with_views('articles')} SELECT author, article_id FROM v_articles",
}

_BUDGETS = ", ".join(f"({i}, {q(name)}, {most}, {window})" for i, (name, (most, window)) in enumerate(P.REQUEST_BUDGETS.items()))
_BUDGET_WALK = f"""WITH RECURSIVE budgets(i, name, most, win) AS (VALUES {_BUDGETS}),
r AS MATERIALIZED (SELECT event_id AS request_id, name || ':' || (user_id % 5) AS key, most, win, date_trunc('day', ts) + to_seconds(event_id % 90) AS ts,
   row_number() OVER (PARTITION BY name, user_id % 5 ORDER BY date_trunc('day', ts) + to_seconds(event_id % 90), event_id) AS n
  FROM events JOIN budgets ON i = event_id % {len(P.REQUEST_BUDGETS)}),
walk AS (
  SELECT key, n, request_id, ts, ts AS opened, CAST(1 AS BIGINT) AS used, TRUE AS allowed, most, win FROM r WHERE n = 1
  UNION ALL
  SELECT key, n, request_id, ts, CASE WHEN fresh THEN ts ELSE opened END, CASE WHEN fresh THEN 1 WHEN used < most THEN used + 1 ELSE used END, fresh OR used < most, most, win
  FROM (SELECT r.*, w.opened, w.used, r.ts >= w.opened + to_seconds(r.win) AS fresh FROM walk w JOIN r ON r.key = w.key AND r.n = w.n + 1))
SELECT request_id, key, allowed, CAST(CASE WHEN allowed THEN most - used ELSE 0 END AS BIGINT) AS remaining,
  CASE WHEN allowed THEN 0 ELSE CAST(ceil((epoch_us(opened) + win * 1000000 - epoch_us(ts)) / 1000000) AS BIGINT) END AS retry_after_seconds,
  {stamp('opened')} AS window_started_at, {stamp("opened + to_seconds(win)")} AS reset_at FROM walk"""

# Queries that build on others.
_AT = f"strftime({NOW_SQL}, '%Y%m%d%H%M%S')"
RECORD_SQL |= {
    "request_budgets": _BUDGET_WALK,
    "crawl_new_snapshots": f"{_CRAWL} SELECT company_id || '-' || {_AT} AS snapshot_id, user_id, company_id, content_hash, evidence AS confidence, {stamp(NOW_SQL)} AS captured_at FROM final WHERE changed",
    "crawl_new_diffs": f"{_CRAWL} SELECT company_id || '-' || {_AT} AS diff_id, user_id, company_id, company_id || '-old' AS previous_snapshot_id, company_id || '-' || {_AT} AS current_snapshot_id, severity, {stamp(NOW_SQL)} AS detected_at FROM final WHERE diff_created",
    "crawl_new_insights": f"{_CRAWL} SELECT company_id || '-' || {_AT} AS diff_id, user_id, company_id, 'rules-v1' AS model, severity FROM final WHERE insight_created",
    "feed_documents": f"WITH page AS ({RECORD_SQL['feed_page']}) SELECT user_id, position, diff_id, company_name AS name, last_crawl_status AS status, insight_id, insight_gate AS severity_gate, verification_state AS verification_cue, detected_at AS detected_cue, has_more, next_cursor FROM page",
    "comparison_own_prices": f"WITH shown AS ({RECORD_SQL['comparison']}), own AS ({RECORD_SQL['price_list_upsert']}) SELECT user_id, company_id, snapshot_id, currency AS own_currency, billing_period AS own_period, notes AS own_notes, plan_count AS own_plan_count FROM shown LEFT JOIN own USING (user_id)",
    "digest_marked": f"{_DIGEST} SELECT u.user_id, {stamp(f"CASE WHEN s.user_id IS NOT NULL THEN {NOW_SQL} ELSE u.last_digest_sent_at END")} AS last_digest_sent_at FROM v_users u LEFT JOIN (SELECT user_id FROM stages WHERE stage = 'sent') s USING (user_id)",
}

_WHO = "CAST(user_id AS BIGINT) AS user_id"
RECORD_SQL["activity_log"] = f"""WITH RECURSIVE map AS (SELECT * FROM (VALUES {_AUDIT_VALUES}) m(event_type, actor_type, resource_type, status)),
asked AS ({RECORD_SQL['company_intake']}), chosen AS ({RECORD_SQL['primary_selection']}), tried AS ({RECORD_SQL['trial_start']}),
paid AS ({_ACCOUNTS[:_ACCOUNTS.index('acting AS (')].rstrip().rstrip(',')} SELECT * FROM acts),
cmds AS (WITH {_COMMANDS} SELECT * FROM cmd),
told AS (
  SELECT {_WHO}, CAST(NULL AS BIGINT) AS company_id, 'competitor_cap_hit' AS event_type, '{{"source":"api:companies.post"}}' AS metadata, CAST(o_orderdate AS TIMESTAMP) AS happened
  FROM asked JOIN orders ON o_orderkey = request_id WHERE reject_reason = 'competitor_limit_reached'
  UNION ALL SELECT {_WHO}, request_id, 'company_created', '{{"source":"api:companies.post","companyType":"' || type || '","domain":"' || company_domain || '"}}', CAST(o_orderdate AS TIMESTAMP)
  FROM asked JOIN orders ON o_orderkey = request_id WHERE reject_reason IS NULL
  UNION ALL SELECT c.user_id, p.company_id, 'primary_pricing_url_changed', '{{"source":"api:companies.primary-pricing.patch","nextPrimaryPricingUrl":"' || primary_pricing_url || '"}}', {NOW_SQL}
  FROM chosen p JOIN cmds c USING (command_id) WHERE primary_changed
  UNION ALL SELECT {_WHO}, NULL, CASE WHEN started THEN 'trial_started' ELSE 'trial_start_blocked' END,
   '{{"source":"api:trial.start","reason":"' || reason || '","trialStatus":"' || trial_status || '","started":' || started || '}}', {NOW_SQL} FROM tried
  UNION ALL SELECT CASE WHEN NOT account.fresh THEN account.id END, NULL, 'webhook_access_' || CASE effect WHEN 'grant' THEN 'granted' ELSE 'revoked' END,
   '{{"source":"api:webhook.stripe","eventId":' || event_id || '}}', arrived_at FROM paid WHERE effect IN ('grant', 'revoke'))
SELECT user_id, actor_type, event_type AS action, resource_type, coalesce(CAST(company_id AS VARCHAR), CAST(user_id AS VARCHAR)) AS resource_id, status, metadata, {stamp('happened')} AS created_at
FROM told JOIN map USING (event_type)"""
