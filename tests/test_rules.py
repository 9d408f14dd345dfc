"""Hand-made cases for the quirks of the rules."""

import json
import random
import time

import pytest
from pyspark.sql import functions as F

from tarifflens.functions import numbers, prices, text, urls
from tarifflens.functions.cursor import decode_cursor, encode_cursor
from tarifflens import policies as P
from tarifflens.operators import (
    audit,
    billing,
    crawl,
    delivery,
    diffing,
    discovery,
    entitlements,
    extraction,
    intake,
    intervals,
)

MENTIONS = [
    ("$49 per member", [(49.0, "USD", "month")]),
    ("USD $20 per developer", [(20.0, "USD", "day")]),
    ("$10 per workspace", [(10.0, "USD", "week")]),
    ("EUR 1,299.99/yearly", [(1299.99, "EUR", "year")]),
    ("$12345", [(1234.0, "USD", "unknown"), (5.0, "USD", "unknown")]),
    ("$9.999", [(9.99, "USD", "unknown"), (9.0, "USD", "unknown")]),
    ("19 €/month", [(19.0, "USD", "unknown")]),
    ("24/7 support", [(24.0, "USD", "unknown"), (7.0, "USD", "unknown")]),
    ("$15 / one-time", [(15.0, "USD", "one_time")]),
    ("£5per annum", [(5.0, "GBP", "unknown")]),
    ("$10000/yr", [(1000.0, "USD", "unknown")]),
    ("éUSD 7 and xUSD 8", [(7.0, "USD", "unknown"), (8.0, "USD", "unknown")]),
    ("no price here", []),
]

ADDRESSES = [
    ("HTTP://www.Example.com:80//a//b/?q=1#x", "http://example.com/a/b/"),
    ("foo.com", "https://foo.com/"),
    ("ftp://x.com", None),
    ("a.com?x=http://b", None),
    ("https://exa mple.com", None),
    ("https://éxample.fr/café x/%20?z", "https://xn--xample-9ua.fr/caf%C3%A9%20x/%20"),
    ("https://u:p@h.com:8443/../a/./b/..", "https://u:p@h.com:8443/a/"),
    ("https://www./", "https://www./"),
    ("https://a.com:99999/", None),
    ("http://h.com\\a\\b", "http://h.com/a/b"),
    ("https://www.plain.example.com/a/b?x#y", "https://plain.example.com/a/b"),
]


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).first()["y"]


def test_price_mentions(spark):
    df = spark.createDataFrame([(t,) for t, _ in MENTIONS], "x string")
    found = df.select(prices.price_mentions(F.col("x")).alias("m")).collect()
    assert [[(m.amount, m.currency, m.period) for m in r.m] for r in found] == [e for _, e in MENTIONS]


def test_addresses(spark):
    df = spark.createDataFrame([(t,) for t, _ in ADDRESSES], "x string")
    found = [r.y for r in df.select(urls.normalize_url(F.col("x")).alias("y")).collect()]
    assert found == [e for _, e in ADDRESSES]


@pytest.mark.parametrize("value,expected", [(1.005, 1.0), (2.675, 2.67), (0.125, 0.13), (1299.5, 1299.5), (33.33333, 33.33), (0.1 + 0.2, 0.3)])
def test_two_decimals(spark, value, expected):
    assert one(spark, value, numbers.fixed2, "double") == expected


def test_entities_decode_in_order(spark):
    assert one(spark, "<p>a&amp;quot;b&lt;&nbsp; c</p>", text.html_text) == 'a"b&lt; c'


def test_payload_keeps_two_spellings_of_a_currency(spark):
    df = spark.sql("select array(struct('usd' currency, 'month' period, 5.0D amount), struct('USD' currency, 'month' period, 5.0D amount)) x")
    assert len(df.select(prices.unique_prices(F.col("x")).alias("y")).first().y) == 2


def test_positional_pairing(spark):
    """One low price shifts every later pair; a second diff of equal lists is empty."""
    kind = "array<struct<currency:string,period:string,amount:double>>"
    old = [("USD", "month", a) for a in (10.0, 20.0)]
    new = [("USD", "month", a) for a in (5.0, 10.0, 20.0)]
    df = spark.createDataFrame([(old, new)], f"o {kind}, n {kind}")
    change = df.select(diffing.bucket_changes(F.col("o"), F.col("n")).alias("c")).first().c[0]
    assert [(u.previous_amount, u.current_amount, u.delta_percent) for u in change.updated_amounts] == [(10.0, 5.0, 50.0), (20.0, 10.0, 50.0)]
    assert change.added_amounts == [20.0] and change.removed_amounts == []
    assert df.select(diffing.bucket_changes(F.col("n"), F.col("n")).alias("c")).first().c == []


def test_primary_needs_a_gap(spark):
    def pick(*scores):
        data = [(f"https://a.com/{i}", c, False) for i, c in enumerate(scores)]
        df = spark.createDataFrame([(data,)], f"c {discovery.CANDIDATE_TYPE}")
        return df.select(discovery.recommended_primary(F.col("c")).alias("y")).first().y

    assert pick(1.0, 0.92) is None  # the double difference is just below .08
    assert pick(0.9, 0.82) == "https://a.com/0"
    assert pick(0.85) is None and pick(0.86) == "https://a.com/0"


def test_cursor_forms(spark):
    df = spark.sql("select timestamp_ntz'2001-08-01 12:34:56.789' t, 42 i")
    back = df.select(decode_cursor(encode_cursor(F.col("t"), F.col("i"))).alias("c")).first().c
    assert (str(back.detected_at), back.id) == ("2001-08-01 12:34:56.789000", "42")
    assert one(spark, "2001-08-01T00:00:00.000Z", decode_cursor).id is None
    assert one(spark, "not a cursor", decode_cursor) is None


@pytest.mark.parametrize("given,expected", [(None, 3), (0, 3), (-1, 3), (2.9, 2), (50, 20), (float("inf"), 3)])
def test_batch_limit(given, expected):
    assert crawl.batch_limit(given) == expected


def test_batch_limit_without_a_maximum():
    assert crawl.batch_limit(500, most=None) == 500


PLANS = [(0, "price_starter", "starter"), (1, "price_pro", "pro"), (2, "price_pro", "starter")]
USERS = "user_id long, customer_id string, has_access boolean, price_id string, trial_status string"
BILLING = (
    "event_id long, arrived_at timestamp_ntz, user_id long, event_type string, subscription_status string, "
    "price_id string, customer_id string"
)
CHECKOUT, PAID, DELETED = "checkout.session.completed", "invoice.paid", "customer.subscription.deleted"


def after(spark, users, events):
    given = spark.createDataFrame(events, BILLING.replace("timestamp_ntz", "string"))
    given = given.withColumn("arrived_at", F.col("arrived_at").cast("timestamp_ntz"))
    states = billing.account_states(spark.createDataFrame(users, USERS), given, PLANS).collect()
    return {r.user_id: (r.has_access, r.price_id, r.customer_id) for r in states}


def test_checkout_without_a_customer_id_keeps_access(spark):
    events = [
        (1, "2024-01-01 00:00:00", 1, CHECKOUT, None, "price_pro", None),
        (2, "2024-01-02 00:00:00", 1, DELETED, None, None, "cus_1"),
    ]
    assert after(spark, [(1, None, False, None, "none")], events) == {1: (True, "price_pro", None)}


def test_events_find_their_user_by_customer_id(spark):
    users = [(1, "cus_MINE", False, None, "none"), (2, "cus_2", True, "price_pro", "none")]
    events = [
        (1, "2024-01-01 00:00:00", 1, PAID, None, "price_pro", "cus_OTHER"),
        (2, "2024-01-02 00:00:00", 1, DELETED, None, None, "cus_2"),
        (3, "2024-01-03 00:00:00", 1, CHECKOUT, None, "price_starter", "cus_NEW"),
        (4, "2024-01-04 00:00:00", 9, DELETED, None, None, "cus_MINE"),
        (5, "2024-01-05 00:00:00", 9, PAID, None, "price_pro", "cus_NEW"),
    ]
    assert after(spark, users, events) == {1: (True, "price_pro", "cus_NEW"), 2: (False, None, "cus_2")}


def test_late_success_is_final(spark):
    rows = [
        (1, 7, "2024-01-01 00:00:00", "processed", "2024-01-01 00:06:00"),
        (2, 7, "2024-01-01 00:30:00", "processed", "2024-01-01 00:30:01"),
        (3, 8, "2024-01-01 00:00:00", "processed", "2024-01-01 00:06:00"),
        (4, 8, "2024-01-01 00:05:30", "failed", "2024-01-01 00:05:31"),
    ]
    given = spark.createDataFrame(rows, "delivery_id long, event_id long, arrived_at string, result string, finished_at string")
    given = given.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("arrived_at", "finished_at")})
    found = {r.delivery_id: (r.action, r.reason) for r in delivery.handle_deliveries(given, 300).collect()}
    assert found == {1: ("process", None), 2: ("skip", "already_processed"), 3: ("process", None), 4: ("process", None)}


@pytest.mark.parametrize("limit", [10, 25])
def test_any_plan_limit_holds(spark, limit):
    columns = (
        "request_id long, requested_at timestamp_ntz, user_id long, type string, name string, domain string, "
        "homepage_url string, primary_pricing_url string"
    )
    rows = [(i, None, 1, "competitor", f"c{i}", f"c{i}.example.com", None, None) for i in range(40)]
    requests = spark.createDataFrame(rows, columns).withColumn(
        "requested_at", F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, request_id * 7)")
    )
    users = spark.createDataFrame([(1, True, limit)], "user_id long, access_granted boolean, competitor_limit int")
    companies = spark.createDataFrame([], "user_id long, type string, domain string")
    admitted = intake.admit_companies(requests, users, companies).where("reject_reason is null")
    assert admitted.count() == limit


def bounded(value, depth=0):
    """The bounds on a parsed value, one by one."""
    if isinstance(value, str):
        return value if len(value) <= P.AUDIT_TEXT_LIMIT else value[: P.AUDIT_TEXT_LIMIT - 3] + "..."
    if isinstance(value, list):
        return [bounded(v, depth + 1) for v in value[: P.AUDIT_KEY_LIMIT]] if depth < P.AUDIT_DEPTH_LIMIT else []
    if isinstance(value, dict):
        return {k: bounded(v, depth + 1) for k, v in list(value.items())[: P.AUDIT_KEY_LIMIT]} if depth < P.AUDIT_DEPTH_LIMIT else {}
    return value


def test_long_candidate_lists_merge_in_one_go(spark):
    """Lists of very many addresses, some of them twice: the best confidence and any choice survive, in short time."""
    def listed(low, high, chosen):
        each = F.sequence(F.lit(low), F.lit(high))
        url = lambda i: F.concat(F.lit("https://a.com/p"), i.cast("string"))
        return F.transform(each, lambda i: F.struct(url(i).alias("url"), (F.lit(0.5) + (i % 7) / 100 * chosen).alias("confidence"), F.lit(bool(chosen)).alias("selected_by_user")))

    def seconds(size):
        start = time.perf_counter()
        merged = discovery.merge_candidates(listed(0, size, 0), listed(size // 2, size + size // 2, 1))
        rows = spark.range(1).select(F.inline(merged)).collect()
        assert len(rows) == size + size // 2 + 1
        assert all(r.selected_by_user == (int(r.url[15:]) >= size // 2) for r in rows)
        assert all(r.confidence == round(0.5 + int(r.url[15:]) % 7 / 100 * r.selected_by_user, 2) for r in rows)
        return time.perf_counter() - start

    seconds(100)
    assert seconds(40_000) < 60


def test_metadata_has_one_layout(spark):
    """Flat, nested, wide, invalid and repeated keys: the bounds of a plain walk, in the order of the text, without Python."""
    long = "x" * 600
    objects = [
        '{"a": 1.50,  "b": [1, {"c": 2}]}',
        '{"a": 1.50, "b": "%s"}' % long,
        "{" + ",".join(f'"k{i:03d}": {i}' for i in reversed(range(60))) + "}",
        '{"a": {"b": {"c": {"d": {"e": 1}}}}, "l": [[[["x"]]]]}',
        '{"z": "1", "y": 1, "x": true, "w": null, "v": "null", "u": "{}", "t": "[1]", "s": {}, "r": []}',
        '{"q": "say \\"hi\\" \\u00e9\\n", "é\\"": {"b": "%s", "a": ["%s", {"z": 1, "b": 2}]}}' % (long, long),
        '{"a": 1, "b": 2, "a": "last"}',
        '{"list": [%s]}' % ",".join(f'"{i}"' for i in range(70)),
        "{}",
    ]
    rows = [*enumerate(objects), (100, "[1]"), (101, "no json"), (102, None), (103, ""), (104, '"text"'), (105, '{"a": ')]
    cleaned = audit.clean_metadata(spark.createDataFrame(rows, "id long, metadata string"))
    found = {r.id: r.metadata for r in cleaned.collect()}
    layout = lambda text: json.dumps({k: bounded(v) for k, v in list(json.loads(text).items())[: P.AUDIT_KEY_LIMIT]}, ensure_ascii=False, separators=(",", ":"))
    assert found == {i: layout(text) for i, text in enumerate(objects)} | {i: "{}" for i in range(100, 106)}
    assert "Python" not in cleaned._jdf.queryExecution().toString()


def test_plan_table_and_list_agree(spark):
    prices = spark.createDataFrame([("price_pro",), ("price_gone",), (None,)], "price_id string")
    table = spark.createDataFrame(PLANS, "ordinal int, price_id string, tier string")
    tiers = [{r.price_id: r.price_tier for r in entitlements.with_price_tier(prices, p).collect()} for p in (PLANS, table)]
    assert tiers[0] == tiers[1] == {"price_pro": "pro", "price_gone": None, None: None}


def test_fixed_values():
    """The twins import the policy tables too, so a wrong value would pass there on both sides."""
    assert P.PLAN_TIERS["starter"]["competitor_limit"] < P.PLAN_TIERS["pro"]["competitor_limit"]
    assert P.SEVERITY_GATES == {"high_only": ("high",), "high_and_medium": ("high", "medium")}
    assert (P.OK_DELAY_SECONDS, P.ERROR_DELAY_SECONDS) == (86_400, 21_600)
    assert (P.BLOCKED_DELAY_SECONDS, P.MANUAL_DELAY_SECONDS) == (129_600, 172_800)
    assert (P.CRAWL_LEASE_SECONDS, P.DELIVERY_LOCK_SECONDS) == (360, 300)
    assert (P.MAX_CRAWL_LIMIT, P.FEED_MAX_LIMIT, P.FEED_DEFAULT_LIMIT, P.TRIAL_DAYS) == (20, 100, 20, 7)
    assert (P.DISCOVERY_MIN_CONFIDENCE, P.DISCOVERY_MAX_CANDIDATES) == (0.35, 8)
    assert (P.PRIMARY_MIN_CONFIDENCE, P.PRIMARY_MIN_GAP) == (0.86, 0.08)
    assert (P.MIN_ABSOLUTE_CHANGE, P.MIN_PERCENT_CHANGE) == (0.5, 1.0)
    assert (P.AUDIT_TEXT_LIMIT, P.AUDIT_KEY_LIMIT, P.AUDIT_DEPTH_LIMIT) == (500, 40, 3)
    assert P.BLOCKED_HTTP_STATUSES == (401, 403, 429)
    assert P.REQUEST_BUDGETS["trial-start"] == (3, 60) and P.REQUEST_BUDGETS["company-create"] == (10, 60)
    assert [w for _, w in P.PATH_PLUS] == [0.85, 0.78, 0.52, 0.35]
    assert [w for _, w in P.TEXT_PLUS] == [0.42, 0.38, 0.26, 0.22, 0.20, 0.14]


def replayed(users, events):
    """Accounts after the events, one by one, as the webhook handles them: the oldest account that holds an id acts."""
    accounts = [dict(zip(("user_id", "email", "customer_id", "access", "price"), u)) for u in users]
    for event_id, _, ref, mail, kind, price, customer in sorted(events, key=lambda e: (e[1], e[0])):
        known = price in ("price_pro", "price_starter")
        mail = (mail or "").strip().lower() or None
        if kind == CHECKOUT:
            if not known:
                continue
            account = next((a for a in accounts if ref is not None and a["user_id"] == ref), None)
            account = account or next((a for a in accounts if mail and a["email"] == mail), None)
            if account is None:
                if mail is None:
                    continue
                account = {"user_id": None, "email": mail, "customer_id": None}
                accounts.append(account)
            account.update(access=True, price=price, customer_id=customer or account["customer_id"])
            continue
        holding = [a for a in accounts if customer is not None and a["customer_id"] == customer]
        if not holding or (kind == PAID and not known):
            continue
        account = min(holding, key=lambda a: (a["user_id"] is None, a["user_id"] or 0, a["email"] or ""))
        account.update(access=kind == PAID, price=price if kind == PAID else None)
    return sorted(repr((a["user_id"], a["email"], a["access"], a["price"], a["customer_id"])) for a in accounts)


JOURNAL = (
    "event_id long, arrived_at string, client_reference_id long, customer_email string, event_type string, "
    "price_id string, customer_id string, subscription_status string"
)


def journal_states(spark, users, events):
    given = spark.createDataFrame([(*e, None) for e in events], JOURNAL).withColumn("arrived_at", F.col("arrived_at").cast("timestamp_ntz"))
    schema = "user_id long, email string, customer_id string, has_access boolean, price_id string, trial_status string"
    frame = spark.createDataFrame([(*u, "none") for u in users], schema)
    return frame, given, billing.account_states(frame, given, PLANS)


def test_a_new_customer_pays_and_leaves(spark):
    """A checkout of an unknown e-mail makes an account, and what follows under its customer id acts on it."""
    events = [
        (1, "2024-01-01 00:00:00", None, " New@Example.com", CHECKOUT, "price_pro", "cus_9"),
        (2, "2024-01-02 00:00:00", None, None, PAID, "price_starter", "cus_9"),
        (3, "2024-01-03 00:00:00", None, None, DELETED, None, "cus_9"),
        (4, "2024-01-04 00:00:00", None, "seven@example.com", CHECKOUT, "price_pro", "cus_7"),
        (5, "2024-01-05 00:00:00", None, "ghost@example.com", CHECKOUT, "price_unknown", "cus_8"),
    ]
    users = [(7, "seven@example.com", None, False, None)]
    states = journal_states(spark, users, events)[2].collect()
    found = {(r.user_id, r.email): (r.has_access, r.price_id, r.customer_id) for r in states}
    assert found == {
        (7, "seven@example.com"): (True, "price_pro", "cus_7"),
        (None, "new@example.com"): (False, None, "cus_9"),
    }


@pytest.mark.parametrize("folded", [512, 3])
def test_accounts_equal_a_replay(spark, monkeypatch, folded):
    """Ids that change hands, are shared, come back and are brought again, by users and by accounts of the same run."""
    monkeypatch.setattr(billing, "FOLDED", folded)
    rng = random.Random(3)
    users = [(i, f"u{i}@x.com" if i % 3 else None, f"cus_{i % 4}" if i % 2 else None, False, None) for i in range(8)]
    events = []
    for event_id in range(600):
        at = f"2024-0{rng.randint(1, 3)}-{rng.randint(1, 9):02} {rng.randint(0, 23):02}:00:00"
        ref = rng.choice([None, rng.randrange(12)])
        mail = rng.choice([None, " ", f"U{rng.randrange(8)}@x.com", f"new{rng.randrange(4)}@x.com"])
        kind = rng.choice([CHECKOUT, PAID, DELETED])
        price = rng.choice(["price_pro", "price_starter", None, "price_gone"])
        events.append((event_id, at, ref, mail, kind, price, rng.choice([None, *(f"cus_{k}" for k in range(6))])))
    frame, given, states = journal_states(spark, users, events)
    wanted = replayed(users, events)
    shown = ("user_id", "email", "has_access", "price_id", "customer_id")
    assert sorted(repr(tuple(r[c] for c in shown)) for r in states.collect()) == wanted
    # In two runs, the second of which meets the accounts of the first.
    times = sorted((e[1], e[0]) for e in events)[:300]
    first = [e for e in events if (e[1], e[0]) in set(times)]
    rest = [e for e in events if (e[1], e[0]) not in set(times)]
    middle = journal_states(spark, users, first)[2]
    given = journal_states(spark, users, rest)[1]
    final = billing.account_states(middle, given, PLANS)
    assert sorted(repr(tuple(r[c] for c in shown)) for r in final.collect()) == wanted


def test_a_busy_customer_id_stays_linear(spark):
    """As many rows as events and changes: for one user's checkouts, and for one id that many users bring."""
    def sizes(count, owners):
        users = [(i, None, None, False, None) for i in range(owners)]
        at = lambda k: f"2024-01-01 {k // 3600:02}:{k // 60 % 60:02}:{k % 60:02}"
        events = [(2 * k, at(k), k % owners, None, CHECKOUT, "price_pro", "cus_hot") for k in range(count)]
        events += [(2 * k + 1, at(k), None, None, PAID, "price_pro", "cus_hot") for k in range(count)]
        frame, given, _ = journal_states(spark, users, events)
        acting = billing.with_event_effect(given, PLANS)
        bought = billing.checkout_accounts(acting.where("is_checkout"), frame)
        named = frame.withColumn("account", billing._account(F.col("user_id"), F.col("email")))
        changes = billing.holder_changes(named, bought)
        held = billing.with_holder(acting.where("not is_checkout"), named, bought)
        return changes.count(), billing.holder_rows(changes).count(), held.count()

    assert sizes(300, 1) == (1, 1, 300)
    assert sizes(300, 300) == (300, 300, 300)


def test_least_cover_equals_brute_force(spark):
    rng = random.Random(4)
    spans = [(rng.choice("ab"), low := rng.randint(1, 200), rng.choice([low, rng.randint(low, 220), intervals.NEVER]), v) for v in range(150)]
    points = [(key, at) for key in "abc" for at in range(1, 221)]
    found = intervals.with_least_cover(
        spark.createDataFrame(points, "k string, at long"),
        spark.createDataFrame(spans, "k string, low long, high long, v long"), ["k"], "at", "v", into="least",
    )
    wanted = {(k, at): min((v for s, low, high, v in spans if s == k and low <= at < high), default=None) for k, at in points}
    assert {(r.k, r.at): r.least for r in found.collect()} == wanted


def test_policies_of_the_caller(spark):
    """Another table of weights, phrases, delays or tiers changes the answers; the default ones stay."""
    homes = spark.createDataFrame([("https://a.com", '<a href="/tarife">Tarife</a>')], "homepage_url string, html string")
    links = P.LinkPolicy(path_plus=((r"^/tarife(?:/|$)", 0.9),))
    assert discovery.discover_pricing_urls(homes).first().candidates == []
    found = discovery.discover_pricing_urls(homes, links=links).first()
    assert found.candidates[0].url == found.recommended_primary_url == "https://a.com/tarife"
    assert discovery.discover_pricing_urls(homes, links=P.LinkPolicy(links.path_plus, primary_confidence=0.99)).first()[-1] is None

    captures = spark.createDataFrame(
        [("https://a.com/t", 200, "text/html", "<p>Zugriff verweigert</p>"), ("https://a.com/t", 451, "text/html", "")],
        "source_url string, http_status int, content_type string, html string",
    )
    pages = P.PagePolicy(blocked=("zugriff verweigert",), blocked_statuses=(451,))
    assert [r.status for r in extraction.extract_pricing(captures).collect()] == ["manual_needed"] * 2
    assert [r.status for r in extraction.extract_pricing(captures, pages=pages).collect()] == ["blocked"] * 2

    states = spark.createDataFrame([("ok",), ("blocked",), ("manual_needed",), ("error",), ("idle",)], "status string")
    now = F.expr("timestamp_ntz'2001-08-01 00:00:00'")
    crawls = P.CrawlPolicy(ok=1, blocked=2, manual_needed=3, error=4)
    after = states.select(crawl.next_crawl_at(F.col("status"), now, crawls).alias("at")).collect()
    assert [r["at"].second for r in after] == [1, 2, 3, 4, 1]

    users = spark.sql(
        "select 1L user_id, true has_access, 'x' price_id, 'none' trial_status, timestamp_ntz'2001-08-02 00:00:00' trial_ends_at "
        "union all select 2L, false, null, 'active', timestamp_ntz'2001-08-02 00:00:00'"
    )
    tiers = P.TierPolicy(
        {"team": dict(competitor_limit=50, gate="all", digest=True), "taste": dict(competitor_limit=1, gate="none", digest=False)},
        {"all": ("high", "medium", "low"), "none": ()},
        trial="taste",
        fallback="team",
    )
    granted = {r.user_id: r for r in entitlements.with_entitlements(users, [(1, "y", "team")], now, tiers).collect()}
    assert (granted[1].competitor_limit, granted[1].allowed_severities) == (50, ["high", "medium", "low"])
    assert (granted[2].plan_tier, granted[2].competitor_limit, granted[2].allowed_severities) == ("taste", 1, [])
    usual = {r.user_id: r.plan_tier for r in entitlements.with_entitlements(users, [(1, "y", "pro")], now).collect()}
    assert usual == {1: "starter", 2: "starter"}
