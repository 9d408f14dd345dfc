"""Billing events to account state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarifflens import policies as P
from tarifflens.functions.columns import bind, blank_to_null, first_true, floor_div
from tarifflens.functions.text import strip_ends
from tarifflens.operators.entitlements import Plans, with_price_tier
from tarifflens.operators.history import carry_forward, running_total, with_previous
from tarifflens.operators.intervals import NEVER, with_least_cover
from tarifflens.operators.ratelimit import micros
from tarifflens.sources.stages import stored

# Order within a key is found per day; the id that an account starts with counts as older than any event.
DAY = 86_400_000_000
BEFORE_ALL = -(2**62)
# So many changes of a customer id travel as a list.
FOLDED = 512


def with_event_effect(events: DataFrame, plans: Plans) -> DataFrame:
    """Add ``effect`` (grant, revoke, touch, none, failed), ``known_price`` and ``is_checkout``.

    Only price ids of known plans count; events that would grant access without one fail.
    """
    known = with_price_tier(events, plans, tier="_tier")
    price = F.when(F.col("_tier").isNotNull(), F.col("price_id"))
    kind, state = F.col("event_type"), F.col("subscription_status")
    checkout = kind == "checkout.session.completed"
    updated = kind == "customer.subscription.updated"
    has_customer = F.col("customer_id").isNotNull()
    granting = updated & has_customer & state.isin(*P.GRANTING_SUBSCRIPTION_STATES)
    needs_price = checkout | (kind == "invoice.paid") | granting
    effect = first_true(
        [
            (needs_price & F.col("_tier").isNull(), "failed"),
            (checkout, "grant"),
            ((kind == "invoice.paid") & has_customer, "grant"),
            (granting, "grant"),
            (updated & has_customer & state.isin(*P.REVOKING_SUBSCRIPTION_STATES), "revoke"),
            (updated & has_customer, "touch"),
            ((kind == "customer.subscription.deleted") & has_customer, "revoke"),
        ],
        "none",
    )
    return known.withColumn("known_price", price).withColumn("effect", effect).withColumn(
        "is_checkout", checkout & (F.col("effect") == "grant")
    ).drop("_tier")


def _latest(value: Column, when: Column) -> Column:
    """Last value in arrival order among the rows where ``when`` holds."""
    return F.max_by(value, F.when(when, F.struct("arrived_at", "event_id")))


def _account(user_id: Column, email: Column) -> Column:
    """What names an account: its user id, or the e-mail of one that a checkout has created. Older accounts sort first."""
    fresh = user_id.isNull()
    return F.struct(fresh.alias("fresh"), user_id.alias("user_id"), F.when(fresh, email).alias("email"))


def checkout_accounts(checkouts: DataFrame, users: DataFrame) -> DataFrame:
    """Checkouts with the ``account`` they act on: by id, else by e-mail, else one that they create; others drop out."""
    if "email" not in users.columns:
        users = users.withColumn("email", F.lit(None).cast("string"))
    resolved, _ = checkout_users(checkouts, users)
    kind = users.schema["user_id"].dataType
    mail = F.col("normalized_email")
    # An account that an earlier run created has an e-mail and no id.
    made = F.col("matched_by") == "new"
    account = F.when(made, _account(F.lit(None).cast(kind), mail)).otherwise(_account(F.col("user_id"), F.lit(None).cast("string")))
    return resolved.where("matched_by != 'none'").select(*checkouts.columns, account.alias("account"))


def holder_changes(users: DataFrame, checkouts: DataFrame) -> DataFrame:
    """When a customer id comes to an account or leaves it: ``customer_id, at, id, account, taken``.

    ``checkouts`` have an account. An account keeps its customer id until a checkout brings another one; checkouts that bring
    the same one again change nothing, so there are no more changes than real ones. The id that an account starts with
    is older than any event.
    """
    known = users.where(F.col("customer_id").isNotNull()).select(
        "account", "customer_id", F.lit(BEFORE_ALL).cast("long").alias("at"), F.lit(-1).cast("long").alias("id")
    )
    brought = checkouts.where(F.col("customer_id").isNotNull()).select(
        "account", "customer_id", micros("arrived_at").alias("at"), F.col("event_id").cast("long").alias("id")
    )
    seen = with_previous(
        known.unionByName(brought), ["account"], ["at", "id"], ["customer_id"], floor_div(F.col("at"), DAY), prefix="left_"
    )
    moved = seen.where(~F.col("customer_id").eqNullSafe(F.col("left_customer_id")))
    # One row for the id that is taken and one for the id that is left.
    both = F.array(
        F.struct(F.col("customer_id"), F.lit(True).alias("taken")),
        F.struct(F.col("left_customer_id").alias("customer_id"), F.lit(False).alias("taken")),
    )
    return moved.select("at", "id", "account", F.inline(both)).where(F.col("customer_id").isNotNull())


def holder_lists(changes: DataFrame) -> DataFrame:
    """``customer_id`` and ``seen``: who holds the id from when on (at, id, holder), null for nobody.

    Of several accounts that hold an id the oldest counts. One row per id, whose changes are gone through in order.
    """
    steps = F.sort_array(F.collect_list(F.struct("at", "id", "account", "taken")))
    account = changes.schema["account"].dataType.simpleString()
    start = F.struct(
        F.array().cast(f"array<{account}>").alias("holding"),
        F.array().cast(f"array<struct<at:bigint,id:bigint,holder:{account}>>").alias("seen"),
    )

    def step(state: Column, change: Column) -> Column:
        own = F.array(change["account"])
        holding = F.when(change["taken"], F.array_union(state["holding"], own)).otherwise(F.array_except(state["holding"], own))
        return bind(
            holding,
            lambda now: F.struct(
                now.alias("holding"),
                F.array_append(
                    state["seen"],
                    F.struct(change["at"].alias("at"), change["id"].alias("id"), F.array_min(now).alias("holder")),
                ).alias("seen"),
            ),
        )

    listed = changes.groupBy("customer_id").agg(steps.alias("steps"))
    return listed.select("customer_id", F.aggregate("steps", start, step, lambda state: state["seen"]).alias("seen"))


def holder_rows(changes: DataFrame) -> DataFrame:
    """The same as rows ``customer_id, at, id, turn, held`` (``held.account`` null for nobody), however many changes an id has.

    Turns are counted per day, the spans of the accounts run from turn to turn and lie over each other, and the least
    account is looked up at each turn.
    """
    rows = changes.withColumn("one", F.lit(1).cast("long"))
    order = ["at", "id", "account"]
    turns = stored(running_total(rows, ["customer_id"], order, "one", floor_div(F.col("at"), DAY), into="turn"))
    # A span ends at the next turn of the account, which is the one before it in falling order.
    falling = turns.select("customer_id", "account", "taken", "turn", (-F.col("turn")).alias("back"))
    ends = with_previous(falling, ["customer_id", "account"], ["back"], ["turn"], floor_div(F.col("back"), 4096), prefix="next_")
    spans = ends.where("taken").select(
        "customer_id", "account", F.col("turn").alias("low"), F.coalesce("next_turn", F.lit(NEVER).cast("long")).alias("high")
    )
    points = turns.select("customer_id", "at", "id", "turn")
    least = with_least_cover(points, spans, ["customer_id"], "turn", "account", into="least")
    return least.select("customer_id", "at", "id", "turn", F.struct(F.col("least").alias("account")).alias("held"))


def with_holder(events: DataFrame, users: DataFrame, checkouts: DataFrame) -> DataFrame:
    """Events with the ``account`` that holds their customer id at that instant; events of ids that nobody holds drop out.

    An as-of join of one row per event. The few changes of an ordinary id travel as a list, in which the event finds the last
    one before it. Ids of more than ``FOLDED`` changes do not: their events and holders go through one frame per id, cut
    into days, and the last holder is carried in.
    """
    changes = stored(holder_changes(users, checkouts))
    timed = events.where(F.col("customer_id").isNotNull())
    crowded = changes.groupBy("customer_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > FOLDED).select("customer_id")
    if crowded.isEmpty():
        return _by_list(timed, changes)
    crowded = stored(crowded)
    usual = _by_list(timed.join(crowded, "customer_id", "left_anti"), changes.join(crowded, "customer_id", "left_anti"))
    return usual.unionByName(
        _by_frame(timed.join(crowded, "customer_id", "left_semi"), changes.join(crowded, "customer_id", "left_semi"))
    )


def _by_list(events: DataFrame, changes: DataFrame) -> DataFrame:
    now = F.struct(micros("arrived_at").alias("at"), F.col("event_id").cast("long").alias("id"))
    joined = events.join(holder_lists(changes), "customer_id").withColumn("_now", now)
    before = F.filter("seen", lambda s: F.struct(s["at"].alias("at"), s["id"].alias("id")) < F.col("_now"))
    found = joined.withColumn("account", F.try_element_at(before, F.lit(-1))["holder"])
    return found.where(F.col("account").isNotNull()).select(*events.columns, "account")


def _by_frame(events: DataFrame, changes: DataFrame) -> DataFrame:
    timed = events.select(
        "customer_id",
        micros("arrived_at").alias("at"),
        F.col("event_id").cast("long").alias("id"),
        F.lit(0).cast("long").alias("turn"),
        F.struct(*events.columns).alias("event"),
    )
    frame = timed.unionByName(holder_rows(changes), allowMissingColumns=True)
    placed = carry_forward(
        frame, ["customer_id"], ["at", "id", "turn"], "held", floor_div(F.col("at"), DAY), into="holder"
    )
    acting = placed.where(F.col("event").isNotNull() & F.col("holder")["account"].isNotNull())
    return acting.select("event.*", F.col("holder")["account"].alias("account"))


def acting_events(users: DataFrame, events: DataFrame, plans: Plans) -> tuple[DataFrame, DataFrame]:
    """Users with their ``account``, and the events that change accounts, each with its ``effect`` and ``account``."""
    acting = with_event_effect(events, plans).where(F.col("effect").isin("grant", "revoke", "touch"))
    nothing = F.lit(None).cast("string")
    email = F.col("email") if "email" in users.columns else nothing
    if "client_reference_id" not in events.columns:
        acting = acting.withColumn("client_reference_id", F.col("user_id"))
    if "customer_email" not in events.columns:
        acting = acting.withColumn("customer_email", nothing)
    elif "email" not in users.columns:
        raise ValueError("accounts need an e-mail column to be found by the e-mail of a checkout")
    named = users.withColumn("account", _account(F.col("user_id"), email))
    acting = acting.select(
        "event_id", "arrived_at", "customer_id", "client_reference_id", "customer_email", "effect", "known_price", "is_checkout"
    )
    bought = checkout_accounts(acting.where("is_checkout"), users)
    others = acting.where("not is_checkout")
    return named, bought.unionByName(with_holder(others, named, bought).select(*bought.columns))


def account_states(users: DataFrame, events: DataFrame, plans: Plans) -> DataFrame:
    """Accounts after all events, in arrival order (T5), those that checkouts create included.

    A checkout acts on the user of its ``client_reference_id`` (or ``user_id``, where events have no such column), else on
    the account of its ``customer_email``, which it creates if there is none; created accounts have an e-mail and no
    ``user_id``, and a later run finds them by it. Every other event acts on the account that holds its customer id at that instant.
    Every field is the last write to it, so one map-side combined aggregate replaces the ordered replay and an account
    with very many events stays cheap.
    """
    named, acting = acting_events(users, events, plans)
    effect, price = F.col("effect"), F.col("known_price")
    grants = effect == "grant"
    changes = grants | (effect == "revoke")
    writes_price = changes | price.isNotNull()
    new_price = F.struct(F.when(effect != "revoke", price).alias("value"))
    names = F.when(F.col("is_checkout") & F.col("customer_id").isNotNull(), F.lit(True))
    folded = acting.groupBy("account").agg(
        _latest(F.struct(grants.alias("value")), changes).alias("_access"),
        _latest(new_price, writes_price).alias("_price"),
        _latest(F.col("customer_id"), names).alias("_customer"),
        F.bool_or(grants).alias("_granted"),
    )
    joined = named.withColumn("_known", F.lit(True)).join(folded, "account", "full")
    swap = {
        "has_access": F.when(F.col("_access").isNotNull(), F.col("_access.value")).otherwise(F.col("has_access")),
        "price_id": F.when(F.col("_price").isNotNull(), F.col("_price.value")).otherwise(F.col("price_id")),
        "customer_id": F.coalesce("_customer", "customer_id"),
        "trial_status": F.when(F.col("_known").isNull(), F.lit("not_started"))
        .when(F.col("_granted") & (F.col("trial_status") == "active"), F.lit("converted"))
        .otherwise(F.col("trial_status")),
    }
    if "email" in users.columns:
        swap["email"] = F.when(F.col("_known").isNull(), F.col("account")["email"]).otherwise(F.col("email"))
    return joined.select(*[swap.get(c, F.col(c)).alias(c) for c in users.columns])


def new_users(resolved: DataFrame, plans: Plans) -> DataFrame:
    """Accounts that checkouts create (J11): one per e-mail that matched nobody, with the access that was paid for.

    ``resolved`` is the first result of ``checkout_users`` with ``checkout_id``, ``price_id`` and ``customer_id``.
    A checkout of an unknown price fails before it looks for an account, so it creates none. Later checkouts win.
    """
    fresh = with_price_tier(resolved.where("matched_by = 'new'"), plans, tier="_tier").where(F.col("_tier").isNotNull())
    named = F.when(F.col("customer_id").isNotNull(), F.col("checkout_id"))
    return fresh.groupBy(F.col("normalized_email").alias("email")).agg(
        F.min("checkout_id").alias("first_checkout_id"),
        F.max_by("price_id", "checkout_id").alias("price_id"),
        F.max_by("customer_id", named).alias("customer_id"),
        F.lit(True).alias("has_access"),
        F.count(F.lit(1)).alias("checkouts"),
        F.lit("not_started").alias("trial_status"),
    )


def checkout_users(checkouts: DataFrame, users: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Whom a checkout belongs to (J11): by id, else by e-mail, else a new user.

    Returns the checkouts with ``user_id`` and ``matched_by`` (id, email, new, none) and the
    frame of e-mails to create users for.
    """
    email = blank_to_null(F.lower(strip_ends(F.col("customer_email"))))
    by_id = users.where(F.col("user_id").isNotNull()).select(
        F.col("user_id").alias("client_reference_id"), F.col("user_id").alias("_by_id")
    )
    by_email = users.where(F.col("email").isNotNull()).groupBy(F.col("email").alias("_email")).agg(
        F.min("user_id").alias("_by_email")
    )
    joined = (
        checkouts.withColumn("_email", email)
        .join(by_id, "client_reference_id", "left")
        .join(by_email, "_email", "left")
    )
    matched = first_true(
        [
            (F.col("_by_id").isNotNull(), "id"),
            (F.col("_by_email").isNotNull(), "email"),
            (F.col("_email").isNotNull(), "new"),
        ],
        "none",
    )
    resolved = joined.withColumn("matched_by", matched).withColumn(
        "user_id", F.coalesce("_by_id", "_by_email")
    )
    fresh = resolved.where("matched_by = 'new'").groupBy(F.col("_email").alias("email")).agg(
        F.count(F.lit(1)).alias("checkouts")
    )
    return resolved.drop("_by_id", "_by_email").withColumnRenamed("_email", "normalized_email"), fresh
