"""Price mentions and pricing payloads."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tarifflens import policies as P
from tarifflens.functions.columns import bind, blank_to_null, first_true, lookup
from tarifflens.functions.numbers import fixed2
from tarifflens.functions.text import NOT_WORD_BEFORE, SPACE, squeeze, unique_lower

# Fixed value: what counts as a price on a page.  Groups: code, symbol, amount, period word.
_PERIOD_ALTERNATIVES = (
    "day|daily|d|week|weekly|wk|w|month|monthly|mo|m|year|yearly|annual|annually|yr|y|once|one-time|onetime"
)
# The look-ahead changes no match; it rejects most characters of a text at once, also blanks that no digit follows.
PRICE_PATTERN = (
    f"(?=[0-9$€£¥]|{SPACE}+[0-9]|[UEGCAJuegcaj][SUBAPsubap][DRPYdrpy])"
    f"(?i)(?:{NOT_WORD_BEFORE}({'|'.join(P.CURRENCY_CODES)}){SPACE}*)?([€£$¥])?{SPACE}*"
    f"(\\d{{1,4}}(?:,\\d{{3}})*(?:\\.\\d{{1,2}})?)"
    f"(?:{SPACE}*(?:/|per){SPACE}*({_PERIOD_ALTERNATIVES}))?"
)

PRICE_TYPE = "array<struct<currency:string,period:string,amount:double>>"


def currency_of(token: Column) -> Column:
    """Symbol or code to currency code."""
    upper = F.upper(squeeze(token))
    return F.coalesce(lookup(P.CURRENCY_SYMBOLS, upper), upper)


def period_of(word: Column) -> Column:
    """Period word to period (X11)."""
    return F.coalesce(lookup(P.PERIOD_WORDS, F.lower(word)), F.lit("unknown"))


def _mention(token: Column) -> Column:
    group = lambda i: F.regexp_extract(token, PRICE_PATTERN, i)
    currency = F.coalesce(
        F.upper(blank_to_null(group(1))), currency_of(blank_to_null(group(2))), F.lit("USD")
    )
    return F.struct(
        currency.alias("currency"),
        period_of(group(4)).alias("period"),
        F.replace(group(3), F.lit(","), F.lit("")).cast("double").alias("amount"),
    )


def price_mentions(text: Column) -> Column:
    """All price mentions in reading order, duplicates kept.

    The long text is scanned once for whole matches; the groups are then read from the
    short matches, which match themselves again in the same way.
    """
    tokens = F.regexp_extract_all(text, F.lit(PRICE_PATTERN), F.lit(0))
    return F.filter(F.transform(tokens, _mention), lambda m: m["amount"] > 0)


def confidence(mentions: Column, pricing_signals: Column, custom_hints: Column) -> Column:
    """How sure we are that this is a pricing page."""
    return first_true(
        [
            (F.size(mentions) >= 3, P.CONFIDENCE_MANY_PRICES),
            ((F.size(mentions) >= 1) & (F.size(pricing_signals) > 0), P.CONFIDENCE_PRICE_AND_SIGNAL),
            (F.size(mentions) >= 1, P.CONFIDENCE_PRICE_ONLY),
            (F.size(custom_hints) > 0, P.CONFIDENCE_CUSTOM_HINT),
            (F.size(pricing_signals) > 0, P.CONFIDENCE_SIGNAL_ONLY),
        ],
        0.0,
    )


def unique_prices(mentions: Column) -> Column:
    """Distinct prices at two decimals, sorted by currency, period, amount.

    Distinct looks at the currency as written; upper-casing comes after, so ``usd`` and
    ``USD`` stay two entries.
    """
    as_written = F.array_distinct(
        F.transform(
            mentions,
            lambda m: F.struct(
                m["currency"].alias("currency"), m["period"].alias("period"), fixed2(m["amount"]).alias("amount")
            ),
        )
    )
    upper = F.transform(
        as_written,
        lambda m: F.struct(
            F.upper(m["currency"]).alias("currency"), m["period"].alias("period"), m["amount"].alias("amount")
        ),
    )
    return F.array_sort(upper)


def canonical_payload(
    source_url: Column,
    page_title: Column,
    page_description: Column,
    plan_names: Column,
    mentions: Column,
    custom_hints: Column,
) -> Column:
    """The stored form of what a pricing page says."""
    return F.struct(
        source_url.alias("source_url"),
        squeeze(blank_to_null(page_title)).alias("page_title"),
        squeeze(blank_to_null(page_description)).alias("page_description"),
        unique_lower(plan_names).alias("plan_names"),
        unique_prices(mentions).alias("price_mentions"),
        unique_lower(custom_hints).alias("custom_pricing_hints"),
    )


# --- stored JSON payloads --------------------------------------------------------------


def _is_string(v: Column) -> Column:
    return F.schema_of_variant(v) == "STRING"


def _text(v: Column, path: str) -> Column:
    """A member when it really is a JSON string, else NULL."""
    member = F.try_variant_get(v, path, "variant")
    return F.when(_is_string(member), F.try_variant_get(v, path, "string"))


def _items(v: Column, path: str) -> Column:
    return F.coalesce(F.try_variant_get(v, path, "array<variant>"), F.array().cast("array<variant>"))


def _strings(v: Column, path: str) -> Column:
    return F.transform(F.filter(_items(v, path), _is_string), lambda s: F.try_variant_get(s, "$", "string"))


def _is_number(v: Column) -> Column:
    return F.schema_of_variant(v).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$")


def _as_number(v: Column) -> Column:
    """Loose number reading: numbers, numeric text, booleans; anything else is NULL."""
    numeric_text = "^[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?$"
    from_text = bind(
        squeeze(F.try_variant_get(v, "$", "string")),
        lambda t: F.when(t.rlike(numeric_text), t.try_cast("double")),
    )
    return (
        F.when(_is_number(v), F.try_variant_get(v, "$", "double"))
        .when(F.schema_of_variant(v) == "BOOLEAN", F.try_variant_get(v, "$", "boolean").cast("double"))
        .when(_is_string(v), from_text)
    )


def lenient_payload(json: Column) -> Column:
    """Payload from stored JSON, forgiving about types.

    NULL without a source URL; text members that are not text are dropped; amounts are read
    loosely and must be above zero; the period must be a known one.
    """
    def read(v: Column) -> Column:
        points = F.transform(
            _items(v, "$.priceMentions"),
            lambda p: F.struct(
                _text(p, "$.currency").alias("currency"),
                _text(p, "$.period").alias("period"),
                _as_number(F.try_variant_get(p, "$.amount", "variant")).alias("amount"),
            ),
        )
        kept = F.filter(
            points,
            lambda m: (m["amount"] > 0)
            & (m["amount"] < float("inf"))
            & (m["currency"] != "")
            & m["period"].isin(*P.PERIODS),
        )
        source = _text(v, "$.sourceUrl")
        payload = canonical_payload(
            source,
            _text(v, "$.pageTitle"),
            _text(v, "$.pageDescription"),
            _strings(v, "$.planNames"),
            kept,
            _strings(v, "$.customPricingHints"),
        )
        return F.when(source != "", payload)

    return bind(F.try_parse_json(json), read)


def strict_price_points(json: Column) -> Column:
    """Price points as the comparison view reads them (X21): real numbers of any sign,
    trimmed upper-case currency, any non-empty lower-case period."""
    def read(v: Column) -> Column:
        points = F.transform(
            _items(v, "$.priceMentions"),
            lambda p: F.struct(
                F.upper(squeeze(_text(p, "$.currency"))).alias("currency"),
                F.lower(squeeze(_text(p, "$.period"))).alias("period"),
                F.when(
                    _is_number(F.try_variant_get(p, "$.amount", "variant")),
                    F.try_variant_get(p, "$.amount", "double"),
                ).alias("amount"),
            ),
        )
        return F.filter(points, lambda m: m["amount"].isNotNull() & (m["currency"] != "") & (m["period"] != ""))

    return bind(F.try_parse_json(json), read)


def payload_json(payload: Column) -> Column:
    """Stored JSON of a payload struct, in the wire names."""
    return F.to_json(
        F.struct(
            payload["source_url"].alias("sourceUrl"),
            payload["page_title"].alias("pageTitle"),
            payload["page_description"].alias("pageDescription"),
            payload["plan_names"].alias("planNames"),
            payload["price_mentions"].alias("priceMentions"),
            payload["custom_pricing_hints"].alias("customPricingHints"),
        )
    )
