"""SQL fragments shared by the checks (DuckDB, RE2 patterns)."""

from __future__ import annotations

from tarifflens import policies as P
from tarifflens.sources.fixtures import NOW, duckdb_view

SPACE = r"[\t\n\x0B\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
NOW_SQL = f"TIMESTAMP '{NOW}'"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def with_views(*names: str) -> str:
    return "WITH " + ", ".join(f"v_{n} AS ({duckdb_view(n)})" for n in names)


def stamp(ts: str) -> str:
    return f"strftime({ts}, '%Y-%m-%d %H:%M:%S')"


def squeeze(x: str) -> str:
    return f"trim(regexp_replace({x}, {q(SPACE + '+')}, ' ', 'g'), ' ')"


def strip_ends(x: str) -> str:
    return f"regexp_replace({x}, {q('^' + SPACE + '+|' + SPACE + '+$')}, '', 'g')"


def html_text(x: str) -> str:
    out = x
    for tag in ("script", "style", "noscript"):
        out = f"regexp_replace({out}, {q(f'<{tag}[^>]*>[' + chr(92) + 's' + chr(92) + f'S]*?</{tag}>')}, ' ', 'gi')"
    out = f"regexp_replace({out}, {q(r'<!--[\s\S]*?-->')}, ' ', 'g')"
    out = f"regexp_replace({out}, '<[^>]+>', ' ', 'g')"
    for entity, char in (("&nbsp;", " "), ("&amp;", "&"), ("&quot;", '"'), ("&#39;", "'")):
        out = f"regexp_replace({out}, {q(entity)}, {q(char)}, 'gi')"
    return squeeze(out)


def fixed2(x: str) -> str:
    return f"CASE WHEN ({x})*8 = floor(({x})*8) THEN round({x}, 2) ELSE CAST(printf('%.2f', {x}) AS DOUBLE) END"


def in_list(values) -> str:  # noqa: ANN001
    return "(" + ", ".join(q(v) for v in values) + ")"


def phrase_list(lowered: str, phrases) -> str:  # noqa: ANN001
    items = ", ".join(f"CASE WHEN contains({lowered}, {q(p)}) THEN {q(p)} END" for p in phrases)
    return f"list_filter([{items}], lambda z: z IS NOT NULL)"


PERIOD_CASE = "CASE lower({x}) " + " ".join(f"WHEN {q(w)} THEN {q(p)}" for w, p in P.PERIOD_WORDS.items()) + " ELSE 'unknown' END"
SYMBOL_CASE = "CASE {x} " + " ".join(f"WHEN {q(s)} THEN {q(c)}" for s, c in P.CURRENCY_SYMBOLS.items()) + " ELSE 'USD' END"
PRICE = (
    r"(?:\b(USD|EUR|GBP|CAD|AUD|JPY)" + SPACE + r"*)?([€£$¥])?" + SPACE + r"*(\d{1,4}(?:,\d{3})*(?:\.\d{1,2})?)"
    r"(?:" + SPACE + r"*(?:/|per)" + SPACE + r"*(day|daily|d|week|weekly|wk|w|month|monthly|mo|m|year|yearly|annual|annually|yr|y|once|one-time|onetime))?"
)


def host_of(url: str) -> str:
    return f"regexp_extract({url}, '^[a-z]+://(?:[^/]*@)?([^/:]*)', 1)"


# --- page_facts: one row per capture, text read once ---------------------------------------


def facts(view: str, name: str) -> str:
    """CTEs ``{name}_text`` and ``{name}`` over a capture view, as in ``extract_pricing``."""
    return f"""
{name}_text AS MATERIALIZED (
  SELECT *, {normal_url('source_url')} AS canonical_url, {html_text('html')} AS page_text FROM {view}),
{name}_found AS MATERIALIZED (
  SELECT *, lower(page_text) AS lowered,
    regexp_extract_all(page_text, {q(PRICE)}, 0, 'i') AS tokens
  FROM {name}_text),
{name}_m AS (
  SELECT company_id, position, {PERIOD_CASE.format(x='p')} AS period,
    CASE WHEN c <> '' THEN upper(c) ELSE {SYMBOL_CASE.format(x='s')} END AS currency,
    CAST(replace(a, ',', '') AS DOUBLE) AS amount
  FROM (SELECT company_id, u.i AS position, regexp_extract(u.t, {q(PRICE)}, 1, 'i') AS c,
      regexp_extract(u.t, {q(PRICE)}, 2, 'i') AS s, regexp_extract(u.t, {q(PRICE)}, 3, 'i') AS a,
      regexp_extract(u.t, {q(PRICE)}, 4, 'i') AS p
    FROM {name}_found, LATERAL (SELECT unnest(tokens) AS t, unnest(range(len(tokens))) AS i) u)),
{name}_mentions AS MATERIALIZED (
  SELECT company_id, row_number() OVER (PARTITION BY company_id ORDER BY position) - 1 AS position, currency, period, amount
  FROM {name}_m WHERE amount > 0),
{name} AS MATERIALIZED (
  SELECT f.*, coalesce(n.n, 0) AS n,
    {phrase_list('lowered', P.BLOCKED_SIGNALS)} AS blocked_signals,
    {phrase_list('lowered', P.PRICING_SIGNALS)} AS pricing_signals,
    {phrase_list('lowered', P.CUSTOM_PRICING_SIGNALS)} AS custom_hints
  FROM {name}_found f LEFT JOIN (SELECT company_id, count(*) AS n FROM {name}_mentions GROUP BY 1) n USING (company_id))"""


_NOTHING = "n = 0 AND len(pricing_signals) = 0 AND len(custom_hints) = 0"


def status_case() -> str:
    return f"""CASE WHEN canonical_url IS NULL THEN 'manual_needed'
 WHEN http_status IN {tuple(P.BLOCKED_HTTP_STATUSES)} THEN 'blocked'
 WHEN http_status BETWEEN 400 AND 499 THEN 'manual_needed'
 WHEN http_status NOT BETWEEN 200 AND 299 THEN 'error'
 WHEN NOT contains(lower(content_type), 'text/html') THEN 'manual_needed'
 WHEN len(blocked_signals) > 0 THEN 'blocked'
 WHEN {_NOTHING} THEN 'manual_needed' ELSE 'ok' END"""


def error_case() -> str:
    return f"""CASE WHEN canonical_url IS NULL THEN {q(P.TEXT_INVALID_URL)}
 WHEN http_status NOT BETWEEN 200 AND 299 THEN 'HTTP ' || http_status
 WHEN NOT contains(lower(content_type), 'text/html') THEN {q(P.TEXT_NOT_HTML)}
 WHEN len(blocked_signals) > 0 THEN {q(P.TEXT_BOT_PREFIX)} || array_to_string(blocked_signals, ', ')
 WHEN {_NOTHING} THEN {q(P.TEXT_NO_SIGNALS)} END"""


def confidence_case() -> str:
    return """CASE WHEN n >= 3 THEN 0.9e0 WHEN n >= 1 AND len(pricing_signals) > 0 THEN 0.78e0 WHEN n >= 1 THEN 0.72e0
 WHEN len(custom_hints) > 0 THEN 0.45e0 WHEN len(pricing_signals) > 0 THEN 0.4e0 ELSE 0e0 END"""


# --- addresses ------------------------------------------------------------------------------

_PATH_KEEPS = "/!$&'()*+,;:=@[]|\\^"


def encode(x: str, keeps: str = _PATH_KEEPS) -> str:
    out = f"url_encode({x})"
    for char in keeps:
        out = f"replace({out}, '%{ord(char):02X}', {q(char)})"
    return f"replace({out}, '%25', '%')"


def normal_url(x: str, keep_query: bool = False) -> str:
    """http(s) addresses of plain hosts without dot segments, which is what the tables hold."""
    raw = f"nullif({strip_ends(x)}, '')" if keep_query else x
    full = f"CASE WHEN contains({raw}, '://') THEN {raw} ELSE 'https://' || {raw} END"
    shape = q(r"^(?i:https?)://[^/?#\s]+([/?#]|$)")
    host = f"regexp_replace(lower(regexp_extract({full}, '^[a-zA-Z]+://([^/?#]*)', 1)), '^www\\.', '')"
    path = f"regexp_extract({full}, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1)"
    query = f"regexp_extract({full}, '^[^?#]*(\\?[^#]+)', 1)" if keep_query else "''"
    return (
        f"CASE WHEN regexp_matches({full}, {shape}) THEN lower(regexp_extract({full}, '^([a-zA-Z]+)://', 1)) || '://' || {host} || "
        f"regexp_replace(CASE WHEN {path} = '' THEN '/' ELSE {encode(path)} END, '/+', '/', 'g') || {query} END"
    )
