"""Checks for the queries over page text."""

from __future__ import annotations

from oracle.common import (
    SPACE,
    confidence_case,
    error_case,
    facts,
    host_of,
    html_text,
    normal_url,
    q,
    squeeze,
    status_case,
    strip_ends,
    with_views,
)
from tarifflens import policies as P

_CAP = with_views("captures")
_FACTS = f"{_CAP}, {facts('v_captures', 'f')}"
_JUDGED = (
    f"{_FACTS}, judged AS MATERIALIZED (SELECT *, {status_case()} AS status, {error_case()} AS error, "
    f"{confidence_case()} AS evidence FROM f)"
)
_HEADINGS = " UNION ALL ".join(
    f"SELECT company_id, unnest(regexp_extract_all(html, {q(rf'<h{i}[^>]*>([' + chr(92) + 's' + chr(92) + rf'S]*?)</h{i}>')}, 1, 'i')) AS body FROM {{src}}"
    for i in range(1, 6)
)
_HEADING_ROWS = (
    f"SELECT company_id, heading FROM (SELECT company_id, {html_text('body')} AS heading FROM ({_HEADINGS}))"
    f" WHERE length(heading) BETWEEN 1 AND {P.PLAN_HEADING_MAX_CHARS} AND regexp_matches(heading, {q('|'.join(P.PLAN_HEADING_WORDS))}, 'i')"
)


def title(x: str) -> str:
    return f"nullif({strip_ends(f'regexp_extract({x}, ' + q(r'<title[^>]*>([\s\S]*?)</title>') + ', 1, ' + q('i') + ')')}, '')"


def description(x: str) -> str:
    pattern = r"""<meta[^>]+(?:name|property)=["']description["'][^>]+content=["']([^"']+)["'][^>]*>"""
    return f"nullif({strip_ends(f'regexp_extract({x}, {q(pattern)}, 1, ' + q('i') + ')')}, '')"


_ANCHOR = (
    r"<a\b[^>]*href" + SPACE + "*=" + SPACE + "*(?:\"([^\"]*)\"|'([^']*)'|("
    + SPACE.replace("[", "[^\"'<>`", 1) + r"+))[^>]*>([\s\S]*?)</a>"
)


def _group(i: int) -> str:
    return f"regexp_extract(w, {q(_ANCHOR)}, {i}, 'i')"


_ANCHORS = f"""{with_views('homepages')},
whole AS (SELECT page_id, homepage_url, unnest(regexp_extract_all(html, {q(_ANCHOR)}, 0, 'i')) AS w,
   unnest(range(len(regexp_extract_all(html, {q(_ANCHOR)}, 0, 'i')))) AS i FROM v_homepages),
raw_links AS (SELECT page_id, homepage_url, i, coalesce(nullif({_group(1)}, ''), nullif({_group(2)}, ''), {_group(3)}) AS href, {_group(4)} AS body FROM whole),
links AS MATERIALIZED (SELECT page_id, homepage_url, row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS position,
   {strip_ends('href')} AS href, {html_text('body')} AS anchor_text FROM raw_links WHERE href <> '')"""
_IGNORED = "regexp_matches(lower(href), '^(#|mailto:|tel:|javascript:|$)')"
_RESOLVED = f"""{_ANCHORS},
based AS (SELECT *, {normal_url('homepage_url')} AS base FROM links WHERE NOT {_IGNORED}),
absolute AS (SELECT *, CASE WHEN regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN href
   WHEN starts_with(href, '//') THEN split_part(base, ':', 1) || ':' || href
   WHEN starts_with(href, '/') THEN regexp_extract(base, '^([a-z]+://[^/]*)', 1) || href
   WHEN starts_with(href, '?') THEN base || href
   ELSE regexp_extract(base, '^([a-z]+://[^/]*/(?:[^?#]*/)?)', 1) || href END AS target FROM based),
resolved AS MATERIALIZED (SELECT page_id, position, href, anchor_text, base, {normal_url('target')} AS url FROM absolute)"""


def _score(x: str, table) -> str:  # noqa: ANN001
    return "(0e0 + " + " + ".join(f"CASE WHEN regexp_matches({x}, {q(p)}) THEN {w}e0 ELSE 0e0 END" for p, w in table) + ")"


_CANDIDATES = f"""{_RESOLVED},
inside AS (SELECT page_id, url, lower(regexp_extract(url, '^[a-z]+://[^/]*(/.*)', 1)) AS path, lower(anchor_text) AS words FROM resolved
  WHERE url IS NOT NULL AND ({host_of('url')} = {host_of('base')} OR ends_with({host_of('url')}, '.' || {host_of('base')}))),
parts AS (SELECT page_id, url, path, {_score('path', P.PATH_PLUS)} AS pp, {_score('words', P.TEXT_PLUS)} AS tp,
   {_score('path', P.PATH_MINUS)} AS pm, {_score('words', P.TEXT_MINUS)} AS tm FROM inside),
scored AS (SELECT page_id, url, greatest(0e0, least(1e0,
   0.04e0 + pp + tp + (CASE WHEN pp > 0.5 AND tp > 0.2 THEN 0.12e0 ELSE 0e0 END)
   - (CASE WHEN path = '/' AND tp < 0.2 THEN 0.12e0 ELSE 0e0 END) - (pm + tm))) AS s FROM parts),
best AS (SELECT page_id, url, max(CASE WHEN s*8 = floor(s*8) THEN round(s, 2) ELSE CAST(printf('%.2f', s) AS DOUBLE) END) AS confidence FROM scored GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY confidence DESC, url) AS rank,
   lead(confidence) OVER (PARTITION BY page_id ORDER BY confidence DESC, url) AS runner_up FROM best WHERE confidence >= {P.DISCOVERY_MIN_CONFIDENCE}),
top AS (SELECT * FROM ranked WHERE rank <= {P.DISCOVERY_MAX_CANDIDATES})"""

_HOST_PART = "regexp_extract(lower(d), '^(?:[a-z][a-z0-9+.-]*://)?([^/:?#]*)', 1)"

PAGE_SQL = {
    "page_text_hash": f"SELECT page_id, length(t) AS text_chars, sha256(lower(t)) AS content_hash FROM (SELECT page_id, {html_text('html')} AS t FROM pages)",
    "page_meta": f"SELECT page_id, {title('html')} AS title, {description('html')} AS description FROM pages",
    "price_mentions": f"{_FACTS} SELECT m.company_id, m.position, m.currency, m.period, m.amount FROM f_mentions m JOIN f USING (company_id) WHERE canonical_url IS NOT NULL AND http_status = 200 AND content_type LIKE 'text/html%'",
    "price_buckets": f"{_FACTS} SELECT {host_of('canonical_url')} AS host, currency, period, count(*) AS price_count, min(amount) AS min_amount, max(amount) AS max_amount FROM f_mentions JOIN f USING (company_id) WHERE canonical_url IS NOT NULL AND http_status = 200 AND content_type LIKE 'text/html%' GROUP BY 1, 2, 3",
    "page_signals": f"{_FACTS}, r AS (SELECT * FROM f WHERE canonical_url IS NOT NULL AND http_status = 200 AND content_type LIKE 'text/html%') SELECT company_id, 'blocked' AS kind, unnest(blocked_signals) AS phrase FROM r UNION ALL SELECT company_id, 'pricing', unnest(pricing_signals) FROM r UNION ALL SELECT company_id, 'custom', unnest(custom_hints) FROM r",
    "extraction_status": f"{_JUDGED} SELECT company_id, status, error, CASE WHEN status = 'ok' THEN evidence ELSE 0e0 END AS confidence, status = 'ok' AND evidence >= 0.75 AND n > 0 AS is_verified, CASE WHEN status = 'ok' THEN sha256(lowered) END AS content_hash FROM judged",
    "plan_headings": f"{_CAP} SELECT company_id, heading, count(*) AS occurrences FROM ({_HEADING_ROWS.replace('{src}', '(SELECT company_id, html FROM v_captures)')}) GROUP BY ALL",
    "canonical_prices": f"{_JUDGED} SELECT DISTINCT company_id, currency, period, amount FROM judged JOIN f_mentions USING (company_id) WHERE status = 'ok'",
    "canonical_texts": f"""{_JUDGED}, h AS ({_HEADING_ROWS.replace('{src}', "(SELECT * FROM judged WHERE status = 'ok')")}),
 plans AS (SELECT company_id, array_to_string(list_sort(list_distinct(list(lower({squeeze('heading')})))), '|') AS plan_names FROM h GROUP BY 1)
 SELECT j.company_id, canonical_url AS source_url, {squeeze(title('html'))} AS page_title, {squeeze(description('html'))} AS page_description,
  coalesce(plan_names, '') AS plan_names, array_to_string(list_sort(custom_hints), '|') AS custom_pricing_hints
 FROM judged j LEFT JOIN plans USING (company_id) WHERE status = 'ok'""",
    "normalized_urls": f"SELECT page_id, url, {normal_url('url')} AS canonical_url, {normal_url('url', True)} AS input_url, {host_of(normal_url('url'))} AS host FROM pages",
    "input_domains": f"""{with_views('intake')}, d AS (SELECT request_id, nullif({strip_ends('domain')}, '') AS d FROM v_intake),
 h AS (SELECT request_id, regexp_replace(CASE WHEN contains(d, ' ') THEN split_part(split_part(lower(d), '/', 1), ':', 1) ELSE {_HOST_PART} END, '^www\\.', '') AS lenient FROM d)
 SELECT request_id, lenient AS lenient_domain, CASE WHEN length(lenient) BETWEEN 1 AND 253 AND NOT starts_with(lenient, '-') AND regexp_matches(lenient, '^(?:[a-z0-9-]{{1,63}}\\.)+[a-z]{{2,63}}$') THEN lenient END AS strict_domain FROM h""",
    "anchors": f"{_ANCHORS} SELECT page_id, position, href, anchor_text, {_IGNORED} AS ignored FROM links",
    "resolved_links": f"{_RESOLVED} SELECT page_id, position, href, url FROM resolved",
    "url_candidates": f"{_CANDIDATES} SELECT page_id, rank, url, confidence FROM top",
    "recommended_primary": f"{_CANDIDATES} SELECT page_id, url AS recommended_primary_url, confidence FROM top WHERE rank = 1 AND confidence >= {P.PRIMARY_MIN_CONFIDENCE} AND (runner_up IS NULL OR confidence - runner_up >= {P.PRIMARY_MIN_GAP}::DOUBLE)",
    "merged_candidates": f"""{_CANDIDATES}, listed AS (SELECT page_id, url, confidence, FALSE AS sel FROM top
  UNION ALL SELECT page_id, {normal_url('url')}, 0.5e0, page_id % 2 = 0 FROM pages
  UNION ALL SELECT page_id, regexp_extract({normal_url('url')}, '^([a-z]+://[^/]*)', 1) || '/pricing', 0.31e0, TRUE FROM pages),
 merged AS (SELECT page_id, url, max(confidence) AS confidence, bool_or(sel) AS selected_by_user FROM listed GROUP BY 1, 2)
 SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY confidence DESC, url) AS rank, url, confidence, selected_by_user FROM merged""",
    "rediscovered": f"""{_CANDIDATES}, own AS (SELECT page_id AS company_id, {normal_url('url')} AS site, page_id % 11 <> 0 AND page_id % 7 <> 0 AS ran,
   CASE WHEN page_id % 3 = 0 THEN 'https://own.example.com/pricing' END AS given FROM pages),
 known AS (SELECT company_id, 1 AS place, site AS url, 0.5e0 AS confidence, company_id % 2 = 0 AS sel FROM own
  UNION ALL SELECT company_id, 2, regexp_extract(site, '^([a-z]+://[^/]*)', 1) || '/pricing', 0.31e0, TRUE FROM own),
 merged AS (SELECT company_id, url, max(confidence) AS confidence, bool_or(sel) AS selected_by_user
  FROM (SELECT company_id, url, confidence, sel FROM known UNION ALL SELECT page_id, url, confidence, FALSE FROM top) GROUP BY 1, 2),
 listed AS (SELECT company_id, row_number() OVER (PARTITION BY company_id ORDER BY confidence DESC, url) AS rank, url, confidence, selected_by_user FROM merged
   WHERE company_id IN (SELECT company_id FROM own WHERE ran)
  UNION ALL SELECT company_id, place, url, confidence, sel FROM known WHERE company_id IN (SELECT company_id FROM own WHERE NOT ran)),
 win AS (SELECT page_id, url FROM top WHERE rank = 1 AND confidence >= {P.PRIMARY_MIN_CONFIDENCE} AND (runner_up IS NULL OR confidence - runner_up >= {P.PRIMARY_MIN_GAP}::DOUBLE))
 SELECT l.company_id, coalesce(given, CASE WHEN ran THEN w.url END) AS primary_pricing_url, rank, l.url, confidence, selected_by_user
 FROM listed l JOIN own USING (company_id) LEFT JOIN win w ON w.page_id = l.company_id""",
}
