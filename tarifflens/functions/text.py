"""HTML and text columns.  Everything stays in JVM expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tarifflens import policies as P
from tarifflens.functions.columns import blank_to_null

# Fixed value: the white-space class of the page rules (wider than Java's \s).
SPACE = "[\\t\\n\\x0B\\f\\r \\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff]"
NOT_WORD_BEFORE = "(?<![A-Za-z0-9_])"
NOT_WORD_AFTER = "(?![A-Za-z0-9_])"
_EDGE = "(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"


def ascii_edges(pattern: str) -> str:
    r"""``\b`` of Java 17 follows Unicode letters; the page rules mean ASCII words."""
    return pattern.replace(r"\b", _EDGE)


def squeeze(value: Column) -> Column:
    """Collapse white space runs and trim.

    The look-ahead skips a single blank before a printable character, which needs no
    change; that is nearly every blank of a text.
    """
    return F.trim(F.regexp_replace(value, "(?! ?[!-~])" + SPACE + "+", " "))


def strip_ends(value: Column) -> Column:
    return F.regexp_replace(value, f"(?![!-~])(?:^{SPACE}+|{SPACE}+$)", "")


def without_element(html: Column, tag: str) -> Column:
    """Drop a tag together with its body."""
    return F.regexp_replace(html, f"(?i)<{tag}[^>]*>[\\s\\S]*?</{tag}>", " ")


def html_text(html: Column) -> Column:
    """Visible text of a page."""
    out = html
    for tag in ("script", "style", "noscript"):
        out = without_element(out, tag)
    out = F.regexp_replace(out, "<!--[\\s\\S]*?-->", " ")
    out = F.regexp_replace(out, "<[^>]+>", " ")
    # The decoded entities, in this order (so &amp;quot; decodes twice).
    for entity, char in (("&nbsp;", " "), ("&amp;", "&"), ("&quot;", '"'), ("&#39;", "'")):
        out = F.regexp_replace(out, "(?i)" + entity, char)
    return squeeze(out)


def content_hash(page_text: Column) -> Column:
    """SHA-256 of the lower-cased page text (X4, X5); the text is already squeezed."""
    return F.sha2(F.lower(page_text), 256)


def meta_description(html: Column) -> Column:
    """Description of the page (X6); attribute order name, content."""
    pattern = (
        "(?i)<meta[^>]+(?:name|property)=[\"']description[\"'][^>]+content=[\"']([^\"']+)[\"'][^>]*>"
    )
    return blank_to_null(strip_ends(F.regexp_extract(html, pattern, 1)))


def page_title(html: Column) -> Column:
    """Title of the page."""
    return blank_to_null(strip_ends(F.regexp_extract(html, "(?i)<title[^>]*>([\\s\\S]*?)</title>", 1)))


def plan_headings(html: Column) -> Column:
    """Headings that talk about plans (X8), in page order."""
    bodies = F.regexp_extract_all(html, F.lit("(?i)<(h[1-5])[^>]*>([\\s\\S]*?)</\\1>"), F.lit(2))
    words = "(?i)" + "|".join(P.PLAN_HEADING_WORDS)
    return F.filter(
        F.transform(bodies, html_text),
        lambda h: (F.length(h) > 0) & (F.length(h) <= P.PLAN_HEADING_MAX_CHARS) & h.rlike(words),
    )


def phrases_in(lowered: Column, phrases: tuple[str, ...]) -> Column:
    """Which fixed phrases occur, in list order."""
    hits = [F.when(lowered.contains(p), F.lit(p)) for p in phrases]
    return F.array_compact(F.array(*hits))


def unique_lower(items: Column) -> Column:
    """Squeezed, lower-cased, distinct, non-empty, sorted."""
    cleaned = F.transform(items, lambda s: F.lower(squeeze(s)))
    return F.array_sort(F.array_distinct(F.filter(cleaned, lambda s: s != "")))


def shorten(value: Column, limit: int) -> Column:
    """At most ``limit`` characters, the last three being dots."""
    return F.when(F.length(value) > limit, F.concat(F.substring(value, 1, limit - 3), F.lit("..."))).otherwise(value)


def utc_minute(ts: Column) -> Column:
    """``2001-08-01 00:00 UTC``."""
    return F.date_format(ts, "yyyy-MM-dd HH:mm' UTC'")


def iso_millis(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
