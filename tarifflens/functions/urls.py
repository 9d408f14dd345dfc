"""Web addresses as JVM expressions.

The rules are those of a browser address parser for http and https.  Left out, and
answered with NULL: percent escapes in host names and IPv4 hosts that are not a dotted quad.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tarifflens.functions.columns import bind, blank_to_null
from tarifflens.functions.text import strip_ends

_MARK = "\u0001"
_ADDRESS = r"(?s)^([A-Za-z][A-Za-z0-9+.\-]*):[/\\]*([^/\\?#]*)([^?#]*)(\?[^#]*)?(#.*)?$"
_FORBIDDEN_HOST = r"[\x00-\x20#%/:<>?@\[\\\]^|\x7f]"
_DOT = r"(?i)(?:\.|%2e)"
# Reserved characters that stay as they are in a path / in a query.
_PATH_KEEPS = "/!$&'()+,;:=@[]|\\^~"
_QUERY_KEEPS = "/!$&()+,;:=@[]|\\^~?`{}"


_PLAIN = (
    r"(?s)^(https?://)(?:www\.)?((?!www\.)[a-z0-9-]++(?:\.[a-z0-9-]++)*+(?<=[a-z]))"
    r"((?:/[A-Za-z0-9_~-][A-Za-z0-9._~-]*+)*+/?)"
)
_PLAIN_HOST = r"^[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)*+(?<=[A-Za-z])$"


def _percent_encode(value: Column, keeps: str) -> Column:
    """Escape what an address may not contain; existing escapes stay."""
    out = F.replace(F.url_encode(value), F.lit("+"), F.lit("%20"))
    for char in keeps:
        out = F.replace(out, F.lit(f"%{ord(char):02X}"), F.lit(char))
    out = F.replace(out, F.lit("%25"), F.lit("%"))
    clean = r"^[A-Za-z0-9._*%" + "".join("\\" + c for c in keeps) + r"\-]*$"
    return F.when(value.rlike(clean), value).otherwise(out)


def _without_dot_segments(path: Column) -> Column:
    """Resolve ``.`` and ``..`` of an absolute path."""
    parts = F.split(path, "/")
    segments = F.slice(parts, F.lit(2), F.size(parts))
    single = lambda s: s.rlike(f"^{_DOT}$")
    double = lambda s: s.rlike(f"^{_DOT}{_DOT}$")

    def step(acc: Column, seg: Column) -> Column:
        return (
            F.when(double(seg), F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))))
            .when(single(seg), acc)
            .otherwise(F.array_append(acc, seg))
        )

    kept = F.aggregate(segments, F.array().cast("array<string>"), step)
    last = F.element_at(parts, -1)
    tail = F.when(single(last) | double(last), F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
    resolved = F.concat(F.lit("/"), F.array_join(F.concat(kept, tail), "/"))
    return F.when(path.rlike(r"(?i)/(?:\.|%2e)"), resolved).otherwise(path)


def _host(authority: Column) -> Column:
    name = F.lower(F.regexp_replace(F.regexp_replace(authority, "(?s)^.*@", ""), ":[0-9]*$", ""))
    ascii_name = F.when(
        name.rlike(r"[^\x00-\x7f]"), F.try_reflect(F.lit("java.net.IDN"), F.lit("toASCII"), name)
    ).otherwise(name)

    def checked(host: Column) -> Column:
        numeric_end = host.rlike(r"(?:^|\.)(?:\d+|0x[0-9a-f]*)\.?$")
        dotted_quad = host.rlike(r"^(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)$")
        return F.when(host.rlike(r"^\[[0-9a-f:.]+\]$"), host).when(
            (host != "") & ~host.rlike(_FORBIDDEN_HOST) & (~numeric_end | dotted_quad), host
        )

    return bind(ascii_name, checked)


def _parts(address: Column) -> Column:
    """``scheme, userinfo, host, port, path, query`` of an http(s) address, else NULL."""
    tidy = F.regexp_replace(F.regexp_replace(address, r"^[\x00-\x20]+|[\x00-\x20]+$", ""), r"[\t\n\r]", "")
    cut = F.split(F.regexp_replace(tidy, _ADDRESS, _MARK.join(["$1", "$2", "$3", "$4", "$5"])), _MARK)

    def build(p: Column) -> Column:
        scheme = F.lower(p[0])
        authority = p[1]
        port = F.regexp_extract(authority, ":([0-9]+)$", 1)
        number = port.try_cast("int")
        default = F.when(scheme == "https", F.lit(443)).otherwise(F.lit(80))
        raw_path = F.replace(p[2], F.lit("\\"), F.lit("/"))
        path = F.when(raw_path == "", F.lit("/")).otherwise(_without_dot_segments(raw_path))
        usable = (
            (F.size(p) == 5)
            & scheme.isin("http", "https")
            & ((port == "") | (number <= 65535))
        )
        return F.when(
            usable,
            F.struct(
                scheme.alias("scheme"),
                F.regexp_extract(authority, "(?s)^(.*)@", 1).alias("userinfo"),
                _host(authority).alias("host"),
                F.when((port == "") | (number == default), F.lit(""))
                .otherwise(F.concat(F.lit(":"), number.cast("string")))
                .alias("port"),
                _percent_encode(path, _PATH_KEEPS).alias("path"),
                F.when(F.length(p[3]) > 1, _percent_encode(p[3], _QUERY_KEEPS)).otherwise(F.lit("")).alias("query"),
            ),
        )

    return bind(cut, build)


def with_scheme(value: Column) -> Column:
    """``https://`` in front unless ``://`` occurs anywhere in the text."""
    return F.when(value.contains("://"), value).otherwise(F.concat(F.lit("https://"), value))


def bare_host(host: Column) -> Column:
    """Lower case without one leading ``www.``."""
    return F.regexp_replace(F.lower(host), r"^www\.", "")


def normalize_url(value: Column, keep_query: bool = False) -> Column:
    """Canonical address (U1), or with the query kept for user input (U2); NULL when unusable."""

    def render(p: Column) -> Column:
        stripped = bare_host(p["host"])
        host = F.when(stripped == "", p["host"]).otherwise(stripped)
        user = F.when(p["userinfo"] == "", F.lit("")).otherwise(F.concat(p["userinfo"], F.lit("@")))
        path = F.regexp_replace(p["path"], "/{2,}", "/")
        query = p["query"] if keep_query else F.lit("")
        return F.concat(p["scheme"], F.lit("://"), user, host, p["port"], path, query)

    raw = blank_to_null(strip_ends(value)) if keep_query else value
    # Most addresses are plain: lower-case host, tidy path.  They need no parsing.
    plain = _PLAIN + ("$" if keep_query else "(?:[?#].*)?$")
    shortcut = F.regexp_replace(F.regexp_replace(raw, plain, "$1$2$3"), "^(https?://[^/]*+)$", "$1/")
    return F.when(raw.rlike(plain), shortcut).otherwise(bind(_parts(with_scheme(raw)), render))


def host_of(normalized: Column) -> Column:
    """Host of an address already in canonical form."""
    return blank_to_null(F.regexp_extract(normalized, r"^[a-z]+://(?:[^/]*@)?(\[[^\]]*\]|[^/:]*)", 1))


def path_of(normalized: Column) -> Column:
    """Path of an address already in canonical form."""
    return F.regexp_extract(normalized, r"^[a-z]+://[^/]*(/[^?#]*)", 1)


def normalize_domain(value: Column) -> Column:
    """Host of address-like text, lenient (U4)."""

    def read(trimmed: Column) -> Column:
        parsed = bind(_parts(with_scheme(trimmed)), lambda p: p["host"])
        fallback = blank_to_null(F.split_part(F.split_part(trimmed, F.lit("/"), F.lit(1)), F.lit(":"), F.lit(1)))
        return F.when(trimmed.rlike(_PLAIN_HOST), trimmed).otherwise(F.coalesce(parsed, fallback))

    return bare_host(bind(blank_to_null(strip_ends(value)), read))


# Fixed value: what a registrable domain looks like.
DOMAIN_PATTERN = r"^(?=.{1,253}$)(?!-)(?:[a-z0-9-]{1,63}\.)+[a-z]{2,63}$"


def strict_domain(value: Column) -> Column:
    """Lenient domain that also has the form of a domain, else NULL."""
    return bind(normalize_domain(value), lambda d: F.when(d.rlike("(?i)" + DOMAIN_PATTERN), d))


def within_domain(host: Column, domain: Column) -> Column:
    """Same host or a subdomain."""
    return (host == domain) | host.endswith(F.concat(F.lit("."), domain))


def is_page_link(href: Column) -> Column:
    """Not empty, a fragment, mail, phone or script link (the negation of U7)."""
    return ~F.lower(strip_ends(href)).rlike("^(?:#|mailto:|tel:|javascript:|$)")


def resolve_href(href: Column, base: Column) -> Column:
    """Absolute address of a link on a page with canonical address ``base`` (U8)."""
    link = F.regexp_replace(F.regexp_replace(href, r"^[\x00-\x20]+|[\x00-\x20]+$", ""), r"[\t\n\r]", "")
    origin = F.regexp_extract(base, r"^([a-z]+://[^/]*)", 1)
    folder = F.regexp_extract(base, r"^([a-z]+://[^/]*/(?:[^?#]*/)?)", 1)
    return (
        F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), link)
        .when(link.rlike(r"^[/\\]{2}"), F.concat(F.split_part(base, F.lit(":"), F.lit(1)), F.lit(":"), link))
        .when(link.rlike(r"^[/\\]"), F.concat(origin, link))
        .when(link.rlike(r"^(?:[?#]|$)"), F.concat(F.split_part(base, F.lit("?"), F.lit(1)), link))
        .otherwise(F.concat(folder, link))
    )
