"""URL filter by rules and by trust that spreads over the link graph of hosts.

Rules name a host (with its subdomains) and the start of a path; the longest that fits decides. Urls without a rule get
the verdict of their host: trust spreads by personalised PageRank from hosts with allowed pages along the links,
distrust from hosts with blocked pages against the links (who links to bad hosts is suspect). A host is blocked when its
distrust reaches ``floor`` and is more than ``ratio`` times its trust.

The seed of a host is the share of its pages that a rule allows, or blocks, so large and small hosts count alike. Links
are counted per pair of hosts with map-side combine; one iteration is one join of host scores to host pairs and one sum
per host, for trust and distrust together. Nothing is collected.

Edge cases: a null url or one without ``://`` has an empty host and path, no rule and no links, and is allowed. Relative
links and links within a host are no edges; a host without links keeps its seed alone. Repeated pages count as often as
they are there. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarifflens.llm.common import stored

DAMPING = 0.85
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Absolute links in a page: href and src attributes with a scheme or two slashes.
LINK = r"""(?i)\b(?:href|src)\s*=\s*["']?\s*((?:[a-z][a-z0-9+.-]*:)?//[^"'\s<>]+)"""

Rule = tuple[str, str, str]  # verdict, host, path


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host and path of a url; both empty where there is none."""
    start = F.instr(url, "://")
    rest = F.when(start > 0, F.substr(url, start + 3)).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The longest rule that fits, as struct(rule, verdict), or null."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, of, start in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):
        fits = ((host == of) | host.endswith("." + of)) & path.startswith(start)
        found = F.when(fits, F.struct(F.lit(of + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def judged_by_rules(pages: DataFrame, rules: list[Rule]) -> DataFrame:
    """The pages with ``host``, ``path``, ``rule`` and ``ruled`` (the rule's verdict, or null)."""
    host, path = host_and_path(F.col("url"))
    return (
        pages.withColumns({"host": host, "path": path})
        .withColumn("__rule", rule_of(F.col("host"), F.col("path"), rules))
        .withColumns({"rule": F.col("__rule.rule"), "ruled": F.col("__rule.verdict")})
        .drop("__rule")
    )


def host_links(pages: DataFrame) -> DataFrame:
    """source, target, links: links between different hosts."""
    source, _ = host_and_path(F.col("url"))
    links = pages.select(
        source.alias("source"), F.explode(F.regexp_extract_all(F.col("html"), F.lit(LINK), F.lit(1))).alias("link")
    )
    # A link may leave out the scheme.
    target, _ = host_and_path(F.regexp_replace("link", "^//", "://"))
    return (
        links.select("source", target.alias("target"))
        .where((F.col("source") != "") & (F.col("target") != "") & (F.col("source") != F.col("target")))
        .groupBy("source", "target")
        .agg(F.count(F.lit(1)).alias("links"))
    )


def seeds(ruled: DataFrame) -> DataFrame:
    """host, trust, distrust: the share of a host's pages that rules allow and block."""
    share = [F.avg((F.coalesce(F.col("ruled"), F.lit("")) == v).cast("double")) for v in ("allow", "block")]
    return ruled.where("host <> ''").groupBy("host").agg(share[0].alias("trust"), share[1].alias("distrust"))


def spread(links: DataFrame, start: DataFrame, steps: int = 20, damping: float = DAMPING) -> DataFrame:
    """host, trust, distrust after ``steps`` rounds of personalised PageRank.

    ``links`` has source, target and links, ``start`` host, trust and distrust. Mass that reaches a host without
    further links stays there and is not dealt out again.
    """
    links = stored(links)
    along = links.select(F.lit("trust").alias("kind"), F.col("source").alias("from"), F.col("target").alias("to"), "links")
    against = links.select(
        F.lit("distrust").alias("kind"), F.col("target").alias("from"), F.col("source").alias("to"), "links"
    )
    both = along.unionByName(against)
    total = stored(both.groupBy("kind", "from").agg(F.sum("links").alias("total")))
    flows = stored(
        both.join(total, ["kind", "from"]).select("kind", "from", "to", (F.col("links") / F.col("total")).alias("share"))
    )
    kinds = F.explode(
        F.array(
            F.struct(F.lit("trust").alias("kind"), F.col("trust").alias("seed")),
            F.struct(F.lit("distrust").alias("kind"), F.col("distrust").alias("seed")),
        )
    ).alias("k")
    base = stored(
        start.select("host", kinds).select("k.kind", "host", ((1 - damping) * F.col("k.seed")).alias("rank"))
    )
    now = base
    if not flows.isEmpty():  # without any link, every round leaves the seeds as they are
        for step in range(steps):
            moved = flows.join(now.withColumnRenamed("host", "from"), ["kind", "from"]).select(
                "kind", F.col("to").alias("host"), (damping * F.col("rank") * F.col("share")).alias("rank")
            )
            now = base.unionByName(moved).groupBy("kind", "host").agg(F.sum("rank").alias("rank"))
            if step % 4 == 3:
                now = stored(now)
    score = [F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("rank"))), F.lit(0.0)) for k in ("trust", "distrust")]
    return now.groupBy("host").agg(score[0].alias("trust"), score[1].alias("distrust"))


def filter_urls(pages: DataFrame, rules: list[Rule], floor: float = 0.05, ratio: float = 2.0) -> DataFrame:
    """page_id, host, path, rule, verdict, trust and distrust of every page (the scores are those of the host)."""
    ruled = judged_by_rules(pages.select("page_id", "url"), rules).drop("url")
    scores = stored(spread(host_links(pages), seeds(ruled))).withColumnRenamed("host", "__host")
    blocked = (F.col("distrust") >= floor) & (F.col("distrust") > ratio * F.col("trust"))
    verdict = F.coalesce(F.col("ruled"), F.when(blocked, "block").otherwise("allow"))
    return ruled.join(scores, F.col("host") == F.col("__host"), "left").select(
        "page_id", "host", "path", "rule", verdict.alias("verdict"), "trust", "distrust"
    )
