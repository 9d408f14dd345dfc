"""Merkle manifest of a dataset, with a proof for every row, by descent through a content-addressed graph.

A row's leaf is the SHA-256 of its fields. The leaves of a source, by ascending doc_id, are hashed in runs of ``RUN`` until one
digest is left, the subroot; the subroots, by source, are hashed likewise into the root. What is stored is content-addressed: a
record maps the digest of a run to its children, so equal runs are one record.

A request for a leaf is its rank, whose digits to the base ``RUN`` are the way down from the root. The requests descend together:
one frontier row stands for all that share the digits so far. A step looks its digest up among the records, goes on to each child
asked for, and keeps the others, as text to the left and to the right of the child, as a segment of the path. The last step
meets the leaves themselves; there the segments are reversed, so that they lead from the leaf to the root.

Scale: texts are read once and never shuffled, only digests are. Ranks come from one sort by range into as many parts as Spark shuffles
to, with one count per part and source added up, so a source with most of the rows spreads over many parts, and rows that are
equal in everything spread by a number of their own. Each level has a sixteenth of the rows of the one below. What reaches the
driver is the number of levels.

Edge cases: a null field is written ``-``, unlike the empty text ``0:``. Rows without a source form the first tree, rows without a
doc_id come first in theirs and are never tampered with. Rows that repeat a doc_id follow each other by digest; equal rows
are leaves of their own and have equal values. An empty table has no root and no rows. Other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarifflens.llm.common import prepare, written

RUN = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# monotonically_increasing_id has the number of the partition above these bits, the row's place in it below.
PLACE_BITS = 33


def field(value: Column) -> Column:
    """The field as it enters a leaf: ``-`` if null, else the number of its bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(**fields: Column) -> Column:
    """The leaf of a row."""
    return F.sha2(F.concat(*(field(fields[name]) for name in FIELDS)), 256)


def tampered_text(doc_id: Column, text: Column) -> Column:
    """The text as a tampering hand leaves it: A-Z lower-cased where 5 divides the CRC-32 of the doc_id."""
    hit = F.crc32(doc_id.cast("string")) % 5 == 0
    return F.when(F.coalesce(hit, F.lit(False)), F.translate(text, UPPER, LOWER)).otherwise(text)


def source_key(source: Column) -> Column:
    """A key that is never null and sorts as the sources do, null first."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit(""))


def ranked(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """The rows with ``rank`` (from 0) and ``total`` within their ``tree``, ordered by the columns ``order``."""
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # The number of a row spreads equal rows; it is settled before the sort samples its input.
    kept = written(rows.withColumn("number", F.monotonically_increasing_id()), f"{name}-rows")
    keys = ["tree", *order, "number"]
    laid = kept.repartitionByRange(tasks, *keys).sortWithinPartitions(*keys)
    laid = written(laid.drop("number").withColumn("at", F.monotonically_increasing_id()), f"{name}-sorted")
    laid = laid.withColumns(
        {"part": F.shiftright("at", PLACE_BITS), "place": F.col("at").bitwiseAND(F.lit(2**PLACE_BITS - 1))}
    ).drop("at")
    # At most one row per part and tree: a tree of any size has no more rows here than there are parts.
    runs = laid.groupBy("part", "tree").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("first"))
    whole_tree = Window.partitionBy("tree")
    before = F.sum("n").over(whole_tree.orderBy("part")) - F.col("n")
    runs = runs.select("part", "tree", (before - F.col("first")).alias("shift"), F.sum("n").over(whole_tree).alias("total"))
    return laid.join(runs, ["part", "tree"]).withColumn("rank", F.col("place") + F.col("shift")).drop("part", "place", "shift")


def hashed_up(nodes: DataFrame, name: str) -> tuple[list[DataFrame], DataFrame, int]:
    """Records of each level, the tops (tree, digest, height, total) and the largest height.

    ``nodes`` has tree, rank, total and digest. Trees of one node are their own top, of height 0.
    """
    largest = nodes.agg(F.max("total")).first()[0] or 0
    records, tops, height, width = [], [], 0, 1
    while True:
        tops.append(nodes.where(F.col("total") <= width).select("tree", "digest", F.lit(height).alias("height"), "total"))
        if largest <= width:
            break
        ordered = F.sort_array(F.collect_list(F.struct("rank", "digest")))["digest"]
        runs = nodes.where(F.col("total") > width).groupBy("tree", F.floor(F.col("rank") / RUN).alias("parent"), "total")
        parents = runs.agg(ordered.alias("children")).withColumn("digest", F.sha2(F.array_join("children", ""), 256))
        parents = written(parents, f"{name}-{height}")
        records.append(parents.select("digest", "children"))
        nodes = parents.select("tree", F.col("parent").alias("rank"), "total", "digest")
        height, width = height + 1, width * RUN
    return records, _united(tops), height


def _united(frames: list[DataFrame]) -> DataFrame:
    whole = frames[0]
    for frame in frames[1:]:
        whole = whole.unionByName(frame)
    return whole


@dataclass
class Manifest:
    """A stored manifest.

    ``leaves``: tree, rank, total, and the columns given with them; ``records``: digest, children; ``sources``: tree, digest (the
    subroot), height, total and rank among the subroots; ``root``: one row with digest.
    """

    leaves: DataFrame
    records: DataFrame
    sources: DataFrame
    root: DataFrame
    source_levels: int
    root_levels: int


def build(leaves: DataFrame) -> Manifest:
    """The manifest of ``leaves``: tree (see ``source_key``), doc_id, digest and any further columns."""
    laid = written(ranked(leaves, ["doc_id", "digest"], "merkle-leaves"), "merkle-ranked")
    records, tops, source_levels = hashed_up(laid.select("tree", "rank", "total", "digest"), "merkle-level")
    subroots = tops.select(F.lit("").alias("tree"), F.col("tree").alias("of"), "digest", "height", F.col("total").alias("n"))
    subroots = written(ranked(subroots, ["of"], "merkle-sources"), "merkle-subroots")
    above, root, root_levels = hashed_up(subroots.select("tree", "rank", "total", "digest"), "merkle-top")
    every = records + above
    known = _united(every).dropDuplicates(["digest"]) if every else None
    if known is None:
        known = laid.select("digest", F.array("digest").alias("children")).where("false")
    sources = subroots.select(F.col("of").alias("tree"), "digest", "height", F.col("n").alias("total"), "rank")
    return Manifest(laid, written(known, "merkle-records"), sources, root.select("digest"), source_levels, root_levels)


def descended(frontier: DataFrame, records: DataFrame) -> DataFrame:
    """One step: each frontier row (digest, pos, path, and what else it has) becomes its children, which keep the others."""
    kept = [c for c in frontier.columns if c not in ("digest", "pos", "path")]
    opened = frontier.join(records, "digest").select(*kept, "pos", "path", "children", F.posexplode("children").alias("digit", "child"))
    return opened.select(
        *kept,
        F.col("child").alias("digest"),
        (F.col("pos") * RUN + F.col("digit")).alias("pos"),
        F.array_append("path", segment(F.col("children"), F.col("digit"))).alias("path"),
    )


def segment(children: Column, digit: Column) -> Column:
    """The children that are not selected, as the text before and after the selected one."""
    return F.struct(
        F.array_join(F.slice(children, F.lit(1), digit), "").alias("before"),
        F.array_join(F.slice(children, digit + 2, F.lit(RUN)), "").alias("after"),
    )


def asked(frontier: DataFrame, requests: DataFrame | None, level: int) -> DataFrame:
    """The frontier rows of a level of the source trees that lead to a requested leaf (all, if there is no list)."""
    if requests is None:
        return frontier
    digits = requests.select("tree", F.floor(F.col("rank") / RUN**level).alias("pos")).distinct()
    return frontier.join(digits, ["tree", "pos"], "left_semi")


def prove(manifest: Manifest, requests: DataFrame | None = None) -> DataFrame:
    """The leaves with subroot, root and path (before, after; from the leaf up), of the requested ones or of all.

    ``requests`` has tree and rank; ranks that no leaf has are passed over.
    """
    records, nothing = manifest.records, F.array().cast("array<struct<before:string,after:string>>")
    if requests is not None:
        requests = requests.select("tree", "rank").distinct()
    frontier = manifest.root.select("digest", F.col("digest").alias("root"), F.lit(0).cast("long").alias("pos"), nothing.alias("path"))
    for _ in range(manifest.root_levels):
        frontier = descended(frontier, records)
    # What lies at the end of the first digits are the subroots; each goes on as the root of its own tree.
    trees = manifest.sources.select("tree", "height", F.col("rank").alias("pos"))
    start = frontier.join(trees, "pos").withColumns({"subroot": F.col("digest"), "pos": F.lit(0).cast("long")})
    start = written(asked(start, requests, manifest.source_levels), "merkle-start")
    below = None
    for level in range(manifest.source_levels, 0, -1):
        reached = start.where(F.col("height") == level)
        if below is not None:
            reached = reached.unionByName(asked(descended(below, records), requests, level))
        below = reached
    alone = start.where("height = 0").withColumn("children", F.lit(None).cast("array<string>"))
    ends = alone if below is None else alone.unionByName(below.join(records, "digest"))
    ends = ends.select("tree", F.col("pos").alias("parent"), "subroot", "root", "path", "children")
    leaves = manifest.leaves if requests is None else manifest.leaves.join(requests, ["tree", "rank"], "left_semi")
    found = leaves.withColumn("parent", F.floor(F.col("rank") / RUN)).join(ends, ["tree", "parent"])
    digit = (F.col("rank") % RUN).cast("int")
    down = F.when(F.col("children").isNull(), F.col("path")).otherwise(
        F.array_append("path", segment(F.col("children"), digit))
    )
    return found.withColumn("path", F.reverse(down)).drop("parent", "children", "total")


def proof_digest(path: Column) -> Column:
    """The digest of all siblings of a path, from the leaf up and left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["before"], s["after"])), ""), 256)


def folded(digest: Column, path: Column) -> Column:
    """The root that a leaf and a path give."""
    return F.aggregate(path, digest, lambda d, s: F.sha2(F.concat(s["before"], d, s["after"]), 256))


def verify(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified, for every row of the documents.

    Every fifth text or so is tampered with (``tampered_text``) before its leaf is computed again and folded.
    """
    prepare(docs.sparkSession)
    columns = {name: F.col(name) for name in FIELDS}
    text = tampered_text(columns["doc_id"], columns["text"])
    own, other = leaf(**columns), leaf(**{**columns, "text": text})
    changed = F.when(~text.eqNullSafe(columns["text"]), other)
    leaves = docs.select(
        source_key(columns["source"]).alias("tree"), "doc_id", own.alias("digest"), changed.alias("changed")
    )
    proven = prove(build(leaves))
    back = folded(F.coalesce("changed", "digest"), F.col("path"))
    return proven.select(
        "doc_id",
        F.col("digest").alias("leaf"),
        "subroot",
        "root",
        proof_digest(F.col("path")).alias("proof_sha256"),
        back.alias("folded_root"),
        (back == F.col("root")).alias("verified"),
    )


#: Levels that the twin unrolls: trees of up to RUN ** TWIN_LEVELS nodes.
TWIN_LEVELS = 8


def verify_sql() -> str:
    """The DuckDB twin of ``verify``: window functions over a fixed number of levels instead of records and descent."""

    def put(name: str, value: str) -> str:
        return f"coalesce(strlen({value}) || ':' || {value}, '-') as {name}"

    parts = [
        """docs as (
    select *, row_number() over () as r, cast(doc_id as varchar) as id_text, cast(n_chars as varchar) as size_text from documents),
crc as (
    select *, id_text is not null and xor(list_reduce(list_concat([4294967295::bigint],
        flatten(list_transform(string_split(id_text, ''), lambda c: [ord(c)::bigint, 0, 0, 0, 0, 0, 0, 0]))),
        lambda s, b: xor(xor(s, b) >> 1, 3988292384 * (xor(s, b) & 1))), 4294967295) % 5 = 0 as hit from docs),
changed as (
    select *, case when hit then translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') else text end as other
    from crc)""",
        f"""fields as (
    select r, doc_id, coalesce('=' || source, '') as tree, {put('f1', 'id_text')}, {put('f2', 'source')}, {put('f3', 'lang')},
        {put('f4', 'size_text')}, {put('f5', 'text')}, {put('f6', 'other')} from changed),
hashed as (
    select r, doc_id, tree, sha256(f1 || f2 || f3 || f4 || f5) as leaf, sha256(f1 || f2 || f3 || f4 || f6) as again from fields),
s0 as (
    select *, leaf as digest, row_number() over (partition by tree order by doc_id nulls first, leaf, r) - 1 as rank,
        count(*) over (partition by tree) as total from hashed)""",
    ]

    def level(before: str, after: str, tree: str) -> str:
        # One row per node; a finished tree (total 1) passes on unchanged.
        return f"""{after} as (
    select {tree}, rank // {RUN} as rank, case when total = 1 then any_value(digest)
        else sha256(string_agg(digest, '' order by rank)) end as digest, (total + {RUN - 1}) // {RUN} as total
    from {before} group by {tree}, rank // {RUN}, total)"""

    parts += [level(f"s{k}", f"s{k + 1}", "tree") for k in range(TWIN_LEVELS)]
    parts.append(
        f"""t0 as (
    select 0 as top, tree, digest, row_number() over (order by tree) - 1 as rank, count(*) over () as total from s{TWIN_LEVELS})"""
    )
    parts += [level(f"t{k}", f"t{k + 1}", "top") for k in range(TWIN_LEVELS)]

    # The siblings of a node, and the fold, level by level; r names a leaf.
    def climb(nodes: str, of: str, before: str, after: str, rank: str, kept: list[str]) -> str:
        n = f"n.{of} = c.{of} and n.rank // {RUN} = c.{rank} // {RUN} and n.total > 1"
        some = ", ".join(f"any_value(c.{name}) as {name}" for name in [*kept, of])
        beside = [f"coalesce(string_agg(n.digest, '' order by n.rank) filter (n.rank {sign} c.{rank}), '')" for sign in "<>"]
        return f"""{after} as (
    select c.r, {some}, any_value(c.{rank}) // {RUN} as {rank}, any_value(c.proof) || {beside[0]} || {beside[1]} as proof,
        case when count(n.rank) = 0 then any_value(c.acc) else sha256({beside[0]} || any_value(c.acc) || {beside[1]}) end as acc
    from {before} c left join {nodes} n on {n} group by c.r)"""

    leaf_columns = ["doc_id", "leaf"]
    parts.append("c0 as (select r, doc_id, tree, leaf, rank, again as acc, '' as proof from s0)")
    parts += [climb(f"s{k}", "tree", f"c{k}", f"c{k + 1}", "rank", leaf_columns) for k in range(TWIN_LEVELS)]
    parts.append(f"""d0 as (
    select c.r, doc_id, leaf, acc, proof, t.top, t.digest as subroot, t.rank as place from c{TWIN_LEVELS} c join t0 t using (tree))""")
    above = [*leaf_columns, "subroot"]
    parts += [climb(f"t{k}", "top", f"d{k}", f"d{k + 1}", "place", above) for k in range(TWIN_LEVELS)]
    return f"""with {", ".join(parts)}
select doc_id, leaf, subroot, t.digest as root, sha256(proof) as proof_sha256, acc as folded_root, acc = t.digest as verified
from d{TWIN_LEVELS} d join t{TWIN_LEVELS} t on d.top = t.top
"""
