"""Exact Jaccard join of n-gram sets by skipping along set relations, down to connected components.

A document is the set of its distinct shingles (four words). Two sets link when 100 * intersection >= 85 * union. What is asked for is
the component of each document, so a link inside a component that is known already need not be found.

1. Sets: one scan writes the digest of each set, and the shingles of a task at a time, sorted, packed by their differences and
   cut by hash range. Ranges are merged into exact numbers of documents, and the shingles of ``LEVELS`` or more go into Bloom
   filters. Equal digests are equal sets: one set stands for them from here on.
2. Index: the shingles of a set are ordered rarest first, by those filters and then by hash. Linked sets share one of their first
   n - ceil(0.85 n) + 1 shingles, so one more scan writes an entry (shingle, set, size, position) for each of those that some
   other document has too. What a filter gets wrong costs work, not links.
3. Index lists are skipped by position: in each list every entry meets the first set of the list (its leader), unless sizes or
   positions leave no room for enough common shingles. Pairs whose outlines leave room are verified exactly, each once, and a linked
   set keeps its relation to its most similar leader: the shingles it lacks and those it has besides.
4. Lists that still hold several components go on in groups, one for each component of a leader: all members of other components
   (``away``) are compared with all members of the group. This happens in tiles of bounded size, one size class against its
   neighbours, first on outlines alone, which leaves the members that may link with one of another component. For these, a tile holds
   an index of its away sets. A member with a relation derives its answers from those of its leader, which are counted once per
   tile: the overlap with each away set less what the member lacks plus what it has besides. A member without one walks the
   lists of its first shingles, blocked by position, so that a list is left at the first position from which no set can reach the
   threshold; only sets met there are counted. Only links come out.
5. Components of all links; the smallest doc_id of each.

An outline has the number of shingles in each of some size / 8 to size / 4 hash buckets; the sum of the smaller numbers of two
outlines is never less than the overlap of the sets, and for unlike sets it is well below the threshold.

Texts are read a few times and never moved; of the sets, only those move whose outlines leave room for a link. Hot lists: a
leader's pairs are as many as the members, verified in parts of ``FANOUT``; the rest goes through tiles in which members travel as
relations. What is broadcast is Bloom filters (128 MB each at most, one per level); once they are too small for a corpus, more
entries are written than need be, none less.

Sets and shingles are told apart by hashes, of 128 and of 64 bits.

Edge cases: null or empty texts and texts without words have no set, link with nothing and are their own component. A text of fewer
than four words is one shingle, unlike any longer text's. Rows without a doc_id belong to the component of their links, if any row in it has
an id, else to none. Rows that repeat a doc_id are each judged by their own text. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarifflens.llm.bloom import filter_of, hits
from tarifflens.llm.common import prepare, stored, written
from tarifflens.llm.components import components

SPAN = 4
# Two sets link when WHOLE * intersection >= PART * union.
PART, WHOLE = 85, 100
# Shingles of so many documents are told apart from rarer ones.
LEVELS = (2, 16, 256)
# Shingles are counted by so many bits of their hash; a task packs so many of them at a time.
COUNT_BITS = 44
PACKED = 1_000_000
FANOUT = 200
# Sets whose sizes lie two classes of this ratio apart cannot link (it is wider than PART / WHOLE, so rounding cannot matter).
CLASS_RATIO = 0.8
# Bounds of a tile: away sets and their shingles, and members that pass by.
TILE_SETS, TILE_SHINGLES, TILE_MEMBERS = 2048, 2_000_000, 4096
# Sets a task remembers so as not to index copies twice; a task may forget them, later steps do not rely on it.
REMEMBERED = 100_000

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
FACTOR = np.uint64(0xD6E8FEB86659FD93)


def scrambled(x: np.ndarray) -> np.ndarray:
    """Mix 64-bit numbers, one to one."""
    for shift in (32, 29):
        x = (x ^ (x >> np.uint64(shift))) * FACTOR
    return x ^ (x >> np.uint64(32))


def shingles(text: str | None) -> np.ndarray:
    """The hashes of the distinct shingles of a text, ascending."""
    found = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    h = np.array([xxhash.xxh3_64_intdigest(w) for w in found], np.uint64)
    span = min(SPAN, len(h))
    count = len(h) - span + 1
    if not span:
        return h
    s = np.full(count, span, np.uint64)
    for k in range(span):
        s = scrambled(s + h[k : count + k])
    return np.unique(s)


def name_of(s: np.ndarray) -> bytes:
    """The name of a set."""
    return xxhash.xxh3_128_digest(s.tobytes())


def prefix(size: int) -> int:
    """How many of its first shingles a set shares at least one of with any set it links to."""
    return size - (PART * size + WHOLE - 1) // WHOLE + 1


def outline_length(size: int) -> int:
    """Buckets of the outline of a set: a power of two."""
    return 1 << max(4, (max(1, size) // 8).bit_length())


def outline(s: np.ndarray) -> bytes:
    """How many shingles fall into each bucket, a byte each; numbers over 255 count as 255."""
    length = outline_length(len(s))
    counts = np.bincount((s & np.uint64(length - 1)).astype(np.int64), minlength=length)
    return np.minimum(counts, 255).astype(np.uint8).tobytes()


def opened(outlines: list[bytes], length: int) -> np.ndarray:
    """Outlines, a row each, all brought to one length no larger than theirs."""
    result = np.empty((len(outlines), length), np.uint16)
    lengths = np.array([len(o) for o in outlines])
    for own in np.unique(lengths):
        at = np.flatnonzero(lengths == own)
        counts = np.frombuffer(b"".join([outlines[i] for i in at]), np.uint8)
        # The low bits of a hash choose the bucket, so buckets that agree in them fall together.
        result[at] = counts.reshape(len(at), own // length, length).sum(axis=1, dtype=np.uint16)
    return result


def may_link(one: np.ndarray, size: np.ndarray, other: np.ndarray, other_size: np.ndarray) -> np.ndarray:
    """Whether sets of such opened outlines may link, row by row."""
    beyond = np.minimum(size - one.sum(axis=-1, dtype=np.int64), other_size - other.sum(axis=-1, dtype=np.int64))
    overlap = np.minimum(one, other).sum(axis=-1, dtype=np.int64) + beyond
    return WHOLE * overlap >= PART * (size + other_size - overlap)


def counted_bits(s: np.ndarray) -> np.ndarray:
    """What a shingle is counted by: the top bits of its hash, in the order of the hashes."""
    return s >> np.uint64(64 - COUNT_BITS)


def packed(ascending: np.ndarray) -> bytes:
    """Ascending numbers by their differences, byte by byte of all of them, so that what is zero throughout takes no room."""
    steps = np.diff(ascending, prepend=np.uint64(0))
    return zstandard.compress(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def tasks_of(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def described(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, node and outline (null without shingles) of every document.

    Further rows have the shingles of a range of hashes that a task has met (``range``, ``part``) and how often (``times``).
    """
    schema = "doc_id long, n_shingles long, node binary, outline binary, range int, part binary, times binary"
    ranges = tasks_of(docs)
    step = 2**COUNT_BITS // ranges + 1

    def ranged(met: list[np.ndarray]) -> pd.DataFrame:
        values, times = np.unique(counted_bits(np.concatenate(met)), return_counts=True)
        cuts = np.searchsorted(values, np.arange(ranges + 1, dtype=np.uint64) * np.uint64(step))
        found = [(at, low, high) for at, (low, high) in enumerate(zip(cuts[:-1], cuts[1:])) if low < high]
        return pd.DataFrame(
            {
                "doc_id": pd.array([None] * len(found), dtype="Int64"),
                "n_shingles": pd.array([None] * len(found), dtype="Int64"),
                "node": [None] * len(found),
                "outline": [None] * len(found),
                "range": pd.array([at for at, _, _ in found], dtype="Int32"),
                "part": [packed(values[low:high]) for _, low, high in found],
                "times": [zstandard.compress(times[low:high].astype(np.uint32).tobytes(), 1) for _, low, high in found],
            }
        )

    def describe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        met, held = [], 0
        for batch in batches:
            sets = [shingles(t) for t in batch["text"]]
            yield pd.DataFrame(
                {
                    "doc_id": whole_ids(batch["doc_id"]),
                    "n_shingles": [len(s) for s in sets],
                    "node": [name_of(s) if len(s) else None for s in sets],
                    "outline": [outline(s) if len(s) else None for s in sets],
                    "range": pd.array([None] * len(sets), dtype="Int32"),
                    "part": [None] * len(sets),
                    "times": [None] * len(sets),
                }
            )
            met += sets
            held += sum(map(len, sets))
            if held >= PACKED:
                yield ranged(met)
                met, held = [], 0
        if held:
            yield ranged(met)

    return written(docs.mapInPandas(describe, schema), "jaccard-sets")


def whole_ids(ids: pd.Series) -> pd.api.extensions.ExtensionArray:
    """Ids as nullable whole numbers, however pandas was handed them."""
    return pd.array([None if pd.isna(d) else int(d) for d in ids], dtype="Int64")


def repeated(parts: DataFrame) -> DataFrame:
    """hash and n: the shingles that several documents have (scrambled), with the number of documents, from the parts of all tasks."""

    def merged(held: list[tuple[np.ndarray, np.ndarray]]) -> pd.DataFrame:
        bits, times = (np.concatenate(column) for column in zip(*held))
        order = np.argsort(bits, kind="stable")
        bits, times = bits[order], times[order]
        start = np.flatnonzero(np.concatenate([[True], bits[1:] != bits[:-1]]))
        n = np.add.reduceat(times.astype(np.int64), start)
        return pd.DataFrame({"hash": scrambled(bits[start][n >= 2]).view(np.int64), "n": n[n >= 2]})

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        here, held = None, []
        for batch in batches:
            for at, part, times in zip(batch["range"], batch["part"], batch["times"]):
                if at != here and held:
                    yield merged(held)
                    held = []
                here = at
                held.append((unpacked(part), np.frombuffer(zstandard.decompress(times), np.uint32)))
        if held:
            yield merged(held)

    laid = parts.select("range", "part", "times").repartition(tasks_of(parts), "range").sortWithinPartitions("range")
    return stored(laid.mapInPandas(merge, "hash long, n long"))


def filters(found: DataFrame) -> list[np.ndarray]:
    """A Bloom filter of the shingles of each level, from ``repeated``."""
    reach = [found.where(F.col("n") >= level).select("hash") for level in LEVELS]
    return [filter_of(hashes, hashes.count()) for hashes in reach]


def packed_filter(known: np.ndarray) -> bytes:
    return zstandard.compress(known.tobytes(), 1)


def share(docs: DataFrame, known: list[np.ndarray]) -> Broadcast:
    """The filters, sent to the workers once."""
    return docs.sparkSession.sparkContext.broadcast([packed_filter(f) for f in known])


class Order:
    """The order of shingles, rarest first."""

    def __init__(self, shared: list[bytes]):
        self.filters = [np.frombuffer(zstandard.decompress(data), np.uint64) for data in shared]

    def levels(self, s: np.ndarray) -> np.ndarray:
        """How many levels each shingle seems to reach; 0 means that a single document has it."""
        h = scrambled(counted_bits(s))
        reached, inside = np.zeros(len(s), np.int8), np.arange(len(s))
        for known in self.filters:
            inside = inside[hits(h[inside], known)]
            reached[inside] += 1
        return reached

    def of(self, s: np.ndarray) -> np.ndarray:
        """The shingles in this order; ``s`` ascends."""
        return s[np.argsort(self.levels(s), kind="stable")]

    def heads(self, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Those of the first shingles that another set may have, and their positions."""
        reached = self.levels(s)
        order = np.argsort(reached, kind="stable")[: prefix(len(s))]
        pos = np.flatnonzero(reached[order])
        return s[order[pos]], pos


def entries(docs: DataFrame, shared: Broadcast) -> DataFrame:
    """token, node, size and pos: the index entries of all sets, but for shingles of one set. Copies may be there several times."""

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order, seen = Order(shared.value), set()
        for batch in batches:
            nodes, sizes, first, pos = [], [], [], []
            for text in batch.column(0).to_pylist():
                s = shingles(text)
                node = name_of(s)
                if not len(s) or node in seen:
                    continue
                if len(seen) >= REMEMBERED:
                    seen.clear()
                seen.add(node)
                nodes.append(node)
                sizes.append(len(s))
                head, at = order.heads(s)
                first.append(head)
                pos.append(at.astype(np.int32))
            counts = np.array([len(f) for f in first], np.int64)
            if not counts.sum():
                continue
            named = pa.array(nodes, pa.binary()).take(pa.array(np.repeat(np.arange(len(nodes)), counts)))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate(first).view(np.int64)),
                    named,
                    pa.array(np.repeat(np.array(sizes, np.int32), counts)),
                    pa.array(np.concatenate(pos)),
                ],
                names=["token", "node", "size", "pos"],
            )

    return docs.select("text").mapInArrow(index, "token long, node binary, size int, pos int")


def lists(docs: DataFrame, shared: Broadcast) -> DataFrame:
    """token, node, size, pos, n (sets of the list) and leader (node, size, pos): the index lists of two sets or more."""
    every = stored(entries(docs, shared).dropDuplicates(["token", "node"]))
    heads = every.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("node", "size", "pos")).alias("leader"))
    return written(every.join(heads.where("n > 1"), "token"), "jaccard-lists")


def enough(overlap: Column, size: Column, other: Column) -> Column:
    """Whether sets of such sizes link with such an overlap."""
    return WHOLE * overlap >= PART * (size + other - overlap)


def room() -> Column:
    """Whether an entry and its leader may link, by sizes and positions.

    If their first common shingle is this one, what follows in either is all they can have in common; if an earlier one is, as many
    more as precede it in both.
    """
    ahead = F.least(F.col("pos"), F.col("leader.pos"))
    behind = F.least(F.col("size") - F.col("pos"), F.col("leader.size") - F.col("leader.pos"))
    return enough((ahead + behind).cast("long"), F.col("size").cast("long"), F.col("leader.size").cast("long"))


def outlines(known: DataFrame) -> DataFrame:
    """node, size and outline of every set; ``known`` has n_shingles for size."""
    return known.where("node is not null").dropDuplicates(["node"]).select("node", F.col("n_shingles").alias("size"), "outline")


@F.pandas_udf(T.BooleanType())
def _alike(one: pd.Series, size: pd.Series, other: pd.Series, other_size: pd.Series) -> pd.Series:
    result = np.zeros(len(one), bool)
    length = np.minimum(one.str.len(), other.str.len()).to_numpy(np.int64)
    for own in np.unique(length):
        at = np.flatnonzero(length == own)
        rows = (opened(column.iloc[at].tolist(), int(own)) for column in (one, other))
        sizes = (column.iloc[at].to_numpy(np.int64) for column in (size, other_size))
        (a, b), (n, m) = rows, sizes
        result[at] = may_link(a, n, b, m)
    return pd.Series(result)


def star(members: DataFrame, drawn: DataFrame) -> DataFrame:
    """node and leader: the pairs of an entry and its leader that positions, sizes and outlines leave room for."""
    pairs = members.where((F.col("node") != F.col("leader.node")) & room())
    pairs = pairs.select("node", F.col("leader.node").alias("leader")).distinct()
    heads = drawn.select(F.col("node").alias("leader"), F.col("size").alias("leader_size"), F.col("outline").alias("leader_outline"))
    both = pairs.join(drawn, "node").join(heads, "leader")
    return both.where(_alike("outline", "size", "leader_outline", "leader_size")).select("node", "leader")


def needed_sets(docs: DataFrame, holders: DataFrame, nodes: DataFrame) -> DataFrame:
    """node and tokens (ascending hashes) of the given nodes, from the texts of some document that has each.

    ``holders`` has doc_id and node. A filter of bounded size sorts out the documents that cannot have one, by id.
    """
    ids = holders.join(nodes, "node").groupBy("node").agg(F.max("doc_id").alias("doc_id"))
    ids = stored(ids.select("doc_id").distinct())
    known = docs.sparkSession.sparkContext.broadcast(packed_filter(filter_of(ids.select(F.xxhash64("doc_id").alias("h")), ids.count())))

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        wanted = np.frombuffer(zstandard.decompress(known.value), np.uint64)
        for batch in batches:
            maybe = hits(batch["h"].to_numpy(np.int64).view(np.uint64), wanted)
            sets = [s for s in map(shingles, batch["text"][maybe]) if len(s)]
            yield pd.DataFrame({"node": [name_of(s) for s in sets], "tokens": [s.tobytes() for s in sets]})

    asked = docs.select("text", F.xxhash64("doc_id").alias("h"))
    made = asked.mapInPandas(make, "node binary, tokens binary")
    # Copies differ in nothing, so any one of them will do.
    return written(made.join(nodes, "node", "left_semi").dropDuplicates(["node"]), "jaccard-needed")


def relations(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """node, leader, shared (their overlap), lacks and has (what tells the node from its leader): the linked ones of the pairs."""
    pairs = stored(pairs)
    parts = pairs.groupBy("leader").agg(F.ceil(F.count(F.lit(1)) / FANOUT).alias("parts"))
    dealt = stored(pairs.join(parts, "leader").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts"))).drop("parts"))
    partners = dealt.select("leader", "part", "node", F.lit(True).alias("partner"))
    heads = dealt.select("leader", "part", F.col("leader").alias("node"), F.lit(False).alias("partner")).distinct()
    rows = heads.unionByName(partners).join(sets, "node")
    laid = rows.repartition(tasks_of(pairs), "leader", "part").sortWithinPartitions("leader", "part", "partner")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        head = None
        for batch in batches:
            out = []
            for leader, partner, node, tokens in zip(*(batch[c] for c in ("leader", "partner", "node", "tokens"))):
                own = np.frombuffer(tokens, np.uint64)
                if not partner:
                    head = own
                    continue
                lacks = np.setdiff1d(head, own, assume_unique=True)
                shared = len(head) - len(lacks)
                if WHOLE * shared >= PART * (len(own) + len(head) - shared):
                    has = np.setdiff1d(own, head, assume_unique=True)
                    out.append((node, leader, shared, lacks.tobytes(), has.tobytes()))
            yield pd.DataFrame(out, columns=["node", "leader", "shared", "lacks", "has"])

    schema = "node binary, leader binary, shared long, lacks binary, has binary"
    return written(laid.mapInPandas(compare, schema), "jaccard-relations")


def size_class(size: Column) -> Column:
    return F.floor(F.log(size.cast("double")) / -math.log(CLASS_RATIO)).cast("int")


def unsettled(members: DataFrame) -> DataFrame:
    """group, node, size and label: the members of lists that hold several components, by the component of their leader.

    ``members`` is what ``labelled`` returns; a list of two has had its only pair decided.
    """
    return members.groupBy(F.col("home").alias("group"), "node").agg(F.first("size").alias("size"), F.first("label").alias("label"))


def tiles(grouped: DataFrame) -> DataFrame:
    """group, k, r, c, node, label and away: the sets of ``unsettled`` groups laid out in tiles.

    Away sets of size class k are dealt to rows r and go to every column c; members of the class and its neighbours are dealt to columns
    and go to every row.
    """
    away = grouped.where(F.col("label") != F.col("group")).withColumn("k", size_class(F.col("size")))
    members = grouped.withColumn("near", F.explode(F.array(*(size_class(F.col("size")) + d for d in (-1, 0, 1)))))
    rows = F.greatest(F.ceil(F.sum("size") / TILE_SHINGLES), F.ceil(F.count(F.lit(1)) / TILE_SETS)).cast("int")
    heights = away.groupBy("group", "k").agg(rows.alias("rows"))
    widths = members.groupBy("group", F.col("near").alias("k")).agg(F.ceil(F.count(F.lit(1)) / TILE_MEMBERS).cast("int").alias("columns"))
    bounds = stored(heights.join(widths, ["group", "k"]))
    place = F.xxhash64("node")

    def dealt(frame: DataFrame, fixed: str, of: str, spread: str, over: str, is_away: bool) -> DataFrame:
        return frame.join(bounds, ["group", "k"]).select(
            "group",
            "k",
            "node",
            "label",
            F.pmod(place, of).cast("int").alias(fixed),
            F.explode(F.sequence(F.lit(0), F.col(over) - 1)).alias(spread),
            F.lit(is_away).alias("away"),
        )

    down = dealt(away, "r", "rows", "c", "columns", True)
    across = dealt(members.withColumnRenamed("near", "k"), "c", "columns", "r", "rows", False)
    return down.unionByName(across.select(*down.columns))


def live(laid: DataFrame, drawn: DataFrame) -> DataFrame:
    """group and node: the members that by their outlines may link with a member of another component, in the tiles of ``tiles``."""
    place = ["group", "k", "r", "c"]
    rows = laid.join(drawn, "node")
    ordered = rows.repartition(tasks_of(laid), *place).sortWithinPartitions(*place, F.desc("away"))

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        here, held, table, hit = None, [], None, set()
        for batch in batches:
            found = []
            for row in batch.itertuples(index=False):
                if (row.group, row.k, row.r, row.c) != here:
                    here, held, table, hit = (row.group, row.k, row.r, row.c), [], None, set()
                if row.away:
                    held.append(row)
                    continue
                if table is None:
                    # Any size that meets this class has an outline of this length at least.
                    length = min(outline_length(int(CLASS_RATIO ** (1 - row.k))), min(len(h.outline) for h in held))
                    sizes, labels = np.array([h.size for h in held], np.int64), np.array([h.label for h in held], object)
                    table = opened([h.outline for h in held], length)
                shorter = min(length, len(row.outline))
                if shorter < length:
                    length, table = shorter, table.reshape(len(held), -1, shorter).sum(axis=1, dtype=np.uint16)
                own = opened([row.outline], length)
                near = np.flatnonzero(may_link(table, sizes, own, np.int64(row.size)) & (labels != row.label))
                if len(near):
                    found.append((row.group, row.node))
                    found += [(row.group, held[i].node) for i in near if i not in hit]
                    hit.update(near.tolist())
            yield pd.DataFrame(found, columns=["group", "node"])

    return ordered.mapInPandas(compare, "group binary, node binary").distinct()


class Tile:
    """The away sets of a tile, indexed."""

    def __init__(self, sets: list[tuple[bytes, bytes, np.ndarray]], order: Order):
        self.nodes = [node for node, _, _ in sets]
        self.labels = np.array([label for _, label, _ in sets], object)
        self.sizes = np.array([len(s) for _, _, s in sets], np.int64)
        tokens = np.concatenate([s for _, _, s in sets])
        owners = np.repeat(np.arange(len(sets)), self.sizes)
        at = np.argsort(tokens, kind="stable")
        self.tokens, self.owners = tokens[at], owners[at]
        # The first shingles of each set: lists in blocks of equal position, the earliest first.
        heads = [order.of(s)[: prefix(len(s))] for _, _, s in sets]
        lengths = [len(h) for h in heads]
        head, pos = np.concatenate(heads), np.concatenate([np.arange(n) for n in lengths])
        owner = np.repeat(np.arange(len(sets)), lengths)
        at = np.lexsort((pos, head))
        self.list_owners = owner[at]
        self.list_tokens, start = np.unique(head[at], return_index=True)
        # One ascending key per entry, list by list, so that the end of the useful blocks is a binary search.
        self.list_keys = np.repeat(np.arange(len(start)), np.diff([*start, len(head)])) * 2**32 + pos[at]

    def counts(self, s: np.ndarray) -> np.ndarray:
        """The overlap of a set with each away set."""
        low, high = np.searchsorted(self.tokens, s, "left"), np.searchsorted(self.tokens, s, "right")
        return np.bincount(self.owners[spans(low, high)], minlength=len(self.nodes))

    def met(self, first: np.ndarray, size: int) -> bool:
        """Whether an away set may link with one of such first shingles: lists are left where positions leave no room."""
        at = np.searchsorted(self.list_tokens, first)
        found = at < len(self.list_tokens)
        found[found] = self.list_tokens[at[found]] == first[found]
        # The largest away set that may link, and how far down its list it may have its first common shingle.
        largest = min(int(self.sizes.max()), size * WHOLE // PART)
        least = -(-PART * (size + max(int(self.sizes.min()), -(-PART * size // WHOLE))) // (WHOLE + PART))
        useful = found & (size - np.arange(len(first)) >= least)
        lists = at[useful]
        low = np.searchsorted(self.list_keys, lists * 2**32)
        high = np.searchsorted(self.list_keys, lists * 2**32 + max(-1, largest - least), "right")
        return bool((high > low).any())

    def linked(self, overlap: np.ndarray, size: int) -> np.ndarray:
        return np.flatnonzero(WHOLE * overlap >= PART * (self.sizes + size - overlap))


def spans(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """All positions of the ranges low..high, one after the other."""
    length = high - low
    total = int(length.sum())
    return np.arange(total) - np.repeat(np.cumsum(length) - length, length) + np.repeat(low, length)


def settle(laid: DataFrame, sets: DataFrame, homes: DataFrame, shared: Broadcast) -> DataFrame:
    """a, b: links between different components within the tiles.

    ``homes`` has the relation of each node to its most similar leader. One link between two components is enough of a tile.
    """
    laid = stored(laid)
    place = ["group", "k", "r", "c"]
    tied = laid.where("not away").join(homes, "node", "left")
    own = tied.where("leader is null").select(*place, "node", "label", F.lit(2).alias("kind"), F.col("node").alias("of"))
    down = laid.where("away").select(*place, "node", "label", F.lit(0).alias("kind"), F.col("node").alias("of"))
    heads = tied.where("leader is not null").select(*place, F.col("leader").alias("of")).distinct()
    heads = heads.select(*place, F.col("of").alias("node"), F.lit(None).cast("binary").alias("label"), F.lit(1).alias("kind"), "of")
    full = down.unionByName(heads).unionByName(own).join(sets.select(F.col("node").alias("of"), F.col("tokens").alias("has")), "of")
    full = full.select(*place, "kind", "node", "label", "of", "has", F.lit(None).cast("binary").alias("lacks"))
    derived = tied.where("leader is not null").select(
        *place, F.lit(2).alias("kind"), "node", "label", F.col("leader").alias("of"), "has", "lacks"
    )
    ordered = full.unionByName(derived).repartition(tasks_of(laid), *place).sortWithinPartitions(*place, "kind", "node")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        order = Order(shared.value)
        here, held, tile, answers, known = None, [], None, {}, set()
        for batch in batches:
            found = []
            for row in batch.itertuples(index=False):
                if (row.group, row.k, row.r, row.c) != here:
                    here, held, tile, answers, known = (row.group, row.k, row.r, row.c), [], None, {}, set()
                s = np.frombuffer(row.has, np.uint64)
                if row.kind == 0:
                    held.append((row.node, row.label, s))
                    continue
                tile = tile or Tile(held, order)
                if row.kind == 1:
                    answers[row.node] = tile.counts(s), len(s)
                    continue
                if row.lacks is None:
                    if not tile.met(order.of(s)[: prefix(len(s))], len(s)):
                        continue
                    overlap, size = tile.counts(s), len(s)
                else:
                    lacks = np.frombuffer(row.lacks, np.uint64)
                    overlap, size = answers[row.of]
                    overlap, size = overlap - tile.counts(lacks) + tile.counts(s), size - len(lacks) + len(s)
                for k in tile.linked(overlap, size):
                    other = tile.labels[k]
                    if other != row.label and (other, row.label) not in known:
                        known.add((other, row.label))
                        known.add((row.label, other))
                        found.append((row.node, tile.nodes[k]))
            yield pd.DataFrame(found, columns=["a", "b"])

    return ordered.mapInPandas(compare, "a binary, b binary").distinct()


def labelled(members: DataFrame, found: DataFrame) -> DataFrame:
    """token, node, size, label and home of the lists of more than two: the components so far of the node and of its leader."""
    open_lists = members.where("n > 2").select("token", "node", "size").join(found.select("node", "label"), "node", "left")
    both = stored(open_lists.withColumn("label", F.coalesce("label", "node")))
    # The leader of a list is its smallest node.
    homes = both.groupBy("token").agg(
        F.min(F.struct("node", "label"))["label"].alias("home"), F.min("label").alias("low"), F.max("label").alias("high")
    )
    return both.join(homes.where("low < high").select("token", "home"), "token")


def linked_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id, one row per row of the documents."""
    prepare(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    made = described(docs)
    known = made.where("range is null")
    shared = share(docs, filters(repeated(made.where("range is not null"))))
    members = lists(docs, shared)
    drawn = outlines(known)
    pairs = stored(star(members, drawn))
    named = known.where("node is not null").select("doc_id", "node")
    ends = pairs.select("node").unionByName(pairs.select(F.col("leader").alias("node"))).distinct()
    tied = relations(pairs, needed_sets(docs, named, stored(ends)))
    found = stored(components(tied, "node", "leader"))
    best = F.max(F.struct("shared", "leader")).alias("best")
    homes = tied.groupBy("node").agg(best).select("node", F.col("best.leader").alias("leader"))
    homes = stored(tied.join(homes, ["node", "leader"]).select("node", "leader", "lacks", "has"))
    grouped = stored(unsettled(labelled(members, found)))
    grouped = stored(grouped.join(live(tiles(grouped), drawn), ["group", "node"], "left_semi"))
    inside = stored(grouped.select("node").distinct())
    heads = homes.join(inside, "node", "left_semi").select(F.col("leader").alias("node"))
    sets = needed_sets(docs, named, stored(inside.unionByName(heads).distinct()))
    more = stored(settle(tiles(grouped), sets, homes, shared))
    if not more.isEmpty():
        # The components found so far are as good as all their links.
        so_far = found.select(F.col("node").alias("a"), F.col("label").alias("b"))
        found = stored(components(so_far.unionByName(more)))
    # Equal sets first: one row per set from here on, then one per component.
    smallest = known.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("first"))
    named = stored(smallest.join(found, "node", "left").withColumn("label", F.coalesce("label", "node")))
    ids = named.groupBy("label").agg(F.min("first").alias("component_id"))
    named = stored(named.join(ids, "label").select("node", "component_id"))
    with_set = known.where("node is not null").join(named, "node").select("doc_id", "n_shingles", "component_id")
    without = known.where("node is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return with_set.unionByName(without)
