"""Near-duplicate classes by consistent weighted sampling.

A text is a bag of shingles (five words). A shingle weighs its count in the text times an inverse document frequency
between 1 and 2, so that passages which many documents share count for less. Improved consistent weighted sampling
draws ``BANDS * DEPTH`` samples of each bag, such that two bags agree in a sample with the probability of their weighted
Jaccard similarity (the sum of the smaller weights over the sum of the larger ones). Texts that agree in all samples of
a band are candidates; the similarity of candidates is then computed exactly, and pairs of ``threshold`` or more link.
In a large group of copies all common shingles are frequent and count for less than the edits, so a pair also links if
the plain Jaccard similarity of its shingle sets reaches the threshold; as many samples again, with all weights equal,
find the candidates of that rule. A class is a connected component of links.

1. Document frequencies: one scan fills a count sketch of fixed size (two rows of ``COUNTERS`` counters, 16 MB), merged
   by segments. The expected load of a counter is taken off, so that rare shingles stay rare in a large corpus. This
   table and filters of bounded size are all that is broadcast.
2. Samples: one scan writes a digest of the words, the band keys and one byte per sample of either kind. Every shingle
   has its own draws in every sample, made from its hash. A first look at 16 bits of it bounds the sampling key from
   below, so that only shingles that may have the smallest key of their bag are worked out; a bag in which none stays
   under the bound is worked out whole. Plain samples are the smallest hash products themselves.
3. Equal digests are exact copies: one of each class, the smallest doc_id, stands for them from here on.
4. In every band bucket, each member is verified against the smallest one: as many pairs as members, however large.
5. Buckets that still hold several components go on in groups, one for each component of a smallest member: all
   members of other components are compared with all members of the group, first on the sample bytes, then, if those
   of either kind look similar, exactly. This happens inside tiles of bounded size that hold each text once, and only
   links come out, so no list of pairs is made. The bytes of a pair right at the threshold look similar in all but one
   of some ten thousand cases.

Verification sends the text of the smaller document once per about ``FANOUT`` partners, and streams them past it. A
Bloom filter of the ids keeps all other texts where they are.

Edge cases: null texts are empty, and all texts without words are copies of each other. A text of fewer than five words
is one shingle. Rows without a doc_id belong to the class of their copies, if any has an id, else to none. Rows that
repeat a doc_id are copies of each other when their texts are equal; if they differ, each text is judged. Lower and
upper case are alike, blanks too.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarifflens.llm.bloom import filter_of, maybe_in
from tarifflens.llm.common import boxed, few, prepare, stored, whole
from tarifflens.llm.components import components

SPAN = 5
THRESHOLD = 0.8
BANDS, DEPTH = 20, 6
SAMPLES = BANDS * DEPTH
COUNTERS = 2**21
SEGMENT = 2**13
# A bag of total weight W has no sampling key below REACH / W with probability exp(-REACH).
REACH = 5.0
# Samples worked out together.
BLOCK = 8
FANOUT = 200
ROW_BLOCK, COLUMN_BLOCK = 256, 2048

ODD = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit numbers."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


class Shingles:
    """Distinct shingle hashes of texts with their counts."""

    def words(self, text: str | None) -> list[bytes]:
        return (text or "").lower().encode("utf-8", "surrogatepass").split()

    def of(self, found: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        if not found:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        h = np.array(list(map(xxhash.xxh3_64_intdigest, found)), np.uint64)
        span = min(SPAN, len(h))
        count = len(h) - span + 1
        s = h[:count]
        for k in range(1, span):
            s = s * ODD + h[k : count + k]
        return np.unique(mixed(s), return_counts=True)


def slots(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The counter of each shingle in either row of the sketch."""
    shift = np.uint64(64 - 21)
    return (s >> shift).astype(np.int64), ((s * ODD) >> shift).astype(np.int64)


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """The count sketch of shingles over all documents (2 x COUNTERS), and the number of documents."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table, shingles, rows = np.zeros((2, COUNTERS), np.int32), Shingles(), 0
        for batch in batches:
            found = [shingles.of(shingles.words(t))[0] for t in batch["text"]]
            rows += len(found)
            if found:
                for row, at in enumerate(slots(np.concatenate(found))):
                    np.add.at(table[row], at, 1)
        flat = table.reshape(-1, SEGMENT)
        for segment in range(len(flat)):
            if flat[segment].any():
                yield pd.DataFrame({"segment": [segment], "part": [zstandard.compress(flat[segment].tobytes(), 1)]})
        if rows:
            yield pd.DataFrame({"segment": [-1], "part": [np.array([rows], np.int64).tobytes()]})

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for segment, part in zip(batch["segment"], batch["part"]):
                part = np.frombuffer(part if segment < 0 else zstandard.decompress(part), np.int64 if segment < 0 else np.int32)
                sums[segment] = sums[segment] + part if segment in sums else part.astype(np.int64)
        for segment, total in sums.items():
            yield pd.DataFrame({"segment": [segment], "part": [zstandard.compress(total.tobytes(), 1)]})

    spark = docs.sparkSession
    parts = docs.select("text").mapInPandas(count, "segment int, part binary")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    merged = parts.repartition(tasks, "segment").mapInPandas(add, "segment int, part binary")
    table, rows = np.zeros(2 * COUNTERS, np.int64), 0
    for row in merged.collect():
        part = np.frombuffer(zstandard.decompress(row["part"]), np.int64)
        if row["segment"] < 0:
            rows = int(part[0])
        else:
            table[row["segment"] * SEGMENT : (row["segment"] + 1) * SEGMENT] = part
    return table.reshape(2, COUNTERS), rows


class Weights:
    """Weights of shingles, from the broadcast sketch of document frequencies less the expected load."""

    def __init__(self, excess: np.ndarray, documents: int):
        self.excess = excess
        self.documents = max(2, documents)

    def of(self, s: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Count times an inverse document frequency between 1 and 2."""
        one, other = (self.excess[row][at] for row, at in enumerate(slots(s)))
        df = np.clip(np.minimum(one, other).astype(np.float64) + 1, 1, self.documents)
        top = np.log(self.documents + 1.0)
        return counts * (1 + (top - np.log(df + 1)) / top)


def gamma_quantile(u: np.ndarray) -> np.ndarray:
    """Quantiles of the gamma distribution of shape 2, by Newton's method on x - ln(1 + x) = -ln(1 - u)."""
    y = -np.log1p(-u)
    x = np.sqrt(2 * y) + y
    for _ in range(6):
        x = x - np.divide((x - np.log1p(x) - y) * (1 + x), x, out=np.zeros_like(x), where=x > 0)
    return x


class Draws:
    """Improved consistent weighted sampling: r and c of shape 2 and beta, for each shingle and sample on its own.

    The upper half of a shingle's product holds a byte that picks one of 256 cells of c and one for r; a scramble of the
    product gives the place inside the cells, and beta. The sampling key is ln a = ln c - r (t - beta + 1) with
    t = floor(ln w / r + beta), so it is never below ln c - r - ln w, which the cells bound from below. Quantiles come
    from tables of 65,536 steps, with straight lines between them, and exactly in the first and the last cell.
    """

    def __init__(self):
        edges = np.arange(1, 2**16) / 2**16
        x = gamma_quantile(edges)
        self.ln_c, self.r = (np.concatenate([[0], v, [0]]).astype(np.float32) for v in (np.log(x), x))
        ends, step = slice(2**8, 2**16, 2**8), np.float32(1e-4)
        least = np.append(np.float32(-np.inf), self.ln_c[ends])
        most = np.append(self.r[ends], np.float32(np.inf))
        self.least = (least[:, None] - most[None, :] - step).ravel()

    def quantile(self, table: np.ndarray, u: np.ndarray, exact) -> np.ndarray:
        """Of numbers of 32 bits."""
        at = (u >> np.uint64(16)).view(np.int64)
        x, after = table.take(at), table.take(at + 1)
        x = x + (after - x) * ((u & np.uint64(0xFFFF)).astype(np.float64) / 2**16)
        outer = np.flatnonzero((at - 2**8).view(np.uint64) >= np.uint64(2**16 - 2**9))
        x[outer] = exact(gamma_quantile((u[outer] + 0.5) / 2**32))
        return x

    def keys(self, product: np.ndarray, ln_w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """ln a and t."""
        fine, top, byte = mixed(product), np.uint64(0xFF000000), np.uint64(0xFFFFFF)
        ln_c = self.quantile(self.ln_c, ((product >> np.uint64(32)) & top) | (fine >> np.uint64(40)), np.log)
        r = self.quantile(self.r, ((product >> np.uint64(24)) & top) | ((fine >> np.uint64(16)) & byte), np.abs)
        beta = ((fine & np.uint64(0xFFFF)).astype(np.float64) + 0.5) / 2**16
        t = np.floor(ln_w / r + beta)
        return ln_c - r * (t - beta + 1), t.astype(np.int64)


MULTIPLIERS = np.random.default_rng(21).integers(1, 2**63, SAMPLES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
PLAIN_MULTIPLIERS = np.random.default_rng(22).integers(1, 2**63, SAMPLES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def sample(s: np.ndarray, weights: np.ndarray, starts: np.ndarray, draws: Draws) -> np.ndarray:
    """SAMPLES samples of each bag. Bags lie one after the other; ``starts`` has where, and none is empty."""
    sizes = np.diff(np.append(starts, len(s)))
    owner = np.repeat(np.arange(len(starts)), sizes)
    ln_w = np.log(weights)
    reach = np.log(REACH) - np.log(np.add.reduceat(weights, starts))
    bound = (reach[owner] + ln_w).astype(np.float32)
    result = np.empty((SAMPLES, len(starts)), np.uint64)
    product, cell = np.empty_like(s), np.empty_like(s)
    least = np.empty(len(s), np.float32)

    def smallest(at: np.ndarray, product: np.ndarray, bag: np.ndarray, found: np.ndarray) -> np.ndarray:
        """Set the sample of each bag in question (``bag`` ascends); the smallest key of every bag."""
        key, t = draws.keys(product, ln_w[at])
        lowest = np.full(len(found), np.inf)
        if len(at):
            first = np.flatnonzero(np.append(True, bag[1:] != bag[:-1]))
            lowest[bag[first]] = np.minimum.reduceat(key, first)
        won = np.flatnonzero(key == lowest[bag])
        found[bag[won]] = mixed(s[at[won]] + t[won].view(np.uint64) * ODD)
        return lowest

    for block in range(0, SAMPLES, BLOCK):
        places, products = [], []
        for by in MULTIPLIERS[block : block + BLOCK]:
            np.multiply(s, by, out=product)
            np.right_shift(product, np.uint64(48), out=cell)
            np.take(draws.least, cell.view(np.int64), out=least, mode="clip")
            places.append(np.flatnonzero(least <= bound))
            products.append(product[places[-1]])
        at, turn = np.concatenate(places), np.repeat(np.arange(len(places)), [len(x) for x in places])
        found = result[block : block + BLOCK].reshape(-1)
        lowest = smallest(at, np.concatenate(products), turn * len(starts) + owner[at], found)
        beyond = np.flatnonzero(lowest > np.tile(reach, len(places)))
        if len(beyond):
            bag = beyond % len(starts)
            at = np.concatenate([np.arange(starts[i], starts[i] + sizes[i]) for i in bag])
            again = np.repeat(beyond, sizes[bag])
            smallest(at, s[at] * MULTIPLIERS[block + again // len(starts)], again, found)
    return result.T


def plain_sample(s: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """SAMPLES samples of the set of shingles of each bag, laid out as in ``sample``."""
    result = np.empty((len(starts), SAMPLES), np.uint64)
    for k, by in enumerate(PLAIN_MULTIPLIERS):
        result[:, k] = np.minimum.reduceat(s * by, starts)
    return result


def looks(threshold: float) -> float:
    """Step 5 passes over pairs whose sample bytes agree less than this: four deviations below the threshold."""
    return threshold - 4 * (threshold * (1 - threshold) / SAMPLES) ** 0.5


def share(docs: DataFrame, frequencies: tuple[np.ndarray, int]) -> Broadcast:
    """The packed sketch of document frequencies and the number of documents, sent to the workers once."""
    table, documents = frequencies
    excess = np.maximum(table - table.sum(axis=1, keepdims=True) / COUNTERS, 0).astype(np.float32)
    return docs.sparkSession.sparkContext.broadcast((zstandard.compress(excess.tobytes(), 1), documents))


def opened(packed: bytes, documents: int) -> Weights:
    """The weights from the shared sketch."""
    return Weights(np.frombuffer(zstandard.decompress(packed), np.float32).reshape(2, COUNTERS), documents)


def sketches(docs: DataFrame, shared: Broadcast) -> DataFrame:
    """doc_id, digest, bands (array of long; none for texts without words) and brief (a byte per sample).

    Bands and bytes of the weighted samples come first, then those of the plain ones.
    """

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weights = opened(*shared.value)
        shingles, draws = Shingles(), Draws()
        turn = mixed(np.arange(1, 2 * SAMPLES + 1, dtype=np.uint64))
        for batch in batches:
            ids = pd.array([None if pd.isna(d) else int(d) for d in batch["doc_id"]], dtype="Int64")
            found = [shingles.words(t) for t in batch["text"]]
            digests = [hashlib.blake2b(b" ".join(w), digest_size=16).digest() for w in found]
            bags = [shingles.of(w) for w in found]
            full = [i for i, (s, _) in enumerate(bags) if len(s)]
            bands = [np.zeros(0, np.int64)] * len(bags)
            brief = [b""] * len(bags)
            for part in (full[i : i + 100] for i in range(0, len(full), 100)):
                s = np.concatenate([bags[i][0] for i in part])
                counts = np.concatenate([bags[i][1] for i in part])
                starts = np.cumsum([0] + [len(bags[i][0]) for i in part[:-1]])
                drawn = np.hstack([sample(s, weights.of(s, counts), starts, draws), plain_sample(s, starts)])
                scrambled = mixed(drawn ^ turn)
                grouped = mixed(scrambled.reshape(len(part), 2 * BANDS, DEPTH).sum(axis=2)).view(np.int64)
                short = scrambled.astype(np.uint8)
                for row, i in enumerate(part):
                    bands[i], brief[i] = grouped[row], short[row].tobytes()
            yield pd.DataFrame({"doc_id": ids, "digest": digests, "bands": bands, "brief": brief})

    return docs.mapInPandas(make, "doc_id long, digest binary, bands array<long>, brief binary")


def bagger(packed: bytes, documents: int):
    """A function from a text to its shingles and their weights."""
    weights, shingles = opened(packed, documents), Shingles()

    def bag(text: str) -> tuple[np.ndarray, np.ndarray]:
        s, counts = shingles.of(shingles.words(text))
        return s, weights.of(s, counts)

    return bag


def similarities(one: tuple[np.ndarray, np.ndarray], other: tuple[np.ndarray, np.ndarray]) -> tuple[float, float]:
    """Weighted Jaccard similarity of two bags, and the plain one of their sets."""
    (s, w), (t, v) = one, other
    common, mine, theirs = np.intersect1d(s, t, assume_unique=True, return_indices=True)
    smaller = np.minimum(w[mine], v[theirs]).sum()
    return float(smaller / (w.sum() + v.sum() - smaller)), len(common) / (len(s) + len(t) - len(common))


def needed_texts(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The documents that may have one of the ids (one column); a filter of bounded size sorts the others out."""
    ids = stored(ids.distinct())
    count = ids.count()
    known = filter_of(few(ids.select(F.xxhash64(ids.columns[0]).alias("h")), count), count)
    return docs.where(maybe_in(F.col("doc_id"), known, docs))


def verify(
    docs: DataFrame, pairs: DataFrame, shared: Broadcast, threshold: float = THRESHOLD
) -> DataFrame:
    """a, b, weighted, plain: the pairs (a, b) of doc_ids of which either similarity reaches the threshold."""
    spark = docs.sparkSession
    pairs = stored(pairs)
    rows = pairs.count()
    parts = few(pairs, rows).groupBy("b").agg(F.ceil(F.count(F.lit(1)) / FANOUT).alias("parts"))
    joined = few(pairs, rows).join(stored(few(parts, rows)), "b")
    dealt = stored(few(joined, rows).select("a", "b", F.pmod(F.xxhash64("a"), F.col("parts")).alias("part")))
    partners = dealt.select(F.col("a").alias("__id"), "b", "part", F.lit(True).alias("partner"))
    centres = dealt.select(F.col("b").alias("__id"), "b", "part", F.lit(False).alias("partner")).distinct()
    needed = stored(few(centres.unionByName(partners), 2 * rows))
    asked = needed_texts(docs, needed.select("__id"))
    texts = asked.join(needed, asked["doc_id"] == needed["__id"]).select("b", "part", "partner", "doc_id", "text")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    laid = texts.repartition(tasks, "b", "part").sortWithinPartitions("b", "part", "partner", "doc_id")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bag = bagger(*shared.value)
        # The centre stays; if rows repeat its doc_id, all its texts do.
        of, centres = None, {}
        for batch in batches:
            out = []
            for b, part, partner, doc_id, text in zip(*(batch[c] for c in ("b", "part", "partner", "doc_id", "text"))):
                if (b, part) != of:
                    of, centres = (b, part), {}
                if not partner:
                    if text not in centres:
                        centres[text] = bag(text)
                    continue
                mine = bag(text)
                for centre in centres.values():
                    both = similarities(mine, centre)
                    if max(both) >= threshold:
                        out.append((doc_id, b, *both))
            yield pd.DataFrame(out, columns=["a", "b", "weighted", "plain"])

    return laid.mapInPandas(compare, "a long, b long, weighted double, plain double")


def unsettled(members: DataFrame) -> DataFrame:
    """key, n, away: buckets of several components, with the members outside that of the smallest one.

    A bucket of two has had its only pair verified.
    """
    split = members.groupBy("key").agg(
        F.count(F.lit(1)).alias("n"), F.sum((F.col("label") != F.col("home")).cast("long")).alias("away")
    )
    return split.where("n > 2 and away > 0")


def tiles(members: DataFrame) -> DataFrame:
    """node, label, brief, group, r, c, away: what step 5 compares, laid out in tiles of bounded size.

    ``members`` has key, node, label, first (smallest node of the bucket), home (its label) and brief. A group is all
    members of the unsettled buckets of one home. Those of other components (``away``) are dealt to rows and go to
    every column, all members are dealt to columns and go to every row.
    """
    inside = members.join(stored(unsettled(members)).select("key"), "key")
    group = stored(
        inside.groupBy(F.col("home").alias("group"), "node").agg(
            F.first("label").alias("label"), F.first("brief").alias("brief")
        )
    )
    away = F.col("label") != F.col("group")
    sizes = group.groupBy("group").agg(
        F.ceil(F.count(F.lit(1)) / COLUMN_BLOCK).cast("int").alias("columns"),
        F.ceil(F.sum(away.cast("long")) / ROW_BLOCK).cast("int").alias("rows"),
    )
    cut, place = group.join(stored(sizes), "group"), F.xxhash64("node")
    named = ["node", "label", "brief", "group"]
    row = cut.where(away).select(
        *named,
        F.pmod(place, "rows").cast("int").alias("r"),
        F.explode(F.sequence(F.lit(0), F.col("columns") - 1)).alias("c"),
        F.lit(True).alias("away"),
    )
    column = cut.select(
        *named,
        F.explode(F.sequence(F.lit(0), F.col("rows") - 1)).alias("r"),
        F.pmod(place, "columns").cast("int").alias("c"),
        F.lit(False).alias("away"),
    )
    return row.unionByName(column)


def settle(
    docs: DataFrame, laid: DataFrame, shared: Broadcast, threshold: float = THRESHOLD
) -> DataFrame:
    """a, b: links between different components within the tiles.

    Only members whose samples of some kind look similar are compared exactly. A member that has found a link to a component in
    its tile looks for no other to that one, since one link joins the two.
    """
    spark = docs.sparkSession
    laid = stored(laid)
    texts = needed_texts(docs, laid.select("node")).select("doc_id", "text")
    rows = laid.join(texts, laid["node"] == texts["doc_id"]).drop("doc_id")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartition(tasks, "group", "r", "c").sortWithinPartitions("group", "r", "c", F.desc("away"), "node")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bag, alike = bagger(*shared.value), looks(threshold)
        tile, held, samples, linked = None, [], [], set()
        names = ("group", "r", "c", "away", "node", "label", "brief", "text")
        for batch in batches:
            found = []
            for group, r, c, away, node, label, brief, text in zip(*(batch[x] for x in names)):
                if (group, r, c) != tile:
                    tile, held, samples, linked = (group, r, c), [], [], set()
                own = np.frombuffer(brief, np.uint8)
                if away:
                    held.append((node, label, bag(text)))
                    samples.append(own)
                    continue
                if isinstance(samples, list):
                    samples = np.stack(samples) if samples else np.zeros((0, len(own)), np.uint8)
                mine = None
                same = (samples == own).reshape(len(samples), len(own) // SAMPLES, SAMPLES).mean(axis=2)
                for k in np.flatnonzero((same >= alike).any(axis=1)):
                    other, other_label, other_bag = held[k]
                    if other == node or other_label == label or (other, label) in linked:
                        continue
                    mine = mine or bag(text)
                    if max(similarities(mine, other_bag)) >= threshold:
                        linked.add((other, label))
                        found.append((max(node, other), min(node, other)))
            yield pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return ordered.mapInPandas(compare, "a long, b long").distinct()


def classes(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, class_id and digest, one row per row of the documents. class_id is the smallest doc_id of the class."""
    prepare(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole(F.col("text")).alias("text"))
    shared = share(docs, document_frequencies(docs))
    made = stored(sketches(docs, shared))
    # Rows of one digest have the same words, and so the same bands and bytes.
    digests = stored(
        made.groupBy("digest").agg(
            F.min("doc_id").alias("node"), F.first("bands").alias("bands"), F.first("brief").alias("brief")
        )
    )
    nodes = digests.where("node is not null")
    # Exploded twice rather than stored: the keys take more room than the digests they come from.
    banded = nodes.select("node", F.posexplode("bands")).select("node", F.xxhash64("pos", "col").alias("key"))
    buckets = stored(
        banded.groupBy("key").agg(F.min("node").alias("first"), F.max("node").alias("last")).where("first < last").drop("last")
    )
    members = stored(banded.join(buckets, "key"))
    star = members.where(F.col("node") != F.col("first")).select(F.col("node").alias("a"), F.col("first").alias("b"))
    links = stored(verify(docs, star.distinct(), shared, threshold).select("a", "b"))
    found = stored(components(links))
    members = stored(members.join(nodes.select("node", "brief"), "node"))
    labels = found.select("node", "label")
    homes = found.select(F.col("node").alias("first"), F.col("label").alias("home"))
    labelled = members.join(labels, "node", "left").join(homes, "first", "left")
    labelled = labelled.withColumns({"label": F.coalesce("label", "node"), "home": F.coalesce("home", "first")})
    more = stored(settle(docs, tiles(stored(labelled)), shared, threshold))
    if not more.isEmpty():
        # The components found so far are as good as all their links.
        known = found.select(F.col("node").alias("a"), F.col("label").alias("b"))
        found = stored(components(known.unionByName(more)))
    names = digests.join(found, "node", "left").select("digest", F.coalesce("label", "node").alias("class_id"))
    return made.select("doc_id", "digest").join(stored(names), "digest").select("doc_id", "class_id", "digest")


@F.pandas_udf(T.BinaryType())
def _digest(texts: pd.Series) -> pd.Series:
    words = Shingles().words
    return texts.map(lambda t: hashlib.blake2b(b" ".join(words(t)), digest_size=16).digest())


def keep_first(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One document of each class, the one of the smallest doc_id, with its own columns.

    Rows without a doc_id stay. Rows that repeat a doc_id are decided text by text: each different one stays unless it
    is a near copy of a smaller doc_id, and equal ones stay once.
    """
    found = stored(classes(docs, threshold))
    counts = found.where("doc_id is not null").groupBy(F.col("doc_id").alias("__id")).count()
    repeated = stored(counts.where("count > 1").select("__id"))
    gone = found.where(F.col("doc_id") != F.col("class_id")).select(F.col("doc_id").alias("__id")).distinct()
    own = found.where(F.col("doc_id") == F.col("class_id")).select(F.col("doc_id").alias("__id"), F.col("digest").alias("__digest"))
    stay = own.join(repeated, "__id", "left_semi").distinct()
    touched = stored(
        gone.join(repeated, "__id", "left_anti").withColumn("__many", F.lit(False)).unionByName(repeated.withColumn("__many", F.lit(True)))
    )
    # Only documents that may be among those move; the others pass in the scan.
    known = filter_of(touched.select(F.xxhash64("__id").alias("h")), touched.count())
    maybe = maybe_in(F.col("doc_id").cast("long"), known, docs)
    asked = boxed(docs.where(maybe)).join(touched, F.col("row.doc_id") == F.col("__id"), "left")
    once = asked.where("__many is null").select("row.*")
    many = asked.where("__many").withColumn("__digest", _digest(whole(F.col("row.text"))))
    again = many.join(stay, ["__id", "__digest"], "left_semi").dropDuplicates(["__id", "__digest"]).select("row.*")
    return docs.where(~maybe).unionByName(once).unionByName(again)
