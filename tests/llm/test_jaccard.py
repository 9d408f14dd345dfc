"""The n-gram Jaccard join against all pairs, its steps, and edge cases."""

import random
import re

import numpy as np
import pytest

from tarifflens.llm import jaccard_join, queries
from tests.conftest import MEDIUM, SMALL

SCHEMA = "doc_id long, text string, node binary, label int, token string"


def plain_set(text):
    found = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not found:
        return frozenset()
    span = min(4, len(found))
    return frozenset(tuple(found[i : i + span]) for i in range(len(found) - span + 1))


def plain(rows):
    """(doc_id, n_shingles, component_id) by comparing each set with all that share a shingle."""
    sets = [plain_set(text) for _, text in rows]
    parent = list(range(len(rows)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    holders = {}
    for i, s in enumerate(sets):
        common = {}
        for x in s:
            for j in holders.get(x, ()):
                common[j] = common.get(j, 0) + 1
            holders.setdefault(x, []).append(i)
        for j, n in common.items():
            if 100 * n >= 85 * (len(s) + len(sets[j]) - n):
                parent[top(i)] = top(j)
    ids = {}
    for i, (doc_id, _) in enumerate(rows):
        ids.setdefault(top(i), []).append(doc_id)
    least = {t: min((d for d in group if d is not None), default=None) for t, group in ids.items()}
    return [(doc_id, len(sets[i]), least[top(i)]) for i, (doc_id, _) in enumerate(rows)]


def bag(rows):
    return sorted(map(repr, rows))


def check(spark, rows):
    frame = spark.createDataFrame([(d, t, None, 0, "") for d, t in rows], SCHEMA).repartition(5)
    found = jaccard_join.linked_components(frame)
    assert found.columns == ["doc_id", "n_shingles", "component_id"]
    assert bag(tuple(r) for r in found.collect()) == bag(plain(rows))


@pytest.mark.parametrize("folder", [SMALL, MEDIUM])
def test_the_given_table(spark, folder):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    found = queries.op13_ngram_jaccard_join(spark, folder)
    wanted = plain(rows)
    assert bag(tuple(r) for r in found.collect()) == bag(wanted)
    assert len({c for _, _, c in wanted}) < len(rows)


def edited(words, rng, share):
    return [rng.choice(("new", "other", "word")) + str(rng.random()) if rng.random() < share else w for w in words]


def test_groups_about_the_threshold(spark):
    """Copies whose similarity lies on both sides of the threshold, short and long, with passages that all share."""
    rng = random.Random(1)
    vocabulary, texts = [f"w{i}" for i in range(3000)], []
    passage = rng.choices(vocabulary, k=50)
    for _ in range(25):
        base = rng.choices(vocabulary, k=rng.choice((3, 6, 9, 30, 120, 400)))
        for share in (0, 0.005, 0.01, 0.02, 0.03, 0.04, 0.05):
            texts += [" ".join(edited(base, rng, share)) for _ in range(3)]
        texts.append(" ".join(base[: len(base) * 9 // 10]))
    texts += [" ".join([*passage, *rng.choices(vocabulary, k=rng.randint(0, 30))]) for _ in range(60)]
    check(spark, [(i * 7 % 1009, t) for i, t in enumerate(texts)])


def test_chains_are_followed(spark):
    """Each text links with the next one only."""
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(words[8 * k : 8 * k + 120]) for k in range(30)]
    sets = [plain_set(t) for t in texts]
    assert 0.85 <= len(sets[0] & sets[1]) / len(sets[0] | sets[1]) and len(sets[0] & sets[2]) / len(sets[0] | sets[2]) < 0.85
    check(spark, [(100 - i, t) for i, t in enumerate(texts)])


def test_unlike_members_of_one_list(spark):
    """Texts from a small stock of passages: every list has many members, hardly any of them alike."""
    rng = random.Random(2)
    stock = [" ".join(f"p{k}w{i}" for i in range(12)) for k in range(40)]
    texts = [" ".join(rng.sample(stock, 8)) for _ in range(500)]
    texts += [t.replace("p1w1 ", "") for t in texts[:40]]
    check(spark, list(enumerate(texts)))


def test_small_tiles_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "TILE_SETS", 7)
    monkeypatch.setattr(jaccard_join, "TILE_MEMBERS", 11)
    monkeypatch.setattr(jaccard_join, "FANOUT", 3)
    rng = random.Random(3)
    base = [f"w{i}" for i in range(150)]
    texts = [" ".join(edited(base, rng, share)) for share in (0.01, 0.02, 0.03, 0.04) for _ in range(60)]
    check(spark, list(enumerate(texts)))


def test_sets_of_a_large_group_are_not_compared_in_pairs(spark):
    """Pairs with the leader are as many as members, and once linked none of them is left for the tiles."""
    rng = random.Random(4)
    base = [f"w{i}" for i in range(400)]
    texts = [" ".join([*base[:k], f"x{k}", *base[k + 1 :]]) for k in rng.sample(range(400), 300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    made = jaccard_join.described(docs)
    shared = jaccard_join.share(docs, jaccard_join.filters(jaccard_join.repeated(made.where("range is not null"))))
    members = jaccard_join.lists(docs, shared)
    pairs = jaccard_join.star(members, jaccard_join.outlines(made.where("range is null")))
    assert pairs.count() < 20 * 300
    nodes = members.select("node").distinct()
    tied = jaccard_join.relations(pairs, jaccard_join.needed_sets(docs, made.where("range is null"), nodes))
    found = jaccard_join.components(tied, "node", "leader")
    assert jaccard_join.unsettled(jaccard_join.labelled(members, found)).isEmpty()


def test_answers_are_derived(spark):
    """Overlaps by relation equal those counted, and lists are left only where nothing can link."""
    rng = np.random.default_rng(5)
    order = jaccard_join.Order([])
    tokens = np.unique(rng.integers(0, 2**64, 300, dtype=np.uint64))
    sets = [np.sort(rng.choice(tokens, size, replace=False)) for size in rng.integers(1, 290, 200)]
    tile = jaccard_join.Tile([(bytes([i]), b"", s) for i, s in enumerate(sets)], order)
    leader = sets[0]
    for k in range(400):
        s = np.sort(rng.choice(tokens, rng.integers(1, 290), replace=False)) if k % 2 else np.delete(sets[k // 2], 0)
        wanted = [len(np.intersect1d(s, t)) for t in sets]
        lacks, has = np.setdiff1d(leader, s), np.setdiff1d(s, leader)
        assert (tile.counts(leader) - tile.counts(lacks) + tile.counts(has)).tolist() == wanted == tile.counts(s).tolist()
        linked = [i for i, (n, t) in enumerate(zip(wanted, sets)) if 100 * n >= 85 * (len(s) + len(t) - n)]
        assert tile.linked(np.array(wanted), len(s)).tolist() == linked
        if linked and len(s):
            assert tile.met(order.of(s)[: jaccard_join.prefix(len(s))], len(s))


def test_documents_are_counted_exactly(spark, monkeypatch):
    """Shingles of several documents, by brute force, with parts of a few shingles only; all of them are in the filters."""
    monkeypatch.setattr(jaccard_join, "PACKED", 500)
    rng = random.Random(7)
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(rng.choices(words, k=rng.randint(0, 40)) + words[: rng.randint(0, 30)]) for _ in range(400)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    found = jaccard_join.repeated(jaccard_join.described(docs).where("range is not null"))
    counts = {}
    for text in texts:
        for h in jaccard_join.counted_bits(jaccard_join.shingles(text)).tolist():
            counts[h] = counts.get(h, 0) + 1
    several = np.array([h for h, n in counts.items() if n > 1], np.uint64)
    wanted = dict(zip(jaccard_join.scrambled(several).view(np.int64).tolist(), (counts[h] for h in several.tolist())))
    assert {r["hash"]: r["n"] for r in found.collect()} == wanted
    order = jaccard_join.Order(jaccard_join.share(docs, jaccard_join.filters(found)).value)
    every = np.unique(np.concatenate([jaccard_join.shingles(t) for t in texts]))
    wanted = [sum(counts[h] >= level for level in jaccard_join.LEVELS) for h in jaccard_join.counted_bits(every).tolist()]
    assert (order.levels(every) >= wanted).all() and (order.levels(every) == wanted).mean() > 0.99


def test_outlines_never_understate(spark):
    rng = np.random.default_rng(6)
    for _ in range(300):
        tokens = rng.integers(0, 2**64, rng.integers(1, 3000), dtype=np.uint64)
        if rng.random() < 0.2:
            tokens &= ~np.uint64(1023)  # all in one bucket, beyond what a byte can hold
        one, other = (np.unique(rng.choice(tokens, max(1, int(len(tokens) * rng.uniform(0.8, 1))))) for _ in range(2))
        drawn = [jaccard_join.outline(s) for s in (one, other)]
        length = min(map(len, drawn))
        a, b = (jaccard_join.opened([d], length) for d in drawn)
        shared = len(np.intersect1d(one, other))
        may = jaccard_join.may_link(a, np.int64(len(one)), b, np.int64(len(other)))[0]
        assert may or 100 * shared < 85 * (len(one) + len(other) - shared)
    unlike = [np.unique(rng.integers(0, 2**64, 500, dtype=np.uint64)) for _ in range(40)]
    table = jaccard_join.opened([jaccard_join.outline(s) for s in unlike], jaccard_join.outline_length(500))
    for i, s in enumerate(unlike):
        may = jaccard_join.may_link(table, np.full(40, 500), table[i : i + 1], np.int64(500))
        assert np.flatnonzero(may).tolist() == [i]


def test_edges(spark):
    long = " ".join(f"word{i}" for i in range(60_000))
    rows = [
        (1, "One two three four five six"),
        (2, "one TWO three\tfour\nfive six "),
        (2, "entirely other words than those above"),
        (3, None),
        (4, ""),
        (5, " \n\t "),
        (6, "one two"),
        (7, "ONE  two"),
        (8, "two one"),
        (None, "one two"),
        (None, "nothing like it, and no id"),
        (None, "nothing like it, and no id"),
        (None, None),
        (9, long),
        (10, long + " end"),
        (11, "ÄÖ one two three"),
        (12, "äö one two three"),
        (13, "no\xa0break here now"),
        *[(14, "the same row again and again")] * 50,
    ]
    check(spark, rows)
    empty = jaccard_join.linked_components(spark.createDataFrame([], SCHEMA))
    assert empty.collect() == [] and empty.columns == ["doc_id", "n_shingles", "component_id"]


def test_components_of_few_pairs_take_few_tasks(spark):
    """Small graphs leave few files and task logs, however many shuffle partitions there are."""
    rng = random.Random(3)
    pairs = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(1000, 1001 + i) for i in range(50)]
    least = {n: n for pair in pairs for n in pair}
    for _ in least:
        for a, b in pairs:
            least[a] = least[b] = min(least[a], least[b])
    settings = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        found = jaccard_join.components(spark.createDataFrame(pairs, "a long, b long"))
        assert found.rdd.getNumPartitions() <= 16
        rows = [tuple(r) for r in found.collect()]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    linked = {n for a, b in pairs if a != b for n in (a, b)}
    assert sorted(rows) == sorted((n, least[n]) for n in linked)
