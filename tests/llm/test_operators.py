"""Each operator against brute force, a public library or held-out rows."""

import hashlib
import random
import re
import textwrap
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from tarifflens.llm import (
    bloom,
    byte_bpe,
    compression_quality,
    fingerprints,
    license_rules,
    line_dedup,
    link_trust,
    near_dedup,
    packing,
    pu_toxicity,
    robust_outliers,
)
from tarifflens.llm.components import components
from tarifflens.llm.queries import LLM_QUERIES, llm_sql
from tests.compare import connect, difference
from tests.conftest import MEDIUM, SMALL

TENTH = "/root/testdata/sf0.1"


def documents(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet")


def test_all_registered():
    assert set(LLM_QUERIES) | {"pipeline"} <= set(entry.queries())
    assert set(llm_sql()) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", list(llm_sql()))
@pytest.mark.parametrize("folder", [SMALL, MEDIUM])
def test_twins(spark, name, folder):
    assert difference(spark, connect(folder), folder, LLM_QUERIES[name], llm_sql()[name]) is None


# Line dedup


def test_filters_miss_no_repeat():
    rng = np.random.default_rng(1)
    keys = rng.integers(0, 2**64, 3000, dtype=np.uint64)
    seen = line_dedup.SeenFilters(2**13)
    seen.add(np.concatenate([keys, keys[:500]]))
    seen.add(keys[500:700])
    suspected = bloom.hits(keys, seen.twice)
    assert suspected[:700].all() and suspected[700:].mean() < 0.05


# Near duplicates


def edits(words, rng, share):
    words = list(words)
    for at in rng.sample(range(len(words)), int(len(words) * share)):
        words[at] = f"edit{rng.random()}"
    return words


def test_near_dedup_against_all_pairs(spark):
    rng = random.Random(4)
    rows, vocabulary = [], [f"w{i}" for i in range(5000)]
    passage = " ".join(rng.choices(vocabulary, k=60))
    for group in range(12):
        base = rng.choices(vocabulary, k=rng.randint(60, 400))
        rows += [" ".join(edits(base, rng, share)) for share in (0, 0.005, 0.01, 0.02, 0.03, 0.05)]
        rows.append(" ".join(base))
    rows += [passage + " " + " ".join(rng.choices(vocabulary, k=80)) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    table, count = near_dedup.document_frequencies(docs)
    assert count == len(rows)
    weights, shingles = near_dedup.opened(*near_dedup.share(docs, (table, count)).value), near_dedup.Shingles()
    bags = []
    for text in rows:
        s, n = shingles.of(shingles.words(text))
        bags.append(dict(zip(s.tolist(), weights.of(s, n).tolist())))
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            every = bags[i].keys() | bags[j].keys()
            low = sum(min(bags[i].get(s, 0), bags[j].get(s, 0)) for s in every)
            high = sum(max(bags[i].get(s, 0), bags[j].get(s, 0)) for s in every)
            if low >= 0.8 * high or len(bags[i].keys() & bags[j].keys()) >= 0.8 * len(every):
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    found = {r.doc_id: r.class_id for r in near_dedup.classes(docs).collect()}
    assert [found[i] for i in range(len(rows))] == label
    assert len(set(label)) < len(rows) - 30  # most edits are near, unrelated texts with a common passage are not
    assert [found[i] for i in range(84, len(rows))] == list(range(84, len(rows)))


@pytest.mark.parametrize("size, times", [(1, 40), (12, 40), (300, 80), (5_000, 60), (100_000, 40)])
def test_samples_agree_like_weighted_jaccard(size, times):
    """At any length, with weights of little spread and with counts up to a million."""
    rng = np.random.default_rng(3)
    draws, agreed, wanted = near_dedup.Draws(), [], []
    for _ in range(times):
        s = np.unique(rng.integers(0, 2**64, size, dtype=np.uint64))
        x = rng.uniform(1, 2, len(s)) * np.where(rng.random(len(s)) < 0.01, 10.0 ** rng.integers(0, 7, len(s)), 1)
        y = np.where(rng.random(len(s)) < 0.6, x, rng.uniform(1, 3, len(s)))
        both = near_dedup.sample(np.concatenate([s, s]), np.concatenate([x, y]), np.array([0, len(s)]), draws)
        agreed.append((both[0] == both[1]).mean())
        wanted.append(np.minimum(x, y).sum() / np.maximum(x, y).sum())
    error = 0.02 if size >= 300 else 0.04
    assert abs(np.mean(agreed) - np.mean(wanted)) < error


def test_samples_of_a_bag_do_not_depend_on_its_neighbours():
    """Shingles passed over by their bounds are those that could not win."""
    rng = np.random.default_rng(4)
    draws = near_dedup.Draws()
    sizes = [1, 2, 700, 30, 5_000]
    s = rng.integers(0, 2**64, sum(sizes), dtype=np.uint64)
    w = rng.uniform(1, 40, len(s))
    starts = np.cumsum([0, *sizes[:-1]])
    found = near_dedup.sample(s, w, starts, draws)
    for k, (start, size) in enumerate(zip(starts, sizes)):
        bag, weights = s[start : start + size], w[start : start + size]
        assert (near_dedup.sample(bag, weights, np.array([0]), draws)[0] == found[k]).all()
        for j, by in enumerate(near_dedup.MULTIPLIERS):
            key, t = draws.keys(bag * by, np.log(weights))
            best = int(key.argmin())
            assert found[k][j] == near_dedup.mixed(bag[best : best + 1] + t[best : best + 1].view(np.uint64) * near_dedup.ODD)[0]


def test_gamma_quantiles():
    x = np.array([1e-4, 0.01, 0.5, 1, 3, 10, 20])
    u = 1 - (1 + x) * np.exp(-x)
    assert np.allclose(near_dedup.gamma_quantile(u), x, rtol=1e-6)
    draws, places = near_dedup.Draws(), np.arange(0, 2**32, 2**32 // 9973, dtype=np.uint64)
    found = draws.quantile(draws.r, places, np.abs)
    assert np.allclose(found, near_dedup.gamma_quantile((places + 0.5) / 2**32), rtol=1e-5) and (np.diff(found) > 0).all()


def test_buckets_are_compared_to_the_end(spark):
    """Members unlike the smallest one of their bucket still find each other."""
    rng = np.random.default_rng(5)
    one, other = (rng.integers(0, 256, near_dedup.SAMPLES, dtype=np.uint8).tobytes() for _ in range(2))
    rows = [(7, 1, 1, 1, 1, one), (7, 2, 2, 1, 1, other), (7, 3, 3, 1, 1, other), (8, 4, 4, 4, 4, one), (8, 5, 5, 4, 4, one)]
    members = spark.createDataFrame(rows, "key long, node long, label long, first long, home long, brief binary")
    text = " ".join(f"w{i}" for i in range(50))
    texts = [(1, "unlike"), (2, text), (3, text + " more"), (4, text), (5, text)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    assert [tuple(r) for r in near_dedup.unsettled(members).collect()] == [(7, 3, 2)]
    laid = near_dedup.tiles(members)
    assert laid.count() == 5  # two away, three members; the bucket of two is settled
    found = near_dedup.settle(docs, laid, near_dedup.share(docs, near_dedup.document_frequencies(docs)))
    assert [tuple(r) for r in found.collect()] == [(3, 2)]


def test_plain_similarity_finds_candidates_in_large_groups(spark):
    """Where a third of ten million documents share their shingles, pairs of plain similarity 0.8 are candidates too."""
    rng = random.Random(6)
    base = [f"w{i}" for i in range(400)]
    shingles = near_dedup.Shingles()
    table = np.zeros((2, near_dedup.COUNTERS), np.int64)
    for row, at in enumerate(near_dedup.slots(shingles.of([w.encode() for w in base])[0])):
        table[row][at] = 3_300_000
    texts = []
    for _ in range(600):  # two of them are alike to 396 / (396 + 2 * 47)
        texts.append(" ".join([*base, *(f"own{rng.random()}" for _ in range(47))]))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    made = {r.doc_id: r for r in near_dedup.sketches(docs, near_dedup.share(docs, (table, 10_000_000))).collect()}
    pairs, missed, unlike = 0, 0, 0
    for i in range(0, 600, 2):
        a, b = (set(shingles.of(shingles.words(texts[k]))[0].tolist()) for k in (i, i + 1))
        assert 0.8 <= len(a & b) / len(a | b) < 0.81
        pairs += 1
        missed += not any(x == y for x, y in zip(made[i].bands, made[i + 1].bands))
        x, y = (np.frombuffer(made[k].brief, np.uint8).reshape(-1, near_dedup.SAMPLES) for k in (i, i + 1))
        unlike += (x == y).mean(axis=1).max() < 0.8 - 4 * (0.8 * 0.2 / near_dedup.SAMPLES) ** 0.5
    assert pairs > 100 and missed <= 0.02 * pairs and unlike <= 0.01 * pairs


def test_plain_bytes_alone_lead_to_comparison(spark):
    rng = np.random.default_rng(7)
    text = " ".join(f"w{i}" for i in range(50))
    half, other, plain = (rng.integers(0, 256, near_dedup.SAMPLES, dtype=np.uint8).tobytes() for _ in range(3))
    laid = [(2, 2, half + plain, 1, 0, 0, True), (3, 3, other + plain, 1, 0, 0, False)]
    laid = spark.createDataFrame(laid, "node long, label long, brief binary, group long, r int, c int, away boolean")
    docs = spark.createDataFrame([(2, text), (3, text)], "doc_id long, text string")
    found = near_dedup.settle(docs, laid, near_dedup.share(docs, near_dedup.document_frequencies(docs)))
    assert [tuple(r) for r in found.collect()] == [(3, 2)]


def test_components_against_union_find(spark):
    rng = random.Random(2)
    pairs = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(150)] + [(1000 + i, 1001 + i) for i in range(40)]
    label = {x: x for p in pairs for x in p if p[0] != p[1]}
    for a, b in pairs * 50:
        if a != b:
            label[a] = label[b] = min(label[a], label[b])
    found = components(spark.createDataFrame(pairs, "a long, b long")).collect()
    assert {r["node"]: r["label"] for r in found} == label and len(found) == len(label)


# Robust outliers


def slow_repeats(words):
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    times, hit = Counter(windows), set()
    for i, w in enumerate(windows):
        if times[w] > 1:
            hit |= {i, i + 1, i + 2}
    return len(hit)


def test_statistics(spark):
    for r in documents(spark, MEDIUM).select("text").collect():
        found = re.findall(r"[^\x20\x09-\x0D]+", r.text)
        lines = [x for x in r.text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert robust_outliers.measure(r.text) == (
            len(found),
            sum(map(len, found)),
            len(re.findall(r"[#*$%&|<>]", r.text)),
            len(lines) - len(set(lines)),
            slow_repeats(found),
            len(re.findall("[A-Z]", r.text)),
        )


def test_outliers(spark):
    rows = {r.doc_id: r for r in robust_outliers.judged_documents(documents(spark, TENTH)).collect()}
    labels = spark.read.parquet(f"{TENTH}/labels.parquet").collect()
    good = [rows[r.doc_id] for r in labels if r.quality == 1 and not rows[r.doc_id].base_failed]
    bad = [rows[r.doc_id] for r in labels if r.quality == 0]
    assert np.mean([r.kept for r in good]) > 0.99 and np.mean([r.kept for r in bad]) < 0.4


def test_groups_of_mostly_failed_rows_are_judged(spark):
    rng = np.random.default_rng(1)

    def row(n, source, words=None, symbols=None):
        words = int(rng.integers(200, 400)) if words is None else words
        return (n, "en", source, words, 5 * words, words // 50 if symbols is None else symbols, 0, 0, words // 10, words < 50)

    rows = [row(n, "junky") for n in range(30)] + [row(30, "junky", 300, 3000)]
    rows += [row(n, "junky", 10) for n in range(31, 100)] + [row(n, "failed", 10) for n in range(100, 170)]
    rows += [row(n, f"small{n % 4}") for n in range(200, 360)]
    # The only small group of its language is judged with the next larger one.
    other = [row(n, "large") for n in range(400, 600)] + [row(n, "next") for n in range(600, 670)]
    other += [row(n, "left") for n in range(700, 720)] + [row(720, "left", 300, 3000)]
    rows += [(n, "de", *r) for n, _, *r in other]
    schema = f"doc_id long, lang string, source string, {robust_outliers.STATISTICS}, base_failed boolean"
    judged = {r.doc_id: r for r in robust_outliers.judge(spark.createDataFrame(rows, schema)).collect()}
    assert len(judged) == len(rows) and all(judged[n].distance is not None for n in judged if not 31 <= n < 170)
    assert not judged[30].kept and not judged[720].kept and all(judged[n].kept for n in range(30))
    assert not any(judged[n].kept for n in range(31, 170))


def test_estimate_resists_contamination(spark):
    rng = np.random.default_rng(0)
    good = rng.multivariate_normal(np.full(6, 5.0), np.diag(np.arange(1, 7)), 3000)
    bad = rng.normal(60, 1, (600, 6))
    data = [("p", [float(v) for v in x]) for x in np.vstack([good, bad])]
    found = robust_outliers.estimates(spark.createDataFrame(data, "pool string, x array<double>")).first()
    assert np.abs(np.array(found.center) - 5).max() < 0.3
    spread = [1 / found.precision[robust_outliers.PAIRS.index((i, i))] for i in range(6)]
    assert np.allclose(spread, np.arange(1, 7) + np.square(robust_outliers.FLOORS), rtol=0.35)


# Licences


def test_licence_rules(spark):
    bsd2 = ["bsd-grant", "bsd-source", "bsd-binary", "bsd-as-is"]
    s = license_rules.SENTENCES
    texts = {
        1: "Copyright (c) 2024 A. Nobody\n\n" + ".\n".join(s[x].upper() for x in bsd2) + ".",
        2: ". ".join(s[x] for x in [*bsd2[:3], "bsd-endorse", bsd2[3]]) + ". All rights reserved.",
        3: ". ".join(s[x] for x in reversed(bsd2)),
        4: "Released under the MIT\nlicense. Licensed under the Apache License, Version 2.0.",
        5: "not released under the MIT license",
    }
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    found = {r.doc_id: r.licences for r in license_rules.scan(docs).collect()}
    assert found == {
        1: ["BSD-2-Clause"],
        2: ["BSD-3-Clause", "all-rights-reserved"],
        3: [],
        4: ["MIT", "Apache-2.0"],
        5: [],
    }


STANDARD = {
    "Apache-2.0": [
        "Copyright 2024 A. Nobody",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance '
        "with the License. You may obtain a copy of the License at",
        "http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed "
        'on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License '
        "for the specific language governing permissions and limitations under the License.",
    ],
    "GPL-3.0-or-later": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the "
        "implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU General Public License "
        "for more details.",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was "
        "not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ],
    "BSD-2-Clause": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met:",
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the "
        "following disclaimer.",
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the "
        "following disclaimer in the documentation and/or other materials provided with the distribution.",
        'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED '
        "WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A "
        "PARTICULAR PURPOSE ARE DISCLAIMED.",
    ],
}


def test_standard_texts_as_published(spark):
    rows = []
    for licence, paragraphs in STANDARD.items():
        rows.append((licence, "one line", " ".join(paragraphs)))
        for width in (*range(30, 100, 3), 10_000):
            filled = "\n\n".join(textwrap.fill(x, width, break_long_words=False, break_on_hyphens=False) for x in paragraphs).split("\n")
            for mark in ("", "    ", "# ", "// ", " * ", "-- "):
                text = "\n".join((mark + line).rstrip() for line in filled)
                rows.append((licence, f"{mark}{width}", f"/*\n{text}\n */" if "*" in mark else text))
    docs = spark.createDataFrame(rows, "licence string, form string, text string")
    assert [r[:2] for r in license_rules.scan(docs).collect() if r.licences != [r.licence]] == []


GNU = {
    "GPL-2.0-or-later": ("program", "General", "2", ";"),
    "LGPL-2.1-or-later": ("library", "Lesser General", "2.1", ";"),
    "LGPL-3.0-or-later": ("library", "Lesser General", "3", ","),
    "AGPL-3.0-or-later": ("program", "Affero General", "3", ","),
}


def test_gnu_notices(spark):
    rows = []
    for licence, (work, name, version, mark) in GNU.items():
        paragraphs = [
            f"This {work} is free software{':' if mark == ',' else ';'} you can redistribute it and/or modify it under the "
            f"terms of the GNU {name} Public License as published by the Free Software Foundation{mark} either version "
            f"{version} of the License, or (at your option) any later version.",
            f"This {work} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the "
            f"implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} Public License "
            "for more details.",
        ]
        for width in (*range(34, 100, 5), 10_000):
            filled = "\n\n".join(textwrap.fill(x, width, break_long_words=False, break_on_hyphens=False) for x in paragraphs)
            rows += [(licence, f"{m}{width}", "\n".join((m + x).rstrip() for x in filled.split("\n"))) for m in ("", "# ", "// ")]
    docs = spark.createDataFrame(rows, "licence string, form string, text string")
    assert [r[:2] for r in license_rules.scan(docs).collect() if r.licences != [r.licence]] == []


def test_several_licences_in_one_text(spark):
    two = STANDARD["BSD-2-Clause"]
    endorse = (
        "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
        "products derived from this software without specific prior written permission."
    )
    three = [*two[:3], endorse, two[3]]
    texts = [[*two, *three], [*three, *two], three, [*three, *STANDARD["Apache-2.0"]], [*two, *two]]
    wanted = [["BSD-3-Clause", "BSD-2-Clause"]] * 2 + [["BSD-3-Clause"], ["BSD-3-Clause", "Apache-2.0"], ["BSD-2-Clause"]]
    docs = spark.createDataFrame([(i, "\n\n".join(x)) for i, x in enumerate(texts)], "doc_id long, text string")
    assert [r.licences for r in license_rules.scan(docs).orderBy("doc_id").collect()] == wanted


def test_a_rule_inside_a_longer_one(spark):
    known = {"a": "one", "b": "two", "c": "three"}
    rules = [("long", ["a", "b", "c"]), ("short", ["b"])]
    texts = ["One. Two. Three.", "Two. One. Two. Three.", "Two.", "One. Two. One. Two. Three."]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = [r.licences for r in license_rules.scan(docs, known, rules).orderBy("doc_id").collect()]
    assert found == [["long"], ["long", "short"], ["short"], ["long", "short"]]


def test_spdx_lines(spark):
    lines = ["// SPDX-License-Identifier: {}\npackage main", "/* SPDX-License-Identifier: {} */\n#include <a.h>", "# SPDX-License-Identifier: {}"]
    rows = [(x, line.format(x)) for x in license_rules.SPDX for line in lines]
    docs = spark.createDataFrame(rows, "licence string, text string")
    assert [r.text for r in license_rules.scan(docs).collect() if r.licences != [r.licence]] == []
    unknown = spark.createDataFrame([("SPDX-License-Identifier: Nothing-1.0",), ("the MIT people said: MIT.",)], "text string")
    assert [r.licences for r in license_rules.scan(unknown).collect()] == [[], []]


def test_list_items_stay_apart(spark):
    docs = spark.createDataFrame([("* released under the mit license\n* all rights reserved",)], "text string")
    assert license_rules.scan(docs).first().licences == ["MIT", "all-rights-reserved"]


def test_licence_plan_is_native(spark):
    plan = LLM_QUERIES["op4_license_rules"](spark, SMALL)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Exchange" not in plan


# Packing


def naive_pack(pieces, capacity):
    bins, result = [], []
    for length, source, cluster in pieces:
        fits = [
            (capacity - used, i)
            for i, (used, sources, clusters) in enumerate(bins)
            if used + length <= capacity and source not in sources and cluster not in clusters
        ]
        if fits:
            number = min(fits)[1]
        else:
            number = len(bins)
            bins.append([0, set(), set()])
        result.append((number, bins[number][0]))
        bins[number][0] += length
        bins[number][1] |= {source} - {None}
        bins[number][2] |= {cluster} - {None}
    return result


@pytest.mark.parametrize("seed", range(5))
def test_packing_against_naive(seed):
    rng = random.Random(seed)
    pieces = [
        (rng.randint(0, 100), rng.choice(["a", "a", "b", "c", None]), rng.choice([None, *range(20)])) for _ in range(400)
    ]
    pieces.sort(key=lambda p: -p[0])
    assert packing.pack_shard(pieces, 100) == naive_pack(pieces, 100)


def test_packed_documents(spark):
    docs = documents(spark, MEDIUM)
    rows = packing.pack(docs, per_shard=100).collect()
    size = {r.doc_id: (len(re.findall(r"[^\x20\x09-\x0D]+", r.text)), r.source, r.text) for r in docs.collect()}
    bins, total = {}, Counter()
    for r in rows:
        bins.setdefault(r.bin_id, []).append(r)
        total[r.doc_id] += r.length
    assert total == {d: s[0] for d, s in size.items()}
    for held in bins.values():
        held.sort(key=lambda r: (r.bin_offset, r.length))
        assert [r.bin_offset for r in held] == [sum(x.length for x in held[:i]) for i in range(len(held))]
        assert sum(r.length for r in held) <= packing.CAPACITY
        assert len({size[r.doc_id][1] for r in held}) == len(held) == len({size[r.doc_id][2] for r in held})


# Fingerprints


def test_peeling_recovers_the_difference():
    rng = np.random.default_rng(0)
    ours, theirs = [], []
    for n in (0, 1, 5, 40, 300, 5000):
        keys = np.unique(rng.integers(0, 2**64, 2 * n + 50, dtype=np.uint64))
        ours.append(keys[n:])
        theirs.append(keys[: len(keys) - n // 2])
    for (lost, gained), a, b in zip(fingerprints.differences(ours, theirs), ours, theirs):
        assert set(lost) == set(a) - set(b) and set(gained) == set(b) - set(a)


def test_fingerprints_against_brute_force(spark):
    docs = sorted(documents(spark, MEDIUM).collect(), key=lambda r: -r.doc_id)
    rows = {r.doc_id: r for r in LLM_QUERIES["op6_paragraph_fingerprints"](spark, MEDIUM).collect()}
    assert len(rows) == len(docs)
    for k, d in enumerate(docs):
        following = docs[(k + 1) % len(docs)].text
        size = len(d.text) // 3
        edit = d.text[: len(d.text) - size] + following[:size]
        r = rows[d.doc_id]
        assert r.n_chars == len(d.text) and r.edited_sha256 == hashlib.sha256(edit.encode()).hexdigest()
        mine, other, changed = (set(fingerprints.digests(t)) for t in (d.text, following, edit))
        assert r.near_edited == pytest.approx(len(mine & changed) / len(mine | changed))
        assert r.near_next == pytest.approx(len(mine & other) / len(mine | other))
    assert len({r.fingerprint for r in rows.values()}) == len({d.text for d in docs})
    assert np.mean([r.near_edited > r.near_next for r in rows.values()]) > 0.97


# Classifiers


def held_out(spark, docs, score, label):
    labels = spark.read.parquet(f"{TENTH}/labels.parquet")
    rows = docs.select("doc_id", score.alias("score")).join(labels, "doc_id").collect()
    rows = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    return np.array([r.score for r in rows]), np.array([r[label] for r in rows])


def area(score, label):
    order = np.argsort(np.argsort(score)) + 1
    ones = (label == 1).sum()
    return (order[label == 1].sum() - ones * (ones + 1) / 2) / ones / (len(label) - ones)


def test_quality_on_held_out_rows(spark):
    docs, labels = documents(spark, TENTH), spark.read.parquet(f"{TENTH}/labels.parquet")
    score, label = held_out(spark, docs, compression_quality.score(F.col("text"), compression_quality.fit(docs, labels)), "quality")
    assert area(score, label) > 0.99 and (score[label == 1] >= 0.5).mean() > 0.99


def test_toxicity_on_held_out_rows(spark):
    docs, labels = documents(spark, TENTH), spark.read.parquet(f"{TENTH}/labels.parquet")
    score, label = held_out(spark, docs, pu_toxicity.score(F.col("text"), pu_toxicity.fit(docs, labels)), "toxic")
    assert area(score, label) > 0.94 and (score[label == 0] >= 0.7).mean() < 0.06


def test_risk_stays_right_with_toxic_rows_among_the_unlabelled():
    rng = np.random.default_rng(0)
    positive = [np.array([0]) for _ in range(300)]
    unlabelled = [np.array([0]) if i < 100 else rng.integers(1, 20, 3) for i in range(1000)]
    weights, bias = pu_toxicity.train(positive, unlabelled, 20, 0.1, 1e-5, steps=800)
    assert bias + weights[0] > 1 and bias + 3 * weights[1:].max() < 0


# Link trust


def test_spread_against_power_iteration(spark):
    rng = np.random.default_rng(1)
    n, a = 12, 0.85
    links = rng.integers(0, 3, (n, n)) * (rng.random((n, n)) < 0.3)
    np.fill_diagonal(links, 0)
    seeds = rng.random((2, n)) * (rng.random((2, n)) < 0.4)
    expected = []
    for flow, seed in ((links, seeds[0]), (links.T, seeds[1])):
        share = flow / np.maximum(flow.sum(axis=1, keepdims=True), 1)
        rank = (1 - a) * seed
        for _ in range(20):
            rank = (1 - a) * seed + a * rank @ share
        expected.append(rank)
    frame = [(f"h{i}", f"h{j}", int(links[i, j])) for i in range(n) for j in range(n) if links[i, j]]
    start = [(f"h{i}", float(seeds[0, i]), float(seeds[1, i])) for i in range(n)]
    found = link_trust.spread(
        spark.createDataFrame(frame, "source string, target string, links long"),
        spark.createDataFrame(start, "host string, trust double, distrust double"),
    ).collect()
    for r in found:
        i = int(r.host[1:])
        assert (r.trust, r.distrust) == pytest.approx((expected[0][i], expected[1][i]))


def test_distrust_follows_links_back(spark):
    pages = spark.createDataFrame(
        [
            (1, "http://bad.net/x", ""),
            (2, "https://Shop.net/a?b", '<a href="http://bad.net/x">'),
            (3, "http://fine.net/", "<a HREF='//good.org/'> <a href=/local>"),
            (4, "http://good.org/", '<a href="http://fine.net/">'),
        ],
        "page_id long, url string, html string",
    )
    found = link_trust.filter_urls(pages, [("block", "bad.net", "/"), ("allow", "org", "/")]).collect()
    assert {(r.page_id, r.host, r.path, r.rule, r.verdict) for r in found} == {
        (1, "bad.net", "/x", "bad.net/", "block"),
        (2, "shop.net", "/a", None, "block"),
        (3, "fine.net", "/", None, "allow"),
        (4, "good.org", "/", "org/", "allow"),
    }


def test_url_rules(spark):
    from urllib.parse import urlsplit

    from tarifflens.llm.queries import URL_RULES

    pages = {r.page_id: r.url for r in spark.read.parquet(f"{MEDIUM}/pages.parquet").collect()}
    found = LLM_QUERIES["op9_link_trust"](spark, MEDIUM).collect()
    assert len(found) == len(pages)
    for r in found:
        parts = urlsplit(pages[r.page_id])
        assert (r.host, r.path) == (parts.netloc.lower(), parts.path)
        fits = [
            (len(h + p), h + p, v)
            for v, h, p in URL_RULES
            if (r.host == h or r.host.endswith("." + h)) and r.path.startswith(p)
        ]
        assert r.rule == (max(fits)[1] if fits else None)
        assert r.verdict in ("allow", "block") and (not fits or r.verdict == max(fits)[2])


# Byte-level BPE


@pytest.fixture(scope="module")
def vocabulary():
    public_tokenizers = pytest.importorskip("public_tokenizers")
    return byte_bpe.Vocabulary.read(
        public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    )


@pytest.fixture(scope="module")
def library(vocabulary):
    tiktoken = pytest.importorskip("tiktoken")
    return tiktoken.Encoding("own", pat_str=vocabulary.pattern, mergeable_ranks=vocabulary.rank_of, special_tokens={})


def test_hash_is_minimal_and_perfect(vocabulary):
    slots = {vocabulary.hash.slot(t) for t in vocabulary.rank_of}
    assert slots == set(range(len(vocabulary.rank_of)))
    assert all(vocabulary.find(t) == r for t, r in vocabulary.rank_of.items())
    assert vocabulary.find(b"no such token at all") == -1


def test_same_ids_as_the_library(spark, vocabulary, library):
    rng = random.Random(0)
    odd = ["", " ", "\n\n x", "a" * 3000, "ab" * 500 + "é" * 200, "你好 \U0001f600\U0001f600!!  \t end "]
    odd += ["".join(chr(rng.choice([32, 97, 98, 233, 8364, 0x1F600, 10])) for _ in range(300)) for _ in range(30)]
    texts = odd + [r.text for r in documents(spark, SMALL).collect()]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    ids = frame.withColumn("ids", byte_bpe.encode(F.col("text"), vocabulary))
    ids = ids.withColumns({"list": byte_bpe.ids_array(F.col("ids")), "back": byte_bpe.decode(F.col("ids"), vocabulary)})
    for r in ids.collect():
        assert r.list == library.encode_ordinary(r.text)
        assert bytes(r.back).decode() == r.text


def test_byte_query(spark, library):
    rows = {r.doc_id: r for r in LLM_QUERIES["op10_byte_bpe"](spark, SMALL).collect()}
    for d in documents(spark, SMALL).collect():
        ids = library.encode_ordinary(d.text)
        r = rows[d.doc_id]
        assert r.n_tokens == len(ids) and r.decoded_sha256 == hashlib.sha256(d.text.encode()).hexdigest()
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()


# Pipeline


def test_pipeline(spark):
    docs = documents(spark, MEDIUM)
    labels = {r.doc_id: r for r in spark.read.parquet(f"{MEDIUM}/labels.parquet").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = stage(spark, docs, MEDIUM).persist()
        assert docs.columns == before.columns
        kept = {r.doc_id for r in docs.select("doc_id").collect()}
        lost = {r.doc_id for r in before.select("doc_id").collect()} - kept
        if name == "quality":
            good = [d for d, r in labels.items() if r.quality == 1]
            assert np.mean([d in kept for d in good]) > 0.97
        if name == "line_dedup":
            assert not lost
        if name == "near_dedup":
            assert docs.select(F.xxhash64("text")).distinct().count() == docs.count()
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, MEDIUM)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == kept
    assert corpus_pipeline.run(spark, SMALL).columns == packed.columns
