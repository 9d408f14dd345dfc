"""Whitening against exact fractions and numpy, and its edge cases."""

from fractions import Fraction
from math import floor

import numpy as np
import pytest

from tarifflens.llm import queries, whitening
from tests.conftest import SMALL

SCHEMA = "vec_id long, embedding array<float>, label int, component string, whitened int"


def frame(spark, vectors):
    return spark.createDataFrame([(i, v, 0, "x", 1) for i, v in enumerate(vectors)], SCHEMA)


def exact(vectors):
    """x, its sums and its covariance matrix, in whole numbers and fractions."""
    x = [[floor(1024 * float(np.float32(c))) + 100_000 for c in v] for v in vectors]
    n, d = len(x), len(x[0])
    s = [sum(v[k] for v in x) for k in range(d)]
    y = [[n * v[k] - s[k] for k in range(d)] for v in x]
    cov = [[Fraction(sum(r[i] * r[j] for r in y), n**3) for j in range(d)] for i in range(d)]
    return x, s, y, cov


def check(rows, vectors, components=8):
    x, s, y, cov = exact(vectors)
    n, d = len(x), len(x[0])
    values, basis = np.linalg.eigh(np.array([[float(c) for c in r] for r in cov]))
    values, basis = values[::-1], basis[:, ::-1]
    count = min(components, d)
    assert len(rows) == n * count
    trace = float(sum(cov[k][k] for k in range(d)))
    signs = {}
    for r in sorted(rows, key=lambda r: (r["vec_id"], r["component"])):
        i, k = r["vec_id"], r["component"] - 1
        assert r["n"] == n and r["deviation"] == sum(v * v for v in y[i])
        assert r["explained"] == pytest.approx(values[k] / trace, rel=1e-9)
        assert r["identity_error"] < 1e-9
        wanted = float(np.dot([v / n for v in y[i]], basis[:, k]) / np.sqrt(values[k]))
        sign = signs.setdefault(k, 1 if r["whitened"] * wanted >= 0 else -1)
        assert r["whitened"] == pytest.approx(sign * wanted, abs=1e-7)


def test_small_tables_agree_with_fractions(spark):
    rng = np.random.default_rng(1)
    for n, d in ((40, 3), (60, 12)):
        vectors = (rng.normal(size=(n, d)) @ rng.normal(size=(d, d)) + 5).astype(np.float32).tolist()
        check(whitening.whiten(frame(spark, vectors)).collect(), vectors)


def test_the_given_table(spark):
    vectors = [r["embedding"] for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").orderBy("vec_id").collect()]
    check(queries.op11_embedding_whitening(spark, SMALL).collect(), vectors)


def test_polarisation_is_exact(spark):
    """Large and lop-sided values, beyond 64 bits: the covariances are the fractions, rounded once."""
    rng = np.random.default_rng(2)
    vectors = (rng.normal(size=(50, 4)) * [1e9, 1e8, 3.0, 0.5] + [0, 1e10, -7, 0]).astype(np.float32).tolist()
    rows = whitening.usable(frame(spark, vectors).select("vec_id", "embedding"), "embedding")
    model = whitening.fit(rows)
    _, s, y, cov = exact(vectors)
    assert model.sums == s
    pairs = {(r["i"], r["j"]): int(r["q"]) for r in whitening.squares(rows, model.whole_mean).collect()}
    assert whitening.covariance(model.n, model.sums, pairs).tolist() == [[float(c) for c in r] for r in cov]
    # Squares of such size have no long: the value is null, not wrong.
    sums = [sum(v * v for v in r) for r in y]
    turned = {r["key"]: r["deviation"] for r in whitening.project(rows, model, "vec_id", 4).collect()}
    assert [turned[i] for i in range(50)] == [v if v < 2**63 else None for v in sums]


def test_left_out_vectors(spark):
    good = [[1.0, 2.0], [3.0, -1.0], [0.5, 0.25], [2.0, 2.0], [2.0, 2.0]]
    bad = [None, [], [1.0, None], [float("nan"), 1.0], [1.0, float("inf")], [1.0, 1e30], [1.0], [1.0, 2.0, 3.0]]
    check(whitening.whiten(frame(spark, good + bad)).collect(), good)


def test_without_rows_or_variance(spark):
    empty = whitening.whiten(frame(spark, [None, []]))
    assert empty.collect() == []
    assert [f.simpleString() for f in empty.schema] == [f.simpleString() for f in whitening.whiten(frame(spark, [[1.0, 2.0]] * 2)).schema]
    same = whitening.whiten(frame(spark, [[1.0, 2.0]] * 3)).collect()
    assert len(same) == 6
    assert all(r["deviation"] == 0 and r["whitened"] is None and r["explained"] is None and r["identity_error"] is None for r in same)
    flat = whitening.whiten(frame(spark, [[1.0, 7.0], [2.0, 7.0], [4.0, 7.0]])).collect()
    assert {r["component"]: r["whitened"] is None for r in flat} == {1: False, 2: True}
    assert all(r["identity_error"] < 1e-12 for r in flat)


def test_rows_without_id_and_repeated_rows(spark):
    rows = [(None, [1.0, 2.0], 0, "", 0), (1, [3.0, 1.0], 0, "", 0), (1, [3.0, 1.0], 0, "", 0), (2, [0.0, 0.5], 0, "", 0)]
    found = whitening.whiten(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(found) == 8 and {r["n"] for r in found} == {4}
    twins = [(r["component"], r["whitened"], r["deviation"]) for r in found if r["vec_id"] == 1]
    assert len(twins) == 4 and len(set(twins)) == 2
