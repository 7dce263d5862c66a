"""Whitening against a plain computation over the distinct vectors."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import whitening

VECTORS = T.StructType(
    [T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType())]
)


def whole(vector):
    ends = (-(2**63), 2**63 - 1)
    return [max(ends[0], min(ends[1], math.floor(256 * float(np.float32(c))))) for c in vector]


def expected(vectors, weights="ones"):
    """n, sums, and per vector: exact deviation and the coordinates up to sign."""
    kept = [(i, whole(v)) for i, v in vectors if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    d = max(len(x) for _, x in kept)
    kept = [(i, tuple(x + [0] * (d - len(x)))) for i, x in kept]
    fit = sorted({x for _, x in kept}) if weights == "ones" else [x for _, x in kept]
    n, sums = len(fit), [sum(x[j] for x in fit) for j in range(d)]
    away = np.array([[x[j] - sums[j] / n for j in range(d)] for x in fit], dtype=float)
    values, vectors_ = np.linalg.eigh(away.T @ away / n)
    order = np.argsort(-values)
    return kept, n, sums, values[order], vectors_[:, order]


def check(made, vectors, weights="ones", components=4):
    kept, n, sums, values, axes = expected(vectors, weights)
    shown = min(components, len(sums))
    rows = made.collect()
    assert len(rows) == shown * len(kept)
    by_id = {}
    for r in rows:
        by_id.setdefault(r["vec_id"], {}).setdefault(r["component"], []).append(r)
    signs = {}
    for i, x in kept:
        deviation = sum((n * x[j] - sums[j]) ** 2 for j in range(len(sums)))
        centred = np.array([x[j] - sums[j] / n for j in range(len(sums))])
        for c in range(1, shown + 1):
            for r in by_id[i][c]:
                assert (r["n"], int(r["deviation"])) == (n, deviation)
                want = centred @ axes[:, c - 1] / np.sqrt(values[c - 1])
                signs.setdefault(c, np.sign(want * r["whitened"]))
                assert r["whitened"] == pytest.approx(signs[c] * want, abs=1e-8)
                assert r["explained"] == pytest.approx(values[c - 1] / values.sum(), rel=1e-9)
                assert r["identity_error"] < 1e-9


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(3)
    base = rng.normal(size=(60, 6)) * np.array([3, 2, 1.5, 1, 0.5, 0.2])
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(base)]
    # A third of the rows share one vector, some differ below the quantum, some are unfit.
    rows += [(100 + i, rows[0][1]) for i in range(40)]
    rows += [(300, [c + 1e-9 for c in rows[1][1]]), (301, None), (302, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (303, [float("nan")] * 6)]
    rows += [(304, [float("inf")] + [0.0] * 5), (305, [-0.0] * 6), (306, [0.0] * 6), (307, [1.5, -2.0]), (308, [])]
    return rows


def table(spark, rows):
    return spark.createDataFrame([(i, v, 0) for i, v in rows], VECTORS)


@pytest.mark.parametrize("weights", ["ones", "counts"])
def test_same_as_plain(spark, vectors, weights):
    check(whitening.whiten(table(spark, vectors), weights=weights), vectors, weights)


def test_hot_vectors_are_salted_without_loss(spark, vectors):
    df = table(spark, vectors)
    check(whitening.whiten(df, hot_rows=7), vectors)
    check(whitening.whiten(df.repartition(9), hot_rows=1), vectors)


def test_exact_beyond_longs(spark):
    rows = [(i, [float(np.float32(1e12 * (i + 1))), float(i * i), -1e30 if i == 3 else 5.0]) for i in range(6)]
    made = whitening.whiten(table(spark, rows)).filter("component = 1").collect()
    _, n, sums, _, _ = expected(rows)
    x = {i: whole(v) for i, v in rows}
    for r in made:
        exact = sum((n * a - s) ** 2 for a, s in zip(x[r["vec_id"]], sums))
        # Beyond 38 digits no type of the engine holds the value.
        assert r["deviation"] is None or int(r["deviation"]) == exact
    small = [(i, [4e6 * (i + 1), 1.0]) for i in range(5)]
    _, n, sums, _, _ = expected(small)
    x = {i: whole(v) for i, v in small}
    for r in whitening.whiten(table(spark, small)).filter("component = 1").collect():
        assert int(r["deviation"]) == sum((n * a - s) ** 2 for a, s in zip(x[r["vec_id"]], sums))


def test_no_variance_empty_and_clashes(spark):
    same = table(spark, [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (None, [1.0, 2.0])])
    rows = whitening.whiten(same).collect()
    assert len(rows) == 6 and all(r["whitened"] == 0.0 and r["n"] == 1 and r["deviation"] == 0 for r in rows)
    assert whitening.whiten(same.limit(0)).count() == 0
    assert whitening.whiten(table(spark, [(1, None)])).columns == whitening.whiten(same).columns
    named = same.withColumn("component", F.lit("x")).withColumn("__x", F.lit("x")).withColumn("__digest", F.lit("x"))
    assert whitening.whiten(named).count() == 6
    with pytest.raises(ValueError, match="ones"):
        whitening.whiten(same, weights="other")


def test_rotations():
    rng = np.random.default_rng(0)
    for n in (1, 2, 5, 20):
        a = rng.normal(size=(n, n))
        a = a @ a.T
        values, vectors = whitening.eigen(a)
        assert np.allclose(np.sort(np.linalg.eigvalsh(a))[::-1], values, rtol=1e-10)
        assert np.allclose(vectors @ vectors.T, np.eye(n), atol=1e-12)
        assert np.allclose(vectors @ a @ vectors.T, np.diag(values), atol=1e-9 * values.max())
