"""Toxicity and quality: held-out accuracy, segments against every interval, missing labels."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import cotraining, learn, toxicity

SF = "/root/testdata/sf0.1"
LABELS = "doc_id bigint, quality int, toxic int"


@pytest.fixture(scope="module")
def tables(spark):
    return [spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels")]


def f1(rows):
    hit = sum(p and t for p, t in rows)
    return 2 * hit / max(1, sum(p for p, _ in rows) + sum(t for _, t in rows))


def test_toxicity_on_held_out_rows(spark, tables):
    docs, labels = tables
    scored = toxicity.score(docs, ["doc_id"], toxicity.train(docs, labels)).join(labels, "doc_id").collect()
    out = [(r["predicted"], r["toxic"]) for r in scored if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert f1(out) > 0.88
    clean = [p for p, t in out if not t]
    assert sum(clean) <= 0.02 * len(clean)


def test_quality_on_held_out_rows(spark, tables):
    docs, labels = tables
    scored = cotraining.score(docs, labels).join(labels, "doc_id").collect()
    out = [(r["predicted"], r["quality"]) for r in scored if r["held_out"]]
    assert sum(p == q for p, q in out) >= 0.95 * len(out)
    good = [p for p, q in out if q]
    assert sum(good) >= 0.98 * len(good)


@pytest.mark.parametrize("seed", range(40))
def test_segments_are_the_maximal_ones(seed):
    """Splitting off the best interval again and again gives the same segments."""
    rng = random.Random(seed)
    scores = [rng.choice([-3, -2, -1, 1, 2, 4]) + rng.random() / 1000 for _ in range(rng.randrange(1, 40))]

    def split(low, high):
        best = max(((sum(scores[i:j]), i, j) for i in range(low, high) for j in range(i + 1, high + 1)), default=(0, 0, 0))
        if best[0] <= 0:
            return []
        return split(low, best[1]) + [best] + split(best[2], high)

    want = [(i, j, round(s, 6)) for s, i, j in split(0, len(scores))]
    assert sorted((i, j, round(s, 6)) for s, i, j in toxicity.segments(enumerate(scores))) == sorted(want)


def test_extreme_value_fit():
    rng = np.random.default_rng(0)
    n = rng.integers(50, 2000, 4000)
    s = (np.log(n) - 1.0 - np.log(-np.log(rng.random(4000)))) / 1.5
    scale, location = toxicity.fit_extreme(list(zip(s.tolist(), n.tolist())))
    assert abs(scale - 1.5) < 0.1 and abs(location + 1.0) < 0.3
    assert toxicity.fit_extreme([]) == (1.0, 0.0)


def test_logistic_recovers_weights():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(4000, 3))
    true = np.array([1.5, -2.0, 0.0, 0.5])
    y = (rng.random(4000) < learn.sigmoid(x @ true[:3] + true[3])).astype(float)
    assert np.abs(learn.fit_logistic(x, y) - true).max() < 0.3
    a = rng.normal(size=(30, 30))
    assert np.allclose(learn.inverse(a) @ a, np.eye(30))


@pytest.mark.parametrize("rows", [[], [(1, None, None), (None, 1, 1)], [(1, 1, 0), (2, 1, 0), (2, 1, 0)], [(1, 0, 1), (6, 1, 0), (8, 1, 0)]])
def test_few_or_no_labels(spark, edge_docs, no_docs, edge_rows, rows):
    labels = spark.createDataFrame(rows, LABELS)
    model = toxicity.train(edge_docs, labels)
    scored = toxicity.score(edge_docs, ["doc_id"], model, with_passages=True).collect()
    assert len(scored) == len(edge_rows) and all(0 <= r["score"] <= 1 for r in scored)
    assert toxicity.score(no_docs, ["doc_id"], model).count() == 0
    quality = cotraining.score(edge_docs, labels).collect()
    assert len(quality) == len(edge_rows) and all(0 <= r["score"] <= 1 for r in quality)
    assert cotraining.score(no_docs, labels).count() == 0


def test_a_text_teaches_once(spark, sf_dir):
    """Many copies of unlabelled documents leave every score as it is."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    some = docs.join(labels, "doc_id", "left_anti").orderBy("doc_id").limit(5)
    copies = some.crossJoin(spark.range(500)).withColumn("doc_id", some["doc_id"] + 1_000_000 * (1 + F.col("id"))).drop("id")
    once, often = (
        {r["doc_id"]: (r["text_score"], r["meta_score"]) for r in cotraining.score(d, labels).collect()}
        for d in (docs, docs.unionByName(copies.select(*docs.columns)))
    )
    assert len(often) == len(once) + 2_500
    assert all(np.allclose(often[k], v, atol=1e-6) for k, v in once.items())


def test_a_row_is_taken_in_one_round_only():
    flat = [cotraining.View("text_x", np.zeros(1), np.ones(1), np.array([w, 0.0, 0.0])) for w in (1.0, 4.0)]
    label, when = cotraining.pseudo_labels(flat, np.array([[5.0], [1.0], [0.0], [-1.0], [-5.0]]))
    assert when.tolist() == [0, 1, -1, 1, 0]
    assert label.tolist() == [1, 1, 0, 0, 0]
