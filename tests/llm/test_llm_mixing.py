"""The mix against its SQL, and its targets against plain resharing."""

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_point
from check import rows_of
from tidemark.llm import mixing
from tidemark.operators.ordered import row_numbers


def reshared(sizes):
    """Targets by resharing excess again and again."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, full = sum(sizes.values()), set()
    while True:
        rest = total - sum(3 * sizes[s] for s in full)
        open_weight = sum(weight[s] for s in order if s not in full) or 1
        target = {s: 3 * sizes[s] if s in full else rest * weight[s] / open_weight for s in order}
        over = {s for s in order if s not in full and target[s] > 3 * sizes[s]}
        if not over:
            return target
        full |= over


@pytest.mark.parametrize("sizes", [
    {"a": 100, "b": 5, "c": 70, None: 3, "é": 9, "z": 400},
    {"a": 1, "b": 1, "c": 1000},
    {"only": 7},
    {"a": 0, "b": 10, None: 0},
    {f"s{i}": (i * 37) % 101 for i in range(50)},
])
def test_targets(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size bigint")
    got = {r["source"]: r["target"] for r in mixing.targets(df).collect()}
    assert got == pytest.approx(reshared(sizes))


def test_equals_sql(spark):
    sf_dir = "/root/testdata/sf0.01"
    duck = duckdb.connect()
    duck.execute(f"create view documents as select * from '{sf_dir}/documents.parquet'")
    df = entry_point.queries()["op2_pareto_mix"](spark, sf_dir)
    want = duck.execute(entry_point.oracle_sql()["op2_pareto_mix"])
    assert rows_of(df.columns, df.collect()) == rows_of([d[0] for d in want.description], want.fetchall())


@pytest.mark.parametrize("slice_rows", [1, 7, 20_000])
def test_words_come_near_the_target(spark, monkeypatch, slice_rows):
    monkeypatch.setattr(mixing, "SLICE_ROWS", slice_rows)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = mixing.mix(docs, ["doc_id", "source"]).collect()
    assert all(r["taken"] <= 3 * r["size"] for r in rows)
    for source in {r["source"] for r in rows}:
        own = [r for r in rows if r["source"] == source]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= max(r["size"] for r in own) / 2 + 1


def test_weights_shift_copies(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = mixing.mix(docs, ["doc_id"], weight=F.when(F.floor(F.col("doc_id") / 20) % 2 == 0, 3.0).otherwise(1.0)).collect()
    even, odd = ([r["copies"] for r in rows if r["doc_id"] // 20 % 2 == k and r["size"]] for k in (0, 1))
    assert sum(even) / len(even) > 1.5 * sum(odd) / len(odd)
    assert all(r["copies"] <= 3 for r in rows)


def test_edges(edge_docs, clash_docs, no_docs, edge_rows):
    assert mixing.mix(no_docs, ["doc_id"]).count() == 0
    assert mixing.copied(no_docs).count() == 0
    a = sorted(map(str, mixing.mix(edge_docs, ["doc_id"]).collect()))
    assert len(a) == len(edge_rows)
    assert a == sorted(map(str, mixing.mix(edge_docs, ["doc_id"]).collect()))
    copied = mixing.copied(clash_docs)
    assert copied.columns == clash_docs.columns
    taken = {}
    for r in mixing.mix(clash_docs, ["doc_id", "text"]).collect():
        taken[r["doc_id"], r["text"]] = taken.get((r["doc_id"], r["text"]), 0) + r["copies"]
    again = {}
    for r in copied.collect():
        again[r["doc_id"], r["text"]] = again.get((r["doc_id"], r["text"]), 0) + 1
    assert again == {k: v for k, v in taken.items() if v}
    assert not any(not (t or "").strip() for _, t in again)


def test_copies_follow_the_weights(spark):
    """Mean copies per weight against the level found by trying, in a source that grows and one that shrinks."""
    docs = spark.range(24_000).selectExpr(
        "id as doc_id", "'a b c d' as text", "if(id % 4 = 0, 'a', 'b') as source", "array(0.5D, 1.0D, 4.0D)[cast(id % 3 as int)] as worth"
    )
    rows = mixing.mix(docs, ["source", "worth"], weight=F.col("worth")).collect()
    for source in ("a", "b"):
        own = [r for r in rows if r["source"] == source]
        want, worths = own[0]["target"] / 4, [r["worth"] for r in own]
        low, high = 0.0, 100.0
        for _ in range(100):
            level = (low + high) / 2
            low, high = (level, high) if sum(min(3.0, level * w) for w in worths) < want else (low, level)
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 4
        for worth in (0.5, 1.0, 4.0):
            copies = [r["copies"] for r in own if r["worth"] == worth]
            expected = min(3.0, level * worth)
            assert sum(copies) / len(copies) == pytest.approx(expected, abs=0.05)
            assert set(copies) <= {int(expected), min(3, int(expected) + 1)}


def test_null_and_repeated_ids_are_taken_apart(spark, monkeypatch):
    """Targets are met although ids, or ids and texts, repeat; also where repeats are numbered in ranges."""
    rows = [(None, f"{i} " + "w " * 19, "a") for i in range(40)]
    rows += [(7, f"{i} " + "w " * 19, "b") for i in range(40)]
    rows += [(9, "same " * 20, "c") for _ in range(40)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")

    def taken():
        out = {}
        for r in mixing.mix(docs, ["source"]).collect():
            words, _ = out.get(r["source"], (0, 0))
            out[r["source"]] = words + r["taken"], r["target"]
        return out

    first = taken()
    assert all(abs(words - target) <= 10 for words, target in first.values())
    assert taken() == first
    small = lambda *args, **named: row_numbers(*args, **named, hot_rows=7)
    monkeypatch.setattr(mixing, "row_numbers", small)
    assert taken() == first
    copies = mixing.copied(docs)
    assert copies.count() * 20 == sum(words for words, _ in first.values())
