"""The fold against a plain sequential loop, with and without slicing."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions.identity import tracked_hash
from tidemark.operators import fold as fd
from tidemark.operators import ordered
from tidemark.operators.ordered import AT, SLICE, in_ranges, row_numbers

SCHEMA = "seq bigint, k string, a string, b double, note string"
STATE = "k string, a string, b double, first_seen bigint, last_changed bigint, change_count bigint"


def spec(hot_rows):
    # The verdict ignores the case of ``a``; changed fields see the raw value.
    return fd.FoldSpec(
        key=["k"], order=["seq"], tracked=["a", "b"],
        hash=F.concat_ws("~", F.lower("a"), F.coalesce(F.col("b").cast("string"), F.lit("-"))),
        at=F.col("seq") * 10, hot_rows=hot_rows,
    )


def loop(rows, state):
    """Reference behaviour, one row at a time."""
    held = {k: dict(a=a, b=b, fs=fs, lc=lc, n=n, seq=None) for k, a, b, fs, lc, n in state}
    out = {}
    for seq, k, a, b, _ in sorted(rows):
        old = held.get(k)
        if old is None:
            held[k] = dict(a=a, b=b, fs=seq * 10, lc=seq * 10, n=0, seq=seq)
            verdict, names, rep = "NEW", [], None
        elif (old["a"].lower(), old["b"]) == (a.lower(), b):
            verdict, names, rep = "UNCHANGED", [], None
        else:
            names = [n for n, o, v in (("a", old["a"], a), ("b", old["b"], b)) if o != v]
            verdict, rep = "CHANGED", old["seq"]
            held[k] = dict(a=a, b=b, fs=old["fs"], lc=seq * 10, n=old["n"] + 1, seq=seq)
        h = held[k]
        out[seq] = (verdict, names, h["fs"], h["lc"], h["n"], rep)
    return out, held


def make(seed, n=240):
    rnd = random.Random(seed)
    rows = []
    for seq in range(n):
        k = "hot" if rnd.random() < 0.5 else f"k{rnd.randrange(12)}"
        rows.append((seq, k, rnd.choice("xXyY"), rnd.choice([1.0, None]), f"n{seq}"))
    state = [("hot", "x", 1.0, 5, 7, 2), ("k1", "y", None, 3, 3, 0), ("gone", "z", 1.0, 1, 1, 4)]
    return rows, state


@pytest.mark.parametrize("hot_rows", [None, 20, 3])
@pytest.mark.parametrize("with_state", [True, False])
def test_fold_equals_loop(spark, hot_rows, with_state):
    rows, stored = make(hot_rows or 1)
    stored = stored if with_state else []
    want, held = loop(rows, stored)
    batch = spark.createDataFrame(random.Random(1).sample(rows, len(rows)), SCHEMA)
    state = spark.createDataFrame(stored, STATE) if with_state else None
    sp = spec(hot_rows)
    verdicts = fd.fold(batch, sp, state)
    got = {
        r.seq: (r.change_type, list(r.changed_fields), r.first_seen, r.last_changed,
                r.change_count, r.replaces.seq if r.replaces else None)
        for r in verdicts.collect()
    }
    assert got == want
    final = {
        r.k: (r.a, r.b, r.first_seen, r.last_changed, r.change_count)
        for r in fd.final_state(batch, verdicts, sp, state).collect()
    }
    assert final == {k: (h["a"], h["b"], h["fs"], h["lc"], h["n"]) for k, h in held.items()}


def test_split_batches_reach_the_same_state(spark):
    rows, _ = make(9)
    sp = spec(20)
    whole = spark.createDataFrame(rows, SCHEMA)
    once = fd.final_state(whole, fd.fold(whole, sp), sp)
    cols = ["k", "a", "b", *fd.LIFECYCLE]
    first = spark.createDataFrame(rows[:100], SCHEMA)
    second = spark.createDataFrame(rows[100:], SCHEMA)
    mid = fd.final_state(first, fd.fold(first, sp), sp).select(*cols)
    mid = spark.createDataFrame(mid.collect(), mid.schema)
    end = fd.final_state(second, fd.fold(second, sp, mid), sp, mid)
    assert sorted(map(tuple, end.select(*cols).collect())) == sorted(
        map(tuple, once.select(*cols).collect())
    )


def test_replay_is_unchanged(spark):
    rows = [(i, f"k{i}", "x", 1.0, "n") for i in range(20)]
    batch = spark.createDataFrame(rows, SCHEMA)
    sp = spec(None)
    state = fd.final_state(batch, fd.fold(batch, sp), sp)
    again = fd.fold(batch, sp, state)
    assert {r.change_type for r in again.collect()} == {"UNCHANGED"}
    assert again.filter("written").count() == 0


def test_summary(spark):
    rows, _ = make(3)
    verdicts = fd.fold(spark.createDataFrame(rows, SCHEMA), spec(None))
    r = fd.summary(verdicts).first()
    assert r.n_new + r.n_changed + r.n_unchanged == len(rows) == r.jobs_processed
    assert r.hit_rate == round(100.0 * r.n_unchanged / len(rows), 1)


def test_tracked_hash_keeps_nulls_apart(spark):
    df = spark.createDataFrame([("a", None), ("a", ""), ("a1:", "b"), ("a", "1:b")], "x string, y string")
    assert df.select(tracked_hash(["x", "y"])).distinct().count() == 4


def test_row_numbers(spark):
    df = spark.range(100).select(F.col("id"), (F.col("id") % 3 == 0).alias("g"))
    got = row_numbers(df, ["id"], ["g"], hot_rows=7, total="n").collect()
    for flag in (True, False):
        part = sorted((r.id, r.row_no, r.n) for r in got if r.g == flag)
        assert [p[1] for p in part] == list(range(1, len(part) + 1))
        assert {p[2] for p in part} == {len(part)}
    plain = sorted((r.id, r.row_no) for r in row_numbers(df, ["id"], hot_rows=9).collect())
    assert [p[1] for p in plain] == list(range(1, 101))


def test_small_ranges_share_a_task_and_wide_rows_do_not(spark, monkeypatch):
    ids = spark.range(3_000).select(F.col("id"), F.sha2(F.col("id").cast("string"), 512).alias("text")).repartition(3)
    small = in_ranges(ids, ["id"], 10)
    assert len(small.inputFiles()) == 1
    got = [tuple(r) for r in small.orderBy(SLICE, AT).select("id", SLICE, AT).collect()]
    assert [r[0] for r in got] == list(range(3_000)) and len({r[1] for r in got}) == 300
    assert [r[2] for r in got] == [i % 10 for i in range(3_000)]
    # Rows that fit one range by their number are dealt by their bytes.
    monkeypatch.setattr(ordered, "TASK_BYTES", 100_000, raising=False)
    wide = in_ranges(ids, ["id"])
    assert len(wide.inputFiles()) >= 4
    assert [r.id for r in wide.orderBy(SLICE, AT).collect()] == list(range(3_000))
