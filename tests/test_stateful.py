"""The fold with its state in the state store against a row-by-row loop."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.streaming.stateful import held, stateful_fold, verdicts

ROWS = "key string, seq bigint, hash string, at bigint"
STORED = "key string, hash string, first_seen bigint, changes bigint"


def loop(rows, stored):
    state = {k: [h, fs, n] for k, h, fs, n in stored}
    out = {}
    for key, seq, value, at in sorted(rows, key=lambda r: r[1]):
        if key not in state:
            state[key], kind = [value, at, 0], "NEW"
        elif state[key][0] == value:
            kind = "UNCHANGED"
        else:
            state[key][0], kind = value, "CHANGED"
            state[key][2] += 1
        out[seq] = (key, kind, state[key][1], state[key][2])
    return out, {k: tuple(v) for k, v in state.items()}


@pytest.mark.parametrize("stored", [[], [("hot", "x", 5, 3), ("k1", "y", 6, 0), ("idle", "z", 7, 9)]])
def test_equals_the_loop_with_hot_and_null_keys(spark, tmp_path, stored):
    rnd = random.Random(len(stored))
    rows = [
        ("hot" if rnd.random() < 0.4 else rnd.choice([None, "k1", "k2", f"k{i}"]), i, rnd.choice("xy"), 10 * i)
        for i in range(150)
    ]
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    before = spark.createDataFrame(stored, STORED) if stored else None
    for part in range(3):
        cut = spark.createDataFrame(rows[part * 50 : part * 50 + 50], ROWS)
        cut.repartition(4).write.parquet(f"{source}/part={part}")
        landed = spark.readStream.schema(ROWS).option("recursiveFileLookup", "true").parquet(source)
        stateful_fold(landed, out, checkpoint, before, hot_rows=5)
    want, end = loop(rows, stored)
    got = {r.seq: (r.key, r.change_type, r.first_seen, r.change_count) for r in verdicts(spark, out).collect()}
    assert got == want
    assert {r.key: (r.hash, r.first_seen, r.changes) for r in held(spark, checkpoint).collect()} == end


def test_only_one_row_per_key_and_batch_reaches_the_state(spark, tmp_path):
    rows = [("hot", i, str(i % 7), i) for i in range(300)]
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame(rows, ROWS).write.parquet(source)
    landed = spark.readStream.schema(ROWS).parquet(source)
    stateful_fold(landed, out, str(tmp_path / "checkpoint"), hot_rows=10)
    assert spark.read.parquet(f"{out}/summaries").count() == 1
    assert verdicts(spark, out).agg(F.max("change_count")).first()[0] == 299
