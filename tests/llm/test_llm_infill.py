"""Infill cuts against a regular expression, and ranks against plain counting."""

import hashlib
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.llm import infill

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def expected(doc_id, text, rate=50, suffix_first=80):
    text = text or ""
    units = UNIT.findall(text)
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return len(units), "plain", None, None, text
    if h[3] % 100 < suffix_first:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def check(df, rows, **options):
    made = infill.rearranged(df, ["doc_id", "text"], **options)
    made = made.withColumn("back", infill.restored(F.col("output"), F.col("form")))
    got = sorted(map(repr, [tuple(r) for r in made.collect()]))
    want = sorted(repr((i, t, *expected(i, t, **options), t or "")) for i, t in rows)
    assert got == want


def test_edges(edge_docs, edge_rows):
    check(edge_docs, [r[:2] for r in edge_rows])
    check(edge_docs, [r[:2] for r in edge_rows], rate=100)


def test_noise(docs_of):
    rng = random.Random(1)
    bits = [" ", "\n", "\t", "\x1c", "\u00a0", "a", "bc", "é", "日本", "😀", "<", "<P", ">", "<S>", "\x0b"]
    rows = [(i, "".join(rng.choice(bits) for _ in range(rng.randint(0, 40)))) for i in range(600)]
    check(docs_of(rows), rows, rate=100, suffix_first=40)


def test_marks_and_long_texts(docs_of):
    rows = [(i, t) for i, t in enumerate(["a <P> b", "<S>", "x<M", " " * 300_000, "y " * 200_000, "é" * 200_000])]
    check(docs_of(rows), rows, rate=100)


def test_clashing_names_and_empty_table(spark, clash_docs, no_docs):
    named = clash_docs.withColumn("n", F.lit("mine")).withColumn("form", F.lit("mine")).withColumn("__text", F.lit("mine"))
    made = infill.rearranged(named, named.columns)
    assert made.columns[-5:] == list(infill.OUTPUTS) and made.filter("n < 0 or form = 'mine'").isEmpty()
    assert made.filter("__text = 'mine'").count() == clash_docs.count()
    assert infill.rearranged(no_docs, ["doc_id"]).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 7), max_size=300), st.lists(st.integers(0, 300), max_size=8))
def test_ranks(symbols, at):
    matrix = infill.WaveletMatrix(np.array(symbols, dtype=np.uint8), 3)
    at = np.array([min(a, len(symbols)) for a in at] + [0, len(symbols)], dtype=np.int64)
    for symbol in range(8):
        assert matrix.rank(symbol, at).tolist() == [symbols[:a].count(symbol) for a in at]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet=" \n\taé日😀", max_size=30), min_size=1, max_size=6), st.integers(0, 30))
def test_cuts(texts, k):
    data = [t.encode() for t in texts]
    bounds = np.cumsum([0] + [len(d) for d in data])
    units = infill.Units(np.frombuffer(b"".join(data), dtype=np.uint8), bounds)
    found = [UNIT.findall(t) for t in texts]
    wanted = np.array([min(k, len(u)) for u in found], dtype=np.int64)
    ends = units.after(wanted)
    want = [bounds[i] + len("".join(u[: wanted[i]]).encode()) for i, u in enumerate(found)]
    assert ends.tolist() == want
    chars = units.characters(ends) - units.characters(bounds[:-1])
    assert chars.tolist() == [len("".join(u[: wanted[i]])) for i, u in enumerate(found)]


@pytest.mark.parametrize("part", ["<P>", "<S>", "<M>"])
def test_a_mark_split_over_a_cut_is_read_back(docs_of, part):
    rows = [(i, f"{part[:2]} {part[0]} {part[1:]} {part[2]} tail") for i in range(40)]
    check(docs_of(rows), rows, rate=100)
