"""Phrase fingerprints: the shared parse equals two plain ones, order is that of the ids."""

import hashlib

import numpy as np
import pytest

from tidemark.llm import lz


def plain_phrases(text):
    data, known, open_at = (text or "").encode(), set(), 0
    for end in range(1, len(data) + 1):
        if data[open_at:end] not in known:
            known.add(data[open_at:end])
            open_at = end
    return known


def expected(rows):
    rows = sorted(((i, t or "") for i, t in rows))
    out = []
    for k, (i, t) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        n = len(t)
        edited = t[: n - n // 4] + after[: n // 4]
        prints = [lz.signature(p, len(p)) for p in map(plain_phrases, (t, edited, after))]
        out.append(
            (i, n, hashlib.sha256(edited.encode()).hexdigest(), lz.text_of(prints[0]), lz.text_of(prints[1]),
             lz.likeness(prints[0], prints[1]), lz.likeness(prints[0], prints[2]))
        )
    return out


@pytest.mark.parametrize("parts", [2, 5, 40])
def test_against_plain_parses(spark, sf_dir, parts):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = sorted(map(tuple, lz.compare_edited(docs).collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == expected([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()])


def test_few_rows(docs_of, no_docs, edge_docs, edge_rows):
    assert lz.compare_edited(no_docs).count() == 0
    for rows in ([(5, "abcabcabc")], [(5, "aaaa bbbb"), (9, None)], [(1, ""), (2, "x"), (3, "")]):
        assert sorted(map(tuple, lz.compare_edited(docs_of(rows)).collect())) == expected(rows)
    assert lz.compare_edited(edge_docs).count() == len(edge_rows)
    got = {r["doc_id"]: r["fingerprint"] for r in lz.fingerprints(edge_docs, ["doc_id"]).collect()}
    assert got[1] == got[2] and got[3] == got[4] == ""


def test_likeness_follows_the_phrase_sets():
    texts = [" ".join(f"w{(i * s) % 997}" for i in range(1500)) for s in (3, 5)]
    half = texts[0][: len(texts[0]) // 2] + texts[1][len(texts[1]) // 2 :]
    a, b = map(plain_phrases, (texts[0], half))
    true = len(a & b) / len(a | b)
    assert abs(lz.likeness(lz.fingerprint(texts[0]), lz.fingerprint(half)) - true) < 0.2
    assert lz.likeness(lz.fingerprint(half), lz.fingerprint(half)) == 1.0
    assert lz.likeness(np.array([], dtype=np.uint32), lz.fingerprint(half)) == 0.0
