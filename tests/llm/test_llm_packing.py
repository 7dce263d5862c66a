"""Packing: pieces hold each id once, sequences have no gaps and little padding."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tidemark.llm import packing


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def test_chunks_equal_whole_texts(tokenizer):
    encode = packing.encoder(None)
    texts = ["", " ", "a'S b''s ''re x're", "İstanbul ŉ ß ſ", "a b\x85c\x1cd\x1fe\x00f", "<|endoftext|> x", "日本 語 é é"]
    texts += [f"a{chr(c)}b1{chr(c)}'s {chr(c)}" for c in range(0x300)]
    for t in texts:
        assert encode(t) == np.array(tokenizer.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes(), repr(t)


def test_forgetting_changes_nothing(tokenizer, monkeypatch):
    monkeypatch.setattr(packing, "REMEMBERED", 6)
    encode = packing.encoder(None)
    for i in range(300):
        text = f"w{i % 11} x{i % 7},y {'z' * (i % 90)} été{i % 3}'ll ---{i % 5}!"
        assert encode(text) == np.array(tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()


def test_another_vocabulary_encodes_texts_whole():
    other = public_tokenizers.path("byte_bpe_50k.json")
    text = "Two  words, one\nline"
    want = np.array(Tokenizer.from_file(other).encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
    assert packing.encoder(other)(text) == want


def check(rows, texts, tokenizer, length):
    """``rows`` of distinct documents against the tokenizer."""
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    assert set(by_doc) == set(texts)
    for doc_id, own in by_doc.items():
        ids = [*tokenizer.encode(texts[doc_id] or "", add_special_tokens=False).ids, 1]
        at = 0
        for r in sorted(own, key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            data = np.array(ids[at : at + r["length"]], dtype="<u4").tobytes()
            assert r["ids_crc32"] == zlib.crc32(data)
            at += r["length"]
        assert at == len(ids)
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= length
    return len(by_sequence)


def test_whole_table(spark, tokenizer):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = packing.pack_documents(docs).collect()
    sequences = check(rows, texts, tokenizer, 2048)
    assert sum(r["length"] for r in rows) > 0.96 * 2048 * sequences


def test_small_sequences(docs_of, tokenizer):
    texts = {i: "word " * (i % 41) for i in range(150)}
    rows = packing.pack_documents(docs_of(list(texts.items())), length=64).collect()
    check(rows, texts, tokenizer, 64)


@pytest.mark.parametrize("seed", range(4))
def test_patterns_cover_the_demand(seed):
    rng = np.random.default_rng(seed)
    demand = rng.integers(0, 50, 32) * (rng.random(32) < 0.7)
    plan = packing.solve(demand, 32)
    sizes = np.arange(1, 33)
    assert (sum((p * u for p, u in plan), np.zeros(32, dtype=int)) == demand).all()
    assert all((p * sizes).sum() <= 32 for p, _ in plan)
    least = (demand * sizes).sum() / 32
    assert sum(u for _, u in plan) <= 1.12 * least + 3
    assert packing.solve(np.zeros(32, dtype=int), 32) == []


def test_best_pattern_is_best():
    rng = np.random.default_rng(3)
    for _ in range(20):
        values, limits = rng.random(4), rng.integers(0, 4, 4)
        best = max(
            (np.dot(values, c) for c in np.ndindex(*(limits + 1)) if np.dot(c, [1, 2, 3, 4]) <= 9),
        )
        assert np.isclose(np.dot(values, packing.best_pattern(values, limits, 9)[:4]), best)


def test_edges(edge_docs, no_docs, clash_docs, edge_rows):
    assert packing.pack_documents(no_docs).count() == 0
    rows = packing.pack_documents(clash_docs).collect()
    assert sum(r["start"] == 0 for r in rows) == len(edge_rows)
    empty = [r for r in rows if r["doc_id"] == 4][0]
    assert (empty["length"], empty["doc_tokens"]) == (1, 1)
    for s in {r["sequence_id"] for r in rows}:
        own = sorted((r["offset"], r["length"]) for r in rows if r["sequence_id"] == s)
        assert own[0][0] == 0 and all(a + b == c for (a, b), (c, _) in zip(own, own[1:])) and sum(own[-1]) <= 2048
