"""Measures and verdicts of the cascade against a plain count."""

import random

import pytest

from tidemark.llm import rules

SPACE = " \t\n\v\f\r"


def split(text):
    out, word = [], ""
    for c in (text or "") + " ":
        if c in SPACE:
            if word:
                out.append(word)
            word = ""
        else:
            word += c
    return out


def brute(text):
    w = split(text)
    windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    inside = set()
    for i, x in enumerate(windows):
        if windows.count(x) > 1:
            inside.update(range(i, i + 8))
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if split(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(inside)


def made(seed):
    rng = random.Random(seed)
    return "".join(rng.choice(["a", "bb", "#", " ", " ", "\n", "\n", "\t", " ", " ", "\x1c", "é"]) for _ in range(rng.randint(0, 300)))


@pytest.mark.parametrize("seed", range(60))
def test_measures(seed):
    text = made(seed) + " one two three four five six seven eight nine" * (seed % 3)
    m = rules.Measures(text)
    assert tuple(getattr(m, n) for n in rules.MEASURES) == brute(text)


def test_order_does_not_change_verdicts(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    order = rules.estimate(docs)
    assert sorted(r.name for r in order) == sorted(r.name for r in rules.RULES)
    a = rules.cascade(docs, ["doc_id"], order, measures=rules.MEASURES).collect()
    b = rules.cascade(docs, ["doc_id"], order[::-1], measures=rules.MEASURES).collect()
    assert sorted(a) == sorted(b)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in a[:60]:
        if len(texts[r["doc_id"]]) < 4_000:
            assert tuple(r[n] for n in rules.MEASURES) == brute(texts[r["doc_id"]])


def test_good_documents_stay(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    kept = rules.cascade(docs, ["doc_id"], rules.RULES, measures=rules.MEASURES).join(labels, "doc_id").collect()
    good = [r["kept"] for r in kept if r["quality"] == 1 and r["n_words"] >= 20]
    bad = [r["kept"] for r in kept if r["quality"] == 0]
    assert sum(good) >= 0.99 * len(good) and sum(bad) <= 0.2 * len(bad)


def test_edges(edge_docs, no_docs, edge_rows):
    assert rules.estimate(no_docs) == list(rules.RULES)
    assert rules.cascade(no_docs, ["doc_id"], rules.RULES).count() == 0
    rows = rules.cascade(edge_docs, ["doc_id"], rules.estimate(edge_docs), measures=rules.MEASURES).collect()
    assert len(rows) == len(edge_rows)
    assert not [r for r in rows if r["doc_id"] in (3, 4, 5)][0]["kept"]
