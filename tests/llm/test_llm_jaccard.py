"""The Jaccard join against counting every pair."""

import itertools
import random

import numpy as np
import pytest

from tidemark.llm import common, jaccard

SPACE = " \t\n\v\f\r"


def shingle_set(text):
    low = "".join(c.lower() if c.isascii() else c for c in text or "")
    for c in SPACE:
        low = low.replace(c, " ")
    w = [x for x in low.split(" ") if x]
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))


def brute(rows):
    sets = [shingle_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    owners = {}
    for i, s in enumerate(sets):
        for x in s:
            owners.setdefault(x, []).append(i)
    pairs = {p for o in owners.values() for p in itertools.combinations(o, 2)}
    for i, j in pairs:
        both = len(sets[i] & sets[j])
        if 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
            root[find(i)] = find(j)
    ids = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            r = find(i)
            ids[r] = min(ids.get(r, doc_id), doc_id)
    return sorted(((d, len(sets[i]), ids.get(find(i))) for i, (d, _) in enumerate(rows)), key=str)


def got(df):
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in df.collect()), key=str)


def test_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert got(jaccard.linked(docs)) == brute([(r["doc_id"], r["text"]) for r in docs.collect()])


def near_copies(seed):
    """Copies around the threshold, chains, a frequent line and texts of every small size."""
    rng = random.Random(seed)
    rows, line = [], "this line stands in very many of all the documents here"
    for _ in range(12):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.randrange(1, 90))]
        for _ in range(rng.randrange(1, 7)):
            text = list(base)
            for _ in range(rng.randrange(0, 4)):
                text[rng.randrange(len(text))] = f"x{rng.randrange(5000)}"
            rows.append(" ".join(text) + ("\n" + line if rng.random() < 0.5 else ""))
            if rng.random() < 0.5:
                base = text
    rows += [rows[0].upper(), rows[1].replace(" ", "  "), None, "", "ÉÀ é", "éà é", "a b", "A B"]
    return list(enumerate(rows))


@pytest.mark.parametrize("seed, hot", [(1, 2), (2, 2_000), (3, 3)])
def test_near_copies(spark, docs_of, monkeypatch, seed, hot):
    monkeypatch.setattr(jaccard, "HOT_ROWS", hot)
    monkeypatch.setattr(jaccard, "FREQUENT", 5)
    rows = near_copies(seed)
    assert got(jaccard.linked(docs_of(rows))) == brute(rows)


def test_a_template_of_many_documents_is_cut_into_tiles(spark, docs_of, monkeypatch):
    """Equal sizes, the same frequent shingles, hardly a link: no task gets the whole group."""
    real, hot = jaccard.candidates, 20

    def bounded(node, *rest):
        if len(node) > 4 * hot:
            raise ValueError(f"{len(node)} rows in one group")
        return real(node, *rest)

    monkeypatch.setattr(jaccard, "HOT_ROWS", hot)
    monkeypatch.setattr(jaccard, "candidates", bounded)
    shared = " ".join(f"t{i}" for i in range(84))
    texts = [shared + " " + " ".join(f"u{d}x{i}" for i in range(20)) for d in range(200)]
    texts += [texts[d].replace(f"u{d}x19", "other") for d in range(0, 200, 25)]
    rows = list(enumerate(texts))
    assert got(jaccard.linked(docs_of(rows))) == brute(rows)


def test_tiles_let_every_fitting_pair_meet(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "HOT_ROWS", 10)
    rng = random.Random(6)
    sizes = {i: rng.choice([40, 60, 61, 80, 81]) for i in range(150)}
    members = spark.createDataFrame(
        [(1, i, i, n, 150) for i, n in sizes.items()], "leader bigint, node bigint, root bigint, n bigint, k bigint"
    )
    groups = {}
    for r in jaccard.in_tiles(members).collect():
        groups.setdefault((r["c"], r["s"], r["t"]), []).append(r)
    assert max(map(len, groups.values())) <= 40
    met = set()
    for (_, s, t), rows in groups.items():
        for a, b in itertools.combinations(rows, 2):
            if (a["home"] or b["home"]) and (s == t or a["side"] != b["side"]):
                pair = tuple(sorted((a["node"], b["node"])))
                assert pair not in met
                met.add(pair)
    fitting = {(i, j) for i, j in itertools.combinations(sizes, 2) if 4 * min(sizes[i], sizes[j]) >= 3 * max(sizes[i], sizes[j])}
    assert fitting <= met


def test_candidates_lose_no_pair():
    rng = np.random.default_rng(4)
    sets = []
    for _ in range(40):
        base = np.unique(rng.integers(0, 2**63, rng.integers(3, 200)).astype(np.uint64))
        for _ in range(6):
            s = base.copy()
            change = rng.random(len(s)) < 0.12 * rng.random()
            s[change] = rng.integers(0, 2**63, change.sum()).astype(np.uint64)
            sets.append(np.unique(s))
    bits = [jaccard.bitmap(s).tobytes() for s in sets]
    node, size = np.arange(len(sets)), np.array([len(s) for s in sets])
    found = set()
    for u, v in jaccard.candidates(node, node, size, np.ones(len(sets), dtype=bool), bits):
        found |= {(min(p), max(p)) for p in zip(u.tolist(), v.tolist())}
    none, links, all_pairs = np.zeros(0, dtype=np.uint64), 0, 0
    for i, j in itertools.combinations(range(len(sets)), 2):
        all_pairs += 1
        both = len(np.intersect1d(sets[i], sets[j]))
        if 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
            links += 1
            assert (i, j) in found
            assert set(jaccard.prefix(sets[i], none).tolist()) & set(jaccard.prefix(sets[j], none).tolist())
    assert links > 100 and len(found) < all_pairs / 5


def test_edges(edge_docs, clash_docs, no_docs, edge_rows):
    assert got(jaccard.linked(no_docs)) == []
    want = brute([(r[0], r[1]) for r in edge_rows])
    assert got(jaccard.linked(edge_docs)) == want
    assert got(jaccard.linked(clash_docs)) == want


def test_one_of_each_group_stays(edge_docs, clash_docs):
    kept = jaccard.deduplicated(clash_docs)
    assert kept.columns == clash_docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(ids, key=str) == sorted([1, 3, 4, 5, None, 6, 7, 8, 10], key=str)


def random_texts(count, words, seed=5):
    rng = random.Random(seed)
    return [" ".join(f"w{rng.randrange(10**6)}" for _ in range(words)) for _ in range(count)]


def test_no_wide_table_is_left_and_shuffle_files_go(spark, docs_of, monkeypatch, tmp_path):
    texts = random_texts(300, 200)
    docs = docs_of(list(enumerate(texts + [t + " more" for t in texts[::3]])))
    monkeypatch.setattr(jaccard, "HOT_ROWS", 10)
    monkeypatch.setattr(common, "shared_folder", lambda spark: str(tmp_path))
    switch = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    switched, real = [], jaccard.materialise

    def seen(df, label):
        switched.append(spark.conf.get(switch))
        return real(df, label)

    monkeypatch.setattr(jaccard, "materialise", seen)
    before = spark.conf.get(switch)
    groups = jaccard.linked(docs)
    # Tables of prefixes (400 bytes a document) and of whole sets (1,600) are gone.
    labels = {f.name.rsplit("-", 1)[0] for f in tmp_path.iterdir()}
    assert not labels & {"whole-sets", "live", "paired-sets"} and "known" in labels
    assert sum(f.stat().st_size for f in tmp_path.rglob("*") if f.is_file()) < 600 * 400
    assert len({r["component_id"] for r in groups.collect()}) == 300
    assert set(switched) == {"true"} and spark.conf.get(switch) == before


def test_brief_bitmaps_are_small_and_never_lose_a_link():
    rng = np.random.default_rng(8)
    for n in (1, 2, 7, 64, 129, 500, 3000):
        base = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        long = jaccard.bitmap(base)
        brief = jaccard.folded(long[None, :], len(long) >> jaccard.FOLDS)
        assert brief.nbytes <= max(16, n / 4) and long.nbytes <= max(64, n)
        for _ in range(20):
            other = base.copy()
            change = rng.random(len(base)) < 0.4 * rng.random()
            other[change] = rng.integers(0, 2**63, change.sum()).astype(np.uint64)
            apart = len(np.setxor1d(base, other))
            bits = jaccard.bitmap(np.unique(other))[None, :]
            for words in (len(long), len(brief[0])):
                differ = jaccard.folded(long[None, :], words) ^ jaccard.folded(bits, words)
                assert np.bitwise_count(differ).sum() <= apart
            both = len(np.intersect1d(base, other))
            linked = 100 * both >= 75 * (2 * n - both)
            assert linked == (apart <= jaccard.most_apart(len(base), len(other)))


def test_long_bitmaps_are_shuffled_for_rows_with_a_candidate_only(spark, docs_of, monkeypatch):
    """One common line lets all texts meet; only the near copies behind it need more than a brief look."""
    monkeypatch.setattr(jaccard, "HOT_ROWS", 50)
    monkeypatch.setattr(jaccard, "FREQUENT", 10_000)
    tables, real = {}, jaccard.materialise

    def kept(df, label):
        tables[label] = real(df, label)
        return tables[label]

    monkeypatch.setattr(jaccard, "materialise", kept)
    line = " ".join(f"t{i}" for i in range(12))
    texts = [f"{line} {t}" for t in random_texts(200, 120)]
    texts += [t[:-4] + " one two" for t in texts[::40]]
    rows = list(enumerate(texts))
    assert got(jaccard.linked(docs_of(rows))) == brute(rows)
    assert tables["members"].count() > 100
    assert tables["left-rows"].count() < 20


def shuffled_bytes(df):
    """Bytes written by the exchanges of a query that was run."""

    def walk(node):
        if node.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            yield from walk(node.executedPlan())
            return
        if node.getClass().getSimpleName().endswith("QueryStageExec"):
            yield from walk(node.plan())
            return
        size = node.metrics().get("shuffleBytesWritten")
        if size.isDefined() and node.getClass().getSimpleName() == "ShuffleExchangeExec":
            yield size.get().value()
        children = node.children()
        for i in range(children.size()):
            yield from walk(children.apply(i))

    return sum(walk(df._jdf.queryExecution().executedPlan()))


def test_texts_that_stay_are_not_shuffled(docs_of):
    texts = random_texts(200, 300)
    rows = [*enumerate(texts), (200, texts[0]), (7, texts[7]), (9, "another text under a known id"), (None, texts[3]), (None, "none"), (None, "none")]
    kept = jaccard.deduplicated(docs_of(rows))
    found = kept.collect()
    assert sorted((r["doc_id"], r["text"]) for r in found if r["doc_id"] is not None) == sorted([*enumerate(texts), (9, rows[202][1])])
    assert [r["text"] for r in found if r["doc_id"] is None and r["text"] == "none"] == ["none"]
    assert shuffled_bytes(kept) < sum(map(len, texts)) / 10
