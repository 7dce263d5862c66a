"""The pipeline: every stage against a plain version of it on what the stage before kept."""

import corpus_pipeline
from tidemark.llm import secrets
from test_llm_jaccard import brute


def test_stages(spark):
    sf_dir = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.materialise(stage(spark, docs, sf_dir), f"test-{name}")
        kept[name] = docs.collect()
        if name != "packing":
            assert docs.columns == columns
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    clean = {r["doc_id"] for r in kept["toxicity"]}
    # Some labelled rows hold no toxic word at all; nearly all the rest go.
    toxic = [i for i, t in labels.items() if t]
    assert sum(i in clean for i in toxic) <= 0.4 * len(toxic)
    assert sum(i not in clean for i, t in labels.items() if not t) <= 0.03 * len(labels)
    groups = brute([(r["doc_id"], r["text"]) for r in kept["toxicity"]])
    assert sorted(r["doc_id"] for r in kept["near_copies"]) == sorted({c for _, _, c in groups})
    encode = secrets.encoder(None)
    assert not any(s["kind"] in secrets.BASE[1:] for r in kept["secrets"] for s in secrets.spans_of(r["text"], encode))
    assert all(r["n_chars"] == len(r["text"]) for r in kept["secrets"])
    copies = {}
    for r in kept["mixing"]:
        copies[r["doc_id"]] = copies.get(r["doc_id"], 0) + 1
    assert set(copies) <= {r["doc_id"] for r in kept["secrets"]} and max(copies.values()) <= 3
    heads = {}
    for r in kept["packing"]:
        heads[r["doc_id"]] = heads.get(r["doc_id"], 0) + (r["start"] == 0)
    assert heads == copies


def test_run_on_awkward_rows(spark, edge_docs, clash_docs, no_docs, tmp_path):
    spark.createDataFrame([(1, 1, 0), (8, 0, 1)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for docs in (edge_docs, clash_docs, no_docs):
        for name, stage in corpus_pipeline.STAGES:
            docs = corpus_pipeline.materialise(stage(spark, docs, str(tmp_path)), f"edge-{name}")
        docs.count()
