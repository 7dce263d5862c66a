"""A corpus pipeline of five stages, each written as Parquet and read again by the next one.

Toxic documents go, one document of each near-duplicate group stays, secrets are
replaced, sources are mixed to their target weights (a document may repeat), and
the rest is packed into token sequences.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import jaccard, mixing, packing, secrets, toxicity
from tidemark.llm.common import materialise, read_table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the classifier does not call toxic."""
    model = toxicity.train(docs, read_table(spark, sf_dir, "labels"))
    # Inner names keep columns that are named like the operator's own apart.
    inner = docs.toDF(*[f"__c{i}" for i in range(len(docs.columns))])
    text = f"__c{docs.columns.index('text')}"
    scored = toxicity.score(inner, inner.columns, model, text)
    return scored.filter("predicted = 0").drop("score", "predicted").toDF(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts linked by five-word shingles at 0.75 or more."""
    return jaccard.deduplicated(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without their secrets; ``n_chars`` follows the text."""
    clean = secrets.redact(docs)
    length = F.length("text").cast(docs.schema["n_chars"].dataType)
    return clean.withColumn("n_chars", F.coalesce(length, F.col("n_chars"))).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.copied(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their place in a sequence."""
    return packing.pack_documents(docs)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("near_copies", drop_near_copies),
    ("secrets", redact_secrets),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: A classifier and a tokenizer have no SQL; tests compare stages with plain Python.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return materialise(STAGES[-1][1](spark, docs, sf_dir), f"stage-{STAGES[-1][0]}")
