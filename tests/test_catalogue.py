"""Registered queries: contract, and a sample compared with the SQL checks."""

import duckdb
import pytest

import __spark_entry__ as entry_point
from check import rows_of
from tidemark.plans import catalogue
from tidemark.plans.catalogue import streams
from tidemark.plans.views import TABLES

SAMPLE = (
    "sync_summary",
    "sync_orders_hot_keys",
    "source_state_hot_sources",
    "adapter_a",
    "clean_html_pages",
    "feed_profile",
    "apply_commands",
    "stream_dead_letter",
)


def test_every_query_has_a_check():
    catalogue.load_all()
    assert set(catalogue.QUERIES) == set(catalogue.ORACLES)
    assert set(catalogue.QUERIES) <= set(entry_point.queries())


def test_entry(spark):
    df = entry_point.entry(spark)
    assert {"source", "n_new", "n_changed", "n_unchanged"} <= set(df.columns)
    assert df.count() > 0


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, sf_dir, name):
    duck = duckdb.connect()
    for t in TABLES:
        duck.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    df = entry_point.queries()[name](spark, sf_dir)
    want = duck.execute(entry_point.oracle_sql()[name])
    assert rows_of(df.columns, df.collect()) == rows_of([d[0] for d in want.description], want.fetchall())


@pytest.mark.parametrize("name", ["replay_batch", "state_compact_between_batches", "stream_state_handover"])
def test_batches_are_cut_from_stored_postings(spark, sf_dir, monkeypatch, name):
    """Each delivery would otherwise derive all postings again, several times."""
    read = []

    def seen(batch, *args):
        read.extend(batch.inputFiles())
        return sync(batch, *args)

    sync = streams.sync_batch
    monkeypatch.setattr(streams, "sync_batch", seen)
    entry_point.queries()[name](spark, sf_dir).collect()
    assert read and not [f for f in read if f.endswith(".parquet") and "/part.parquet" in f]
