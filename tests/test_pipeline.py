"""End to end: landed pages to verdicts, feed and stored state, batch and stream."""

import json

import pytest
from pyspark.sql import functions as F

from tidemark.functions.identity import KEY
from tidemark.plans.jobs import posting_spec, sync_due_feeds
from tidemark.sources.snapshots import StateTable
from tidemark.streaming.requests import MAX_RECEIVES, routed
from tidemark.streaming.sync import sync_batch
from tidemark.streaming.watch import read_feed, run_until, watch_key


def land(spark, *bodies):
    rows = [(s, 0, json.dumps(b)) for s, b in bodies]
    return spark.createDataFrame(rows, "source_id string, page_no bigint, payload string")


def job(title, text, salary=None):
    return {"jobs": [{"guid": "g", "title": title, "companyName": "Acme", "locationRestrictions": ["Bengaluru"],
                      "employmentType": "Full Time", "minSalary": salary, "description": text, "applicationLink": "u"}]}


def other(title, text):
    return {"jobs": [{"id": 1, "jobTitle": title, "companyName": "ACME", "jobGeo": "Bangalore",
                      "jobType": ["full-time"], "jobDescription": text, "url": "u"}]}


def test_scheduled_runs(spark, tmp_path):
    sources = spark.createDataFrame(
        [("himalayas", "BUILTIN", "ACTIVE", None), ("jobicy", "BUILTIN", "DISABLED", None)],
        "source_id string, source_type string, status string, next_check bigint")
    table = StateTable(spark, str(tmp_path / "state"), [KEY])
    out = str(tmp_path / "out")

    def run(version, *bodies):
        assert sync_due_feeds(land(spark, *bodies), sources, table, out, 1000 + version, version)
        return [(r.change_type, list(r.changed_fields)) for r in
                spark.read.parquet(f"{out}/results/v={version}").collect()]

    first = ("himalayas", job("Data Engineer", "<p>Build it</p>"))
    assert run(0, first, ("jobicy", other("x", "y"))) == [("NEW", [])]
    assert not sync_due_feeds(land(spark, first), sources, table, out, 1000, 0)
    assert run(1, ("himalayas", job("DATA engineer", "Build  it"))) == [("UNCHANGED", [])]
    assert run(2, ("himalayas", job("DATA engineer", "Build more", 10))) == [
        ("CHANGED", ["title", "salary_min", "description"])]
    row = table.read().first()
    assert (row.first_seen, row.last_changed, row.change_count, row.status) == (1000, 1002, 1, "OPEN")
    assert row.title == "DATA engineer"
    feed = [spark.read.parquet(f"{out}/feed/v={v}").collect() for v in range(3)]
    assert [len(f) for f in feed] == [1, 0, 1]
    event = feed[2][0]
    assert (event.event_name, event.before.title, event.after.title) == ("MODIFY", "Data Engineer", "DATA engineer")
    assert feed[0][0].before is None

    stream = read_feed(spark, f"{out}/feed", spark.read.parquet(f"{out}/feed/v=0").schema)
    run_until(watch_key(stream, KEY, row[KEY]), str(tmp_path / "sink"), str(tmp_path / "cp"))
    watched = spark.read.parquet(str(tmp_path / "sink")).collect()
    assert sorted((w.event_name, w.has_old_image) for w in watched) == [("INSERT", False), ("MODIFY", True)]


def test_same_job_from_two_feeds(spark, tmp_path):
    sources = spark.createDataFrame([(s, "BUILTIN", "ACTIVE", None) for s in ("himalayas", "jobicy")],
                                    "source_id string, source_type string, status string, next_check bigint")
    table = StateTable(spark, str(tmp_path / "state"), [KEY])
    pages = land(spark, ("jobicy", other("Engineer, Data", "<b>Build</b> it")), ("himalayas", job("Data Engineer", "Build it")))
    assert sync_due_feeds(pages, sources, table, str(tmp_path / "out"), 5, 0)
    rows = table.read().collect()
    assert len(rows) == 1 and rows[0].change_count == 1
    # Feed order decides: the second feed comes last and replaces the whole row.
    assert rows[0].source == "jobicy"


def test_replayed_batch_writes_nothing(spark, tmp_path):
    rows = spark.range(8).select(
        F.col("id").alias("seq"), F.lit("s").alias("source"), F.concat(F.lit("k"), "id").alias(KEY),
        *[F.lit("v").alias(c) for c in ("title", "company", "location", "employment_type", "description", "apply_url")],
        F.lit(1).cast("decimal(18,4)").alias("salary_min"), F.lit(None).cast("decimal(18,4)").alias("salary_max"))
    table = StateTable(spark, str(tmp_path / "state"), [KEY])
    spec = posting_spec(F.col("seq"))
    out = str(tmp_path / "out")
    assert sync_batch(rows, 0, spec, table, out)
    assert not sync_batch(rows, 0, spec, table, out)
    assert sync_batch(rows, 1, spec, table, out)
    again = spark.read.parquet(f"{out}/results/v=1")
    assert {r.change_type for r in again.collect()} == {"UNCHANGED"}
    assert table.read().count() == 8 and spark.read.parquet(f"{tmp_path}/state/delta/__version=1").count() == 0


def test_deliveries_are_routed_once(spark, tmp_path):
    sources = spark.createDataFrame([("a", "ACTIVE")], "source_id string, status string")
    new = spark.createDataFrame([("1", '{"source_id":"a"}', 0), ("2", "{", 0), ("3", '{"source_id":"b"}', 1), ("4", "{", 2)],
                                "message_id string, body string, attempts bigint")
    got = sorted((r.message_id, r.route, r.attempts) for r in routed(new, sources).collect())
    assert got == [("1", "done", 1), ("2", "pending", 1), ("3", "pending", 2), ("4", "dead", MAX_RECEIVES)]


def test_batches_around_a_compaction_and_a_new_stream(spark, tmp_path):
    def batch(seq, key, title):
        return spark.createDataFrame([(seq, "s", key, title)], f"seq bigint, source string, {KEY} string, title string").select(
            "*", *[F.lit("v").alias(c) for c in ("company", "location", "employment_type", "description", "apply_url")],
            F.lit(1).cast("decimal(18,4)").alias("salary_min"), F.lit(None).cast("decimal(18,4)").alias("salary_max"))

    table, spec, out = StateTable(spark, str(tmp_path / "state"), [KEY]), posting_spec(F.col("seq")), str(tmp_path / "out")
    assert sync_batch(batch(0, "a", "x"), 0, spec, table, out)
    assert sync_batch(batch(1, "a", "y"), 1, spec, table, out)
    table.compact()
    assert sync_batch(batch(2, "b", "z"), 2, spec, table, out)
    assert sorted((r[KEY], r.title) for r in table.read().collect()) == [("a", "y"), ("b", "z")]
    with pytest.raises(ValueError):
        sync_batch(batch(3, "c", "w"), 0, spec, table, out)
    # A fresh checkpoint starts at 0 again under a name of its own.
    assert sync_batch(batch(3, "c", "w"), 0, spec, table, out, stream="another")
    assert table.read().count() == 3
