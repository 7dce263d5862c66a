"""Archives: round trip, revisits and the global order of the merged index."""

import hashlib
import random

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_point
from check import rows_of
from tidemark.llm import warc

PAGES = "page_id bigint, url string, html string"


def test_equals_sql(spark, sf_dir):
    duck = duckdb.connect()
    duck.execute(f"create view pages as select * from '{sf_dir}/pages.parquet'")
    df = entry_point.queries()["op6_warc_index"](spark, sf_dir)
    want = duck.execute(entry_point.oracle_sql()["op6_warc_index"])
    assert rows_of(df.columns, df.collect()) == rows_of([d[0] for d in want.description], want.fetchall())


@pytest.fixture(scope="module")
def pages(spark):
    same = "same payload \r\n\r\n WARC/1.1\r\n" * 10
    rows = [
        (5, "http://www.B.example.com/x?q=1#frag", same),
        (2, "https://user@a.example.com:8080/", same),
        (9, None, same),
        (3, "http://b.example.com/x?q=1", "short"),
        (4, "http://b.example.com/x?q=1", "short"),
        (7, "bad\r\nurl", "ü" * 60),
        (8, "http://c.example/", None),
        (1, "http://c.example/", ""),
        (11, "http://a.example.com/" + "p" * 3000, "long " * 50_000),
        (None, "http://z.example/", "ü" * 60),
        (6, "http://d.example/", "twice " * 30),
        (6, "http://d.example/", "twice " * 30),
    ]
    return spark.createDataFrame(rows, PAGES)


@pytest.mark.parametrize("per_file", [2, 4_000])
def test_round_trip(spark, pages, per_file):
    path = warc.scratch_path(spark, "warc-test")
    warc.write_archives(pages, path, records_per_file=per_file)
    read = warc.read_archives(spark, path)
    rows = read.collect()
    assert len(rows) == pages.count()
    want = {r["page_id"]: (r["html"] or "").encode() for r in pages.collect()}
    for r in rows:
        assert r["payload_bytes"] == len(want[r["page_id"]])
        assert r["payload_digest"] == hashlib.sha256(want[r["page_id"]]).hexdigest()
    kinds = {r["page_id"]: (r["record_type"], r["refers_to"]) for r in rows}
    assert kinds == {5: ("revisit", 2), 2: ("response", None), 9: ("revisit", 2), 3: ("response", None), 4: ("response", None),
                     7: ("response", None), None: ("revisit", 7), 8: ("response", None), 1: ("response", None),
                     11: ("response", None), 6: ("response", None)}
    merged = warc.merge_index(read, parts=3).collect()
    keys = [(r["url_key"], r["captured"], r["page_id"] is not None, r["page_id"] or 0) for r in merged]
    assert keys == sorted(keys) and len(merged) == len(rows)


def test_url_keys(spark):
    df = spark.createDataFrame([("http://www.B.Example.com/X?q=1#f",), ("https://u:p@a.com:8080",), (None,)], "u string")
    assert [r[0] for r in df.select(warc.url_key(F.col("u"))).collect()] == ["com,example,b)/x?q=1", "com,a):8080", ")/"]


@pytest.mark.parametrize("runs", [0, 1, 2, 3, 5, 8, 13])
def test_loser_tree(runs):
    rng = random.Random(runs)
    made = [sorted((rng.randrange(50), i) for i in range(rng.randrange(0, 40))) for _ in range(runs)]
    assert list(warc.LoserTree([iter(r) for r in made])) == sorted(x for r in made for x in r)


def test_no_pages(spark):
    assert warc.archive_and_index(spark.createDataFrame([], PAGES)).count() == 0
