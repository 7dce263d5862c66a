import json

import pytest
from pyspark.sql import functions as F

from tidemark.functions.paths import clean_value, get_path, number_at
from tidemark.sources import custom, feeds, landed
from tidemark.sources.messages import check_requests, crawl_requests, parse_requests
from tidemark.sources.snapshots import StateTable

PAYLOAD = json.dumps({"data": {"jobs": [{"title": "Backend Engineer"}, {"title": "Cloud Engineer"}]}})


@pytest.mark.parametrize(
    "path,want",
    [
        ("data.jobs.1.title", "Cloud Engineer"),
        ("data.jobs.0.title", "Backend Engineer"),
        ("data.jobs.7.title", ""),
        ("data.jobs.title", ""),
        ("", ""),
        (None, ""),
    ],
)
def test_paths(spark, path, want):
    df = spark.createDataFrame([(PAYLOAD, path)], "j string, p string")
    assert df.select(clean_value(get_path(F.parse_json("j"), F.col("p")))).first()[0] == want


@pytest.mark.parametrize(
    "raw,want",
    [('"$120,000"', 120000.0), ('"not published"', None), ("1e5", 100000.0), ("true", None),
     ("null", None), ("-3", None), ('"1e5"', 15.0), ("[1,2]", 12.0)],
)
def test_numbers(spark, raw, want):
    df = spark.createDataFrame([(f'{{"v":{raw}}}',)], "j string")
    value = F.try_variant_get(F.parse_json("j"), "$.v", "variant")
    assert df.select(number_at(value)).first()[0] == want


def config(spark, fields, paging=("NONE", 1, 1), records_path="jobs", source="custom-x"):
    row = (source, "CUSTOM_API", ("https://x.example/", records_path, fields, (paging[0], "page", paging[1], paging[2])))
    return spark.createDataFrame([row], f"source_id string, source_type string, api_config {custom.CONFIG_TYPE}")


FLAT = {"source_id": "id", "title": "title", "company": "company", "location": "location",
        "employment_type": "type", "apply_url": "apply"}
RECORD = {"id": "abc-123", "title": "Backend Engineer", "company": "Example Corp", "location": "Remote",
          "type": "full-time", "apply": "https://jobs.example.com/abc-123"}


def pages(spark, bodies, source="custom-x"):
    rows = [(source, i, json.dumps(b) if not isinstance(b, str) else b) for i, b in bodies]
    return spark.createDataFrame(rows, "source_id string, page_no bigint, payload string")


def test_configured_record(spark):
    got = custom.map_records(pages(spark, [(1, {"jobs": [RECORD, "x", {"title": "t"}]})]), config(spark, FLAT))
    full = feeds.finalize(got).collect()
    assert len(full) == 1
    row = full[0]
    assert (row.source, row.source_id, row.employment_type) == ("custom-x", "abc-123", "FULL_TIME")
    assert row.apply_url == RECORD["apply"] and len(row.canonical_job_id) == 16


def test_external_id_falls_back(spark):
    records = [{"title": "t", "company": "c", "location": "l"}, {"title": "t", "company": "c", "apply": "u"}]
    got = custom.map_records(pages(spark, [(1, {"jobs": records})]), config(spark, FLAT)).collect()
    assert [r.source_id for r in sorted(got, key=lambda r: r.pos)] == ["c|t|l", "u"]


def test_reading_stops_at_first_empty_page_and_at_the_cap(spark):
    def body(*ids):
        return {"jobs": [{"id": i, "title": "t", "company": "c"} for i in ids]}

    landed_pages = pages(spark, [(0, body("z")), (1, body("a", "b")), (2, body("c")), (3, {"jobs": []}), (4, body("d"))])
    cfg = config(spark, FLAT, ("PAGE", 1, 9))
    ids = lambda df: [r.source_id for r in sorted(df.collect(), key=lambda r: (r.page_no, r.pos))]
    assert ids(custom.map_records(landed_pages, cfg)) == ["a", "b", "c"]
    assert ids(custom.map_records(landed_pages, cfg, limit=2)) == ["a", "b"]
    assert ids(custom.map_records(landed_pages, config(spark, FLAT, ("PAGE", 1, 1)))) == ["a", "b"]
    eleven = pages(spark, [(i, body(str(i))) for i in range(1, 13)])
    assert len(ids(custom.map_records(eleven, config(spark, FLAT, ("PAGE", 1, 50))))) == 12
    many = pages(spark, [(1, body(*[str(i) for i in range(900)]))])
    assert len(ids(custom.map_records(many, config(spark, FLAT)))) == 900


def test_a_broken_page_fails_the_run_of_its_feed(spark):
    good = {"jobs": [{"id": "a", "title": "t", "company": "c"}]}
    paged = config(spark, FLAT, ("PAGE", 1, 9))
    assert custom.map_records(pages(spark, [(1, good), (2, "{nope"), (3, good)]), paged).count() == 0
    # Behind the end of the feed it does not matter.
    assert custom.map_records(pages(spark, [(1, good), (2, {"jobs": []}), (3, "{nope")]), paged).count() == 1


def test_a_huge_salary_is_no_salary(spark):
    rich = {"jobs": [{"id": "a", "title": "t", "company": "c", "salary": 10**18}]}
    fields = {**FLAT, "salary_min": "salary"}
    got = custom.map_records(pages(spark, [(1, rich)]), config(spark, fields)).collect()
    assert [r.salary_min for r in got] == [None]
    a = {"jobs": [{"guid": "1", "title": "T", "companyName": "C", "minSalary": 10**18}]}
    landed = pages(spark, [(1, a)]).withColumn("source_id", F.lit("himalayas"))
    assert [r.salary_min for r in feeds.adapt(landed, "himalayas").collect()] == [None]


def test_rejects(spark):
    landed_pages = pages(spark, [(1, "{nope"), (2, {"jobs": 3}), (3, {"jobs": []})])
    got = {r.page_no: r.reject for r in custom.rejected_pages(landed_pages, config(spark, FLAT)).collect()}
    assert got == {1: "not_json", 2: "no_record_array"}


def test_preview(spark):
    body = {"jobs": [dict(RECORD, id=str(i)) for i in range(5)] + [{"title": ""}]}
    got = custom.preview(pages(spark, [(1, body)]), config(spark, FLAT)).collect()
    assert len(got) == 3 and {(r.sample_count, r.records_seen) for r in got} == {(3, 6)}
    assert {r.employment_type for r in got} == {"FULL_TIME"}


def test_root_array(spark):
    got = custom.map_records(pages(spark, [(1, [RECORD])]), config(spark, FLAT, records_path="$"))
    assert got.count() == 1


def test_builtin_feeds(spark):
    a = {"jobs": [{"guid": "", "applicationLink": "u", "title": "<b>T</b> &amp; x", "companyName": "C",
                   "locationRestrictions": ["A", "B"], "employmentType": "Full Time", "minSalary": 10,
                   "maxSalary": None, "description": "<p>d</p>", "pubDate": None}]}
    b = {"jobs": [{"id": 7, "jobTitle": "T", "companyName": "C", "jobGeo": "G", "jobType": ["full-time", "<i>x</i>"],
                   "jobDescription": "d", "url": "u", "pubDate": "p"}]}
    c = [{"legal": 1}, "text", {"id": "1", "position": "P", "company": "C", "tags": ["Full Time", "sql"],
                                "apply_url": "", "url": "u2", "salary_min": 5, "date": "d"}]
    landed_pages = (
        pages(spark, [(0, a)], "himalayas").unionByName(pages(spark, [(0, b)], "jobicy"))
        .unionByName(pages(spark, [(0, c)], "remoteok"))
    )
    sources = spark.createDataFrame([("himalayas", None)], "source_id string, source_type string")
    rows = {r.source: r for r in feeds.union_feeds(landed_pages, sources).collect()}
    assert (rows["himalayas"].source_id, rows["himalayas"].title, rows["himalayas"].location) == ("u", "T & x", "A, B")
    assert rows["himalayas"].published_at == "" and rows["himalayas"].salary_max is None
    assert (rows["jobicy"].source_id, rows["jobicy"].employment_type) == ("7", "FULL_TIME")
    assert (rows["remoteok"].apply_url, rows["remoteok"].employment_type) == ("u2", "FULL_TIME")
    raw = feeds.adapt(landed_pages, "jobicy").first()
    assert raw.employment_type == "full-time, x"


def test_dispatch_and_seed(spark, tmp_path):
    rows = [("jobicy", None), ("c", "custom_api"), ("x", "BUILTIN"), ("jobicy", "FTP")]
    df = spark.createDataFrame(rows, "source_id string, source_type string")
    assert [r.adapter for r in feeds.dispatch(df).collect()] == ["jobicy", "custom", None, None]
    item = {"source_id": {"S": "s1"}, "source_name": {"S": "S 1"}, "crawl_interval": {"N": "3600"}, "status": {"S": "ACTIVE"}}
    (tmp_path / "seed.json").write_text(json.dumps({"Sources": [{"PutRequest": {"Item": item}}]}, indent=1))
    seed = landed.read_seed(spark, str(tmp_path)).first()
    assert (seed.source_id, seed.crawl_interval, seed.status) == ("s1", 3600, "ACTIVE")


def test_requests(spark):
    sources = spark.createDataFrame([("a", "ACTIVE"), ("d", "DISABLED")], "source_id string, status string")
    bodies = ['{"source_id":"a"}', '{"source_id":"d"}', '{"source_id":"n"}', "{}", "[]", "{", None]
    df = spark.createDataFrame([(b,) for b in bodies], "body string")
    got = [r.outcome for r in check_requests(parse_requests(df).coalesce(1), sources).collect()]
    assert sorted(got) == sorted(["OK", "source_not_active", "source_not_found", "no_source_id",
                                  "not_an_object", "malformed", "malformed"])
    body = crawl_requests(sources, 5, "MANUAL_SYNC", "admin").filter("source_id = 'a'").first().body
    assert json.loads(body) == {"source_id": "a", "reason": "MANUAL_SYNC", "requested_at": 5, "requested_by": "admin"}


def test_state_table(spark, tmp_path):
    table = StateTable(spark, str(tmp_path / "state"), ["id"])
    rows = lambda *kv: spark.createDataFrame(list(kv), "id string, v bigint")
    now = lambda **kw: sorted((r.id, r.v) for r in table.read(**kw).collect())
    assert table.read() is None
    assert table.upsert(rows(("01", 1), ("02", 2), ("ff", 3)), 0)
    assert not table.upsert(rows(("01", 99)), 0)
    assert table.upsert(rows(("02", 20), ("03", 30)), 1)
    assert now() == [("01", 1), ("02", 20), ("03", 30), ("ff", 3)]
    assert table.delete(rows(("01", 0)), 2)
    assert now() == [("02", 20), ("03", 30), ("ff", 3)]
    assert table.compact() == 3
    assert now() == [("02", 20), ("03", 30), ("ff", 3)]
    # The compaction takes no number from the batches.
    assert table.upsert(rows(("02", 21)), 3)
    assert not table.upsert(rows(("02", 99)), 3)
    assert now() == [("02", 21), ("03", 30), ("ff", 3)]
    assert now(keys=["02", "ff"]) == [("02", 21), ("ff", 3)]
    with pytest.raises(ValueError):
        table.upsert(rows(("x", 1)), 1)
    # Another stream counts its batches by itself; writes may have no batch at all.
    assert table.upsert(rows(("s", 5)), 0, "other")
    assert table.upsert(rows(("t", 6)))
    assert now() == [("02", 21), ("03", 30), ("ff", 3), ("s", 5), ("t", 6)]


def test_state_table_compacts_by_itself(spark, tmp_path):
    table = StateTable(spark, str(tmp_path / "state"), ["id"], compact_after=2)
    for i in range(6):
        assert table.upsert(spark.createDataFrame([(f"k{i % 3}", i)], "id string, v bigint"), i)
    assert sorted((r.id, r.v) for r in table.read().collect()) == [("k0", 3), ("k1", 4), ("k2", 5)]
    assert len(table.versions()) > 6


def scanned_rows(df):
    """Rows that the Parquet scans of a plan gave, after skipping row groups."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    plan = plan.executedPlan() if "AdaptiveSparkPlan" in plan.nodeName() else plan
    leaves, total = plan.collectLeaves(), 0
    for i in range(leaves.size()):
        node = leaves.apply(i)
        node = node.plan() if "QueryStage" in node.nodeName() else node
        if "Scan parquet" in node.nodeName():
            total += node.metrics().apply("numOutputRows").value()
    return total


def test_a_lookup_skips_row_groups(spark, tmp_path):
    spark.conf.set("parquet.block.size", "65536")
    table = StateTable(spark, str(tmp_path / "state"), ["id"], prefix=1)
    rows = spark.range(40_000).select(F.sha2(F.col("id").cast("string"), 256).alias("id"), F.col("id").alias("v"))
    try:
        for part in range(4):
            # Deltas hold scattered keys: their ranges overlap, only the filters tell them apart.
            table.upsert(rows.filter(F.col("v") % 4 == part).coalesce(1), part)
    finally:
        spark.conf.unset("parquet.block.size")
    ids = [r.id for r in rows.filter("v in (5, 17, 39999)").collect()]
    asked = spark.createDataFrame([(i,) for i in [*ids, "none"]], "id string")
    found = table.lookup(asked)
    assert sorted(r.v for r in found.collect()) == [5, 17, 39999]
    deltas = spark.read.parquet(f"{table.root}/delta").filter(F.col("id") == ids[0])
    assert scanned_rows(deltas) <= 10_000 < 40_000
    assert scanned_rows(spark.read.parquet(f"{table.root}/delta").filter("id = 'none'")) == 0
    table.compact()
    assert sorted(r.v for r in table.lookup(asked).collect()) == [5, 17, 39999]
    # A null key, or too many keys, read the whole table and find the same rows.
    more = asked.unionByName(spark.createDataFrame([(None,)], "id string"))
    assert sorted(r.v for r in table.lookup(more).collect()) == [5, 17, 39999]
    assert sorted(r.v for r in table.lookup(asked, most=1).collect()) == [5, 17, 39999]


def test_a_long_list_of_keys_stays_out_of_the_plan(spark, tmp_path, capsys):
    table = StateTable(spark, str(tmp_path / "state"), ["id"])
    rows = spark.range(3_000).withColumn("v", F.col("id") * 2)
    table.upsert(rows)
    table.compact()
    table.delete(rows.filter("id % 3 = 0"))
    asked = rows.select("id").filter("id % 2 = 1").unionByName(spark.range(5_000, 5_010))
    found = table.lookup(asked, most=asked.count())
    assert sorted(r.id for r in found.collect()) == [i for i in range(3_000) if i % 2 and i % 3]
    capsys.readouterr()
    found.explain(True)
    plan = capsys.readouterr().out
    assert " IN (" not in plan and "INSET" not in plan


def test_pages_are_mapped_in_several_tasks_whatever_the_join_streams(spark):
    noise = F.concat(*[F.sha2(F.concat("id", F.lit(f"-{i}")), 512) for i in range(400)])
    pages = spark.range(60).select(
        F.lit("api").alias("source_id"),
        F.col("id").alias("page_no"),
        F.concat(F.lit('{"data":{"jobs":[{"t":"x","n":"'), noise, F.lit('"}]}}')).alias("payload"),
    )
    found = custom.with_records(F.broadcast(pages), config(spark, FLAT, records_path="data.jobs", source="api").coalesce(1))
    rows = found.select("page_no", F.size("records").alias("n"), F.spark_partition_id().alias("task")).collect()
    assert sorted((r.page_no, r.n) for r in rows) == [(i, 1) for i in range(60)]
    assert len({r.task for r in rows}) > 1
