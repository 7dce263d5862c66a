"""The trigram index and the page directory against scans and plain numbering."""

import random

import pytest
from pyspark.sql import functions as F

from test_sources import scanned_rows
from tidemark.operators import ordered, page_directory, text_index

ROWS = "id bigint, text string"


def made(n, seed=0):
    rnd = random.Random(seed)
    words = ["alpha", "Beta", "ga\nmma", "100%", "a_b", "c\\d", "ÉTÉ", "日本語", "x😀y", "zz"]
    rows = [(i, " ".join(rnd.choices(words, k=rnd.randint(0, 6)))) for i in range(n)]
    return rows + [(n, None), (n + 1, ""), (n + 2, "only here: quux"), (n + 3, "long " * 30_000 + "the end")]


@pytest.mark.parametrize("block_rows, range_rows", [(1, 7), (4, 50), (256, 1_000_000)])
def test_search_equals_a_scan(spark, tmp_path, block_rows, range_rows):
    rows, path = made(150), str(tmp_path / "index")
    for batch in (0, 1, 1):
        part = spark.createDataFrame([r for r in rows if r[0] % 2 == batch], ROWS)
        text_index.add(part, path, batch, ["id"], F.lower("text"), block_rows, range_rows)
    for asked in ["", "a", "zz", "beta", "a\nm", "0% ", "_b", "\\d", "été", "日本語", "x😀y", "😀y ", "quux", "the end", "missing"]:
        got = text_index.search(spark, path, asked, F.lower("text"), block_rows)
        assert got.columns == ["id", "text"]
        want = sorted(i for i, t in rows if t is not None and asked.lower() in t.lower())
        assert sorted(r.id for r in got.collect()) == want, asked


def test_a_search_skips_blocks_without_its_trigrams(spark, tmp_path):
    path = str(tmp_path / "index")
    rows = spark.range(30_000).select("id", F.concat(F.lit("word"), F.md5(F.col("id").cast("string"))).alias("text"))
    rows = rows.withColumn("text", F.when(F.col("id") == 12_345, "wordneedle").otherwise(F.col("text")))
    text_index.add(rows, path, 0, ["id"], F.lower("text"))
    assert text_index.candidates(spark, path, "needle").count() == 1
    rest = text_index.search(spark, path, "NEEDLE", F.lower("text"))
    assert [r.id for r in rest.collect()] == [12_345]
    # The candidate list is one row; the rest are rows of the stored table.
    assert scanned_rows(rest) < 3_000


def test_long_texts_are_stored_by_several_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ordered, "TASK_BYTES", 100_000, raising=False)
    path = str(tmp_path / "index")
    rows = spark.range(4_000).select("id", F.sha2(F.col("id").cast("string"), 512).alias("text"))
    text_index.add(rows, path, 0, ["id"], F.lower("text"))
    assert len(spark.read.parquet(f"{path}/rows").inputFiles()) >= 4
    asked = rows.filter("id = 1234").first().text[20:60]
    assert [r.id for r in text_index.search(spark, path, asked, F.lower("text")).collect()] == [1234]


def test_an_empty_index_finds_nothing(spark, tmp_path):
    path = str(tmp_path / "index")
    text_index.add(spark.createDataFrame([], ROWS), path, 0, ["id"], F.lower("text"))
    assert text_index.search(spark, path, "any", F.lower("text")).count() == 0
    assert text_index.search(spark, path, "", F.lower("text")).count() == 0


@pytest.mark.parametrize("range_rows", [3, 40, 1_000_000])
def test_pages_equal_plain_numbering(spark, tmp_path, range_rows):
    path = str(tmp_path / "pages")
    keys = [None, *random.Random(1).sample(range(10_000), 133)]
    rows = spark.createDataFrame([(k, f"t{k}") for k in keys], "id bigint, text string").repartition(5)
    page_directory.store(rows, path, ["id"], range_rows)
    order = sorted(keys, key=lambda k: (k is not None, k or 0))
    assert page_directory.pages_in(spark, path, 20) == 7
    for number in (1, 2, 4, 7, 8):
        got = page_directory.read_page(spark, path, number, 20).collect()
        want = order[(number - 1) * 20 : number * 20]
        assert [r.id for r in sorted(got, key=lambda r: r.row_no)] == want
        assert sorted(r.row_no for r in got) == [(number - 1) * 20 + i + 1 for i in range(len(want))]
        assert all(r.page_no == number and r.text == f"t{r.id}" for r in got)
    with pytest.raises(ValueError):
        page_directory.read_page(spark, path, 0, 20)


def test_a_page_reads_few_rows(spark, tmp_path):
    path = str(tmp_path / "pages")
    page_directory.store(spark.range(60_000).toDF("id"), path, ["id"], 30_000)
    page = page_directory.read_page(spark, path, 400, 100)
    assert scanned_rows(page) <= 3_000
    assert page.agg(F.min("id"), F.max("id")).first()[:] == (39_900, 39_999)


def test_an_empty_table_has_no_pages(spark, tmp_path):
    path = str(tmp_path / "pages")
    page_directory.store(spark.range(0).toDF("id"), path, ["id"])
    assert page_directory.pages_in(spark, path) == 0
    assert page_directory.read_page(spark, path, 1).count() == 0
