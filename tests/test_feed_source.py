"""The change feed as a stream source: offsets, restarts, start at latest, one key."""

import pytest
from pyspark.sql import functions as F

from tidemark.streaming.feed_source import ChangeFeed, FeedReader, finished_versions
from tidemark.streaming.watch import run_until

SCHEMA = "key string, seq bigint, after struct<v:bigint>"


@pytest.fixture
def feed(spark, tmp_path):
    spark.dataSource.register(ChangeFeed)
    root = str(tmp_path / "feed")

    def add(version, *keys, stream=""):
        rows = [(k, 10 * version + i, (version,)) for i, k in enumerate(keys)]
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{root}/v={stream}{version}")

    def read(name, **options):
        stream = spark.readStream.format("change_feed").schema(SCHEMA).options(path=root, **options).load()
        run_until(stream, str(tmp_path / name), str(tmp_path / f"{name}-checkpoint"))
        got = spark.read.schema(SCHEMA).parquet(str(tmp_path / name)).collect()
        return sorted((r.key, r.seq, r.after.v) for r in got)

    return root, add, read


def test_a_restarted_query_goes_on_where_it_stopped(feed):
    root, add, read = feed
    add(0, "a", "b")
    assert read("all") == [("a", 0, 0), ("b", 1, 0)]
    assert read("all") == [("a", 0, 0), ("b", 1, 0)]
    add(1, "a")
    add(2, "c")
    assert read("all") == [("a", 0, 0), ("a", 10, 1), ("b", 1, 0), ("c", 20, 2)]


def test_versions_per_batch(feed):
    root, add, read = feed
    for v in range(3):
        add(v, "a")
    assert [len(read("one", versionsPerBatch="1")) for _ in range(4)] == [1, 2, 3, 3]


def test_start_at_latest_and_at_a_version(feed):
    root, add, read = feed
    add(0, "a")
    add(1, "b")
    assert read("late", startingVersion="latest") == []
    add(2, "c")
    assert read("late", startingVersion="latest") == [("c", 20, 2)]
    assert read("from", startingVersion="1") == [("b", 10, 1), ("c", 20, 2)]


def test_unfinished_versions_are_not_seen(feed, tmp_path):
    root, add, read = feed
    add(0, "a")
    add(1, "b")
    (tmp_path / "feed" / "v=1" / "_SUCCESS").unlink()
    assert read("all") == [("a", 0, 0)]
    (tmp_path / "feed" / "v=1" / "_SUCCESS").touch()
    assert read("all") == [("a", 0, 0), ("b", 10, 1)]


def test_one_key_skips_row_groups(spark, feed, tmp_path):
    root, add, read = feed
    add(0, "a", "b", "a")
    assert read("key", keyColumn="key", keyValue="a") == [("a", 0, 0), ("a", 2, 0)]
    assert read("none", keyColumn="key", keyValue="zz") == []
    # Sorted by key, all but one row group of a file can be told from its statistics.
    import pyarrow.dataset as ds

    path = str(tmp_path / "sorted")
    rows = spark.range(40_000).select(F.format_string("k%06d", "id").alias("key"))
    small = {"parquet.block.size": "16384", "parquet.page.size": "4096"}
    rows.coalesce(1).write.options(**small).parquet(path)
    fragment = next(iter(ds.dataset(path, format="parquet").get_fragments()))
    groups = len(fragment.row_groups)
    hit = len(fragment.split_by_row_group(filter=ds.field("key") == "k000007"))
    assert groups > 3 and hit == 1


def test_streams_in_one_folder_are_named(feed):
    root, add, read = feed
    add(0, "a", stream="s1-")
    assert finished_versions(root).keys() == {0}
    add(0, "b", stream="s2-")
    with pytest.raises(ValueError, match="name one"):
        finished_versions(root)
    assert read("s2", stream="s2") == [("b", 0, 0)]


def test_an_empty_feed_has_nothing(tmp_path):
    reader = FeedReader(None, {"path": str(tmp_path / "none")})
    assert reader.initialOffset() == reader.latestOffset() == {"version": 0}
