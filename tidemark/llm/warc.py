"""WARC archives of pages, read back and indexed by an external merge.

Equal payloads are stored once: the page with the smallest id holds the response,
the others are revisits of it.  Each archive is written in the order of its URL
keys and capture times, so its index is a sorted run.  The runs are cut into key
ranges, and a loser tree merges the runs of a range: the result is the capture
history of every URL in global order.

A null page is an empty payload, a null URL an empty one.  Rows that repeat both
page id and payload are equal captures and share their record type; a null id
counts as larger than any other.  Without capture times a page is dated by its id
modulo ``CAPTURE_SPAN``.  An empty table gives no archive.
"""

from __future__ import annotations

import gzip
import hashlib
import io
from collections.abc import Iterable, Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tidemark.llm.common import materialise, scratch_path, slices

#: Payloads of fewer bytes are always stored.
LEAST_BYTES = 100
#: Records of one archive file at most, so that one file fits a task.
RECORDS_PER_FILE = 4_000
#: Time of capture where the table has none: this epoch second plus the page id.
FIRST_CAPTURE = 1_704_067_200
#: Ids count on from it modulo this many seconds, so any id has a date with four-digit year.
CAPTURE_SPAN = 10**9
_END = "\r\n"
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def classified(pages: DataFrame, key: str = "page_id", payload: str = "html") -> DataFrame:
    """Adds ``payload_bytes``, ``payload_digest``, ``record_type`` and ``refers_to``."""
    body = F.coalesce(F.col(payload), F.lit(""))
    rows = pages.withColumn("payload_bytes", F.octet_length(body).cast("bigint"))
    rows = rows.withColumn("payload_digest", F.sha2(F.encode(body, "UTF-8"), 256))
    narrow = rows.filter(F.col("payload_bytes") >= LEAST_BYTES).select(key, "payload_digest")
    # Only digests met more than once are joined back.
    first = (
        narrow.groupBy("payload_digest")
        .agg(F.min(key).alias("__first"), F.count(F.lit(1)).alias("__n"))
        .filter("__n > 1")
        .select(F.col("payload_digest").alias("__digest"), "__first")
    )
    rows = rows.join(first, (F.col("payload_digest") == F.col("__digest")) & (F.col("payload_bytes") >= LEAST_BYTES), "left")
    again = F.col("__first").isNotNull() & ~F.col(key).eqNullSafe(F.col("__first"))
    return rows.withColumn("record_type", F.when(again, "revisit").otherwise("response")).withColumn(
        "refers_to", F.when(again, F.col("__first"))
    )


def _header(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value, F.lit(_END))


def _id(key: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(key.cast("string"), F.lit("")), F.lit(">"))


def record(key: str, url: str, payload: str, captured: Column) -> Column:
    """One record as text, without the blank lines that end it."""
    body = F.coalesce(F.col(payload), F.lit(""))
    address = F.regexp_replace(F.coalesce(F.col(url), F.lit("")), r"[\r\n]", "%0A")
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{_END}Content-Type: text/html; charset=utf-8{_END}Content-Length: "),
        F.col("payload_bytes").cast("string"),
        F.lit(_END * 2),
    )
    revisit = F.col("record_type") == "revisit"
    block = F.when(revisit, http).otherwise(F.concat(http, body))
    length = F.octet_length(http) + F.when(revisit, 0).otherwise(F.col("payload_bytes"))
    return F.concat(
        F.lit(f"WARC/1.1{_END}"),
        _header("WARC-Type", F.col("record_type")),
        _header("WARC-Record-ID", _id(F.col(key))),
        _header("WARC-Target-URI", address),
        _header("WARC-Date", F.date_format(F.timestamp_seconds(captured), "yyyy-MM-dd'T'HH:mm:ss'Z'")),
        F.when(
            revisit,
            F.concat(
                _header("WARC-Profile", F.lit(_REVISIT)),
                _header("WARC-Refers-To", _id(F.col("refers_to"))),
            ),
        ).otherwise(F.lit("")),
        _header("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("payload_digest"))),
        F.lit(f"Content-Type: application/http; msgtype=response{_END}"),
        _header("Content-Length", length.cast("string")),
        F.lit(_END),
        block,
    )


def write_archives(
    pages: DataFrame,
    path: str,
    key: str = "page_id",
    url: str = "url",
    payload: str = "html",
    captured: Column | None = None,
    records_per_file: int = RECORDS_PER_FILE,
) -> None:
    """Writes gzipped WARC files below ``path`` with Spark's text writer; each is sorted by URL key and time."""
    time = F.coalesce(F.lit(FIRST_CAPTURE) + F.pmod(F.col(key), F.lit(CAPTURE_SPAN)) if captured is None else captured, F.lit(FIRST_CAPTURE))
    inner = pages.select(F.col(key).alias("page_id"), F.col(url).alias("url"), F.col(payload).alias("html"), time.alias("captured"))
    rows = classified(inner)
    rows = rows.withColumn("__key", url_key(F.col("url")))
    sorted_rows = rows.sortWithinPartitions("__key", "captured", "page_id")
    (
        sorted_rows.select(record("page_id", "url", "html", F.col("captured")).alias("value"))
        .write.option("lineSep", _END * 2)
        .option("compression", "gzip")
        .option("maxRecordsPerFile", records_per_file)
        .text(path)
    )


def url_key(url: Column) -> Column:
    """Host labels from the right, then the path and query, in lower case: ``com,example)/a?b``."""
    plain = F.lower(F.regexp_replace(F.coalesce(url, F.lit("")), r"[\r\n]", "%0A"))
    bare = F.regexp_replace(plain, r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?", "")
    bare = F.regexp_replace(bare, r"#.*$", "")
    host = F.regexp_extract(bare, r"^[^/?:]*", 0)
    rest = F.substring(bare, F.length(host) + 1, 2**31 - 1)
    labels = F.array_join(F.reverse(F.split(F.regexp_replace(host, r"^www\.", ""), r"\.")), ",")
    return F.concat(labels, F.lit(")"), F.when(rest == "", "/").otherwise(rest))


INDEX = T.StructType(
    [
        T.StructField("page_id", T.LongType()),
        T.StructField("url", T.StringType()),
        T.StructField("captured", T.StringType()),
        T.StructField("payload_bytes", T.LongType()),
        T.StructField("payload_digest", T.StringType()),
        T.StructField("record_type", T.StringType()),
        T.StructField("refers_to", T.LongType()),
        T.StructField("archive", T.StringType()),
        T.StructField("offset", T.LongType()),
        T.StructField("length", T.LongType()),
    ]
)


def _page(value: str | None) -> int | None:
    digits = (value or "")[len("<urn:page:") : -1]
    return int(digits) if digits else None


def records(stream, archive: str) -> Iterator[tuple]:
    """Index rows of one archive, in order; the payload of each response is hashed again."""
    offset = 0
    while line := stream.readline():
        begun, fields = offset, {}
        if line.strip() != b"WARC/1.1":
            raise ValueError(f"no record at {offset} of {archive}")
        offset += len(line)
        while (line := stream.readline()).strip():
            offset += len(line)
            name, _, value = line.decode().partition(":")
            fields[name] = value.strip()
        offset += len(line)
        block = stream.read(int(fields["Content-Length"]))
        offset += len(block) + len(stream.read(4))
        http, _, payload = block.partition(b"\r\n\r\n")
        digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
        if fields["WARC-Type"] == "response":
            size = len(payload)
            if hashlib.sha256(payload).hexdigest() != digest:
                raise ValueError(f"damaged payload at {begun} of {archive}")
        else:
            size = int(http.rpartition(b"Content-Length: ")[2])
        yield (
            _page(fields["WARC-Record-ID"]),
            fields["WARC-Target-URI"],
            fields["WARC-Date"],
            size,
            digest,
            fields["WARC-Type"],
            _page(fields.get("WARC-Refers-To")),
            archive,
            begun,
            offset - begun,
        )


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], type=f.type) for i, f in enumerate(schema)], schema=schema)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One index row per record of the archives below ``path``: each archive is a sorted run."""
    arrow = to_arrow_schema(INDEX)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                name = batch.column(0)[i].as_py().rpartition("/")[2]
                rows = []
                with gzip.open(io.BytesIO(batch.column(1)[i].as_buffer())) as plain:
                    for row in records(plain, name):
                        rows.append(row)
                        if len(rows) == 10_000:
                            yield _batch(rows, arrow)
                            rows = []
                if rows:
                    yield _batch(rows, arrow)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path)
    return files.select("path", "content").mapInArrow(run, INDEX)


class LoserTree:
    """Merges sorted runs: each inner node keeps the loser of its match, the root the winner."""

    def __init__(self, runs: list[Iterator[tuple]]):
        self.runs = runs
        self.heads = [next(r, None) for r in runs]
        self.losers = [-1] * len(runs)
        for i in range(len(runs)):
            self._replay(i, building=True)

    def _wins(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return y is None or (x is not None and (x, a) <= (y, b))

    def _replay(self, winner: int, building: bool = False) -> None:
        node = (winner + len(self.runs)) // 2
        while node > 0:
            held = self.losers[node]
            if held < 0 and building:
                self.losers[node] = winner
                return
            if not self._wins(winner, held):
                self.losers[node], winner = winner, held
            node //= 2
        self.losers[0] = winner

    def __iter__(self) -> Iterator[tuple]:
        while self.runs and self.heads[self.losers[0]] is not None:
            winner = self.losers[0]
            yield self.heads[winner]
            self.heads[winner] = next(self.runs[winner], None)
            self._replay(winner)


def merge_index(runs: DataFrame, parts: int | None = None) -> DataFrame:
    """The runs merged into one global order of URL key, capture time and page id.

    Range partitions bound what one merge holds; keys include the page id, so the
    history of one URL may span several ranges.
    """
    spark = runs.sparkSession
    order = ["url_key", "captured", "page_id"]
    keyed = materialise(runs.withColumn("url_key", url_key(F.col("url"))), "index-runs")
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = keyed.repartitionByRange(parts, *order).sortWithinPartitions("archive", "offset")
    schema = ranged.schema
    arrow = to_arrow_schema(schema)
    at = [schema.fieldNames().index(c) for c in order]
    archive = schema.fieldNames().index("archive")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_run: dict[str, list[tuple]] = {}
        for batch in batches:
            for piece in slices(batch):
                for row in zip(*[piece.column(i).to_pylist() for i in range(piece.num_columns)]):
                    key = (row[at[0]], row[at[1]], row[at[2]] is not None, row[at[2]] or 0)
                    by_run.setdefault(row[archive], []).append((key, row))
        merged = LoserTree([iter(rows) for rows in by_run.values()])
        out = []
        for _, row in merged:
            out.append(row)
            if len(out) == 10_000:
                yield _batch(out, arrow)
                out = []
        if out:
            yield _batch(out, arrow)

    return ranged.mapInArrow(run, schema)


def archive_and_index(pages: DataFrame, **options) -> DataFrame:
    """Writes archives of ``pages``, reads them back and returns their merged index."""
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    write_archives(pages, path, **options)
    return merge_index(read_archives(spark, path))
