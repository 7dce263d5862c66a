"""Lempel-Ziv phrase fingerprints.

A text is parsed into dictionary phrases (each the shortest run of bytes not yet
in the dictionary).  The phrases are hashed, and the smallest ``K`` hashes are
the signature.  The share of common hashes among the smallest ``K`` of two
signatures estimates the Jaccard likeness of the phrase sets, which follows how
well one text compresses given the other.

A null text is empty; the fingerprint of an empty text is the empty string, alike
1.0 with another empty one and 0.0 with any other.  A null document id sorts
first; rows with equal ids follow each other by a hash of their text, then in any order.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tidemark.llm.common import map_rows, slices

#: Hashes of a signature.
K = 64


def phrases(data: bytes, known: set[bytes], start: int, at: int) -> tuple[list[bytes], int]:
    """Parses ``data`` from ``at`` with a phrase open since ``start``; adds the new ones to ``known``."""
    added = []
    for end in range(at + 1, len(data) + 1):
        phrase = data[start:end]
        if phrase not in known:
            known.add(phrase)
            added.append(phrase)
            start = end
    return added, start


def signature(known: Iterable[bytes], count: int) -> np.ndarray:
    """The ``K`` smallest mixed hashes of the phrases, ascending."""
    h = np.fromiter(map(zlib.crc32, known), dtype=np.uint32, count=count)
    h ^= h >> np.uint32(16)
    h *= np.uint32(0x7FEB352D)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x846CA68B)
    h ^= h >> np.uint32(16)
    h = np.unique(np.partition(h, 4 * K)[: 4 * K] if count > 4 * K else h)
    return h[:K]


def text_of(signature: np.ndarray) -> str:
    return signature.astype(">u4").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated Jaccard likeness; exact where both have fewer than ``K`` phrases."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    union = np.union1d(a, b)[:K]
    return float((np.isin(union, a) & np.isin(union, b)).sum() / len(union))


def fingerprint(text: str | None) -> np.ndarray:
    data, known = (text or "").encode(), set()
    phrases(data, known, 0, 0)
    return signature(known, len(known))


def fingerprints(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """Columns ``keep`` and ``fingerprint``, one row per document; no shuffle."""
    fields = T.StructType([T.StructField("fingerprint", T.StringType())])
    return map_rows(docs, [text], keep, fields, lambda: lambda value: (text_of(fingerprint(value)),))


def _both(text: str, after: str) -> tuple:
    """Fingerprints of a text and of its edited text, and what the edit is.

    Both share all but the last quarter, so that part is parsed once.
    """
    n = len(text)
    quarter = n // 4
    head = text[: n - quarter].encode()
    edited = text[: n - quarter] + after[:quarter]
    known: set[bytes] = set()
    _, open_at = phrases(head, known, 0, 0)
    added, _ = phrases(text.encode(), known, open_at, len(head))
    own = signature(known, len(known))
    known.difference_update(added)
    phrases(edited.encode(), known, open_at, len(head))
    return own, signature(known, len(known)), hashlib.sha256(edited.encode()).hexdigest()


OUT = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("n_chars", T.LongType()),
        T.StructField("edited_sha256", T.StringType()),
        T.StructField("fingerprint", T.StringType()),
        T.StructField("edited_fingerprint", T.StringType()),
        T.StructField("near_edited", T.DoubleType()),
        T.StructField("near_next", T.DoubleType()),
    ]
)


def in_order(docs: DataFrame) -> DataFrame:
    """Rows by ascending ``doc_id``, each followed by the next row of the whole table.

    The ids are cut at approximate percentiles, which are ids of the table.  Each
    range also gets the rows of the id that opens the next range (``__ahead``),
    the last one those of the smallest id: nothing else has to cross ranges.
    """
    spark = docs.sparkSession
    key = F.coalesce(F.col("doc_id"), F.lit(-(2**63)))
    parts = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), key.cast("bigint").alias("__key"))
    share = [i / parts for i in range(1, parts)]
    cuts = rows.agg(
        F.min("__key").alias("low"), F.percentile_approx("__key", share, 100 * parts).alias("cuts")
    ).first()
    low = cuts["low"]
    cuts = sorted(c for c in set(cuts["cuts"] or ()) if c > low)
    if cuts:
        found = F.array(*[F.lit(c).cast("bigint") for c in cuts])
        part = F.size(F.filter(found, lambda c: c <= F.col("__key")))
    else:
        part = F.lit(0)
    opens = F.array_contains(found, F.col("__key")) if cuts else F.lit(False)
    ahead = (
        F.when(F.col("__key") == F.lit(low), F.lit(len(cuts)))
        .when(opens, part - 1)
        .otherwise(F.lit(None).cast("int"))
    )
    placed = rows.select(
        "doc_id",
        "text",
        "__key",
        F.explode(
            F.array_compact(
                F.array(
                    F.struct(part.alias("p"), F.lit(False).alias("a")),
                    F.when(ahead.isNotNull(), F.struct(ahead.alias("p"), F.lit(True).alias("a"))),
                )
            )
        ).alias("__to"),
    )
    return (
        placed.select("doc_id", "text", "__key", F.col("__to.p").alias("__part"), F.col("__to.a").alias("__ahead"))
        .withColumn("__tie", F.xxhash64("text"))
        .repartitionById(len(cuts) + 1, F.col("__part"))
        .sortWithinPartitions("__part", "__ahead", "__key", "__tie")
    )


def compare_edited(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, with their likenesses."""
    arrow = to_arrow_schema(OUT)

    def pack(rows):
        return pa.RecordBatch.from_arrays(
            [pa.array([r[i] for r in rows], type=f.type) for i, f in enumerate(arrow)], schema=arrow
        )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The row before is finished when its follower is seen; only the first
        # row ahead of a range is a follower, the other ones are not asked for.
        last, waiting = None, None
        for batch in batches:
            for piece in slices(batch):
                rows = []
                columns = [piece.column(c).to_pylist() for c in ("doc_id", "text", "__part", "__ahead")]
                for doc_id, text, part, ahead in zip(*columns):
                    if last is not None and last[2] == part:
                        own, edited, digest = _both(last[1], text)
                        row = (last[0], len(last[1]), digest, text_of(own), text_of(edited), likeness(own, edited))
                        if waiting is not None:
                            rows.append((*waiting[0], likeness(waiting[1], own)))
                        waiting = (row, own)
                    if ahead:
                        if waiting is not None:
                            rows.append((*waiting[0], likeness(waiting[1], fingerprint(text))))
                        last, waiting = None, None
                    else:
                        last = (doc_id, text, part)
                if rows:
                    yield pack(rows)

    return in_order(docs).mapInArrow(run, OUT)
