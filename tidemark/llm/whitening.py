"""Whitening of embeddings over their distinct quantised vectors.

Entries become whole numbers, ``floor(scale * entry)``.  Identical vectors are
grouped once, with their number of copies; the grouping merges copies before the
shuffle, so a vector that a third of the rows share is one row after it.  Sums,
the centred products (one small matrix product per Arrow batch), the whitened
coordinates and the exact deviations are made once per distinct vector; the rows
then join back on a digest of their vector.  That join deals rows of one vector to
as many salts as its copies need.

The fit counts each distinct vector once (``weights="ones"``) or as often as it
occurs (``"counts"``).  Components are eigenvectors of the covariance, found on the
driver from one matrix of dimension x dimension, whatever the number of rows.

Rows whose vector is null or holds a null, NaN or infinite entry go; all others
stay, repeated ids too.  Shorter vectors are filled up with zeros to the longest
one.  Entries whose scaled value passes the range of a long stop at its ends.
With fewer dimensions than components only those that exist are returned.  A
component without variance whitens to 0.  A deviation of more than 38 digits is null.  Equal eigenvalues keep the order the
solver found them in.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tidemark.llm.common import materialise, slices

SCALE = 256
COMPONENTS = 4
#: Copies of one vector that join back in one group, about.
HOT_ROWS = 100_000
#: Eigenvalues below this share of the largest count as no variance.
FLAT = 1e-13

WIDE = T.DecimalType(38, 0)


@dataclass(frozen=True)
class Fit:
    """What the fit list gave: its size, exact sums, centre, eigenvalues (falling) and components (rows)."""

    n: int
    sums: list[int]
    centre: np.ndarray
    values: np.ndarray
    components: np.ndarray
    trace: float


def quantised(rows: DataFrame, key: str, vector: str, scale: int = SCALE) -> DataFrame:
    """``__id`` and ``__x`` (array of long) of the rows whose vector is whole."""
    entries = F.transform(F.col(vector), lambda c: c.cast("double"))
    inside = F.forall(entries, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    edge = float(2**63)
    scaled = F.transform(entries, lambda c: F.greatest(F.lit(-edge), F.least(F.lit(edge), F.lit(float(scale)) * c)))
    # The largest double below 2**63 is not its neighbour, so the upper end is set apart.
    top = F.lit(2**63 - 1)
    whole = F.transform(scaled, lambda c: F.when(c >= edge, top).when(c <= -edge, F.lit(-(2**63))).otherwise(F.floor(c)))
    return rows.filter(F.col(vector).isNotNull() & inside).select(F.col(key).alias("__id"), whole.alias("__x"))


def _rows(batch: pa.RecordBatch, dims: int) -> np.ndarray:
    """The vectors of a batch as a matrix of longs."""
    return batch.column("__x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, dims)


def _whole_sums(x: np.ndarray, weight: np.ndarray) -> list[int]:
    """Exact weighted sums per dimension."""
    if len(x) and float(np.abs(x.astype(float)).max()) * float(weight.sum()) < 2**62:
        return (x * weight[:, None]).sum(axis=0).tolist()
    return (x.astype(object) * weight.astype(object)[:, None]).sum(axis=0).tolist() if len(x) else [0] * x.shape[1]


def sums(distinct: DataFrame, dims: int) -> tuple[int, list[int]]:
    """Size of the fit list and exact sums per dimension; one row per task and dimension meets in Spark."""
    out = T.StructType([T.StructField("dim", T.IntegerType()), T.StructField("total", WIDE), T.StructField("n", T.LongType())])
    arrow = to_arrow_schema(out)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import decimal

        totals, n = [0] * dims, 0
        for batch in batches:
            for part in slices(batch):
                weight = part.column("__w").to_numpy()
                totals = [a + b for a, b in zip(totals, _whole_sums(_rows(part, dims), weight))]
                n += int(weight.sum())
        columns = [list(range(dims)), [decimal.Decimal(t) for t in totals], [n] * dims]
        yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, arrow)], schema=arrow)

    partial = distinct.select("__x", "__w").mapInArrow(run, out)
    merged = partial.groupBy("dim").agg(F.sum("total").cast(WIDE).alias("total"), F.sum("n").alias("n")).collect()  # dims rows
    merged.sort(key=lambda r: r["dim"])
    return (int(merged[0]["n"]) if merged else 0), [int(r["total"]) for r in merged]


def centred_products(distinct: DataFrame, centre: np.ndarray) -> np.ndarray:
    """Sum of ``w * (x - centre)(x - centre)^T`` over ``distinct``; each task adds up its batches."""
    dims = len(centre)
    out = T.StructType([T.StructField("dim", T.IntegerType()), T.StructField("line", T.ArrayType(T.DoubleType()))])
    arrow = to_arrow_schema(out)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dims, dims))
        for batch in batches:
            for part in slices(batch):
                away = _rows(part, dims) - centre
                # A plain loop product: no threads of a linear-algebra library inside a worker.
                total += np.einsum("ni,nj->ij", away * part.column("__w").to_numpy()[:, None], away)
        columns = [pa.array(range(dims), type=pa.int32()), pa.array(list(total), type=arrow.field("line").type)]
        yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    def add(key, lines):
        import pandas as pd

        # One short line per task of the pass above.
        return pd.DataFrame({"dim": [key[0]], "line": [np.sum(np.stack(lines["line"].to_list()), axis=0)]})

    partial = distinct.select("__x", "__w").mapInArrow(run, out)
    merged = {r["dim"]: r["line"] for r in partial.groupBy("dim").applyInPandas(add, out).collect()}  # dims rows
    return np.array([merged[i] for i in range(dims)])


def eigen(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (rows) of a symmetric matrix by Jacobi rotations.

    Each vector's entry of largest size is positive.
    """
    a, n = matrix.astype(float).copy(), len(matrix)
    vectors = np.eye(n)
    for _ in range(60):
        size = np.abs(a - np.diag(np.diag(a))).max() if n else 0.0
        if size <= 1e-300 or size <= 1e-17 * np.abs(np.diag(a)).max():
            break
        for p in range(n - 1):
            for q in range(p + 1, n):
                if abs(a[p, q]) <= 1e-18 * max(abs(a[p, p]), abs(a[q, q]), 1e-300):
                    continue
                theta = (a[q, q] - a[p, p]) / (2.0 * a[p, q])
                t = (1.0 if theta >= 0 else -1.0) / (abs(theta) + np.hypot(1.0, theta))
                c = 1.0 / np.hypot(1.0, t)
                s = t * c
                for m in (a, a.T):
                    low, high = m[p].copy(), m[q].copy()
                    m[p], m[q] = c * low - s * high, s * low + c * high
                low, high = vectors[p].copy(), vectors[q].copy()
                vectors[p], vectors[q] = c * low - s * high, s * low + c * high
    order = np.argsort(-np.diag(a), kind="stable")
    vectors = vectors[order]
    for v in vectors:
        if v[np.argmax(np.abs(v))] < 0:
            v *= -1.0
    return np.diag(a)[order], vectors


def _deviation(x: np.ndarray, n: int, total: list[int]) -> list[int]:
    """Sum over dimensions of ``(n * x - S) ** 2``, exactly."""
    reach = n * max(int(x.max(initial=0)), -int(x.min(initial=0))) + max((abs(t) for t in total), default=0)
    if reach * reach * max(1, x.shape[1]) < 2**63:
        away = n * x - np.array(total, dtype=np.int64)
        return (away * away).sum(axis=1).tolist()
    # Python's integers where a long could overflow: about fifty times slower, just as exact.
    away = n * x.astype(object) - np.array(total, dtype=object)
    return (away * away).sum(axis=1).tolist()


def fit(distinct: DataFrame, dims: int) -> Fit:
    """The fit over ``distinct`` (``__x`` of ``dims`` entries and weight ``__w``), one row at least."""
    n, total = sums(distinct, dims)
    centre = np.array([t / n for t in total], dtype=float)
    covariance = centred_products(distinct, centre) / n
    values, components = eigen(covariance)
    return Fit(n, total, centre, values, components, float(np.trace(covariance)))


def projected(distinct: DataFrame, model: Fit, components: int) -> DataFrame:
    """Each distinct vector with ``__white`` (its whitened coordinates) and ``__deviation``."""
    dims = len(model.centre)
    shown = min(components, dims)
    top = max(float(model.values[0]), 0.0) if dims else 0.0
    scale = np.array([1.0 / np.sqrt(e) if e > FLAT * top and e > 0 else 0.0 for e in model.values[:shown]])
    axes = model.components[:shown] * scale[:, None]
    n, total, centre = model.n, model.sums, model.centre
    out = T.StructType(
        [
            *[distinct.schema[c] for c in ("__digest", "__copies", "__w")],
            T.StructField("__white", T.ArrayType(T.DoubleType())),
            T.StructField("__deviation", WIDE),
        ]
    )
    arrow = to_arrow_schema(out)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import decimal

        for batch in batches:
            for part in slices(batch):
                x = _rows(part, dims)
                white = np.einsum("nd,kd->nk", x - centre, axes)
                made = [
                    pa.array(list(white), type=arrow.field("__white").type),
                    pa.array([decimal.Decimal(d) if d < 10**38 else None for d in _deviation(x, n, total)], type=arrow.field("__deviation").type),
                ]
                kept = [part.column(c).cast(arrow.field(c).type) for c in ("__digest", "__copies", "__w")]
                yield pa.RecordBatch.from_arrays(kept + made, schema=arrow)

    return distinct.select("__digest", "__copies", "__w", "__x").mapInArrow(run, out)


def identity_error(white: DataFrame, n: int, shown: int) -> float:
    """Largest absolute entry of the measured covariance of ``__white`` minus the identity."""

    def weighed(value: Column) -> Column:
        return F.sum(F.col("__w") * value)

    means = white.agg(*[weighed(F.col("__white")[i]) for i in range(shown)]).first()
    away = [F.col("__white")[i] - F.lit(float(means[i]) / n) for i in range(shown)]
    pairs = [(i, j) for i in range(shown) for j in range(i, shown)]
    found = white.agg(*[weighed(away[i] * away[j]) for i, j in pairs]).first()
    return max((abs(float(v) / n - (1.0 if i == j else 0.0)) for (i, j), v in zip(pairs, found)), default=0.0)


def joined_back(named: DataFrame, white: DataFrame, hot_rows: int) -> DataFrame:
    """``white`` at every row of ``named`` with its digest; a vector with more than
    ``hot_rows`` copies is joined in as many salts as its copies need."""
    salts = F.ceil(F.col("__copies") / F.lit(hot_rows)).cast("int")
    hot = white.filter(salts > 1).select("__digest", salts.alias("__salts"))
    if hot.isEmpty():
        return named.join(white, "__digest")
    # One row per ``hot_rows`` rows of the table at most; Spark decides how to join it.
    own = F.coalesce(F.col("__salts"), F.lit(1))
    dealt = F.pmod(F.xxhash64("__id", F.spark_partition_id()), own).cast("int")
    rows = named.join(hot, "__digest", "left").withColumn("__salt", dealt).drop("__salts")
    spread = white.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.greatest(salts, F.lit(1)) - 1)))
    return rows.join(spread, ["__digest", "__salt"])


def whiten(
    rows: DataFrame,
    key: str = "vec_id",
    vector: str = "embedding",
    scale: int = SCALE,
    components: int = COMPONENTS,
    weights: str = "ones",
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """One row per kept row and component: ``key``, ``component``, ``n``, ``deviation``
    (decimal), ``whitened``, ``explained``, ``identity_error`` and ``copies``."""
    if weights not in ("ones", "counts"):
        raise ValueError("weights are 'ones' or 'counts'")
    spark = rows.sparkSession
    shape = T.StructType(
        [
            T.StructField(key, rows.schema[key].dataType),
            T.StructField("component", T.IntegerType()),
            T.StructField("n", T.LongType()),
            T.StructField("deviation", WIDE),
            T.StructField("whitened", T.DoubleType()),
            T.StructField("explained", T.DoubleType()),
            T.StructField("identity_error", T.DoubleType()),
            T.StructField("copies", T.LongType()),
        ]
    )
    whole = quantised(rows, key, vector, scale)
    dims = whole.agg(F.max(F.size("__x"))).first()[0]
    shown = min(components, dims or 0)
    if not shown:
        return spark.createDataFrame([], shape)
    filled = whole.withColumn("__x", F.concat("__x", F.array_repeat(F.lit(0).cast("bigint"), dims - F.size("__x"))))
    digest = F.unhex(F.sha2(F.array_join(F.col("__x").cast("array<string>"), ","), 256))
    weight = F.lit(1).cast("bigint") if weights == "ones" else F.col("__copies")
    groups = filled.groupBy("__x").agg(F.count(F.lit(1)).alias("__copies"))
    groups = groups.withColumn("__w", weight).withColumn("__digest", digest)
    distinct = materialise(groups, "distinct-vectors")
    model = fit(distinct, dims)
    white = materialise(projected(distinct, model, components), "whitened-vectors")
    error = identity_error(white, model.n, shown)
    joined = joined_back(filled.select("__id", digest.alias("__digest")), white, hot_rows)
    share = [float(e) / model.trace if model.trace > 0 else 0.0 for e in model.values[:shown]]
    shares = F.array(*[F.lit(v) for v in share])
    long_form = joined.select("__id", "__deviation", "__copies", F.posexplode("__white").alias("__at", "__value"))
    return long_form.select(
        F.col("__id").alias(key),
        (F.col("__at") + 1).cast("int").alias("component"),
        F.lit(model.n).cast("bigint").alias("n"),
        F.col("__deviation").alias("deviation"),
        F.col("__value").alias("whitened"),
        F.element_at(shares, F.col("__at") + 1).alias("explained"),
        F.lit(error).alias("identity_error"),
        F.col("__copies").alias("copies"),
    )
