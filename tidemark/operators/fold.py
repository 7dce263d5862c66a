"""The sync fold: classify each landed row against the stored state.

Rows of one key form a sequence.  A row is ``NEW`` when nothing is stored for
its key, ``UNCHANGED`` when its comparison hash equals the stored one and
``CHANGED`` otherwise; only NEW and CHANGED rows replace what is stored.  As an
UNCHANGED row has the stored hash, the stored hash always equals that of the
row just before, so one ordered pass over narrow columns decides everything.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.values import hit_rate
from tidemark.operators.ordered import (
    HOT_ROWS,
    SLICE,
    WHOLE,
    find_hot,
    mark_hot,
    null_safe_join,
    split_hot,
)

TYPES = ("NEW", "UNCHANGED", "CHANGED")
#: Lifecycle columns kept with each stored row.
LIFECYCLE = ("first_seen", "last_changed", "change_count")


@dataclass(frozen=True)
class FoldSpec:
    """What identifies, orders and describes the rows of a table.

    ``hash`` is evaluated on stored rows as well as on landed rows, so a stored
    row that was edited in place is compared by its present values.  ``at`` is
    the epoch second of a landed row.  ``keep`` names narrow landed columns that
    verdicts carry along.  ``landed_hash`` is the hash of landed rows where the
    batch already holds it.
    """

    key: Sequence[str]
    order: Sequence[str]
    tracked: Sequence[str]
    hash: Column
    at: Column
    hot_rows: int | None = HOT_ROWS
    keep: Sequence[str] = ()
    landed_hash: Column | None = None


def touched(state: DataFrame, batch: DataFrame, key: Sequence[str]) -> DataFrame:
    """Stored rows whose key occurs in the batch.

    The keys are made distinct first, so a hot key is one row before the join.
    """
    return state.join(batch.select(*key).distinct(), list(key), "left_semi")


def fold(batch: DataFrame, spec: FoldSpec, state: DataFrame | None = None) -> DataFrame:
    """One verdict per landed row.

    Returns the key and order columns, ``change_type``, ``written``,
    ``changed_fields`` (in tracked order, against the last written raw values),
    ``first_seen``, ``last_changed``, ``change_count`` and ``replaces``: the
    order columns of the landed row it replaces, null for NEW rows and for rows
    that replace what ``state`` holds.  Wide columns never enter the ordered
    pass, and a hot key is cut into ranges of its full order (see ``ordered``).
    """
    key, order = list(spec.key), list(spec.order)
    hot = find_hot(batch, key, spec.hot_rows)
    landed = batch.select(
        *key,
        *order,
        *[F.col(c).alias(f"__keep_{c}") for c in spec.keep],
        F.lit(True).alias("__landed"),
        (spec.hash if spec.landed_hash is None else spec.landed_hash).alias("__hash"),
        _marks(batch, spec.tracked).alias("__marks"),
        spec.at.cast("bigint").alias("__seen"),
        spec.at.cast("bigint").alias("__at"),
        F.lit(0).cast("bigint").alias("__changes"),
    )
    rows, ranged = split_hot(landed, key, order, hot, spec.hot_rows)
    if state is not None:
        kinds = {f.name: f.dataType for f in batch.schema.fields}
        kept = touched(state, batch, key).withColumns(
            {c: F.col(c).cast(kinds[c]) for c in spec.tracked}
        )
        stored = mark_hot(kept, key, hot).select(
            *key,
            "__hot",
            F.lit(WHOLE).cast("bigint").alias(SLICE),
            *[F.lit(None).cast(kinds[c]).alias(c) for c in order],
            *[F.lit(None).cast(kinds[c]).alias(f"__keep_{c}") for c in spec.keep],
            F.lit(False).alias("__landed"),
            spec.hash.alias("__hash"),
            _marks(kept, spec.tracked).alias("__marks"),
            F.col("first_seen").cast("bigint").alias("__seen"),
            F.col("last_changed").cast("bigint").alias("__at"),
            F.coalesce(F.col("change_count").cast("bigint"), F.lit(0)).alias("__changes"),
        )
        rows = rows.unionByName(stored)
        ranged = None if ranged is None else ranged.unionByName(stored.filter("__hot"))
    passed = _passed(rows, key, order)
    if ranged is None:
        return _verdicts(_without_carry(passed), spec)
    # Only the rows of hot keys are ordered a second time, for the ends of the ranges.
    hot_passed = _passed(ranged, key, order)
    return _verdicts(_with_carry(passed, hot_passed, key), spec)


def _marks(df: DataFrame, tracked: Sequence[str]) -> Column:
    """Fixed-width stand-ins of the raw values, equal when the values are."""

    def mark(name: str) -> Column:
        kind = df.schema[name].dataType
        fixed = (T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)
        if isinstance(kind, fixed):
            return F.col(name)
        return F.unhex(F.md5(F.col(name).cast("string")))

    return F.struct(*[mark(c).alias(c) for c in tracked])


def _passed(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The ordered pass inside each (key, slice): one shuffle, one sort.

    ``__sure`` marks rows whose change is certain inside the slice; only the
    first row of a slice depends on what earlier slices leave behind.
    """
    inside = Window.partitionBy(*key, SLICE).orderBy(*[F.col(c).asc_nulls_first() for c in order])
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    prior = inside.rowsBetween(Window.unboundedPreceding, -1)
    hashed = rows.withColumns(
        {
            "__prev_hash": F.lag("__hash").over(inside),
            "__me": F.struct("__marks", *order, "__landed"),
        }
    )
    sure = F.col("__prev_hash").isNotNull() & (F.col("__prev_hash") != F.col("__hash"))
    flagged = hashed.withColumn("__sure", sure)
    return flagged.withColumns(
        {
            "__prev_sure": F.last(F.when(F.col("__sure"), F.col("__me")), True).over(prior),
            "__sure_at": F.last(F.when(F.col("__sure"), F.col("__at")), True).over(upto),
            "__n_sure": F.sum(F.col("__sure").cast("bigint")).over(upto),
            "__first": F.first("__me").over(upto),
            "__first_hash": F.first("__hash").over(upto),
            "__first_seen": F.first("__seen").over(upto),
            "__first_at": F.first("__at").over(upto),
            "__base": F.first("__changes").over(upto),
            "__ends": F.lead("__hash").over(inside).isNull(),
        }
    )


def _without_carry(passed: DataFrame) -> DataFrame:
    """No hot key: every slice is a whole key, nothing comes before it."""
    kinds = {
        "hash": "string",
        "me": passed.schema["__me"].dataType,
        "at": "bigint",
        "seen": "bigint",
        "changes": "bigint",
    }
    nothing = {f"__carry_{name}": F.lit(None).cast(kind) for name, kind in kinds.items()}
    return passed.withColumns({"__known": F.lit(False), **nothing})


def _with_carry(passed: DataFrame, hot_passed: DataFrame, key: list[str]) -> DataFrame:
    """Adds what earlier slices of the same hot key leave behind."""
    along = Window.partitionBy(*key).orderBy(SLICE)
    upto = along.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    # The last row of a slice holds the running values of the whole slice.
    ends = hot_passed.filter("__ends").withColumns(
        {
            "__carry_hash": F.lag("__hash").over(along),
            "__carry_seen": F.first("__first_seen").over(upto),
            "__key_base": F.first("__base").over(upto),
        }
    )
    known = F.col("__carry_hash").isNotNull()
    written = ~known | (F.col("__carry_hash") != F.col("__first_hash"))
    last_written = F.coalesce(
        F.when(F.col("__sure"), F.col("__me")),
        F.col("__prev_sure"),
        F.when(F.col("__first_written"), F.col("__first")),
    )
    settled = ends.withColumns({"__known": known, "__first_written": written}).withColumns(
        {
            "__slice_me": last_written,
            "__slice_at": F.coalesce(
                "__sure_at", F.when(F.col("__first_written"), F.col("__first_at"))
            ),
            "__slice_changes": F.col("__n_sure")
            + (F.col("__known") & F.col("__first_written")).cast("bigint"),
        }
    )
    carried = settled.select(
        *key,
        SLICE,
        "__known",
        "__carry_hash",
        "__carry_seen",
        F.last("__slice_me", True).over(before).alias("__carry_me"),
        F.last("__slice_at", True).over(before).alias("__carry_at"),
        (
            F.col("__key_base") + F.coalesce(F.sum("__slice_changes").over(before), F.lit(0))
        ).alias("__carry_changes"),
    )
    joined = null_safe_join(passed, carried, [*key, SLICE], "left")
    return joined.withColumn("__known", F.coalesce("__known", F.lit(False)))


def _verdicts(passed: DataFrame, spec: FoldSpec) -> DataFrame:
    known, sure = F.col("__known"), F.col("__sure")
    opening = F.col("__prev_hash").isNull()
    first_changed = known & (F.col("__carry_hash") != F.col("__first_hash"))
    first_written = ~known | first_changed
    change_type = (
        F.when(opening & ~known, F.lit("NEW"))
        .when(sure | (opening & first_changed), F.lit("CHANGED"))
        .otherwise(F.lit("UNCHANGED"))
    )
    # The row whose raw values are stored when this row arrives.
    held = F.coalesce(
        "__prev_sure", F.when(~opening & first_written, F.col("__first")), F.col("__carry_me")
    )
    rows = passed.filter("__landed").withColumns({"change_type": change_type, "__held": held})
    changed = F.col("change_type") == "CHANGED"
    differing = F.array_compact(
        F.array(
            *[
                F.when(~F.col(f"__held.__marks.{c}").eqNullSafe(F.col(f"__marks.{c}")), F.lit(c))
                for c in spec.tracked
            ]
        )
    )
    base = F.when(known, F.col("__carry_changes") + first_changed.cast("bigint")).otherwise(
        F.col("__base")
    )
    return rows.select(
        *spec.key,
        *spec.order,
        *[F.col(f"__keep_{c}").alias(c) for c in spec.keep],
        "change_type",
        (F.col("change_type") != "UNCHANGED").alias("written"),
        F.when(changed, differing).otherwise(F.array().cast("array<string>")).alias("changed_fields"),
        F.when(known, F.col("__carry_seen")).otherwise(F.col("__first_seen")).alias("first_seen"),
        F.coalesce(
            "__sure_at", F.when(first_written, F.col("__first_at")), F.col("__carry_at")
        ).alias("last_changed"),
        (base + F.col("__n_sure")).alias("change_count"),
        F.when(
            changed & F.col("__held.__landed"),
            F.struct(*[F.col(f"__held.{c}").alias(c) for c in spec.order]),
        ).alias("replaces"),
    )


def written_rows(batch: DataFrame, verdicts: DataFrame, spec: FoldSpec) -> DataFrame:
    """The wide landed row that each touched key ends with, with lifecycle columns.

    Keys without a written row are left out: what is stored for them stays.  The
    winners are found on narrow verdicts; the wide rows join on key and order,
    which spreads a hot key.
    """
    order = list(spec.order)
    last = verdicts.filter("written").groupBy(*spec.key).agg(
        F.max(F.struct(*order, *LIFECYCLE)).alias("__last")
    )
    last = last.select(*spec.key, *[F.col(f"__last.{c}").alias(c) for c in (*order, *LIFECYCLE)])
    wide = batch.drop(*[c for c in LIFECYCLE if c in batch.columns])
    return wide.join(last, [*spec.key, *order])


def final_state(
    batch: DataFrame, verdicts: DataFrame, spec: FoldSpec, state: DataFrame | None = None
) -> DataFrame:
    """Stored rows after the batch: replaced whole where a row was written."""
    fresh = written_rows(batch, verdicts, spec)
    if state is None:
        return fresh
    kept = state.join(fresh.select(*spec.key), list(spec.key), "left_anti")
    return kept.unionByName(fresh, allowMissingColumns=True)


def summary(verdicts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Counts per change type (zeros included) with cache figures derived from them."""
    counts = verdicts.groupBy(*by).agg(
        *[F.count_if(F.col("change_type") == t).alias(f"n_{t.lower()}") for t in TYPES]
    )
    return with_cache_figures(counts)


def with_cache_figures(counts: DataFrame) -> DataFrame:
    """Unchanged rows are cache hits (writes avoided), the others misses."""
    return counts.withColumns(
        {
            "cache_hits": F.col("n_unchanged"),
            "cache_misses": F.col("n_new") + F.col("n_changed"),
            "jobs_processed": F.col("n_new") + F.col("n_changed") + F.col("n_unchanged"),
            "redundant_updates_prevented": F.col("n_unchanged"),
            "hit_rate": hit_rate("n_unchanged", F.col("n_new") + F.col("n_changed")),
        }
    )
