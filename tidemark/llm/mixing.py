"""Mixing sources to target weights by Pareto order sampling.

A source's target is shared among its documents in proportion to their weights,
up to a most number of copies each.  Every document first gets its certain whole
copies; the rest of its expected copies is an inclusion probability.  Documents are
ranked by the random odds divided by the inclusion odds, and each source takes
documents in that order until its remaining words are met.  Only DataFrame
functions are used.

A null text has no words and is never taken; a null source is a source of its
own and sorts last.  Numbers are drawn from the id, the text and, where both repeat,
the occurrence, so rows that repeat an id or have none are taken or left apart from
each other.  Equal ranks fall back on the drawn digits.  A text of any length is one
size and one digest.  An empty table gives an empty mix.  Kept columns may have any name.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import WORD, materialise
from tidemark.operators.ordered import row_numbers

WEIGHTS = (5, 2, 1)
MAX_COPIES = 3
SEED = "pareto-1"
#: Document weight from this many words on; the default weight of a document.
LENGTH_WEIGHTS = ((0, 0.5), (50, 1.0), (500, 2.0))
#: Document weights are held between one step and its inverse, in whole steps.
WEIGHT_STEP = 1 / 16
#: Rows of a source that one ranked slice holds, about.
SLICE_ROWS = 20_000


def n_words(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("bigint")


def by_length(size: Column) -> Column:
    """The weight of a document of ``size`` words: longer ones are taken more often."""
    out = F.lit(LENGTH_WEIGHTS[0][1])
    for least, weight in LENGTH_WEIGHTS[1:]:
        out = F.when(size >= least, F.lit(weight)).otherwise(out)
    return out


def _in_steps(weight: Column) -> Column:
    """A weight as one of at most 256 steps, so that a source has few classes; null counts as 1."""
    whole = F.round(F.coalesce(weight.cast("double"), F.lit(1.0)) / F.lit(WEIGHT_STEP))
    return F.least(F.greatest(whole, F.lit(1.0)), F.lit(WEIGHT_STEP**-2)) * F.lit(WEIGHT_STEP)


def _same(key: Column, text: Column) -> Column:
    """Names rows of one id and one text."""
    return F.concat_ws(":", F.coalesce(key.cast("string"), F.lit("")), F.md5(F.coalesce(text, F.lit(""))))


def _with_draw(rows: DataFrame, seed: str) -> DataFrame:
    """``rows`` with ``__draw``, the digits of a hash of ``__same`` and the occurrence: the same in every run.

    Names are counted first; only rows that repeat a name are numbered, in ranges
    where one name has very many.
    """
    repeated = rows.groupBy("__same").agg(F.count(F.lit(1)).alias("__n")).filter("__n > 1").select("__same")
    repeated = materialise(repeated, "mix-repeated")
    if repeated.isEmpty():
        numbered = rows.withColumn("__nth", F.lit(1).cast("bigint"))
    else:
        marked = rows.join(repeated.withColumn("__again", F.lit(True)), "__same", "left")
        once = marked.filter(F.col("__again").isNull()).withColumn("__nth", F.lit(1).cast("bigint"))
        again = row_numbers(marked.filter("__again"), ["__same"], ["__same"], name="__nth")
        numbered = once.unionByName(again).drop("__again")
    draw = F.md5(F.concat_ws(":", F.lit(seed), F.col("__same"), F.col("__nth").cast("string")))
    return numbered.withColumn("__draw", draw).drop("__same", "__nth")


def _uniform(draw: Column) -> Column:
    """A number in (0, 1) from the first 52 bits of hexadecimal digits."""
    return (F.conv(F.substring(draw, 1, 13), 16, 10).cast("bigint").cast("double") + F.lit(0.5)) / F.lit(float(2**52))


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MAX_COPIES) -> DataFrame:
    """Adds ``target`` to one row per source (``source``, ``source_size``).

    With targets ``min(most * size, level * weight)`` the level solves the sum:
    sources are ordered by the level at which they are full, and the full ones
    are those for which the level of the rest lies above their own.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), ((place - 1) % len(weights) + 1).cast("int"))
    full = F.lit(most) * F.col("source_size")
    rows = sizes.withColumn("__w", weight.cast("bigint")).withColumn("__full", full)
    rising = Window.orderBy(F.col("__full") / F.col("__w"), F.col("source").asc_nulls_last())
    before = rising.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    rows = rows.withColumn(
        "__level",
        (F.sum("source_size").over(whole) - F.coalesce(F.sum("__full").over(before), F.lit(0)))
        / F.sum("__w").over(rising.rowsBetween(Window.currentRow, Window.unboundedFollowing)),
    )
    # Levels of the rest only matter from the first source that is not full on.
    rows = rows.withColumn("__open", F.col("__full") >= F.col("__level") * F.col("__w"))
    level = F.min(F.when(F.col("__open"), F.struct(F.col("__full") / F.col("__w"), F.col("source").isNull(), F.col("source"), F.col("__level")).alias("s"))).over(whole)
    rows = rows.withColumn("__rest", level["__level"])
    return rows.withColumn(
        "target", F.least(F.col("__full").cast("double"), F.col("__rest") * F.col("__w"))
    ).drop("__w", "__full", "__level", "__open", "__rest")


def expected_copies(classes: DataFrame, most: int) -> DataFrame:
    """Adds ``__e``, the expected copies of a document, to one row per source and weight.

    ``classes`` holds ``__at``, ``__m``, ``__words``, ``__rows`` and the source's
    ``target``.  Copies are ``min(most, level * weight)`` and the level solves the sum: classes are
    ordered by falling weight, and the full ones are those that the level of the rest
    would lift above ``most``.  ``__ps`` lists rows and inclusion probability of each
    class of the source.
    """
    whole = Window.partitionBy("__at")
    falling = whole.orderBy(F.col("__m").desc())
    before = falling.rowsBetween(Window.unboundedPreceding, -1)
    rest = falling.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    full = F.lit(most) * F.coalesce(F.sum("__words").over(before), F.lit(0))
    weighed = F.sum(F.col("__words") * F.col("__m")).over(rest)
    rows = classes.withColumn("__level", (F.col("target") - full) / F.nullif(weighed, F.lit(0.0)))
    is_open = F.lit(most) >= F.col("__level") * F.col("__m")
    level = F.max(F.when(is_open, F.struct("__m", "__level"))).over(whole)["__level"]
    # Without an open class all are full; LEAST passes over the null.
    rows = rows.withColumn("__e", F.least(F.lit(float(most)), level * F.col("__m")))
    share = F.struct(F.col("__rows").cast("double").alias("n"), (F.col("__e") - F.floor("__e")).alias("p"))
    return rows.withColumn("__ps", F.sort_array(F.collect_list(share).over(whole))).drop("__level")


def _drawn(rows: DataFrame, classes: DataFrame, most: int) -> DataFrame:
    """Certain copies ``__c``, rank ``__q`` (null if no share is left) and slice ``__slice`` of each row."""
    joined = rows.join(classes, ["__at", "__m"])
    joined = joined.withColumn("__e", F.when(F.col("size") > 0, F.col("__e")).otherwise(0.0))
    joined = joined.withColumn("__c", F.floor("__e").cast("bigint")).withColumn("__p", F.col("__e") - F.col("__c"))
    # Random odds over inclusion odds.
    u = _uniform(F.col("__draw"))
    rank = (u * (1 - F.col("__p"))) / ((1 - u) * F.col("__p"))
    joined = joined.withColumn("__q", F.when(F.col("__p") > 0, rank))
    # Slices follow the rank: how many rows of the source are expected below it.
    odds = F.col("__q")
    below = F.aggregate("__ps", F.lit(0.0), lambda n, s: n + s["n"] * odds * s["p"] / (1 - s["p"] + odds * s["p"]))
    cut = F.floor(below / F.lit(float(SLICE_ROWS))).cast("bigint")
    return joined.withColumn("__slice", F.coalesce(cut, F.lit(-1))).drop("__ps")


def _cutoffs(drawn: DataFrame) -> DataFrame:
    """Per source the slice and rank of the last document taken.

    A source may hold a third of all rows, so the words of its slices are summed
    first and only the slice in which the target falls is ordered.
    """
    ranked = F.col("__q").isNotNull()
    sums = drawn.groupBy("__at", "__slice").agg(
        F.first("target").alias("__target"),
        F.sum(F.when(ranked, F.col("size")).otherwise(0)).alias("__words"),
        F.sum(F.col("__c") * F.col("size")).alias("__certain"),
    )
    group = Window.partitionBy("__at")
    before = group.orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("__left", F.col("__target") - F.sum("__certain").over(group))
    sums = sums.withColumn("__before", F.coalesce(F.sum("__words").over(before), F.lit(0)))
    last = (
        sums.filter((F.col("__slice") >= 0) & (F.col("__before") <= F.col("__left")))
        .groupBy("__at")
        .agg(F.max(F.struct("__slice", "__before", "__left")).alias("__last"))
        .select("__at", "__last.*")
    )
    inside = Window.partitionBy("__at").orderBy("__q", "__draw").rowsBetween(Window.unboundedPreceding, -1)
    rows = drawn.filter(ranked).join(last, ["__at", "__slice"])
    start = F.col("__before") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    # The document on the edge is taken when that comes nearer to the target.
    taken = start + F.col("size") / 2 <= F.col("__left")
    edge = rows.withColumn("__taken", taken).groupBy("__at").agg(
        F.max(F.when(F.col("__taken"), F.struct("__q", "__draw"))).alias("__edge")
    )
    return last.join(edge, "__at", "left").select("__at", F.col("__slice").alias("__cut"), "__edge")


def _at(source: str) -> Column:
    """A source as a join key that is never null."""
    return F.coalesce(F.concat(F.lit("s"), F.col(source).cast("string")), F.lit(""))


def mix(
    docs: DataFrame,
    keep: Sequence[str],
    text: str = "text",
    source: str = "source",
    key: str = "doc_id",
    weight: Column | None = None,
    weights: Sequence[int] = WEIGHTS,
    most: int = MAX_COPIES,
    seed: str = SEED,
    wide: bool = False,
) -> DataFrame:
    """Columns ``keep`` with ``size``, ``source_size``, ``target``, ``copies`` and ``taken``.

    ``weight`` (default :func:`by_length`) shifts copies between the documents of a
    source; it is rounded to steps of ``WEIGHT_STEP``, and no document gets more than
    ``most``.  Decisions are made on narrow rows and end in one written row per source;
    joining them back moves no document whose id and text occur once.  ``wide`` reads
    kept columns from ``docs`` again instead of writing them.
    """
    keep = list(keep)
    size = n_words(text)
    drawn_from = docs.select(
        *[F.col(c).alias(f"__k{i}") for i, c in enumerate(keep)],
        _at(source).alias("__at"),
        F.col(source).alias("source"),
        size.alias("size"),
        _same(F.col(key), F.col(text)).alias("__same"),
        _in_steps(by_length(size) if weight is None else weight).alias("__m"),
    )
    narrow = ["__at", "source", "size", "__same", "__m"]
    named = materialise(drawn_from.select(*narrow) if wide else drawn_from, "mix-rows")
    rows = _with_draw(named, seed)
    parts = named.groupBy("source", "__at", "__m").agg(
        F.sum("size").alias("__words"), F.count_if(F.col("size") > 0).alias("__rows")
    )
    parts = materialise(parts, "mix-parts")
    sizes = parts.groupBy("source", "__at").agg(F.sum("__words").alias("source_size"))
    sources = targets(sizes, weights, most).drop("source")
    classes = expected_copies(parts.drop("source").join(sources, "__at"), most).drop("__words", "__rows")
    classes = materialise(classes, "mix-classes")
    cutoffs = materialise(_cutoffs(_drawn(rows.drop("source"), classes, most)), "mix-cutoffs")
    last = _with_draw(drawn_from, seed) if wide else rows
    chosen = _drawn(last.drop("source"), classes, most).join(cutoffs, "__at", "left")
    extra = (F.col("__slice") < F.col("__cut")) | (
        (F.col("__slice") == F.col("__cut")) & (F.struct("__q", "__draw") <= F.col("__edge"))
    )
    extra = F.when(F.col("__q").isNotNull() & F.coalesce(extra, F.lit(False)), 1).otherwise(0)
    copies = (F.col("__c") + extra).cast("bigint")
    return chosen.select(
        *[F.col(f"__k{i}").alias(c) for i, c in enumerate(keep)],
        "size",
        "source_size",
        "target",
        copies.alias("copies"),
        (copies * F.col("size")).alias("taken"),
    )


def copied(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with each row repeated as often as the mix takes it; rows not taken go."""
    inner = [f"__in{i}" for i in range(len(docs.columns))]
    names = dict(zip(docs.columns, inner))
    given = {"text": "text", "source": "source", "key": "doc_id"} | options
    given |= {k: names[given[k]] for k in ("text", "source", "key")}
    chosen = mix(docs.toDF(*inner), inner, wide=True, **given)
    repeated = chosen.filter(F.col("copies") > 0).withColumn(
        "__i", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int")))
    )
    return repeated.select(*[F.col(n).alias(c) for c, n in names.items()])
