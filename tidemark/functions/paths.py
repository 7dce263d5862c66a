"""Dotted JSON paths over VARIANT values.

A path may come from a column, so one scan serves any number of configured
feeds.  A digit segment is a list index on arrays and a key on objects.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.text import _col, clean_text

_DIGIT_SEGMENT = r"(^|\.)[0-9]+(\.|$)"


def variant_path(path: Column) -> Column:
    """``a.b c`` as ``$['a']['b c']``; ``$`` and ``.`` are the root."""
    bare = F.regexp_replace(path, r"^\.+|\.+$", "")
    steps = F.transform(F.split(bare, r"\."), _key_step)
    return F.when(path.isin("$", "."), F.lit("$")).otherwise(
        F.concat(F.lit("$"), F.array_join(steps, ""))
    )


def _key_step(segment: Column) -> Column:
    quote = F.when(segment.contains("'"), F.lit('"')).otherwise(F.lit("'"))
    return F.concat(F.lit("["), quote, segment, quote, F.lit("]"))


def get_path(value: Column, path: Column | str) -> Column:
    """The VARIANT at ``path``; a miss, an empty or a null path gives null.

    Only paths with a digit segment are resolved step by step; all others are a
    single extraction.
    """
    path = F.lit(path) if isinstance(path, str) else path
    asked = F.nullif(path, F.lit(""))
    bare = F.regexp_replace(asked, r"^\.+|\.+$", "")

    def step(at: Column, segment: Column) -> Column:
        key = F.try_variant_get(at, F.concat(F.lit("$"), _key_step(segment)), "variant")
        index = F.try_variant_get(at, F.concat(F.lit("$["), segment, F.lit("]")), "variant")
        return F.when(segment.rlike("^[0-9]+$"), F.coalesce(index, key)).otherwise(key)

    stepwise = F.aggregate(F.split(bare, r"\."), value, step)
    return F.when(bare.rlike(_DIGIT_SEGMENT), stepwise).otherwise(
        F.try_variant_get(value, variant_path(asked), "variant")
    )


def as_text(value: Column) -> Column:
    """Text of a VARIANT: strings as they are, booleans as True/False, lists and
    objects as JSON text, JSON null as null."""
    text = F.try_variant_get(value, "$", "string")
    return F.when(F.schema_of_variant(value) == "BOOLEAN", F.initcap(text)).otherwise(text)


def clean_value(value: Column, exact: bool = False) -> Column:
    """Cleaned text of a VARIANT, ``''`` when missing."""
    return clean_text(as_text(value), exact)


def number_at(value: Column) -> Column:
    """Non-negative number of a VARIANT; text is stripped to its digits first."""
    kind = F.schema_of_variant(value)
    text = F.regexp_replace(F.try_variant_get(value, "$", "string"), r"[^0-9.+-]", "")
    number = (
        F.when(kind == "BOOLEAN", F.lit(None))
        .when(kind.rlike("^(STRING|ARRAY|OBJECT)"), text.try_cast("double"))
        .otherwise(F.try_variant_get(value, "$", "double"))
    )
    return F.when(number >= 0, number)


def text_at(value: Column | str, path: str) -> Column:
    """Text at a literal variant path such as ``$.title``."""
    return as_text(F.try_variant_get(_col(value), path, "variant"))
