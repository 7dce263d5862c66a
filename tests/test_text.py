import unicodedata

import pytest
from pyspark.sql import functions as F

from tidemark.functions import text as tx
from tidemark.functions import values as vx


def one(spark, value, fn, schema="v string"):
    return spark.createDataFrame([(value,)], schema).select(fn(F.col("v"))).first()[0]


def each(spark, cases, *fns):
    """Applies every function to the inputs of ``cases`` in one job each."""
    df = spark.createDataFrame([(i, raw) for i, (raw, _) in enumerate(cases)], "i int, v string")
    for fn in fns:
        got = {r.i: r.out for r in df.select("i", fn(F.col("v")).alias("out")).collect()}
        for i, (raw, want) in enumerate(cases):
            assert got[i] == want, raw


def test_clean_text(spark):
    cases = [
        (None, ""),
        ("  a \t b\n", "a b"),
        ("<p>One<br>two</p>", "One two"),
        ("a<b>b</b>c", "a b c"),
        ('<a title="x > y">t</a>', "t"),
        ("<script>var t='</p>';</script>x", "x"),
        ("<style>p{}</style><!-- no -->y &amp; z", "y & z"),
        ("Tom &amp;lt; Jerry&nbsp;!", "Tom &lt; Jerry !"),
        ("3 < 4 and 5 > 2", "3 < 4 and 5 > 2"),
        ("it&#39;s", "it's"),
    ]
    each(spark, cases, tx.clean_text, lambda c: tx.clean_text(c, True))


def test_exact_tier(spark):
    cases = [
        ("ﬁne ½", "fine 1⁄2"),
        ("é", "é"),
        ("&frac12; <p>&hellip;", "1⁄2 ..."),
        ("AT&T <b>x", "AT&T x"),
        ("<![CDATA[raw]]> z", "raw z"),
        ("full　width Ａ", "full width A"),
    ]
    each(spark, cases, lambda c: tx.clean_text(c, True))


def test_stable_class_is_stable():
    import re

    stable = re.compile(f"[{tx.NFKC_STABLE}]")
    for code in range(0x10000):
        ch = chr(code)
        if 0xD800 <= code < 0xE000 or not stable.match(ch):
            continue
        assert code > 0x7F
        assert unicodedata.normalize("NFKC", ch) == ch
        assert unicodedata.category(ch)[0] != "M"


def test_native_equals_exact_on_pages(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    rows = pages.select("html", tx.clean_text("html").alias("native")).collect()
    assert [r.native for r in rows] == [tx.visible_text(r.html) for r in rows]


def test_employment_type(spark):
    cases = [
        ("Full-Time", "FULL_TIME"),
        ("fulltime", "FULL_TIME"),
        ("part_time", "PART_TIME"),
        ("Freelance", "CONTRACT"),
        ("international", "INTERNSHIP"),
        ("Temp role", "TEMPORARY"),
        ("attempt", "OTHER"),
        (None, "OTHER"),
        ("contract full time", "FULL_TIME"),
    ]
    each(spark, cases, tx.employment_type, lambda c: tx.employment_type(c, clean=False))


def test_normalisation_equalities(spark):
    title = lambda v: one(spark, v, tx.normalize_title)
    place = lambda v: one(spark, v, tx.normalize_location)
    assert title("Software Engineer - Backend") == title("Backend Software Engineer")
    assert title("The Head of R&D, C++ and C#") == "c# c++ d head r"
    assert place("Bengaluru") == place("Bangalore") == "bangalore"
    assert place("New Bombay, Madrasi") == "new mumbai madrasi"


def test_volatile_text(spark):
    tail = " Please mention the word **X** when applying to show you read the job post completely (y)."
    df = spark.createDataFrame([("remoteok", "Job." + tail), ("jobicy", "Job." + tail)], "s string, d string")
    got = [r[0] for r in df.select(tx.strip_volatile("s", "d")).collect()]
    assert got == ["Job.", "Job." + tail]


def test_display(spark):
    assert one(spark, 1234567, lambda c: tx.grouped_number(c), "v bigint") == "12,34,567"
    assert one(spark, 999, lambda c: tx.grouped_number(c), "v bigint") == "999"
    assert one(spark, "x" * 300, tx.preview) == "x" * 240 + "..."
    assert one(spark, "  Foo & Bar! ", tx.slug) == "foo-bar"
    assert one(spark, "!!", tx.slug) == "source"
    df = spark.createDataFrame(
        [(None, None), (800000.0, 1200000.5), (5.0, None), (None, 7.0)], "a double, b double"
    )
    assert [r[0] for r in df.select(tx.salary_text("a", "b")).collect()] == [
        "Salary not specified", "800,000 - 1,200,000.5", "5+", "Up to 7",
    ]


def test_number_or_none(spark):
    cases = [("$120,000", 120000.0), ("not published", None), ("1e5", 15.0), ("100-200", None),
     ("80k", 80.0), ("-5", None), ("", None)]
    each(spark, cases, vx.number_or_none)


def test_values(spark):
    assert one(spark, "x", vx.to_int) == 0
    assert one(spark, 1700000000, vx.epoch_ms, "v bigint") == 1700000000000
    assert one(spark, 1700000000123, vx.epoch_ms, "v bigint") == 1700000000123
    assert one(spark, 12000000.0, vx.decimal_text, "v double") == "12000000"
    assert one(spark, 0.5, vx.decimal_text, "v double") == "0.5"


def test_space_characters_match_python(spark):
    import sys

    spaces = {chr(c) for c in range(sys.maxunicode + 1) if chr(c).isspace()}
    assert set(tx.SPACE_CHARACTERS) == spaces
    text = "a".join(sorted(spaces))
    assert one(spark, f"x{text}y", tx.collapse_space) == " ".join(f"x{text}y".split())
