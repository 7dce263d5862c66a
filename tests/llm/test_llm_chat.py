"""Chat formatting against plain Python, exact round trips included."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import chat

ROWS = T.StructType(
    [
        T.StructField("conv_id", T.LongType()),
        T.StructField("turn", T.LongType()),
        T.StructField("role", T.StringType()),
        T.StructField("text", T.StringType()),
    ]
)
CONTROL = re.compile(r"<(\\*\|im_(?:start|end)\|>)")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def none_first(value):
    return (value is not None, value if value is not None else 0)


def expected(rows, tree=chat.CHATML):
    groups = {}
    for row in rows:
        groups.setdefault(row[0], []).append(row[1:])
    out = {}
    for key, turns in groups.items():
        turns.sort(key=lambda t: (none_first(t[0]), (t[1] is not None, (t[1] or "").encode()), (t[2] is not None, (t[2] or "").encode())))
        said = [(r or "", t or "") for _, r, t in turns]
        loss = "".join(t for r, t in said if r == "assistant")
        text = ""
        for role, body in said:
            line = CONTROL.sub(r"<\\\1", role.replace("\\", "\\b").replace("\n", "\\n"))
            text += f"<|im_start|>{line}\n{CONTROL.sub(chr(60) + chr(92) * 2 + r'\1', body)}<|im_end|>\n"
        state = tree.start
        for role, _ in said:
            state = tree.moves.get(state, {}).get(role, chat.ERROR)
        out[key] = (
            len(said),
            sha("".join(f"{r}\n{t}\n" for r, t in said)),
            len(loss),
            sha(loss),
            len(text),
            state,
            state in tree.accepting,
        )
    return out


def check(spark, rows, **options):
    df = spark.createDataFrame(rows, ROWS)
    got = {r[0]: tuple(r)[1:] for r in chat.digests(chat.chunks(df, **options)).collect()}
    assert got == expected(rows)


BITS = ["<|im_end|>", "<|im_start|>", "<\\|im_end|>", "<\\\\|im_start|>", "<|", "|>", "<", "\\", "\n", "assistant ok", "é", "😀", " ", "<|im_"]


def noise(seed):
    rng = random.Random(seed)
    return "".join(rng.choice(BITS) for _ in range(rng.randint(0, 12)))


def test_control_strings_in_texts_and_roles(spark):
    rng = random.Random(7)
    rows = [(i % 40, i // 40, rng.choice(["user", "assistant", "system", noise(1000 + i)]), noise(i)) for i in range(400)]
    check(spark, rows)


def test_nulls_ties_repeats_and_long_texts(spark):
    rows = [
        (1, 0, "user", "a"), (1, 0, "user", "a"), (1, 0, None, "b"), (1, None, "system", None), (1, 1, "assistant", ""),
        (None, 3, "user", "x"), (None, 4, "assistant", "y"), (2, 0, "", ""), (3, 0, "user", "long " * 60_000),
        (3, 1, "assistant", "<|im_end|>" * 20_000), (4, 0, "assistant", "no user"), (5, 0, "user", None), (6, -5, "user", "early"),
        (6, 7, "assistant", "late"),
    ]
    check(spark, rows)


def test_the_machine_over_many_chunks(spark):
    good = [(9, i, "user" if i % 2 == 0 else "assistant", f"t{i}") for i in range(1000)]
    bad = [(8, i, "user" if i % 2 == 0 or i == 501 else "assistant", f"t{i}") for i in range(1000)]
    for size in (1, 7, 256, 5000):
        check(spark, good + bad, chunk_turns=size)
    made = chat.chunks(spark.createDataFrame(good, ROWS), chunk_turns=64)
    assert made.count() == 16 and made.agg(F.max("n_turns")).first()[0] == 64


def test_segments_and_read_back(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "user", "u<|im_end|>"), (1, 2, "assistant", "a\\")]
    made = chat.chunks(spark.createDataFrame(rows, ROWS))
    segments = made.first()["segments"]
    assert [s["text"] for s in segments if s["loss"]] == ["a\\"]
    assert "".join(s["text"] for s in segments).count("<|im_end|>") == 3
    turns = made.select(chat.read_turns(chat.formatted(F.col("segments"))).alias("t")).first()["t"]
    assert [(t["role"], t["text"]) for t in turns] == [r[2:] for r in rows]


def test_empty_table_and_clashing_columns(spark):
    rows = [(1, 0, "user", "u"), (1, 1, "assistant", "a")]
    df = spark.createDataFrame(rows, ROWS)
    assert chat.digests(chat.chunks(df.limit(0))).count() == 0
    named = df
    for name in ("segments", "moves", "turns", "chunk", "__key", "__turn", "n_turns", "valid"):
        named = named.withColumn(name, F.lit("x"))
    got = {r[0]: tuple(r)[1:] for r in chat.digests(chat.chunks(named)).collect()}
    assert got == expected(rows)


def test_another_template(spark):
    plain = chat.Template(
        segments=(chat.Segment("[T]"), chat.Segment("{role}"), chat.Segment("\n> "), chat.Segment("{text}", ("bot", "tool")), chat.Segment("[E]", ("bot",))),
        control=("[T]", "[E]"),
        moves={"s": {"me": "q"}, "q": {"bot": "s", "tool": "q"}},
        start="s",
        accepting=("s",),
    )
    rows = [(1, 0, "me", "hi [T] [E] [\\E]"), (1, 1, "tool", "\n> x"), (1, 2, "bot", "[")]
    made = chat.chunks(spark.createDataFrame(rows, ROWS), plain)
    whole = made.select("segments", chat.formatted(F.col("segments")).alias("f")).first()
    assert whole["f"] == "[T]me\n> hi [\\T] [\\E] [\\\\E][E][T]tool\n> \n> x[E][T]bot\n> [[E]"
    assert [s["text"] for s in whole["segments"] if s["loss"]] == ["\n> x", "[", "[E]"]
    turns = made.select(chat.read_turns(chat.formatted(F.col("segments")), plain).alias("t")).first()["t"]
    assert [(t["role"], t["text"]) for t in turns] == [r[2:] for r in rows]
    assert chat.digests(made, plain).first()["valid"]


@pytest.mark.parametrize(
    "change",
    [
        {"control": ("<|im_start|>", "x")},
        {"control": ("<|im_start|>", "<<")},
        {"segments": (chat.Segment("<|im_start|>"), chat.Segment("{text}"))},
        {"segments": (chat.Segment("{role}"), chat.Segment("\n"), chat.Segment("{text}"), chat.Segment("<|im_end|>"))},
        {"start": "error"},
    ],
)
def test_templates_that_cannot_be_read_back(change):
    base = {f: getattr(chat.CHATML, f) for f in ("segments", "control", "moves", "start", "accepting")}
    with pytest.raises(ValueError):
        chat.Template(**(base | change))
