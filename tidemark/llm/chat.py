"""Chat formatting: a finite-state machine over roles and a declarative template, in DataFrame functions only.

A template names the segments of a turn, which of them count for the loss and for
which roles, the control strings, and the machine: for each state the state that a
role leads to.  Turns become segments ``(text, loss)`` row by row.  Control strings
inside texts and roles are escaped by one backslash behind their first character,
and texts that look escaped get one more, so reading back is exact.

Turns are gathered in chunks of at most ``CHUNK_TURNS`` turn numbers of a
conversation, so a long conversation is many rows.  A chunk carries its move: for
every state the machine could be in before it, the state after it.  Moves are
composed along the chunks of a conversation, one row per chunk.

A null text is empty, a null role is the empty role; roles unknown to the machine
lead to ``ERROR``, which nothing leaves, and are formatted like others.  Rows without
a conversation id form one conversation.  Turns are ordered by turn number (null
first), then role, then text, so ties and repeated rows have one order and all
stay.  An empty table gives an empty result.  Texts of any length are formatted
whole; what is not bounded by a chunk is the final text of one conversation, which
has to fit one row where a caller asks for it as one (as a digest of it does).
Other columns of the input are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Turn numbers that meet in one chunk.
CHUNK_TURNS = 256
#: The state of a conversation whose roles break the order.
ERROR = "error"
ROLE, TEXT = "{role}", "{text}"


@dataclass(frozen=True)
class Segment:
    """A part of a turn: fixed text, the role or the text, and the roles for which it counts for the loss."""

    value: str
    loss: tuple[str, ...] = ()


@dataclass(frozen=True)
class Template:
    """Segments of a turn, control strings, and the machine over roles.

    The first segment starts with a control string that starts no other segment; the
    role and the text come once each, in this order, with fixed text behind them.  The
    text ends at a control string.  The first character of a control string occurs in
    none at a later place, so no control string can arise where two pieces touch.
    """

    segments: tuple[Segment, ...]
    control: tuple[str, ...]
    moves: Mapping[str, Mapping[str, str]]
    start: str
    accepting: tuple[str, ...]

    def __post_init__(self) -> None:
        values = [s.value for s in self.segments]
        if values.count(ROLE) != 1 or values.count(TEXT) != 1 or values.index(ROLE) > values.index(TEXT):
            raise ValueError("a template has the role once and then the text once")
        if not self.control or any(len(c) < 2 or "\\" in c or "\n" in c for c in self.control):
            raise ValueError("control strings have two characters or more, and no backslash or line end")
        first = {c[0] for c in self.control}
        if any(ch in first for c in self.control for ch in c[1:]):
            raise ValueError("the first character of a control string occurs at its start only")
        if not self.head or self.head not in self.control:
            raise ValueError("a turn starts with a control string as a segment of its own")
        if self.between[:1] != "\n" or not self.tail.startswith(self.control):
            raise ValueError("a line end follows the role, a control string the text")
        if self.between.count("\n") != 1 or any(self.head in v for v in values[1:]):
            raise ValueError("the head occurs once in a turn")
        if ERROR in self.states:
            raise ValueError(f"{ERROR!r} is no state of a template")

    def _fixed(self, low: int, high: int) -> str:
        return "".join(s.value for s in self.segments[low:high])

    @property
    def _at(self) -> tuple[int, int]:
        values = [s.value for s in self.segments]
        return values.index(ROLE), values.index(TEXT)

    @property
    def head(self) -> str:
        return self._fixed(0, self._at[0])

    @property
    def between(self) -> str:
        return self._fixed(self._at[0] + 1, self._at[1])

    @property
    def tail(self) -> str:
        return self._fixed(self._at[1] + 1, len(self.segments))

    @property
    def states(self) -> list[str]:
        return sorted({self.start, *self.accepting, *self.moves, *(s for m in self.moves.values() for s in m.values())})


#: Turn marks of the ChatML convention (fixed values); the loss is on what an assistant says.
CHATML = Template(
    segments=(
        Segment("<|im_start|>"),
        Segment(ROLE),
        Segment("\n"),
        Segment(TEXT, loss=("assistant",)),
        Segment("<|im_end|>"),
        Segment("\n"),
    ),
    control=("<|im_start|>", "<|im_end|>"),
    moves={
        "start": {"system": "system", "user": "user"},
        "system": {"user": "user"},
        "user": {"assistant": "assistant"},
        "assistant": {"user": "user"},
    },
    start="start",
    accepting=("assistant",),
)


def _rests(template: Template) -> dict[str, str]:
    """For each first character of a control string a pattern of what may follow."""
    by_first: dict[str, list[str]] = {}
    for c in template.control:
        by_first.setdefault(c[0], []).append(re.escape(c[1:]))
    return {first: "|".join(rests) for first, rests in by_first.items()}


def escaped(text: Column, template: Template) -> Column:
    """``text`` without a control string; ``unescaped`` gives it back."""
    found = [f"{re.escape(c)}(?=\\\\*(?:{rest}))" for c, rest in _rests(template).items()]
    return F.regexp_replace(text, "|".join(found), "$0\\\\")


def unescaped(text: Column, template: Template) -> Column:
    found = [f"(?<={re.escape(c)})\\\\(?=\\\\*(?:{rest}))" for c, rest in _rests(template).items()]
    return F.regexp_replace(text, "|".join(found), "")


def escaped_role(role: Column, template: Template) -> Column:
    """A role on one line: a backslash becomes ``\\b`` and a line end ``\\n``, then like a text."""
    one_line = F.replace(F.replace(role, F.lit("\\"), F.lit("\\b")), F.lit("\n"), F.lit("\\n"))
    return escaped(one_line, template)


def unescaped_role(role: Column, template: Template) -> Column:
    plain = unescaped(role, template)
    return F.replace(F.replace(plain, F.lit("\\n"), F.lit("\n")), F.lit("\\b"), F.lit("\\"))


def turn_segments(role: Column, text: Column, template: Template = CHATML) -> Column:
    """The segments ``(text, loss)`` of one turn."""
    made = []
    for segment in template.segments:
        if segment.value == ROLE:
            value = escaped_role(role, template)
        elif segment.value == TEXT:
            value = escaped(text, template)
        else:
            value = F.lit(segment.value)
        loss = role.isin(*segment.loss) if segment.loss else F.lit(False)
        made.append(F.struct(value.alias("text"), loss.alias("loss")))
    return F.array(*made)


def _moved(state: Column, role: Column, template: Template) -> Column:
    """The state that ``role`` leads to."""
    after = F.lit(ERROR)
    for name, moves in template.moves.items():
        for by, to in moves.items():
            after = F.when((state == name) & (role == by), to).otherwise(after)
    return after


def chunks(
    rows: DataFrame,
    template: Template = CHATML,
    key: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    chunk_turns: int = CHUNK_TURNS,
) -> DataFrame:
    """Formatted conversations in chunks: ``key``, ``chunk``, ``n_turns``, ``segments`` and
    ``moves`` (the state after the chunk for each of ``template.states`` before it)."""
    used = rows.select(
        F.col(key).alias("__key"), F.col(turn).alias("__turn"), F.col(role).alias("__role"), F.col(text).alias("__text")
    )
    entry = F.struct(F.col("__turn").alias("turn"), F.col("__role").alias("role"), F.col("__text").alias("text"))
    gathered = used.groupBy("__key", F.floor(F.col("__turn") / F.lit(chunk_turns)).alias("chunk"))
    ordered = gathered.agg(F.sort_array(F.collect_list(entry)).alias("turns"))
    turns = F.transform(
        "turns",
        lambda t: F.struct(
            F.coalesce(t["role"], F.lit("")).alias("role"), F.coalesce(t["text"], F.lit("")).alias("text")
        ),
    )
    states = F.array(*[F.lit(s) for s in template.states])
    moves = F.aggregate(
        "turns", states, lambda before, t: F.transform(before, lambda s: _moved(s, t["role"], template))
    )
    ordered = ordered.withColumn("turns", turns)
    return ordered.select(
        F.col("__key").alias(key),
        "chunk",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.flatten(F.transform("turns", lambda t: turn_segments(t["role"], t["text"], template))).alias("segments"),
        moves.alias("moves"),
    )


def formatted(segments: Column) -> Column:
    """The training text of a chunk."""
    return F.array_join(F.transform(segments, lambda s: s["text"]), "")


def read_turns(text: Column, template: Template = CHATML) -> Column:
    """Turns ``(role, text)`` of a formatted text; the inverse of formatting."""
    # Each piece behind a head holds one turn; a head never occurs inside a text.
    pieces = F.split(text, re.escape(template.head), -1)
    pieces = F.slice(pieces, F.lit(2), F.size(pieces) - 1)

    def turn(piece: Column) -> Column:
        line = F.instr(piece, "\n")
        body = F.substr(piece, line + len(template.between), F.length(piece) - line - len(template.between) + 1 - len(template.tail))
        return F.struct(
            unescaped_role(F.substr(piece, F.lit(1), line - 1), template).alias("role"),
            unescaped(body, template).alias("text"),
        )

    return F.transform(pieces, turn)


def read_loss(segments: Column, template: Template = CHATML) -> Column:
    """The text under the loss mask, as it was before escaping."""
    under = F.filter(segments, lambda s: s["loss"])
    return F.array_join(F.transform(under, lambda s: unescaped(s["text"], template)), "")


def end_state(moves: Column, template: Template = CHATML) -> Column:
    """The state behind chunks in order: their ``moves``, applied one after the other."""
    states = F.array(*[F.lit(s) for s in template.states])
    return F.aggregate(
        moves,
        F.lit(template.start),
        lambda state, move: F.coalesce(F.get(move, F.array_position(states, state).cast("int") - 1), F.lit(ERROR)),
    )


def valid(state: Column, template: Template = CHATML) -> Column:
    return state.isin(*template.accepting)


def digests(made: DataFrame, template: Template = CHATML, key: str = "conv_id") -> DataFrame:
    """What the output of :func:`chunks` reads back as, one row per conversation."""
    whole = formatted(F.col("segments"))
    turns = F.transform(
        read_turns(F.col("__whole"), template), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))
    )
    read = made.withColumn("__whole", whole).select(
        F.col(key),
        F.struct(
            F.col("chunk").alias("chunk"),
            turns.alias("turns"),
            read_loss(F.col("segments"), template).alias("loss"),
            F.length("__whole").cast("bigint").alias("chars"),
            F.col("moves").alias("moves"),
        ).alias("__part"),
    )
    # One short list of chunks per conversation.
    joined = read.groupBy(key).agg(F.sort_array(F.collect_list("__part")).alias("__parts"))
    turn_lists, losses = F.col("__parts.turns"), F.array_join(F.col("__parts.loss"), "")
    state = end_state(F.col("__parts.moves"), template)
    total = F.aggregate("__parts", F.lit(0).cast("bigint"), lambda n, p: n + F.size(p["turns"]))
    return joined.select(
        F.col(key),
        total.alias("n_turns"),
        F.sha2(F.array_join(F.flatten(turn_lists), ""), 256).alias("turns_sha256"),
        F.length(losses).cast("bigint").alias("loss_chars"),
        F.sha2(losses, 256).alias("loss_sha256"),
        F.aggregate("__parts.chars", F.lit(0).cast("bigint"), lambda n, c: n + c).alias("formatted_chars"),
        state.alias("state"),
        valid(state, template).alias("valid"),
    )
