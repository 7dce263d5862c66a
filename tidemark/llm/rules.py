"""Quality rules as a short-circuit cascade.

Each rule reads lazily computed measures of one text and rejects or passes it.
On a random sample every rule is timed and its rejections are kept as bit masks;
the rules are then ordered greedily by rejections per cost among the texts that
the rules before them let pass.  Over the whole table a text leaves the cascade
at its first rejection.  The order changes only the cost, never the verdict.

A null text has no words.  Repeated rows give repeated results.
"""

from __future__ import annotations

import time
from collections import Counter
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import cached_property

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import map_rows

#: Rows of the sample that only sets the order of the rules.
SAMPLE_ROWS = 2_000
WINDOW = 8
SYMBOLS = "#*$%&|<>"
_SPACE = " \t\n\v\f\r"
_MIX = np.array([pow(0x9E3779B97F4A7C15, 2 * i + 1, 2**64) for i in range(WINDOW)], dtype=np.uint64)


class Measures:
    """Measures of one text, each computed when first asked for."""

    def __init__(self, text: str | None):
        self.text = text or ""

    @cached_property
    def words(self) -> list[bytes]:
        # bytes.split() parts at exactly the six ASCII white-space bytes.
        return self.text.encode().split()

    @property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return len(self.text) - sum(map(self.text.count, _SPACE))

    @cached_property
    def n_symbols(self) -> int:
        return sum(map(self.text.count, SYMBOLS))

    @cached_property
    def lines(self) -> list[str]:
        return [line for line in self.text.split("\n") if line.strip(_SPACE)]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_distinct(self) -> int:
        return len(set(self.words))

    @cached_property
    def n_repeat_words(self) -> int:
        """Words inside windows of ``WINDOW`` words that occur twice or more."""
        n = len(self.words) - WINDOW + 1
        if n < 2:
            return 0
        codes = np.fromiter(map(hash, self.words), dtype=np.int64, count=len(self.words)).view(np.uint64)
        keys = np.zeros(n, dtype=np.uint64)
        for i in range(WINDOW):
            keys += codes[i : i + n] * _MIX[i]
        order = np.argsort(keys)
        ranked = keys[order]
        same = ranked[1:] == ranked[:-1]
        if not same.any():
            return 0
        maybe = np.zeros(n, dtype=bool)
        maybe[order[1:][same]] = True
        maybe[order[:-1][same]] = True
        # Equal windows always share a key; comparing the words drops chance hits.
        where = np.flatnonzero(maybe).tolist()
        windows = [tuple(self.words[i : i + WINDOW]) for i in where]
        counted = Counter(windows)
        inside = np.zeros(len(self.words) + 1, dtype=np.int64)
        for i, window in zip(where, windows):
            if counted[window] > 1:
                inside[i] += 1
                inside[i + WINDOW] -= 1
        return int((np.cumsum(inside) > 0).sum())


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Measures], bool]


#: The first two decide ``base_failed``; the rest are the cascade's own.
BASE_RULES = (
    Rule("few_words", lambda m: m.n_words < 20),
    Rule("repeated_windows", lambda m: 100 * m.n_repeat_words > 30 * m.n_words),
)
RULES = (
    *BASE_RULES,
    Rule("symbols", lambda m: 4 * m.n_symbols > m.n_words),
    Rule("repeated_lines", lambda m: 2 * m.n_dup_lines > len(m.lines)),
    Rule("word_length", lambda m: not 2 * m.n_words <= m.word_chars <= 15 * m.n_words),
    Rule("few_distinct_words", lambda m: m.n_words >= 50 and 5 * m.n_distinct < m.n_words),
)
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def estimate(docs: DataFrame, rules: Sequence[Rule] = RULES, text: str = "text", rows: int = SAMPLE_ROWS) -> list[Rule]:
    """The rules in their order of rejection per cost, from a random sample of about ``rows`` rows."""
    total = docs.count()
    if total == 0:
        return list(rules)
    sample = docs.select(text).sample(min(1.0, rows / total), seed=7)

    def start():
        def each(value):
            seconds, mask = [], 0
            for i, rule in enumerate(rules):
                began = time.perf_counter()
                mask |= int(rule.rejects(Measures(value))) << i
                seconds.append(time.perf_counter() - began)
            return mask, seconds

        return each

    fields = T.StructType([T.StructField("mask", T.LongType()), T.StructField("cost", T.ArrayType(T.DoubleType()))])
    timed = map_rows(sample, [text], [], fields, start)
    # One row per mask of rejections: at most 2 ** len(rules).
    groups = timed.groupBy("mask").agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(F.col("cost")[i]).alias(f"c{i}") for i in range(len(rules))]
    ).collect()
    cost = [sum(g[f"c{i}"] for g in groups) + 1e-9 for i in range(len(rules))]
    left, order, alive = list(range(len(rules))), [], list(groups)
    while left:
        rejected = {i: sum(g["n"] for g in alive if g["mask"] >> i & 1) for i in left}
        best = max(left, key=lambda i: (rejected[i] / cost[i], -cost[i]))
        order.append(rules[best])
        left.remove(best)
        alive = [g for g in alive if not g["mask"] >> best & 1]
    return order


def cascade(
    docs: DataFrame,
    keep: list[str],
    order: Sequence[Rule],
    text: str = "text",
    measures: Sequence[str] = (),
) -> DataFrame:
    """Columns ``keep``, the asked ``measures`` and ``kept``: no rule rejects the text."""
    order, measures = list(order), list(measures)

    def start():
        def each(value):
            m = Measures(value)
            kept = not any(rule.rejects(m) for rule in order)
            return (*[getattr(m, name) for name in measures], kept)

        return each

    fields = T.StructType([T.StructField(name, T.LongType()) for name in measures] + [T.StructField("kept", T.BooleanType())])
    return map_rows(docs, [text], keep, fields, start)
