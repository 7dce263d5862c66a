"""Toxic passages as maximum-scoring segments of token log-odds.

Training counts the toxic and clean labelled documents that hold a word or a word
beginning; equal texts count once.
Their log-odds carry a Dirichlet prior spread like the tokens of both classes
together, so rare tokens stay near zero.  A linear scan finds every maximal
segment of positive score in a text.  The largest segment score of clean
documents follows an extreme-value law in the length of the text; its fitted
parameters turn scores into expected chance counts, and the evidence of all
significant passages is calibrated to a probability.

Only words are read for a score.  A null or empty text has no passage and gets
the score of one.  Labels with a null id or class are not used; an id with
several labels counts as toxic if any is.  Without usable labels every score is
the prior one.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import map_rows, materialise
from tidemark.llm.learn import apply_logistic, fit_logistic

#: Labelled documents the model is fitted on, chosen by a hash of their id.
MAX_LABELLED = 40_000
#: Strength of the prior in counted tokens, least z-score and most entries of the lexicon.
PRIOR_TOKENS = 2_000.0
MIN_Z = 4.0
MAX_TERMS = 50_000
#: What every token costs, about the share of toxic words in a toxic text: it ends
#: a passage where they get rarer.
DRIFT = 0.03
#: Expected chance count under which a passage is significant.
SIGNIFICANT = 0.05
#: Every ``FOLDS``-th document by checksum is never learned from.
FOLDS = 5

_WORD = re.compile(r"[^\W\d_]+")
STEMS = (4, 3)


def held_out(key: str = "doc_id") -> Column:
    """Whether the labels of a document are kept for testing."""
    return F.crc32(F.encode(F.coalesce(F.col(key).cast("string"), F.lit("")), "UTF-8")) % FOLDS == 0


def tokens(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


@dataclass(frozen=True)
class Model:
    scores: dict[str, float]
    scale: float  # of the extreme-value law
    location: float  # the log of its constant
    weights: tuple[float, ...]

    def token_score(self, word: str) -> float:
        """Of the word itself, else of its longest known beginning."""
        known = self.scores.get(word)
        if known is None:
            for n in STEMS:
                if len(word) >= n:
                    known = self.scores.get(word[:n] + "*")
                    if known is not None:
                        break
        return (known or 0.0) - DRIFT


def segments(scores: Iterator[tuple[int, float]]) -> list[tuple[float, int, int]]:
    """All maximal scoring segments ``(score, first, last + 1)`` of ``(place, score)`` pairs, in linear time.

    Each open segment keeps the running total at its left and right end.  A new
    positive token looks for the nearest open segment that starts lower; if that
    one also ends lower the two join, else the new one stays open behind it.
    """
    total, stack = 0.0, []  # of (left total, right total, first, end, nearest open one starting lower)
    for place, score in scores:
        before, total = total, total + score
        if score <= 0:
            continue
        left, right, first, end = before, total, place, place + 1
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][0] >= left:
                j = stack[j][4]
            if j < 0 or stack[j][1] >= right:
                stack.append((left, right, first, end, j))
                break
            left, first = stack[j][0], stack[j][2]
            del stack[j:]
    return [(right - left, first, end) for left, right, first, end, _ in stack]


def passages(words: list[str], model: Model, remembered: dict[str, float]) -> list[tuple[float, int, int]]:
    """Maximal segments of a text; ``remembered`` holds token scores between texts."""
    scores = []
    for word in words:
        s = remembered.get(word)
        if s is None:
            if len(remembered) >= 200_000:
                remembered.clear()
            s = remembered[word] = model.token_score(word)
        scores.append(s)
    if not words or max(scores) <= 0:
        return []
    return segments(enumerate(scores))


def evidence(found: list[tuple[float, int, int]], n: int, scale: float, location: float) -> tuple[float, float, int]:
    """Log chance count of the best passage, summed evidence and number of significant passages."""
    best, total, many = 0.0, 0.0, 0
    for score, _, _ in found:
        surplus = scale * score - location - math.log(max(n, 2))
        best = max(best, surplus)
        if surplus > -math.log(SIGNIFICANT):
            total += surplus
            many += 1
    return best, total, many


def _features(best: float, total: float, n: int) -> list[float]:
    return [min(best, 30.0) / 10, math.log1p(total), math.log1p(1000.0 * total / (n + 50.0))]


def training_rows(docs: DataFrame, labels: DataFrame, text: str = "text") -> DataFrame:
    """``text`` and ``toxic`` of the labelled documents to learn from, at most ``MAX_LABELLED``."""
    usable = (
        labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out())
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
    )
    # The limit bounds what is broadcast: an id and a class for each row.
    chosen = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_LABELLED)
    chosen = materialise(chosen.select(F.col("doc_id").alias("__id"), "toxic"), "labelled")
    here = F.col("doc_id") == F.col("__id")
    ids = docs.select("doc_id", F.xxhash64(text).alias("h")).join(F.broadcast(chosen), here)
    ids = ids.groupBy("h", "toxic").agg(F.min("__id").alias("__id")).select("__id", "toxic").limit(MAX_LABELLED)
    ids = materialise(ids, "training-ids")
    return docs.select("doc_id", text).join(F.broadcast(ids), here).select(text, "toxic")


def lexicon(rows: DataFrame, text: str = "text") -> dict[str, float]:
    """Significant log-odds by token."""

    def count(batches):
        import pyarrow as pa

        from tidemark.llm.common import slices

        counts = (Counter(), Counter())
        for batch in batches:
            for piece in slices(batch):
                for value, toxic in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist()):
                    found = set(tokens(value))
                    stems = {w[:k] + "*" for w in found for k in STEMS if len(w) >= k}
                    counts[bool(toxic)].update(found | stems)
            if len(counts[0]) + len(counts[1]) > 200_000:
                yield from _emit(counts, pa)
        yield from _emit(counts, pa)

    counted = rows.select(text, "toxic").mapInArrow(count, "token string, kind int, toxic long, clean long")
    totals = counted.groupBy("kind", "token").agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c"))
    totals = materialise(totals, "token-counts")
    sums = totals.groupBy("kind").agg(F.sum("t").alias("nt"), F.sum("c").alias("nc"))
    sums = sums.filter((F.col("nt") > 0) & (F.col("nc") > 0))
    scored = totals.join(F.broadcast(sums), "kind")  # one row per kind of token: three
    prior = F.lit(PRIOR_TOKENS) * (F.col("t") + F.col("c")) / (F.col("nt") + F.col("nc"))
    t, c = F.col("t") + prior, F.col("c") + prior
    odds = F.log(t / (F.col("nt") + PRIOR_TOKENS - t)) - F.log(c / (F.col("nc") + PRIOR_TOKENS - c))
    z = odds / F.sqrt(1 / t + 1 / c)
    best = (
        scored.select("token", odds.alias("odds"), z.alias("z"))
        .filter(F.abs("z") >= MIN_Z)
        .orderBy(F.abs("z").desc(), "token")
        .limit(MAX_TERMS)
        .collect()
    )
    return {r["token"]: float(r["odds"]) for r in best}


def _emit(counts, pa):
    """Counts of both classes as one batch; empties the counters."""
    clean, toxic = counts
    every = list(clean.keys() | toxic.keys())
    if every:
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(every, pa.string()),
                pa.array([len(w) if w[-1] == "*" else 0 for w in every], pa.int32()),
                pa.array([toxic[w] for w in every], pa.int64()),
                pa.array([clean[w] for w in every], pa.int64()),
            ],
            names=["token", "kind", "toxic", "clean"],
        )
    clean.clear()
    toxic.clear()


def train(docs: DataFrame, labels: DataFrame, text: str = "text") -> Model:
    """The model fitted on the labelled documents that are not held out."""
    rows = training_rows(docs, labels, text)
    scores = lexicon(rows, text)
    model = Model(scores, 1.0, 0.0, ())

    def start():
        remembered: dict[str, float] = {}

        def each(value):
            words = tokens(value)
            found = [s for s, _, _ in passages(words, model, remembered)]
            return len(words), max(found, default=0.0), found

        return each

    fields = T.StructType(
        [T.StructField("n", T.LongType()), T.StructField("best", T.DoubleType()), T.StructField("s", T.ArrayType(T.DoubleType()))]
    )
    seen = materialise(map_rows(rows, [text], ["toxic"], fields, start), "training-segments")
    # At most MAX_LABELLED short rows, here and below.
    clean = seen.filter(F.col("toxic") == 0).select("best", "n").collect()
    scale, location = fit_extreme([(r["best"], r["n"]) for r in clean])

    def features():
        return lambda n, s: (_features(*evidence([(x, 0, 0) for x in s], n, scale, location)[:2], n),)

    made = map_rows(seen, ["n", "s"], ["toxic"], T.StructType([T.StructField("x", T.ArrayType(T.DoubleType()))]), features)
    fitted = made.collect()
    x = np.array([r["x"] for r in fitted]).reshape(len(fitted), 3)
    y = np.array([float(bool(r["toxic"])) for r in fitted])
    return Model(scores, scale, location, tuple(fit_logistic(x, y)))


def fit_extreme(best: list[tuple[float, int]]) -> tuple[float, float]:
    """Scale and location of ``P(best > s) = 1 - exp(-n * exp(location - scale * s))``, by maximum likelihood.

    For a given scale the location has a closed form; the scale is found by bisection.
    Texts without any positive token tell nothing about the tail and are left out.
    """
    best = [(b, n) for b, n in best if b > 0 and n > 1]
    s = np.array([b for b, _ in best], dtype=float)
    log_n = np.log([n for _, n in best]) if best else np.array([])
    if len(s) < 10 or s.std() < 1e-9:
        return 1.0, 0.0

    def slope(scale: float) -> float:
        w = log_n - scale * s
        w = np.exp(w - w.max())
        return 1.0 / scale - s.mean() + float((w * s).sum() / w.sum())

    low, high = 1e-3, 1e3
    for _ in range(80):
        mid = math.sqrt(low * high)
        low, high = (mid, high) if slope(mid) > 0 else (low, mid)
    scale = min(max(low, 0.2), 20.0)
    w = log_n - scale * s
    return scale, -(w.max() + math.log(np.exp(w - w.max()).mean()))


def score(docs: DataFrame, keep: list[str], model: Model, text: str = "text", with_passages: bool = False) -> DataFrame:
    """Columns ``keep``, ``score`` and ``predicted``; ``passages`` (word ranges with their log chance counts) if asked for."""
    weights = np.array(model.weights)

    def start():
        remembered: dict[str, float] = {}

        def each(value):
            words = tokens(value)
            found = passages(words, model, remembered)
            best, total, _ = evidence(found, len(words), model.scale, model.location)
            p = float(apply_logistic(weights, np.array([_features(best, total, len(words))]))[0])
            out = (p, int(p >= 0.5))
            if with_passages:
                bar = -math.log(SIGNIFICANT) + model.location + math.log(max(len(words), 2))
                out += ([{"first": a, "end": b, "log_chance": round(bar - model.scale * s + math.log(SIGNIFICANT), 4)} for s, a, b in found if model.scale * s > bar],)
            return out

        return each

    fields = [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]
    if with_passages:
        span = [T.StructField("first", T.LongType()), T.StructField("end", T.LongType()), T.StructField("log_chance", T.DoubleType())]
        fields.append(T.StructField("passages", T.ArrayType(T.StructType(span))))
    return map_rows(docs, [text], keep, T.StructType(fields), start)
