"""Quality by co-training: a text view and a metadata view teach each other.

The text view measures what the words are like; the metadata view sees language,
source, sizes, line layout and how far the page compresses.  Each view is a
logistic classifier.  In every round each view labels all documents of the table
it has become sure of, and these join the training rows of the other view: a text
counts once, in the first round that is sure of it.  Nothing is collected; Spark sums
what a Newton step needs.  The texts of one class and round weigh no more together
than the labelled rows of that class.
In the end both views are calibrated on labelled rows that neither was fitted on
and combined.

Labels with a null id or class are not used; an id with several labels is good if
all are.  A null text is empty.  Without usable labels every score is the prior.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import map_rows, materialise
from tidemark.llm.learn import apply_logistic, fit_logistic, newton_step, newton_sums
from tidemark.llm.rules import Measures
from tidemark.llm.toxicity import held_out

#: Labelled documents the views are fitted and calibrated on, chosen by a hash of their id.
MAX_LABELLED = 20_000
ROUNDS = 3
#: How sure a view must be to label a document for the other one.
SURE = 0.95
#: The view that labels for a view.
TEACHER = {"text_x": "meta_x", "meta_x": "text_x"}
#: Newton steps of a round at most, and the change of a weight that ends them.
STEPS, SMALL_STEP = 25, 1e-4
RIDGE = 1.0
N_MEASURES = 10
LANG_SLOTS, SOURCE_SLOTS = 8, 16


def text_view(m: Measures) -> list[float]:
    """What the words of a text are like."""
    n, chars, text = m.n_words, max(m.word_chars, 1), m.text
    per = max(n, 1)
    top = Counter(m.words).most_common(1)[0][1] if n else 0
    return [
        math.log1p(n),
        m.word_chars / per,
        min(m.n_symbols / per, 5.0),
        m.n_dup_lines / max(len(m.lines), 1),
        m.n_repeat_words / per,
        m.n_distinct / per * math.log1p(n),
        top / per,
        sum(map(text.count, ".,;:!?")) / per,
        sum(map(text.count, "0123456789")) / chars,
        len({w[:1] for w in m.words}) / 26,
    ]


def metadata_view(m: Measures, lang: str | None, source: str | None, n_chars: int | None) -> list[float]:
    """What is known about a document besides its words."""
    data = m.text.encode()
    size, lines = len(data), len(m.lines)
    slots = [0.0] * (LANG_SLOTS + SOURCE_SLOTS)
    slots[zlib.crc32((lang or "").encode()) % LANG_SLOTS] = 1.0
    slots[LANG_SLOTS + zlib.crc32((source or "").encode()) % SOURCE_SLOTS] = 1.0
    return [
        math.log1p(max(n_chars or 0, 0)),
        float(n_chars is None),
        math.log1p(lines),
        math.log1p(size / max(lines, 1)),
        size / max(len(m.text), 1),
        len(zlib.compress(data, 1)) / max(size, 1),
        *slots,
    ]


def features(docs: DataFrame, keep: list[str]) -> DataFrame:
    """Columns ``keep`` and the arrays ``text_x`` and ``meta_x``; one narrow pass."""

    def start():
        def each(text, lang, source, n_chars):
            m = Measures(text)
            return text_view(m), metadata_view(m, lang, source, n_chars)

        return each

    fields = T.StructType([T.StructField(n, T.ArrayType(T.FloatType())) for n in ("text_x", "meta_x")])
    return map_rows(docs, ["text", "lang", "source", "n_chars"], keep, fields, start)


@dataclass(frozen=True)
class View:
    """A fitted view: scaled inputs and their squares, weights."""

    column: str
    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray

    @staticmethod
    def expand(x: np.ndarray, mean: np.ndarray, spread: np.ndarray) -> np.ndarray:
        z = np.clip((x - mean) / spread, -6, 6)
        plain = min(z.shape[1], 6 if z.shape[1] > N_MEASURES else N_MEASURES)  # slots are 0 or 1 and need no square
        return np.hstack([z, z[:, :plain] ** 2])

    @classmethod
    def fit(cls, column: str, x: np.ndarray, y: np.ndarray) -> View:
        mean = x.mean(axis=0) if len(x) else np.zeros(x.shape[1])
        spread = x.std(axis=0) + 1e-3 if len(x) else np.ones(x.shape[1])
        return cls(column, mean, spread, fit_logistic(cls.expand(x, mean, spread), y, ridge=RIDGE))

    def score(self, x: np.ndarray) -> np.ndarray:
        return apply_logistic(self.weights, self.expand(x, self.mean, self.spread))


def pseudo_labels(teachers: list[View], x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Class of each row and the round whose teacher was the first to be sure of it; round -1 where none is."""
    label, when = np.zeros(len(x)), np.full(len(x), -1)
    for k, view in enumerate(teachers):
        p = view.score(x)
        new = (when < 0) & ((p >= SURE) | (p <= 1 - SURE))
        label[new] = p[new] >= 0.5
        when[new] = k
    return label, when


def _summed(pool: DataFrame, each: Callable[[dict], np.ndarray], size: int) -> np.ndarray:
    """The sum of the vectors that ``each`` makes of the views of batches of rows."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            n = batch.num_rows
            if n:
                total += each({c: batch.column(c).flatten().to_numpy().reshape(n, -1).astype(float) for c in TEACHER})
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array(total)], names=["at", "value"])

    parts = pool.select(*TEACHER).mapInArrow(run, "at bigint, value double")
    out = np.zeros(size)
    for r in parts.groupBy("at").agg(F.sum("value").alias("value")).collect():
        out[r["at"]] = r["value"]
    return out


def _taught(pool: DataFrame, views: dict, teachers: dict, weights: dict, train: dict) -> dict:
    """The views fitted on their training rows and on all texts of the pool that their teachers have labelled."""
    sizes = {c: len(views[c].weights) for c in TEACHER}
    for _ in range(STEPS):
        now = views

        def each(x, now=now):
            parts = []
            for c, teacher in TEACHER.items():
                label, when = pseudo_labels(teachers[teacher], x[teacher])
                sure = when >= 0
                each_weight = weights[c][when[sure], label[sure].astype(int)]
                inputs = View.expand(x[c][sure], now[c].mean, now[c].spread)
                gradient, curve = newton_sums(now[c].weights, inputs, label[sure], each_weight)
                parts += [gradient, curve.ravel()]
            return np.concatenate(parts)

        far = _summed(pool, each, sum(d + d * d for d in sizes.values()))
        views, largest = {}, 0.0
        for c, d in sizes.items():
            x, y = train[c]
            gradient, curve = newton_sums(now[c].weights, View.expand(x, now[c].mean, now[c].spread), y, np.ones(len(y)))
            step = newton_step(now[c].weights, gradient + far[:d], curve + far[d : d + d * d].reshape(d, d), RIDGE)
            far = far[d + d * d :]
            views[c] = replace(now[c], weights=now[c].weights - step)
            largest = max(largest, float(np.abs(step).max()))
        if largest < SMALL_STEP:
            break
    return views


def logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def score(docs: DataFrame, labels: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """``doc_id``, ``held_out``, ``text_score``, ``meta_score``, ``score``, ``predicted`` and ``kept`` of every document."""
    table = materialise(features(docs.withColumn("__th", F.xxhash64("text")), ["doc_id", "__th"]), "views")
    usable = (
        labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out())
        .groupBy("doc_id")
        .agg(F.min("quality").alias("good"))
    )
    chosen = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_LABELLED).withColumnRenamed("doc_id", "__id")
    # The limit bounds what is broadcast and what is collected.
    labelled = table.join(F.broadcast(chosen), F.col("doc_id") == F.col("__id"))
    rows = labelled.withColumn("__part", F.pmod(F.xxhash64("doc_id", F.lit("part")), F.lit(4))).select(
        "text_x", "meta_x", F.col("good").cast("double").alias("good"), "__part"
    ).collect()
    n_text, n_meta = len(text_view(Measures(""))), len(metadata_view(Measures(""), None, None, None))
    x = {
        "text_x": np.array([r["text_x"] for r in rows], dtype=float).reshape(len(rows), n_text),
        "meta_x": np.array([r["meta_x"] for r in rows], dtype=float).reshape(len(rows), n_meta),
    }
    y = np.array([r["good"] for r in rows])
    held = np.array([r["__part"] == 0 for r in rows], dtype=bool)
    train = {c: (x[c][~held], y[~held]) for c in x}
    views = {c: View.fit(c, *train[c]) for c in x}
    if len(y) and 0 < y[~held].sum() < (~held).sum():
        # Each text once, and none that is labelled.
        known = labelled.select("__th").distinct()
        pool = table.join(F.broadcast(known), "__th", "left_anti").groupBy("__th").agg(F.min(F.struct("text_x", "meta_x")).alias("m"))
        pool = materialise(pool.select("m.*"), "pool")
        per_class = np.array([(y[~held] == k).sum() for k in (0, 1)])
        teachers, weights = {c: [] for c in x}, {c: np.zeros((0, 2)) for c in x}
        for at in range(rounds):
            teachers = {c: [*teachers[c], views[c]] for c in x}

            def new(xs, teachers=teachers, at=at):
                found = [pseudo_labels(teachers[t], xs[t]) for t in TEACHER.values()]
                return np.array([((when == at) & (label == k)).sum() for label, when in found for k in (0, 1)], dtype=float)

            taken = _summed(pool, new, 2 * len(TEACHER)).reshape(-1, 2)
            for c, n in zip(TEACHER, taken):
                weights[c] = np.vstack([weights[c], np.minimum(1.0, per_class / np.maximum(n, 1.0))])
            views = _taught(pool, views, teachers, weights, train)
    both = np.column_stack([logit(views[c].score(x[c][held])) for c in ("text_x", "meta_x")])
    final = fit_logistic(both, y[held], ridge=0.1)

    @F.pandas_udf("text_score double, meta_score double, score double")
    def combined(text_x, meta_x):
        import pandas as pd

        t = views["text_x"].score(np.array(text_x.tolist(), dtype=float).reshape(len(text_x), n_text))
        m = views["meta_x"].score(np.array(meta_x.tolist(), dtype=float).reshape(len(meta_x), n_meta))
        return pd.DataFrame({"text_score": t, "meta_score": m, "score": apply_logistic(final, np.column_stack([logit(t), logit(m)]))})

    scored = table.select("doc_id", held_out().alias("held_out"), combined("text_x", "meta_x").alias("s")).select(
        "doc_id", "held_out", "s.*"
    )
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int")).withColumn("kept", F.col("score") >= 0.5)
