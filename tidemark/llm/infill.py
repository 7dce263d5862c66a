"""Fill-in-the-middle texts: two cuts per document, found on a wavelet matrix over character classes.

A batch of texts is one byte sequence.  Every byte belongs to a class: space, first
byte of another character or continuation byte, each with a mark where a unit ends.
A wavelet matrix over these classes answers how often a class occurs before a
position.  Ranks of several classes add up to the number of units (and of code
points) before a position, and a bisection on such ranks, run for all documents of
the batch together, finds the byte after the k-th unit.  Memory is bounded by one
slice of a batch, or one text where a text is larger; nothing is shuffled.

A unit is a run of other characters with the spaces before it, or the spaces that
end a text.  A null text is empty; an empty text has no units and stays plain, as
does a text that holds one of the marks.  A null id draws like the empty string.
Equal ids draw equal cuts, whatever their texts; repeated rows give repeated
results.  An empty table gives an empty one.  Texts of any length are cut whole.
An input column named like an output is replaced by it.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tidemark.llm.common import slices

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Percent of the documents that are rearranged, and of these that put the suffix first.
RATE, SUFFIX_FIRST = 50, 80
SEED = 42
OUTPUTS = ("n", "form", "prefix_chars", "middle_chars", "output")


class Bits:
    """A bit vector that counts the ones before a position."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        self.words = np.zeros(len(bits) // 64 + 1, dtype="<u8")
        self.words.view(np.uint8)[: len(packed)] = packed
        self.before = np.zeros(len(self.words) + 1, dtype=np.int64)
        np.cumsum(np.bitwise_count(self.words), out=self.before[1:])
        self.ones = int(self.before[-1])

    def rank(self, at: np.ndarray) -> np.ndarray:
        word = at >> 6
        inside = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & inside)


class WaveletMatrix:
    """Counts of symbols below ``2 ** levels`` before any position of a sequence."""

    def __init__(self, symbols: np.ndarray, levels: int):
        self.levels: list[tuple[int, Bits, int]] = []
        rest = symbols
        for shift in range(levels - 1, -1, -1):
            bit = (rest >> shift) & 1
            vector = Bits(bit)
            self.levels.append((shift, vector, len(rest) - vector.ones))
            if shift:
                ones = bit.astype(bool)
                rest = np.concatenate([rest[~ones], rest[ones]])

    def rank(self, symbol: int, at: np.ndarray) -> np.ndarray:
        """How often ``symbol`` occurs before each position."""
        low, high = np.zeros(1, dtype=np.int64), at
        for shift, vector, zeros in self.levels:
            low_ones, high_ones = vector.rank(low), vector.rank(high)
            if (symbol >> shift) & 1:
                low, high = zeros + low_ones, zeros + high_ones
            else:
                low, high = low - low_ones, high - high_ones
        return high - low


#: Classes of a byte; the lowest bit says that a unit ends behind it.
SPACE, FIRST, CONTINUED = 0, 2, 4


class Units:
    """Units and code points of texts laid end to end; text ``i`` is ``data[bounds[i]:bounds[i + 1]]``."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray):
        space = (data == 0x20) | ((data >= 0x09) & (data <= 0x0D))
        last = np.zeros(len(data), dtype=bool)
        full = bounds[1:] > bounds[:-1]
        last[bounds[1:][full] - 1] = True
        follows = np.append(space[1:], True) if len(data) else space
        ends = last | (~space & follows)
        kind = np.where(space, SPACE, np.where((data & 0xC0) == 0x80, CONTINUED, FIRST))
        self.bounds = bounds
        self.matrix = WaveletMatrix((kind + ends).astype(np.uint8), 3)

    def before(self, at: np.ndarray) -> np.ndarray:
        """Units that end before a position."""
        return sum(self.matrix.rank(kind + 1, at) for kind in (SPACE, FIRST, CONTINUED))

    def characters(self, at: np.ndarray) -> np.ndarray:
        """Code points that start before a position."""
        return at - self.matrix.rank(CONTINUED, at) - self.matrix.rank(CONTINUED + 1, at)

    def after(self, wanted: np.ndarray) -> np.ndarray:
        """For each text the position behind its first ``wanted`` units."""
        low, high = self.bounds[:-1].copy(), self.bounds[1:].copy()
        goal = self.before(low) + wanted
        open_ = low < high
        while open_.any():
            middle = (low + high) >> 1
            short = self.before(middle) < goal
            low = np.where(open_ & short, middle + 1, low)
            high = np.where(open_ & ~short, middle, high)
            open_ = low < high
        return low


def draws(key: Column, seed: int = SEED) -> list[Column]:
    """Four numbers below 2**32 that depend on the id and the seed only."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("bigint") for i in range(4)]


def form_of(text: Column, third: Column, fourth: Column, rate: int, suffix_first: int) -> Column:
    plain = (text == "") | (F.pmod(third, F.lit(100)) >= rate)
    for mark in (PREFIX, SUFFIX, MIDDLE):
        plain = plain | F.contains(text, F.lit(mark))
    return F.when(plain, "plain").when(F.pmod(fourth, F.lit(100)) < suffix_first, "spm").otherwise("psm")


def rearranged(
    docs: DataFrame,
    keep: Sequence[str],
    key: str = "doc_id",
    text: str = "text",
    seed: int = SEED,
    rate: int = RATE,
    suffix_first: int = SUFFIX_FIRST,
) -> DataFrame:
    """Columns ``keep`` with ``n`` (units), ``form`` (plain, psm or spm), ``prefix_chars`` and
    ``middle_chars`` (code points, null if plain) and ``output``, the text to train on."""
    kept = [c for c in keep if c not in OUTPUTS]
    first, second, third, fourth = draws(F.col(key), seed)
    whole = F.coalesce(F.col(text), F.lit(""))
    used = docs.select(
        *[F.col(c).alias(f"__c{i}") for i, c in enumerate(kept)],
        whole.alias("__text"),
        first.alias("__first"),
        second.alias("__second"),
        form_of(whole, third, fourth, rate, suffix_first).alias("form"),
    )
    names = [f"__c{i}" for i in range(len(kept))]
    made = [
        T.StructField("n", T.LongType()),
        T.StructField("form", T.StringType()),
        T.StructField("prefix_chars", T.LongType()),
        T.StructField("middle_chars", T.LongType()),
        T.StructField("output", T.StringType()),
    ]
    out = T.StructType([used.schema[c] for c in names] + made)
    arrow = to_arrow_schema(out)
    prefix, suffix, middle = (m.encode() for m in (PREFIX, SUFFIX, MIDDLE))

    def cut(part: pa.RecordBatch) -> pa.RecordBatch:
        column = part.column("__text").cast(pa.large_binary())
        bounds = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
        raw = column.buffers()[2]
        body = memoryview(raw)[bounds[0] : bounds[-1]] if raw is not None else memoryview(b"")
        bounds = bounds - bounds[0]
        units = Units(np.frombuffer(body, dtype=np.uint8), bounds)
        starts, stops = bounds[:-1], bounds[1:]
        n = units.before(stops) - units.before(starts)
        one, two = (part.column(c).to_numpy() % (n + 1) for c in ("__first", "__second"))
        left, right = units.after(np.minimum(one, two)), units.after(np.maximum(one, two))
        forms = part.column("form").to_pylist()
        begun = units.characters(starts)
        at_left, at_right = units.characters(left), units.characters(right)
        texts = []
        for form, a, p, m, b in zip(forms, starts.tolist(), left.tolist(), right.tolist(), stops.tolist()):
            if form == "plain":
                texts.append(bytes(body[a:b]))
            elif form == "psm":
                texts.append(b"".join((prefix, body[a:p], suffix, body[m:b], middle, body[p:m])))
            else:
                texts.append(b"".join((suffix, body[m:b], prefix, body[a:p], middle, body[p:m])))
        plain = np.array([f == "plain" for f in forms], dtype=bool)
        columns = [part.column(c).cast(arrow.field(c).type) for c in names]
        columns += [
            pa.array(n, type=pa.int64()),
            pa.array(forms, type=pa.string()),
            pa.array(at_left - begun, type=pa.int64(), mask=plain),
            pa.array(at_right - at_left, type=pa.int64(), mask=plain),
            pa.array(texts, type=pa.binary()).cast(arrow.field("output").type),
        ]
        return pa.RecordBatch.from_arrays(columns, schema=arrow)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "__text"):
                yield cut(part)

    result = used.mapInArrow(run, out)
    return result.select(*[F.col(c).alias(name) for c, name in zip(names, kept)], *OUTPUTS)


def restored(output: Column, form: Column) -> Column:
    """The text that ``rearranged`` made ``output`` of."""
    # A rearranged text holds each mark once, so splitting at them is exact.
    parts = F.split(output, "|".join((PREFIX, SUFFIX, MIDDLE)), -1)
    return (
        F.when(form == "plain", output)
        .when(form == "psm", F.concat(parts[1], parts[3], parts[2]))
        .otherwise(F.concat(parts[2], parts[3], parts[1]))
    )
