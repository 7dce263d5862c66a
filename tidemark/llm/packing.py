"""Packing token sequences by cutting stock with column generation.

Documents are tokenised once and cut into full pieces and one remainder.  The
remainders are items of a cutting-stock problem: their lengths, rounded up to
bins, make a histogram whose size is fixed.  A linear program over patterns
(how many items of each bin share one sequence) is solved by column generation:
a knapsack recursion prices new patterns with the dual values.  Patterns are
rounded down and used whole; what is left over is packed by the same knapsack
over the rest.  Pieces are ranked inside their bin and the ranks are laid over
the slots of the patterns, so no piece has to meet another one to find its place.

A null text is empty; an empty document still has its end token and so one piece.
Repeated rows are packed each for itself.  An empty table gives no sequence.
"""

from __future__ import annotations

import json
import re
import struct
import unicodedata
import zlib
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import map_rows, materialise, worker_cache
from tidemark.llm.learn import inverse as inverted

LENGTH = 2048
#: Lengths are rounded up to this many tokens in the histogram.
BIN = 16
END = 1
#: Rows that one ranked slice of a bin holds, about.
SLICE_ROWS = 20_000
#: Chunks, and parts of chunks, that a worker remembers with their ids: half of them in
#: use, half from before; the older half goes when the other is full.
REMEMBERED = 600_000
#: Longer chunks are not remembered.
LONGEST = 64

#: Texts with other characters than these are left whole to the tokenizer: ones below
#: U+0300 that stay there in lower case, without the white space on which engines differ.
_FAST = re.compile("[^\x00-\x1b\x20-\x7f\xa0-\u012f\u0131-\u0239\u023b-\u023d\u023f-\u02ff]")
#: How a vocabulary cuts normalised text into the parts its model sees (fixed value).
_CUT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def _class(kind: str) -> str:
    """The characters below U+0300 of a Unicode category, for a pattern."""
    return "".join(re.escape(chr(c)) for c in range(0x300) if unicodedata.category(chr(c)).startswith(kind))


#: The same cut for the characters of ``_FAST``.
_PARTS = re.compile(
    _CUT.replace(r"\p{L}", _class("L")).replace(r"\p{N}", _class("N")).replace(r"\s", "\t-\r \xa0")
)
#: Bytes as the characters a byte-level model knows them by: printable ones as they are,
#: the others in turn from U+0100.
_SHOWN = [b for b in range(256) if 0x21 <= b <= 0x7E or (b >= 0xA1 and b != 0xAD)]
_BYTES = {b: b for b in _SHOWN} | {b: 256 + i for i, b in enumerate(sorted(set(range(256)) - set(_SHOWN)))}


class _Recent(dict):
    """Values made once per key and remembered in two generations."""

    def __init__(self, make: Callable[[str], bytes]):
        self.make, self.old = make, {}

    def __missing__(self, key: str) -> bytes:
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= LONGEST:
            if len(self) >= REMEMBERED // 2:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def _cuts_as_known(tokenizer) -> bool:
    """Whether a vocabulary drops white space, lower-cases and cuts as ``_PARTS`` does."""
    made = json.loads(tokenizer.to_str())
    steps = made["pre_tokenizer"] and made["pre_tokenizer"].get("pretokenizers") or []
    cut = [s for s in steps if s["type"] == "Split"]
    kinds = [s["type"] for s in steps]
    normal = made["normalizer"] and made["normalizer"].get("normalizers") or []
    return (
        kinds == ["Split", "ByteLevel"]
        and cut[0]["pattern"] == {"Regex": _CUT}
        and cut[0]["invert"]
        and not (steps[1]["add_prefix_space"] or steps[1]["use_regex"])
        and [s["type"] for s in normal] == ["NFC", "Replace", "Lowercase"]
        and made["post_processor"] is None
    )


def encoder(vocabulary: str | None) -> Callable[[str], bytes]:
    """Text to its ids as little-endian bytes, equal to encoding it whole.

    Where the vocabulary is known to cut as ``_PARTS`` does, chunks between white space
    are looked up; an unknown one is cut into parts, and only parts that are unknown too
    go through the model.  Other vocabularies, and other characters, encode texts whole.
    """
    cache = worker_cache()
    key = ("chunks", vocabulary)
    if key not in cache:
        import public_tokenizers
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(vocabulary or public_tokenizers.path("word_bpe_49k.json"))
        model = tokenizer.model

        def ids_of(part: str) -> bytes:
            if not (part.isascii() and part.isprintable()):
                part = part.encode().decode("latin-1").translate(_BYTES)
            return _packed([token.id for token in model.tokenize(part)])

        parts = _Recent(ids_of)
        chunks = _Recent(lambda chunk: b"".join(map(parts.__getitem__, _PARTS.findall(chunk))))
        cache[key] = (tokenizer, chunks, _cuts_as_known(tokenizer))
    tokenizer, chunks, known = cache[key]

    def encode(text: str) -> bytes:
        if not known or _FAST.search(text) or "<|" in text:
            return _packed(tokenizer.encode(text, add_special_tokens=False).ids)
        return b"".join(map(chunks.__getitem__, text.lower().split()))

    return encode


PIECES = T.ArrayType(
    T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "ids_crc32")])
)


def pieces(docs: DataFrame, keep: list[str], text: str = "text", length: int = LENGTH, vocabulary: str | None = None) -> DataFrame:
    """One row per piece: ``keep``, ``start``, ``length``, ``ids_crc32`` and ``doc_tokens``."""

    def start():
        encode = encoder(vocabulary)
        end = np.array([END], dtype="<u4").tobytes()

        def each(value):
            ids = memoryview(encode(value or "") + end)
            total = len(ids) // 4
            cut = [
                {"start": at, "length": min(length, total - at), "ids_crc32": zlib.crc32(ids[4 * at : 4 * (at + length)])}
                for at in range(0, total, length)
            ]
            return cut, total

        return each

    fields = T.StructType([T.StructField("__pieces", PIECES), T.StructField("doc_tokens", T.LongType())])
    made = map_rows(docs, [text], keep, fields, start)
    made = made.select(*keep, "doc_tokens", F.explode("__pieces").alias("__p"))
    return made.select(*keep, "__p.start", "__p.length", "__p.ids_crc32", "doc_tokens")


def best_pattern(values: np.ndarray, limits: np.ndarray, room: int) -> np.ndarray:
    """Knapsack: counts of bins (sizes 1, 2, ...) with the most value in ``room``, at most ``limits`` of each."""
    n = len(values)
    best = np.zeros(room + 1)
    used = np.zeros((n, room + 1), dtype=np.int16)
    for i in np.flatnonzero((values > 1e-12) & (limits > 0)):
        size, most = i + 1, int(min(limits[i], room // (i + 1)))
        gained, count = best.copy(), np.zeros(room + 1, dtype=np.int16)
        for k in range(1, most + 1):
            shifted = best[: room + 1 - k * size] + k * values[i]
            better = shifted > gained[k * size :] + 1e-12
            gained[k * size :][better] = shifted[better]
            count[k * size :][better] = k
        best, used[i] = gained, count
    pattern, left = np.zeros(n, dtype=np.int64), int(np.argmax(best))
    for i in range(n - 1, -1, -1):
        pattern[i] = used[i, left]
        left -= int(pattern[i]) * (i + 1)
    return pattern


def solve(demand: np.ndarray, room: int) -> list[tuple[np.ndarray, int]]:
    """Patterns with their number of uses that cover ``demand`` exactly.

    ``demand[i]`` items have size ``i + 1``.  The restricted program keeps a basis
    of one pattern per present size; each priced pattern enters by the ratio test
    (the revised simplex step).  Work depends on the number of bins only.
    """
    demand = demand.astype(np.int64)
    present = np.flatnonzero(demand)
    if not len(present):
        return []
    sizes = present + 1
    basis = np.diag((room // sizes).astype(float))
    # Slightly uneven demands keep the simplex from standing still in a corner.
    need = demand[present] + np.linspace(1e-3, 2e-3, len(present))
    most = np.full(room, room, dtype=np.int64)
    inverse, bound = np.diag(1.0 / (room // sizes)), 0.0
    for step in range(40 * len(present)):
        x, dual = (inverse * need).sum(axis=1), inverse.sum(axis=0)
        values = np.zeros(room)
        values[present] = np.maximum(dual, 0)
        entering = best_pattern(values, most, room)[present].astype(float)
        # No solution is better than this one over the value of the best pattern.
        value = max(1.0, float((dual * entering).sum()))
        bound = max(bound, x.sum() / value)
        if x.sum() - bound <= max(0.5, 1e-5 * bound):
            break
        change = (inverse * entering).sum(axis=1)
        steps = np.where(change > 1e-9, x / np.where(change > 1e-9, change, 1), np.inf)
        out = int(np.argmin(steps))
        basis[:, out] = entering
        if step % 200 == 199:
            inverse = inverted(basis)
        else:
            row = inverse[out] / change[out]
            inverse = inverse - np.outer(change, row)
            inverse[out] = row
    x = (inverted(basis) * need).sum(axis=1)
    left, plan = demand.copy(), []
    for j in np.argsort(-x):
        pattern = np.zeros(room, dtype=np.int64)
        pattern[present] = np.rint(basis[:, j]).astype(np.int64)
        inside = pattern > 0
        uses = int(min(np.floor(x[j] + 1e-6), (left[inside] // pattern[inside]).min()))
        if uses > 0:
            plan.append((pattern, uses))
            left -= uses * pattern
    # What rounding left over: fill one sequence after the other, fullest first.
    volume = np.arange(1, room + 1) * (1 + 1e-6 * np.arange(1, room + 1))
    while left.any():
        pattern = best_pattern(volume * (left > 0), left, room)
        inside = pattern > 0
        uses = int((left[inside] // pattern[inside]).min())
        plan.append((pattern, uses))
        left -= uses * pattern
    return plan


def slots(plan: list[tuple[np.ndarray, int]]) -> list[tuple[int, int, int, int, int]]:
    """Rows ``(bin, first rank, items per use, first sequence, first slot)``: ranks of a bin laid over the patterns."""
    taken: dict[int, int] = {}
    rows, sequence = [], 0
    for pattern, uses in plan:
        slot = 0
        for i in np.flatnonzero(pattern)[::-1].tolist():
            each = int(pattern[i])
            rows.append((i + 1, taken.get(i, 0), each, sequence, slot))
            taken[i] = taken.get(i, 0) + uses * each
            slot += each
        sequence += uses
    return rows


def pack(cut: DataFrame, order: list[str], length: int = LENGTH, bin_size: int = BIN) -> DataFrame:
    """``cut`` (a written table of pieces) with ``sequence_id`` and ``offset``.

    ``order`` ranks the pieces inside a bin.
    """
    spark = cut.sparkSession
    room = length // bin_size
    sized = cut.withColumn("__bin", F.ceil(F.col("length") / F.lit(bin_size)).cast("int"))
    # Slices of a bin by a hash of the order columns; a hot bin is split like any other.
    counts = sized.groupBy("__bin").agg(F.count(F.lit(1)).alias("n"))
    histogram = {r["__bin"]: r["n"] for r in counts.collect()}  # at most length / bin_size rows
    demand = np.array([histogram.get(i + 1, 0) for i in range(room)], dtype=np.int64)
    parts = {b: -(-n // SLICE_ROWS) for b, n in histogram.items()}
    if not parts:
        return cut.withColumn("sequence_id", F.lit(0).cast("bigint")).withColumn("offset", F.lit(0).cast("bigint"))
    many = F.element_at(F.create_map(*[F.lit(v) for kv in parts.items() for v in kv]), F.col("__bin"))
    sized = sized.withColumn("__slice", F.pmod(F.xxhash64(*order), many.cast("bigint")))
    per_slice = sized.groupBy("__bin", "__slice").agg(F.count(F.lit(1)).alias("__n"))
    ahead = Window.partitionBy("__bin").orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    per_slice = per_slice.select("__bin", "__slice", F.coalesce(F.sum("__n").over(ahead), F.lit(0)).alias("__before"))
    ranks = Window.partitionBy("__bin", "__slice").orderBy(*order)
    ranked = sized.withColumn("__rn", F.row_number().over(ranks)).join(per_slice, ["__bin", "__slice"])
    ranked = ranked.withColumn("__rank", F.col("__before") + F.col("__rn") - 1)
    # The layout has at most (patterns x bins) rows, so it travels inside the task.
    layout = slots(solve(demand, room))
    table: dict[int, tuple] = {}
    for b in histogram:
        own = [r[1:] for r in layout if r[0] == b]
        table[b] = tuple(np.array(c, dtype=np.int64) for c in zip(*own))

    @F.pandas_udf("sequence long, slot long")
    def place(bins, rank):
        import pandas as pd

        sequence, slot = np.zeros(len(bins), dtype=np.int64), np.zeros(len(bins), dtype=np.int64)
        b, r = bins.to_numpy(), rank.to_numpy()
        for one in np.unique(b):
            at = np.flatnonzero(b == one)
            first, each, first_sequence, first_slot = table[int(one)]
            row = np.searchsorted(first, r[at], side="right") - 1
            inside = r[at] - first[row]
            sequence[at] = first_sequence[row] + inside // each[row]
            slot[at] = first_slot[row] + inside % each[row]
        return pd.DataFrame({"sequence": sequence, "slot": slot})

    placed = ranked.withColumn("__at", place("__bin", "__rank"))
    placed = placed.withColumn("sequence_id", F.col("__at.sequence")).withColumn("__slot", F.col("__at.slot"))
    # A sequence holds at most ``length`` pieces.
    before = Window.partitionBy("sequence_id").orderBy("__slot").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)).cast("bigint"))
    return placed.select(*cut.columns, "sequence_id", "offset")


def pack_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, vocabulary: str | None = None) -> DataFrame:
    """Tokenises, cuts and packs ``docs``: one row per piece."""
    cut = materialise(pieces(docs.select(key, text), [key], text, length, vocabulary), "pieces")
    return pack(cut, [key, "start", "ids_crc32"], length)
