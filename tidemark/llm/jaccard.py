"""Exact Jaccard join of word shingles with signature trees.

Every text becomes a set of hashed shingles.  Equal sets are one node.  Two sets
that are alike enough share one of the first shingles of their common order, so
nodes meet under those shingles only.  A shingle is led by the node under it that
shares its shingles with most others, and what meets under any shingle of one
leader forms a block.  A large block is cut by set size and into tiles of bounded
rows, and each pair of tiles is walked by itself.  A set's bitmap tells where an odd
number of its shingles falls, so two sets differ in one shingle at least for each
bit that differs.  In a block, a signature tree holds in each inner node the AND and the OR
of its sets' bitmaps and the range of their sizes; two trees are walked together,
and a pair of nodes is left as soon as bitmaps differ in more bits than linked sets
of these sizes can.  What is left is counted exactly on the whole sets.

The disk holds wide columns where they are needed only: a first walk uses bitmaps that
are folded to a fourth and leaves few rows for the whole ones, tables with prefixes or whole
sets are deleted once they are used, shuffle files go with each step, and
``deduplicated`` shuffles texts only of rows it may have to drop.

Two rounds keep large groups of near copies from being paired off: the first
compares each node with its leaders, the second walks only between sets that are
not yet in one component.

A null or empty text has an empty set, is linked with nothing and is a component
of its own.  Rows with equal sets are one component, also if they repeat an id.
A null id is no candidate for the id of a component while there is another one.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tidemark.llm.common import materialise, short_lived, slices, without_leftovers
from tidemark.llm.components import components

SHINGLE = 5
#: Similarity in hundredths: links have ``100 * both >= PERCENT * either``.
PERCENT = 75
#: Documents of the sample that names frequent shingles, the count there that
#: makes one frequent, and how many are named.  They only come last in the order
#: of shingles; results do not depend on them.
SAMPLE_ROWS, FREQUENT, MOST_FREQUENT = 20_000, 16, 20_000
#: Nodes of a block above which it is also split by set size, and rows of a tile
#: into which the size classes of such a block are cut.
HOT_ROWS = 8_000
#: Bits of the filter that picks the texts to be counted exactly.  A full filter
#: lets more texts pass and never loses one.
FILTER_BITS = 1 << 25
FANOUT = 16
#: Bits of the bitmap of a small set, and how often a brief one is folded in half.
LEAST_BITS, FOLDS = 512, 2
#: Bytes of bitmaps compared in one step, and words remembered with their hashes.
STEP_BYTES = 1 << 24
WORDS = 200_000

_U = np.uint64
_PRIMES = np.array([0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5], dtype=_U)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


class _Words(dict):
    """Hashes of words, remembered while there is room."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORDS:
            self.clear()
        made = self[word] = xxhash.xxh3_64_intdigest(word)
        return made


def shingles(text: str | None, words: dict) -> np.ndarray:
    """The distinct hashed shingles of a text, ascending."""
    parts = (text or "").encode().lower().split()
    n = len(parts)
    if not n:
        return np.zeros(0, dtype=_U)
    codes = np.fromiter(map(words.__getitem__, parts), dtype=_U, count=n)
    width = min(n, SHINGLE)
    sums = np.full(n - width + 1, width, dtype=_U)
    for i in range(width):
        sums += codes[i : i + len(sums)] * _PRIMES[i]
    return np.unique(_mixed(sums))


def node_of(found: np.ndarray) -> int:
    """The identity of a set."""
    return xxhash.xxh3_64_intdigest(found.tobytes()) - (1 << 63)


def prefix(found: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """The first shingles of the set, frequent ones last: alike sets share one of them."""
    n = len(found)
    length = n - -(-PERCENT * n // 100) + 1
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, found), len(frequent) - 1)
        late = frequent[at] == found
        if late.any():
            found = np.concatenate([found[~late], found[late]])
    return found[:length]


def most_apart(a, b):
    """Shingles that are in one only of two linked sets of ``a`` and ``b`` shingles, at most."""
    return (a + b) * (100 - PERCENT) // (100 + PERCENT)


def bitmap(found: np.ndarray) -> np.ndarray:
    """Four to eight bits per shingle, as 64-bit words; ``LEAST_BITS`` at least.

    A bit is set where an odd number of shingles falls, so the bits in which two
    bitmaps differ are never more than the shingles in which their sets do.
    """
    bits = max(LEAST_BITS, 1 << int(4 * len(found) - 1).bit_length())
    out = np.bincount((found >> _U(32)).astype(np.int64) & (bits - 1), minlength=bits)
    return np.packbits((out & 1).astype(np.uint8), bitorder="little").view(_U)


def folded(bits: np.ndarray, words: int) -> np.ndarray:
    """Rows of bitmaps folded onto ``words`` words: a bit is set if an odd number of those that fall on it is."""
    while bits.shape[1] > words:
        half = bits.shape[1] // 2
        bits = bits[:, :half] ^ bits[:, half:]
    return bits


def _batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema)], schema=schema)


SETS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("th", T.LongType()),
        T.StructField("node", T.LongType()),
        T.StructField("n", T.LongType()),
        T.StructField("prefix", T.ArrayType(T.LongType())),
        T.StructField("bits", T.BinaryType()),
        T.StructField("brief", T.BinaryType()),
    ]
)


def frequent_shingles(texts: DataFrame) -> np.ndarray:
    """Shingles that many documents of a random sample share, ascending."""
    total = texts.count()
    if total == 0:
        return np.zeros(0, dtype=_U)
    out = T.StructType([T.StructField("s", T.LongType()), T.StructField("k", T.LongType())])
    schema = to_arrow_schema(out)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, held = _Words(), []
        for batch in batches:
            for piece in slices(batch):
                held += [shingles(t, words) for t in piece.column(0).to_pylist()]
        if held:
            s, k = np.unique(np.concatenate(held), return_counts=True)
            yield _batch(schema, s.view(np.int64), k)

    sample = texts.select("text").sample(min(1.0, SAMPLE_ROWS / total), seed=11)
    counted = sample.mapInArrow(run, out).groupBy("s").agg(F.sum("k").alias("k")).filter(F.col("k") >= FREQUENT)
    rows = counted.orderBy(F.col("k").desc(), "s").limit(MOST_FREQUENT).collect()
    return np.sort(np.array([r["s"] for r in rows], dtype=np.int64).view(_U))


def sets_of(docs: DataFrame, frequent: np.ndarray) -> DataFrame:
    """One narrow row per document; ``prefix``, ``bits`` and ``brief`` only where a task meets a set first."""
    schema = to_arrow_schema(SETS)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, met = _Words(), set()
        for batch in batches:
            for piece in slices(batch):
                nodes, sizes, firsts, bits, briefs = [], [], [], [], []
                for text in piece.column(1).to_pylist():
                    found = shingles(text, words)
                    node = node_of(found) if len(found) else None
                    new = node is not None and node not in met
                    met.add(node)
                    nodes.append(node)
                    sizes.append(len(found))
                    firsts.append(prefix(found, frequent).view(np.int64) if new else None)
                    long = bitmap(found) if new else None
                    bits.append(long.tobytes() if new else None)
                    briefs.append(folded(long[None, :], len(long) >> FOLDS).tobytes() if new else None)
                yield _batch(schema, piece.column(0), piece.column(2), nodes, sizes, firsts, bits, briefs)

    return docs.select(F.col("doc_id").cast("bigint"), "text", F.xxhash64("text").alias("th")).mapInArrow(run, SETS)


LIVE = T.StructType([T.StructField(c, T.LongType()) for c in ("key", "node", "n", "k")])


def live_rows(sets: DataFrame) -> DataFrame:
    """Rows ``(key, node, n, k)`` of shingles under which ``k`` > 1 different nodes meet.

    One shuffle by shingle; tasks read their rows sorted and look for neighbours.
    """
    schema = to_arrow_schema(LIVE)
    keyed = sets.filter(F.col("prefix").isNotNull()).select(F.explode("prefix").alias("key"), "node", "n")
    ordered = keyed.repartition("key").sortWithinPartitions("key", "node")

    def groups(key, node, n):
        fresh = np.ones(len(key), dtype=bool)
        fresh[1:] = (key[1:] != key[:-1]) | (node[1:] != node[:-1])
        key, node, n = key[fresh], node[fresh], n[fresh]
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        k = np.diff(np.append(starts, len(key)))
        k = np.repeat(k, k)
        more = k > 1
        return _batch(schema, key[more], node[more], n[more], k[more])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The rows of the last key wait for the next batch.
        held: list[tuple] = []
        for batch in batches:
            columns = tuple(batch.column(i).to_numpy() for i in range(3))
            if not len(columns[0]):
                continue
            if columns[0][0] == columns[0][-1] and (not held or held[-1][0][-1] == columns[0][0]):
                held.append(columns)
                continue
            whole = tuple(np.concatenate(c) for c in zip(*held, columns)) if held else columns
            cut = int(np.searchsorted(whole[0], whole[0][-1]))
            if cut:
                yield groups(*[c[:cut] for c in whole])
            held = [tuple(c[cut:] for c in whole)]
        if held:
            yield groups(*[np.concatenate(c) for c in zip(*held)])

    return ordered.mapInArrow(run, LIVE)


@dataclass
class Signatures:
    """Sets of one block and of one bitmap width, in tree order."""

    node: np.ndarray
    group: np.ndarray
    size: np.ndarray
    home: np.ndarray
    levels: list[tuple]  # leaves first: (AND of bitmaps, OR of bitmaps, least size, largest size)

    @classmethod
    def build(cls, node, group, size, home, bits) -> Signatures:
        levels = [(bits, bits, size, size)]
        while len(levels[-1][2]) > FANOUT:
            every, some, low, high = levels[-1]
            cut = np.arange(0, len(low), FANOUT)
            levels.append(
                (
                    np.bitwise_and.reduceat(every, cut, axis=0),
                    np.bitwise_or.reduceat(some, cut, axis=0),
                    np.minimum.reduceat(low, cut),
                    np.maximum.reduceat(high, cut),
                )
            )
        return cls(node, group, size, home, levels)

    def narrowed(self, words: int) -> Signatures:
        """The same sets with bitmaps folded onto ``words`` words."""
        return Signatures.build(self.node, self.group, self.size, self.home, folded(self.levels[0][0], words))


def walk(a: Signatures, b: Signatures, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of leaf pairs whose bitmaps differ little enough; dual traversal from the tops."""
    top = max(len(a.levels), len(b.levels)) - 1
    last_a, last_b = len(a.levels) - 1, len(b.levels) - 1
    i, j = np.meshgrid(np.arange(len(a.levels[-1][2])), np.arange(len(b.levels[-1][2])), indexing="ij")
    stack = [(top, i.ravel(), j.ravel())]
    # An inner pair makes FANOUT ** 2 pairs of places below it.
    leaf, inner = (max(FANOUT, STEP_BYTES // (8 * x)) for x in (max(8, a.levels[0][0].shape[1]), max(FANOUT**2, a.levels[0][0].shape[1])))
    while stack:
        level, i, j = stack.pop()
        if len(i) > (inner if level else leaf):
            half = len(i) // 2
            stack += [(level, i[:half], j[:half]), (level, i[half:], j[half:])]
            continue
        if same:
            keep = i <= j if level else i < j
            i, j = i[keep], j[keep]
        every_a, some_a, low_a, high_a = a.levels[min(level, last_a)]
        every_b, some_b, low_b, high_b = b.levels[min(level, last_b)]
        fits = (100 * high_a[i] >= PERCENT * low_b[j]) & (100 * high_b[j] >= PERCENT * low_a[i])
        i, j = i[fits], j[fits]
        if level:
            # Bits that all sets of one side have and none of the other.
            differ = (every_a[i] & ~some_b[j]) | (every_b[j] & ~some_a[i])
        else:
            differ = every_a[i] ^ every_b[j]
        fits = np.bitwise_count(differ).sum(axis=1, dtype=np.int64) <= most_apart(high_a[i], high_b[j])
        i, j = i[fits], j[fits]
        if not len(i):
            continue
        if level == 0:
            yield i, j
            continue
        i, j = _children(i, level, last_a, len(a.levels[min(level - 1, last_a)][2])), _children(j, level, last_b, len(b.levels[min(level - 1, last_b)][2]))
        left = np.repeat(i, j.shape[1], axis=1).ravel()
        right = np.tile(j, (1, i.shape[1])).ravel()
        real = (left >= 0) & (right >= 0)
        stack.append((level - 1, left[real], right[real]))


def _children(at: np.ndarray, level: int, last: int, count: int) -> np.ndarray:
    """Places one level down; a lower tree waits at its top.  -1 where a node has fewer children."""
    if level > last:
        return at[:, None]
    down = at[:, None] * FANOUT + np.arange(FANOUT)[None, :]
    return np.where(down < count, down, -1)


def candidates(node, group, size, home, bits: list[bytes], side=None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of nodes of different groups that may be linked, among the rows of one block.

    With ``side``, only between rows of side 0 and rows of side 1.
    """
    widths = np.array([len(x) // 8 for x in bits])

    def trees_of(rows: np.ndarray) -> dict[int, Signatures]:
        trees = {}
        for width in np.unique(widths[rows]).tolist():
            at = rows[widths[rows] == width]
            at = at[np.lexsort((group[at], size[at]))]
            block = np.frombuffer(b"".join([bits[k] for k in at]), dtype=_U).reshape(len(at), width)
            trees[width] = Signatures.build(node[at], group[at], size[at], home[at], block)
        return trees

    # Sets that fit differ by a third in size at most, so by one width.
    if side is None:
        trees = trees_of(np.arange(len(node)))
        meetings = [(tree, tree, True) for tree in trees.values()]
        wider = [(trees, trees)]
    else:
        one, two = (trees_of(np.flatnonzero(side == k)) for k in (0, 1))
        meetings = [(tree, two[width], False) for width, tree in one.items() if width in two]
        wider = [(one, two), (two, one)]
    for narrow, wide in wider:
        meetings += [(tree, wide[2 * width].narrowed(width), False) for width, tree in narrow.items() if 2 * width in wide]
    for a, b, same in meetings:
        for i, j in walk(a, b, same):
            new = (a.group[i] != b.group[j]) & (a.home[i] | b.home[j])
            if new.any():
                yield a.node[i[new]], b.node[j[new]]


PAIR = T.StructType([T.StructField("u", T.LongType()), T.StructField("v", T.LongType())])


def blocks_of(live: DataFrame) -> DataFrame:
    """Distinct ``(leader, node)``: nodes that share a shingle share a block.

    Near copies share most of their shingles, so they meet once here instead of
    once for every shingle.
    """
    fame = live.groupBy("node").agg(F.sum("k").alias("fame"))
    known = live.join(fame, "node")
    lead = known.groupBy("key").agg(F.max(F.struct("fame", "node")).alias("m")).select("key", F.col("m.node").alias("leader"))
    return live.select("key", "node").join(lead, "key").select("leader", "node").distinct()


def in_tiles(members: DataFrame) -> DataFrame:
    """Rows ``(leader, c, s, t, side, node, root, n, home)``; ``members`` has the ``k`` nodes of each leader.

    A block of at most ``HOT_ROWS`` nodes is one group.  A larger one is split by
    size class: sets of one class only fit their own and the two next ones, whose
    sets are its guests.  A class with more rows than ``HOT_ROWS`` is cut into tiles
    of about that many, its own sets and the guests apart, and each pair of tiles
    that has own sets is a group: two sets that fit meet in one group.
    """
    size_class = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100.0 / PERCENT))).cast("int")
    places = F.when(
        F.col("k") > HOT_ROWS,
        F.array(*[F.struct((size_class - d).alias("c"), F.lit(d == 0).alias("home")) for d in (0, 1, 2)]),
    ).otherwise(F.array(F.struct(F.lit(-9).alias("c"), F.lit(True).alias("home"))))
    rows = members.withColumn("__p", F.explode(places)).select("leader", "__p.c", "node", "root", "n", "k", "__p.home")
    # At most one row for every HOT_ROWS rows, so it can be broadcast.
    large = (
        rows.filter(F.col("k") > HOT_ROWS)
        .groupBy("leader", "c")
        .agg(F.count_if("home").alias("own"), F.count_if(~F.col("home")).alias("guests"))
        .filter(F.col("own") + F.col("guests") > HOT_ROWS)
    )
    rows = rows.join(F.broadcast(large), ["leader", "c"], "left")
    own, guests = (F.ceil(F.col(x) / HOT_ROWS).cast("int") for x in ("own", "guests"))
    salt = F.xxhash64("node", F.lit("tile"))
    tile = F.when(F.col("home"), F.pmod(salt, own)).otherwise(own + F.pmod(salt, guests)).cast("int")
    # Own sets meet every tile, guests only the tiles of own sets.
    others = F.when(F.col("home"), own + guests).otherwise(own)
    rows = rows.withColumn("__tile", F.coalesce(tile, F.lit(0))).withColumn("__others", F.coalesce(others, F.lit(1)))
    rows = rows.filter("__others > 0").withColumn("__o", F.explode(F.sequence(F.lit(0), F.col("__others") - 1)))
    rows = rows.withColumns({"s": F.least("__tile", "__o"), "t": F.greatest("__tile", "__o")})
    side = (F.col("__tile") != F.col("s")).cast("int")
    return rows.select("leader", "c", "s", "t", side.alias("side"), "node", "root", "n", "home")


ROW = T.StructType(
    [T.StructField(c, T.LongType()) for c in ("leader", "c", "s", "t", "side", "node", "root", "n")]
    + [T.StructField("home", T.BooleanType())]
)


def walked(rows: DataFrame, bits: DataFrame, pairs: bool) -> DataFrame:
    """Candidate pairs among the rows of each block or pair of tiles, or else the rows that have one.

    ``bits`` has a bitmap of each node; ``rows`` is a table of :data:`ROW`.
    """
    out = to_arrow_schema(PAIR if pairs else ROW)
    place = ["leader", "c", "s", "t"]
    joined = rows.join(bits.toDF("node", "bits"), "node").select(*[f.name for f in ROW], "bits")
    ordered = joined.repartition(*place).sortWithinPartitions(*place)

    def group(here: tuple, parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(parts)
        node, root, n, side = (table.column(c).to_numpy() for c in ("node", "root", "n", "side"))
        home = table.column("home").to_numpy().astype(bool)
        _, _, s, t = here
        found = candidates(node, root, n, home, table.column("bits").to_pylist(), side if s < t else None)
        if pairs:
            for u, v in found:
                yield _batch(out, np.maximum(u, v), np.minimum(u, v))
            return
        # A node is in one row of a group.
        order = np.argsort(node)
        met = np.zeros(len(node), dtype=bool)
        for u, v in found:
            met[order[np.searchsorted(node, np.concatenate([u, v]), sorter=order)]] = True
        if met.any():
            yield from table.select(out.names).filter(pa.array(met)).cast(out).combine_chunks().to_batches()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.column_stack([batch.column(i).to_numpy() for i in range(len(place))])
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
            for low, high in zip(cuts, cuts[1:]):
                here = tuple(keys[low].tolist())
                if here != last and held:
                    yield from group(last, held)
                    held = []
                held.append(batch.slice(low, high - low))
                last = here
        if held:
            yield from group(last, held)

    return ordered.mapInArrow(run, PAIR if pairs else ROW)


def cross_pairs(blocks: DataFrame, nodes: DataFrame, grouped: DataFrame) -> DataFrame:
    """Candidate links between nodes of different groups; ``grouped`` has ``node`` and ``root``.

    Leaders are left out of their own blocks: :func:`star_pairs` has all their pairs.
    A first walk over brief bitmaps leaves the rows that may be linked at all; long
    bitmaps are shuffled for these only.
    """
    rows = blocks.filter("node != leader").join(grouped, "node", "left").withColumn("root", F.coalesce("root", "node"))
    mixed = rows.groupBy("leader").agg(F.min("root").alias("a"), F.max("root").alias("b"), F.count(F.lit(1)).alias("k"))
    rows = rows.join(mixed.filter("a != b").select("leader", "k"), "leader")
    members = materialise(rows.join(nodes.select("node", "n"), "node").select("leader", "node", "root", "n", "k"), "members")
    rows = in_tiles(members).select(*[F.col(f.name).cast(f.dataType) for f in ROW])
    left = materialise(walked(rows, nodes.select("node", "brief"), False), "left-rows")
    return walked(left, nodes.select("node", "bits"), True).distinct()


def star_pairs(blocks: DataFrame, nodes: DataFrame) -> DataFrame:
    """Each node with the leaders of its blocks, where bitmaps and sizes allow a link."""
    pairs = blocks.filter("node != leader").select(F.col("node").alias("u"), F.col("leader").alias("v"))
    one = nodes.select(F.col("node").alias("u"), F.col("n").alias("nu"), F.col("bits").alias("bu"))
    two = nodes.select(F.col("node").alias("v"), F.col("n").alias("nv"), F.col("bits").alias("bv"))
    sizes = nodes.select(F.col("node").alias("u"), F.col("n").alias("a"))
    others = nodes.select(F.col("node").alias("v"), F.col("n").alias("b"))
    fitting = pairs.join(sizes, "u").join(others, "v")
    fitting = fitting.filter((100 * F.col("a") >= PERCENT * F.col("b")) & (100 * F.col("b") >= PERCENT * F.col("a")))
    both = fitting.select("u", "v").join(one, "u").join(two, "v").select("u", "v", "nu", "nv", "bu", "bv")
    schema = to_arrow_schema(PAIR)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u, v, nu, nv = (batch.column(i).to_pylist() for i in range(4))
            keep_u, keep_v = [], []
            for a, b, na, nb, x, y in zip(u, v, nu, nv, batch.column(4).to_pylist(), batch.column(5).to_pylist()):
                x, y = np.frombuffer(x, dtype=_U)[None, :], np.frombuffer(y, dtype=_U)[None, :]
                width = min(x.shape[1], y.shape[1])
                if int(np.bitwise_count(folded(x, width) ^ folded(y, width)).sum()) <= most_apart(na, nb):
                    keep_u.append(max(a, b))
                    keep_v.append(min(a, b))
            yield _batch(schema, keep_u, keep_v)

    return both.mapInArrow(run, PAIR)


def counted(docs: DataFrame, sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs whose whole sets are alike enough, as a written table.

    The texts are read again and only those of paired nodes are parsed: a filter
    of fixed size, made of hashes of their texts, goes to every task.
    """
    ends = pairs.select(F.col("u").alias("node")).union(pairs.select("v")).distinct()
    wanted = sets.filter("first").join(ends, "node", "left_semi").select("th")
    place = F.pmod("th", F.lit(FILTER_BITS)) + 1  # bucket numbers count from 1
    # At most FILTER_BITS / 32768 rows of 4 KB.
    rows = (
        wanted.groupBy((F.bitmap_bucket_number(place)).alias("b"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits"))
        .collect()
    )
    span = 32_768
    marks = np.zeros(FILTER_BITS // 8 + span // 8, dtype=np.uint8)
    for r in rows:
        marks[(r["b"] - 1) * span // 8 : r["b"] * span // 8] = np.frombuffer(r["bits"], dtype=np.uint8)
    shared = docs.sparkSession.sparkContext.broadcast(marks)
    out = T.StructType([T.StructField("node", T.LongType()), T.StructField("s", T.ArrayType(T.LongType()))])
    schema = to_arrow_schema(out)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, met, bits = _Words(), set(), shared.value
        for batch in batches:
            for piece in slices(batch):
                at = piece.column(1).to_numpy()
                hit = (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1
                nodes, found = [], []
                for i in np.flatnonzero(hit).tolist():
                    s = shingles(piece.column(0)[i].as_py(), words)
                    if not len(s):
                        continue
                    node = node_of(s)
                    if node not in met:
                        met.add(node)
                        nodes.append(node)
                        found.append(s.view(np.int64))
                if nodes:
                    yield _batch(schema, nodes, found)

    texts = docs.select("text", F.pmod(F.xxhash64("text"), F.lit(FILTER_BITS)).alias("__bit"))
    full = texts.mapInArrow(run, out)
    full, discard = short_lived(full.join(ends, "node", "left_semi"), "paired-sets")
    full = full.dropDuplicates(["node"])
    one = full.select(F.col("node").alias("u"), F.col("s").alias("su"))
    two = full.select(F.col("node").alias("v"), F.col("s").alias("sv"))
    both = pairs.join(one, "u").join(two, "v")
    common = F.size(F.array_intersect("su", "sv"))
    either = F.size("su") + F.size("sv") - common
    links = materialise(both.filter(100 * common >= PERCENT * either).select("u", "v"), "counted")
    discard()
    return links


def linked(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``n_shingles`` and ``component_id`` of every row of ``docs``."""
    with without_leftovers(docs.sparkSession):
        return _linked(docs)


def _linked(docs: DataFrame) -> DataFrame:
    texts = docs.select("doc_id", "text")
    whole, discard_whole = short_lived(sets_of(texts, frequent_shingles(texts)), "whole-sets")
    live, discard_live = short_lived(live_rows(whole), "live")
    firsts = whole.filter(F.col("prefix").isNotNull())
    nodes = materialise(
        firsts.join(live.select("node").distinct(), "node", "left_semi").select("node", "n", "bits", "brief").dropDuplicates(["node"]),
        "nodes",
    )
    blocks = materialise(blocks_of(live), "blocks")
    discard_live()
    sets = materialise(whole.select("doc_id", "th", "node", "n", F.col("prefix").isNotNull().alias("first")), "sets")
    discard_whole()
    stars = materialise(star_pairs(blocks, nodes).distinct(), "stars")
    first = counted(texts, sets, stars)
    grouped = components(first)
    others = cross_pairs(blocks, nodes, grouped).join(stars, ["u", "v"], "left_anti")
    second = counted(texts, sets, materialise(others, "crosses"))
    grouped = components(first.union(second))
    known = sets.filter(F.col("node").isNotNull()).groupBy("node").agg(F.min("doc_id").alias("least"))
    known = known.join(grouped, "node", "left").withColumn("root", F.coalesce("root", "node"))
    known = materialise(known, "known")
    roots = known.groupBy("root").agg(F.min("least").alias("component_id"))
    final = known.join(roots, "root").select("node", "component_id")
    rows = sets.select("doc_id", "node", F.col("n").alias("n_shingles"))
    return rows.join(final, "node", "left").select(
        "doc_id", "n_shingles", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id")
    )


def deduplicated(docs: DataFrame) -> DataFrame:
    """``docs`` with the document of the smallest id of each group only.

    Most rows have an id of their own that stays.  A filter of fixed size, made of
    hashes of all other ids, lets them pass where they are read; the rows it holds
    back, some of them by chance, are joined and compared.
    """
    # Inner names keep columns that are named like the operator's own apart.
    inner = docs.toDF(*[f"__c{i}" for i in range(len(docs.columns))])
    key, text = (f"__c{docs.columns.index(c)}" for c in ("doc_id", "text"))
    groups = linked(inner.select(F.col(key).alias("doc_id"), F.col(text).alias("text")))
    ids = groups.groupBy(F.col("doc_id").alias("__id")).agg(
        F.max(F.col("doc_id").eqNullSafe(F.col("component_id"))).alias("__stays"), F.count(F.lit(1)).alias("__k")
    )
    with without_leftovers(docs.sparkSession):
        doubtful = materialise(ids.filter("__k > 1 or not __stays").select("__id", "__stays"), "doubtful-ids")

    def place(c: Column) -> Column:
        return F.pmod(F.xxhash64(c.cast("bigint")), F.lit(FILTER_BITS))

    # At most FILTER_BITS / 64 rows of two numbers, so it can be broadcast.
    places = doubtful.select(place(F.col("__id")).alias("__at"))
    words = places.select(F.shiftright("__at", 6).alias("__word"), (F.col("__at") % 64).cast("int").alias("__bit"))
    words = words.groupBy("__word").agg(F.bit_or(F.expr("shiftleft(1L, __bit)")).alias("__bits"))
    rows = inner.withColumn("__at", place(F.col(key))).withColumn("__word", F.shiftright("__at", 6))
    rows = rows.join(F.broadcast(words), "__word", "left")
    whole_id = F.col(key).eqNullSafe(F.col(key).cast("bigint"))
    passes = whole_id & (F.coalesce(F.getbit("__bits", (F.col("__at") % 64).cast("int")), F.lit(0)) == 0)
    held = rows.filter(~passes).select(*inner.columns)
    held = held.join(doubtful, held[key].eqNullSafe(doubtful["__id"]), "left")
    held = held.filter(F.coalesce("__stays", whole_id)).withColumn("__h", F.xxhash64(text))
    # A row that repeats both id and text is the same document.
    again = Window.partitionBy(key, "__h").orderBy("__h")
    held = held.withColumn("__rn", F.row_number().over(again)).filter("__rn = 1")
    kept = rows.filter(passes).select(*inner.columns).union(held.select(*inner.columns))
    return kept.toDF(*docs.columns)
