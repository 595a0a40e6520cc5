"""Near-duplicate groups by an LSH forest over MinHash signatures.

Texts with the same shingle set are one class from the start. Each class has a signature;
each of several orders of its columns is a tree, held as a sorted sequence: Spark sorts the
classes by a number for their first ``depth`` columns and then by the following ones, so
classes with a common prefix stand together. Those that share ``depth`` columns are a
region. The orders' prefixes of that depth have no column in common.

First, in each sorted order, a class meets its neighbours of longest common prefix: the one
before it, and the first that shares as long a prefix. So the depth of a comparison follows
the region: where many are alike it is deep, elsewhere shallow. Sorting is split into
ranges, so a region may be cut; its first class by a hash stands for the whole of it. The
signatures then pick one partner for each class. That joins nearly all copies of a text at
a cost linear in the classes. Then in each region, however large, where different
components meet, the classes outside the region's largest component are compared with all
classes of other components, block by block: a tile of two blocks drops the pairs whose
signatures are too unlike, and gives a spanning forest of the components that the others'
links join. Links are confirmed on full shingle sets.

Recall: a pair shares a region in one of 16 orders of depth 4 with probability 1 - 7e-6 at
the threshold 0.85 and 1 - 2.2e-4 at 0.8 (more alike, more likely), in regions of every
size; its signatures then agree enough with probability 1 - 9e-6 and 1 - 5e-6.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from perispark.llm.common import Scratch, lower_words
from perispark.llm.components import components
from perispark.llm.containment import FILTER_BITS, Hasher, value_filter, without

_RANDOM = np.random.default_rng(20_240_601)
FACTORS = (_RANDOM.integers(1, 2**63, 64, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
SHIFTS = _RANDOM.integers(0, 2**63, 64, dtype=np.uint64)
SKETCH = "doc_id bigint, n_shingles bigint, class bigint, signature binary"
PLACES = "class bigint, key bigint, upper bigint, lower bigint, n bigint"


def signature(own: np.ndarray) -> np.ndarray:
    """64 MinHash values (32 bits) of a set of hashes."""
    least = np.full(64, np.iinfo(np.uint64).max)
    for lo in range(0, len(own), 2048):
        least = np.minimum(least, (own[None, lo : lo + 2048] * FACTORS[:, None] + SHIFTS[:, None]).min(axis=1))
    return (least >> np.uint64(32)).astype(np.uint32)


def class_of(own: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(own.tobytes(), digest_size=8).digest(), "little", signed=True)


def _sketches(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    hasher = Hasher(k)
    for batch in batches:
        out = []
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            own = np.unique(hasher(lower_words(text)))
            some = len(own) and doc_id is not None
            out.append((doc_id, len(own), class_of(own) if some else None, signature(own).tobytes() if some else None))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
        cols = list(zip(*out, strict=True)) or [[]] * 4
        columns = [pa.array(c, t) for c, t in zip(cols, kinds, strict=True)]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_shingles", "class", "signature"])


def _mixed(columns: np.ndarray, seed: int) -> np.ndarray:
    x = np.full(len(columns), seed, np.uint64)
    for j in range(columns.shape[1]):
        x = (x ^ columns[:, j]) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(31)
    return x.view(np.int64)


#: Columns by which a sorted order goes on below its regions, of 16 bits each in two longs.
DEEPER = 8


def _places(batches: Iterator[pa.RecordBatch], orders: int, depth: int) -> Iterator[pa.RecordBatch]:
    """A row for each class and order: the region's number, then the columns below."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(n, 64).astype(np.uint64)
        for t in range(orders):
            at = (64 * t // orders + np.arange(depth + DEEPER)) % 64
            low = sig[:, at[depth:]] & np.uint64(0xFFFF)
            halves = [low[:, h : h + 4] << np.uint64(16) * np.arange(4, dtype=np.uint64)[::-1] for h in (0, 4)]
            below = [pa.array(np.bitwise_or.reduce(h, axis=1).view(np.int64)) for h in halves]
            columns = [batch.column(0), pa.array(_mixed(sig[:, at[:depth]], t)), *below, batch.column(2)]
            yield pa.RecordBatch.from_arrays(columns, ["class", "key", "upper", "lower", "n"])


def common_prefix(key: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> np.ndarray:
    """For each row but the first, how many columns below the region it shares with the one before; -1 in another region."""
    columns = [(x >> np.int64(s)) & 0xFFFF for x in (upper, lower) for s in (48, 32, 16, 0)]
    same = np.cumprod([(x[1:] == x[:-1]) for x in columns], axis=0).sum(axis=0)
    return np.where(key[1:] == key[:-1], same, -1)


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of sorted places, (a, b, first): each class with the one before it and with the first
    one of the longest prefix it shares with that, which is marked."""
    last: tuple | None = None
    for batch in batches:
        names, *where = (batch.column(c).to_numpy() for c in ("class", "key", "upper", "lower"))
        if not len(names):
            continue
        if last is None:
            leaders = np.full(DEEPER + 1, names[0])
            before = [names[:1], *(x[:1] for x in where)]
            skip = 1
        else:
            before, leaders, skip = last[0], last[1], 0
        names = np.concatenate((before[0], names[skip:]))
        where = [np.concatenate((x, y[skip:])) for x, y in zip(before[1:], where, strict=True)]
        shared = common_prefix(*where)
        index = np.arange(1, len(names))
        firsts = []
        for d in range(DEEPER + 1):  # the first class of the run that shares d columns below the region
            start = np.maximum.accumulate(np.where(shared < d, index, 0))
            firsts.append(np.where(start > 0, names[start], leaders[d]))
        firsts = np.array(firsts)
        met = np.flatnonzero(shared >= 0)
        first = firsts[shared[met], met]
        a = np.concatenate((names[1:][met], names[1:][met]))
        b = np.concatenate((names[:-1][met], first))
        marked = np.repeat([False, True], len(met))
        keep = a != b
        yield pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(b[keep]), pa.array(marked[keep])], ["a", "b", "first"])
        if len(names) > 1:
            leaders = firsts[:, -1]
        last = [names[-1:], *(x[-1:] for x in where)], leaders


def _sets(batches: Iterator[pa.RecordBatch], bits: np.ndarray, k: int) -> Iterator[pa.RecordBatch]:
    """Classes and sets of the texts whose place is set in the filter."""
    hasher = Hasher(k)
    for batch in batches:
        place = batch.column(1).to_numpy()
        wanted = (bits[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1
        sets = [np.unique(hasher(lower_words(t))) for t in batch.column(0).filter(pa.array(wanted)).to_pylist()]
        columns = [pa.array([class_of(x) for x in sets], pa.int64()), pa.array([x.tobytes() for x in sets], pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["class", "own"])


def _confirmed(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        for x, y in zip(batch.column("own_a"), batch.column("own_b"), strict=True):
            x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
            shared = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(100 * shared >= percent * (len(x) + len(y) - shared))
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _signatures(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(len(column), 64)


def _agreeing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        agree = (_signatures(batch.column("sig_a")) == _signatures(batch.column("sig_b"))).sum(axis=1)
        columns = [batch.column("a"), batch.column("b"), batch.column("first"), pa.array(agree.astype(np.int32))]
        yield pa.RecordBatch.from_arrays(columns, ["a", "b", "first", "agree"])


def spanning(pairs: np.ndarray) -> list[list[int]]:
    """Those of the pairs that join what earlier ones don't."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            parent[x] = x = parent.get(up, up)
        return x

    out = []
    for a, b in pairs.tolist():
        x, y = root(a), root(b)
        if x != y:
            parent[max(x, y)] = min(x, y)
            out.append([a, b])
    return out


def _tiles(batches: Iterator[pa.RecordBatch], percent: int, alike: int) -> Iterator[pa.RecordBatch]:
    """Components that links between the outside classes of the left block and the right
    block's classes of other components join: no more pairs than components in the tile.
    Sets are looked at only of classes that some pair of ``alike`` agreeing columns needs."""
    for batch in batches:
        for left, right in zip(batch.column("left"), batch.column("right"), strict=True):
            x, y = left.values, right.values
            take = lambda part, name: part.field(name).to_numpy(zero_copy_only=False)
            outer = np.flatnonzero(take(x, "outside"))
            sig_a, sig_b = _signatures(x.field("signature"))[outer], _signatures(y.field("signature"))
            fits = np.zeros((len(outer), len(y)), np.int16)
            for j in range(64):
                fits += sig_a[:, j][:, None] == sig_b[:, j][None, :]
            fits = fits >= alike
            n_a, n_b = take(x, "n")[outer], take(y, "n")
            fits &= 100 * np.minimum(n_a[:, None], n_b[None, :]) >= percent * np.maximum(n_a[:, None], n_b[None, :])
            ids_a, ids_b = take(x, "class")[outer], take(y, "class")
            of_a, of_b = take(x, "component")[outer], take(y, "component")
            fits &= of_a[:, None] != of_b[None, :]
            fits &= ~take(y, "outside").astype(bool)[None, :] | (ids_a[:, None] < ids_b[None, :])
            some_a, some_b = np.flatnonzero(fits.any(axis=1)), np.flatnonzero(fits.any(axis=0))
            if not len(some_a):
                continue
            fits, of_a, of_b = fits[np.ix_(some_a, some_b)], of_a[some_a], of_b[some_b]
            own_a, own_b = x.field("own").take(pa.array(outer[some_a])), y.field("own").take(pa.array(some_b))
            sets_a, sets_b = ([np.frombuffer(o, np.uint64) for o in own.to_pylist()] for own in (own_a, own_b))
            size_a, size_b = (np.array([len(v) for v in sets]) for sets in (sets_a, sets_b))
            a, b = np.nonzero(fits)
            # shared shingles by a product of membership tables, a slice of the shingles at a time
            every, at = np.unique(np.concatenate(sets_a), return_inverse=True)
            rows = np.repeat(np.arange(len(sets_a)), size_a)
            where = np.concatenate(sets_b)
            found = np.minimum(np.searchsorted(every, where), len(every) - 1)
            hit = every[found] == where
            cols, other = found[hit], np.repeat(np.arange(len(sets_b)), size_b)[hit]
            shared = np.zeros((len(sets_a), len(sets_b)), np.int64)
            for lo in range(0, len(every), 4096):
                p, q = (at >= lo) & (at < lo + 4096), (cols >= lo) & (cols < lo + 4096)
                left_table, right_table = np.zeros((len(sets_a), 4096), np.float32), np.zeros((len(sets_b), 4096), np.float32)
                left_table[rows[p], at[p] - lo] = 1
                right_table[other[q], cols[q] - lo] = 1
                shared += (left_table @ right_table.T).astype(np.int64)
            k = shared[a, b]
            linked = 100 * k >= percent * (size_a[a] + size_b[b] - k)
            meet = np.unique(np.stack([of_a[a[linked]], of_b[b[linked]]], axis=1), axis=0)
            joins = np.array(spanning(meet), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(joins[:, 0]), pa.array(joins[:, 1])], ["a", "b"])


def near_duplicates(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = 3, percent: int = 85,
    orders: int = 16, depth: int = 4, block: int = 256, block_bytes: int = 4_000_000, grid: int = 16,
) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: a row per row.

    Texts are linked if their sets of k-word shingles (lower-case A-Z, ASCII white space)
    have percent / 100 or more of their union in common. component_id is the smallest
    doc_id reachable, kept says that it is the row's own.

    With fewer words than k the whole sequence is the one shingle; null and empty texts
    have none and are their own component. Rows with a null id link with nothing: their
    component is null and they are kept. Repeated rows share a component, and each row of
    the smallest id is kept. An empty table gives no rows; other columns aren't read.

    A block of a region holds about ``block`` classes and ``block_bytes`` of their sets, a
    class of more alone. Pairs of blocks are dealt to cells of ``grid`` by ``grid`` blocks,
    so that no join key carries more of a region than a cell.
    """
    scratch = Scratch(docs.sparkSession)
    spread = math.sqrt(64 * percent / 100 * (1 - percent / 100))
    alike = max(1, int(64 * percent / 100 - 4.6 * spread))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sketch = scratch.written(rows.mapInArrow(lambda it: _sketches(it, k), SKETCH), "near-sketch")
    least = (F.min(x).alias(y) for x, y in (("doc_id", "doc_id"), ("n_shingles", "n"), ("signature", "signature")))
    classes = scratch.written(sketch.filter("class IS NOT NULL").groupBy("class").agg(*least), "near-classes")
    signs = classes.select("class", "signature", "n")
    places = signs.mapInArrow(lambda it: _places(it, orders, depth), PLACES)
    shared = places.groupBy("key").agg(F.count("*").alias("members")).filter("members > 1").select("key")
    met = scratch.written(places.join(shared, "key").select("class", "key", "upper", "lower", "n"), "near-places")

    # neighbours of longest common prefix in the sorted orders, and a region's first class by a hash
    # with the region, so that orders have different ones
    order = ("key", "upper", "lower")
    placed = met.repartitionByRange(*order).sortWithinPartitions(*order, "class")
    pairs = placed.mapInArrow(_neighbours, "a bigint, b bigint, first boolean")
    leader = met.groupBy("key").agg(F.min_by("class", F.xxhash64("class", "key")).alias("b"))
    led = met.select("key", F.col("class").alias("a")).join(leader, "key").filter("a != b").select("a", "b", F.lit(True).alias("first"))
    pairs = pairs.union(led).groupBy("a", "b").agg(F.max("first").alias("first"))
    scored = _with_agreement(pairs, signs, percent).filter(F.col("agree") >= alike)
    # the first ones of prefixes before the class next to it, so that groups hang on one class instead of falling into pairs
    first = scratch.written(scored.groupBy("a").agg(F.max_by("b", F.struct("first", "agree", "b")).alias("b")), "near-first")

    # texts are read once more where they lie: a filter of fixed size leaves those of the ids needed, and a few others
    needed = met.select("class").distinct().join(classes.select("class", "doc_id"), "class")
    sent = docs.sparkSession.sparkContext.broadcast(value_filter(needed.select(F.xxhash64("doc_id").alias("value"))))
    texts = rows.filter("doc_id IS NOT NULL").select("text", F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_BITS)).alias("place"))
    sets = texts.mapInArrow(lambda it: _sets(it, sent.value, k), "class bigint, own binary")
    sets = scratch.written(sets.groupBy("class").agg(F.min("own").alias("own")), "near-sets")
    links = scratch.written(_verified(first, sets, percent), "near-links")
    joined = components(links, scratch).withColumnRenamed("node", "class")

    # where components meet: those outside a region's largest component with all others
    named = met.join(joined, "class", "left").withColumn("component", F.coalesce("component", "class"))
    named = scratch.written(named.select("class", "component", "key", "n"), "near-named")
    counted = named.groupBy("key", "component").agg(F.count("*").alias("classes"), F.sum("n").alias("shingles"))
    biggest = F.max_by("component", F.struct("classes", "component")).alias("largest")
    n_blocks = F.ceil(F.greatest(F.sum("classes") / block, 8 * F.sum("shingles") / block_bytes)).alias("n_blocks")
    largest = counted.groupBy("key").agg(biggest, n_blocks, F.count("*").alias("parts"))
    largest = largest.filter("parts > 1").select("key", "largest", "n_blocks")
    block_of = F.pmod(F.xxhash64("class"), "n_blocks").alias("block")
    outside = (F.col("component") != F.col("largest")).alias("outside")
    one = F.struct("class", "component", outside, "n", "signature", "own").alias("one")
    mixed = named.join(largest, "key").join(sets.join(signs.select("class", "signature"), "class"), "class").select("key", block_of, (F.col("n_blocks") == 1).alias("alone"), one)
    parts = mixed.groupBy("key", "block", "alone").agg(F.collect_list("one").alias("part"), F.max("one.outside").alias("some"))
    blocks = scratch.written(parts, "near-blocks")
    # a region of one block, as most are, meets itself where it lies
    pairs = blocks.filter("alone").select(F.col("part").alias("left"), F.col("part").alias("right")).union(_cells(blocks.filter("NOT alone"), grid))
    meetings = scratch.written(pairs.mapInArrow(lambda it: _tiles(it, percent, alike), "a bigint, b bigint"), "near-meetings")

    whole = components(meetings, scratch).select(F.col("node").alias("component"), F.col("component").alias("whole"))
    ids = classes.select("class", "doc_id").join(joined, "class", "left").withColumn("component", F.coalesce("component", "class"))
    ids = ids.join(whole, "component", "left").select("class", "doc_id", F.coalesce("whole", "component").alias("component"))
    least = ids.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    by_class = ids.join(least, "component").select("class", "component_id")
    out = sketch.select("doc_id", "n_shingles", "class").join(by_class, "class", "left")
    component = F.coalesce("component_id", "doc_id")
    kept = F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept")
    return scratch.result(out.select("doc_id", "n_shingles", component.alias("component_id"), kept), "near-result")


def _cells(blocks: DataFrame, grid: int) -> DataFrame:
    """(left, right): each block with outside classes with all blocks of its region. The pairs of a region
    form cells of grid by grid blocks; a block goes to all cells of its row, or of its column."""
    sizes = blocks.groupBy("key").agg(F.count_if("some").alias("n_left"), F.count("*").alias("n_right"))
    placed = blocks.join(sizes.select("key", *(F.ceil(F.col(x) / grid).alias(y) for x, y in (("n_left", "rows"), ("n_right", "cols")))), "key")
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    left = placed.filter("some").select("key", F.pmod("block", "rows").alias("row"), every("cols").alias("col"), F.col("part").alias("left"))
    right = placed.filter("rows > 0").select("key", every("rows").alias("row"), F.pmod("block", "cols").alias("col"), F.col("part").alias("right"))
    return left.join(right, ["key", "row", "col"]).select("left", "right")


def _with_agreement(pairs: DataFrame, signs: DataFrame, percent: int) -> DataFrame:
    """(a, b, first, agree) of the pairs whose sizes allow a link; agree: equal signature values."""
    side = lambda x: signs.select(F.col("class").alias(x), F.col("signature").alias(f"sig_{x}"), F.col("n").alias(f"n_{x}"))
    fits: Column = 100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")
    both = pairs.join(side("a"), "a").join(side("b"), "b").filter(fits)
    return both.select("a", "b", "first", "sig_a", "sig_b").mapInArrow(_agreeing, "a bigint, b bigint, first boolean, agree int")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    side = lambda x: sets.select(F.col("class").alias(x), F.col("own").alias(f"own_{x}"))
    return (
        pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b").mapInArrow(lambda it: _confirmed(it, percent),
        "a bigint, b bigint"))


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", **how) -> DataFrame:  # noqa: ANN003
    """docs without the documents that near_duplicates() doesn't keep. Of repeated rows of
    a kept id each stays; rows with a null id stay."""
    return without(docs, near_duplicates(docs, id_col=id_col, **how).filter(~F.col("kept")), id_col=id_col)
