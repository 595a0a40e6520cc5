"""Benchmark decontamination by size-partitioned MinHash containment search.

Items are short, documents long, so a document's whole signature says nothing about an
item inside it. Items are partitioned by the size of their shingle sets (powers of
two); for each class, documents are cut into overlapping windows of twice the class's
size, so an item of the class lies within a window. A signature is one permutation
hashing: the shingle's hash picks one of ``bins`` bins, each bin keeps its least hash.
An item and a window that share a bin's value are candidates (items of few shingles
compare all theirs); the document's full shingle set then decides exactly.

Documents are read and hashed once, whatever the number of items. A filter of fixed size
leaves of a document's shingles those that some item may hold; these are joined to the
items' signatures by value, and of the candidates' shingles the common ones are counted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from perispark.llm.common import Scratch, lower_words

#: Words hashed at a time.
TOGETHER = 50_000
#: Items of up to so many shingles are looked up by all of them.
SMALL = 8
#: Bits of the filter of the items' shingles, whatever their number: 16 MB.
FILTER_BITS = 1 << 27
#: Bits of a filter of ids for each of them, as long as that isn't more than FILTER_BITS.
BITS_PER_ID = 256
#: Parts over which a value's or an item's documents are spread.
SALTS = 16
#: No hash in a bin.
EMPTY = np.iinfo(np.uint64).max


def shingles(tokens: list[bytes], k: int) -> list[bytes]:
    """k-word shingles in order; with fewer words the whole sequence as one, none without words."""
    if not tokens:
        return []
    if len(tokens) < k:
        return [b" ".join(tokens)]
    return [b" ".join(tokens[i : i + k]) for i in range(len(tokens) - k + 1)]


class Hasher:
    """64-bit hashes of shingles, the same in all tasks. A word's hash is a polynomial in numbers drawn
    for its bytes, a shingle's one in its words' hashes, put together from runs of one, two, four
    ... words; both are mixed."""

    def __init__(self, k: int):
        self.k = k
        self.numbers = np.random.default_rng(20_240_602).integers(0, 2**64, 256, dtype=np.uint64)
        self.factor = xxhash.xxh64_intdigest(b"factor") | 1
        self._powers(1 << 12)

    def _powers(self, n: int) -> None:
        """The factor's powers and those of its inverse, for so many bytes."""
        down = pow(self.factor, -1, 1 << 64)
        self.up, self.down = (np.cumprod(np.append(np.ones(1, np.uint64), np.full(n - 1, x, np.uint64))) for x in (self.factor, down))

    def words(self, tokens: list[bytes]) -> np.ndarray:
        if len(tokens) > TOGETHER:
            return np.concatenate([self.words(tokens[lo : lo + TOGETHER]) for lo in range(0, len(tokens), TOGETHER)])
        symbols = np.frombuffer(b" ".join(tokens) + b" ", np.uint8)
        n = len(symbols)
        if n > len(self.up):
            self._powers(2 * n)
        sums = np.cumsum(self.numbers[symbols] * self.up[:n])
        ends = np.flatnonzero(symbols == 32)
        starts = np.append(0, ends[:-1] + 1)
        before = sums[starts - 1]
        before[0] = 0
        x = (sums[ends - 1] - before) * self.down[starts]
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(32))

    def __call__(self, tokens: list[bytes]) -> np.ndarray:
        if not tokens:
            return np.zeros(0, np.uint64)
        run, width = self.words(tokens), 1
        k = min(self.k, len(tokens))
        n = len(tokens) - k + 1
        x, done, rest = np.full(n, len(tokens) if k < self.k else 0, np.uint64), 0, k
        while rest:
            power = np.uint64(pow(self.factor, width, 1 << 64))
            if rest & 1:
                x = x * power + run[done : done + n]
                done += width
            rest >>= 1
            if rest:
                run = run[:-width] * power + run[width:]
                width *= 2
        x ^= x >> np.uint64(29)
        x *= np.uint64(0x9E3779B97F4A7C15)
        return x ^ (x >> np.uint64(32))


def size_class(n: int) -> int:
    """The least power of two, SMALL at least, that isn't below n."""
    return max(SMALL, 1 << (n - 1).bit_length())


def signature(own: np.ndarray, bins: int) -> np.ndarray:
    """The least hash of each bin that isn't empty."""
    least = np.full(bins, EMPTY)
    np.minimum.at(least, (own % np.uint64(bins)).astype(np.int64), own)
    return least[least != EMPTY]


def window_values(h: np.ndarray, size: int, bins: int) -> np.ndarray:
    """The values of the signatures of all windows of twice the size, at every multiple of it."""
    last = max(0, (len(h) - 1) // size - 1)
    block = np.arange(len(h)) // size
    least = np.full((last + 2, bins), EMPTY)
    np.minimum.at(least.ravel(), block * bins + (h % np.uint64(bins)).astype(np.int64), h)  # blocks of the size
    windows = np.unique(np.minimum(least[:-1], least[1:]))  # two blocks make a window
    return windows[windows != EMPTY]


def _item_sets(batches: Iterator[pa.RecordBatch], k: int, bins: int) -> Iterator[pa.RecordBatch]:
    """item_id, level (of its size class), its shingles, and those it is looked up by; items without shingles go."""
    hasher = Hasher(k)
    for batch in batches:
        out = []
        for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            own = np.unique(hasher(lower_words(text)))
            if len(own):
                size = size_class(len(own))
                by = own if size == SMALL else np.unique(signature(own, bins))
                out.append((item, (size // SMALL).bit_length() - 1, own.view(np.int64), by.view(np.int64)))
        kinds = (pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()))
        cols = list(zip(*out, strict=True)) or [[]] * 4
        columns = [pa.array(c, t) for c, t in zip(cols, kinds, strict=True)]
        yield pa.RecordBatch.from_arrays(columns, ["item_id", "level", "own", "by"])


def filter_buckets(values: DataFrame) -> DataFrame:
    """(bucket, bits): the filter of FILTER_BITS bits of which those are set that the values' low bits
    name, in buckets of 4 KB; buckets without a set bit are left out."""
    place = (F.pmod("value", F.lit(FILTER_BITS)) + 1).alias("place")
    return values.select(place).groupBy(F.bitmap_bucket_number("place").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bits"))


def value_filter(values: DataFrame) -> np.ndarray:
    """filter_buckets() as one array: never more than FILTER_BITS / 8 bytes."""
    out = np.zeros(FILTER_BITS // 8, np.uint8)
    for r in filter_buckets(values).collect():  # FILTER_BITS / 32768 rows at most
        out[(r.bucket - 1) * 4096 : r.bucket * 4096] = np.frombuffer(r.bits, np.uint8)
    return out


def _id_place(seed: int, size: int) -> Column:
    return F.pmod(F.xxhash64("_id", F.lit(seed)), F.lit(size))


def _id_filter(ids: DataFrame, seed: int, scratch: Scratch) -> tuple[DataFrame, int]:
    """The filter of the ids, as a table (_slice, _bits) without slices of no bit, and its size: BITS_PER_ID
    for each id, FILTER_BITS at most."""
    size = min(FILTER_BITS, 1 << max(15, (BITS_PER_ID * ids.count()).bit_length()))
    part = F.explode(F.sequence(F.lit(0), F.lit(31))).alias("part")  # a bucket has 32 slices of 128 bytes
    parts = filter_buckets(ids.select(_id_place(seed, size).alias("value"))).select("bucket", "bits", part)
    number = ((F.col("bucket") - 1) * 32 + F.col("part")).alias("_slice")
    slices = parts.select(number, F.substring("bits", F.col("part") * 128 + 1, F.lit(128)).alias("_bits"))
    return scratch.written(slices.filter(F.col("_bits") != F.lit(bytes(128))), "id-filter"), size


def _marked(rows: DataFrame, ids: tuple[DataFrame, int], seed: int) -> DataFrame:
    """rows, and in ``_in<seed>`` whether the filter of ids has a bit for theirs; a null id has none."""
    place = _id_place(seed, ids[1])
    at = F.shiftright(place.bitwiseAND(F.lit(1023)), 3).cast("int") + 1
    byte = F.conv(F.hex(F.substring("_bits", at, F.lit(1))), 16, 10).cast("int")
    found = F.coalesce(F.getbit(byte, place.bitwiseAND(F.lit(7)).cast("int")) == 1, F.lit(False))
    met = rows.join(F.broadcast(ids[0]), F.shiftright(place, 10) == F.col("_slice"), "left")
    return met.withColumn(f"_in{seed}", F.col("_id").isNotNull() & found).drop("_slice", "_bits")


def without(docs: DataFrame, gone: DataFrame, *, id_col: str = "doc_id") -> DataFrame:
    """docs without the rows whose id ``gone`` holds in doc_id; rows with a null id stay.

    Rows stay where they lie, whatever the number of ids: a first filter has the ids that go, a
    second one those ids of docs that stay though the first has them. Both are of bounded size. A
    row that the first lacks stays, one that only the first has goes; the few rows that both
    have are joined with the ids.
    """
    scratch = Scratch(docs.sparkSession)
    gone = scratch.written(gone.select(F.col("doc_id").cast("long").alias("_id")).filter("_id IS NOT NULL").distinct(), "gone")
    rows = docs.select(F.struct("*").alias("_row"), F.col(id_col).cast("long").alias("_id"))
    first = _id_filter(gone, 1, scratch)
    spared = _marked(rows.select("_id"), first, 1).filter("_in1").select("_id").join(gone, "_id", "left_anti").distinct()
    second = _id_filter(scratch.written(spared, "spared"), 2, scratch)
    sure = _marked(rows, first, 1).filter("NOT _in1")
    both = _marked(_marked(rows, first, 1).filter("_in1"), second, 2).filter("_in2").join(gone, "_id", "left_anti")
    return sure.select("_row.*").union(both.select("_row.*"))


def _held(batches: Iterator[pa.RecordBatch], bits: np.ndarray, levels: list[int], k: int, bins: int) -> Iterator[pa.RecordBatch]:
    """For each document's distinct shingles that pass the filter: row, doc_id, value, and at: the levels
    (as bits) in one of whose windows it is a signature's value."""
    hasher = Hasher(k)
    for batch in batches:
        rows, ids, values, marks = [], [], [], []
        for row, doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            h = hasher(lower_words(text))
            place = (h & np.uint64(FILTER_BITS - 1)).astype(np.int64)
            mine = np.unique(h[(bits[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1])
            if not len(mine):
                continue
            at = np.zeros(len(mine), np.int64)
            for level in levels:
                found = True if level == 0 else np.isin(mine, window_values(h, SMALL << level, bins), assume_unique=True)
                at |= np.where(found, np.int64(1) << level, 0)
            rows.append(pa.array(np.full(len(mine), row)))
            ids.append(pa.array([doc_id] * len(mine), pa.int64()))
            values.append(mine.view(np.int64))
            marks.append(at)
        if rows:
            columns = [pa.concat_arrays(rows), pa.concat_arrays(ids), pa.array(np.concatenate(values)), pa.array(np.concatenate(marks))]
            yield pa.RecordBatch.from_arrays(columns, ["row", "doc_id", "value", "at"])


def find_items(
    docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
        item_text_col: str = "text",
    k: int = 5, containment: float = 0.8, bins: int = 64,
) -> DataFrame:
    """Rows (doc_id, item_id, n_shared, n_shingles, containment): items whose distinct k-word
    shingles lie in the document's to the share ``containment`` at least.

    Words are lower-cased (A-Z) and split at ASCII white space. Items and texts with fewer
    words than k are one shingle; null and empty ones have none and match nothing. Items
    with a null id are left out; documents with a null id are searched and reported with
    it. Repeated documents give repeated rows, repeated item ids count once for each text.
    An empty table gives no rows; other columns aren't read.

    Scale: one scan of the documents, which are never shuffled; only shingles that pass a
    filter of FILTER_BITS are. A value or an item that very many documents hold is spread
    over SALTS parts. Nothing that grows with the items or documents reaches the driver.
    """
    scratch = Scratch(docs.sparkSession)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"),
        F.col(text_col).cast("string").alias("text")).filter("text IS NOT NULL AND text != ''")
    wanted = items.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).cast("string").alias("text"))
    wanted = wanted.filter("item_id IS NOT NULL AND text IS NOT NULL").distinct()
    sets = wanted.mapInArrow(lambda it: _item_sets(it, k, bins), "item_id bigint, level int, own array<bigint>, by array<bigint>")
    sets = scratch.written(sets.withColumn("entry", F.monotonically_increasing_id()), "items")
    levels = sorted(r.level for r in sets.select("level").distinct().collect())  # one for each power of two
    sent = docs.sparkSession.sparkContext.broadcast(value_filter(sets.select(F.explode("own").alias("value"))))
    held = rows.mapInArrow(lambda it: _held(it, sent.value, levels, k, bins), "row bigint, doc_id bigint, value bigint, at bigint")
    held = scratch.written(held, "held")

    salt, salts = F.pmod(F.xxhash64("row"), F.lit(SALTS)).alias("salt"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    named = sets.select("entry", "level", F.explode("by").alias("value")).select("*", salts)
    meets = F.expr("shiftright(at, level) & 1 = 1")
    near = held.select("row", "value", "at", salt).join(named, ["value", "salt"]).filter(meets).select("row", "entry").distinct()
    asked = near.select("*", salt).join(sets.select("entry", "item_id", F.size("own").cast("long").alias("n_shingles"), "own", salts), ["entry", "salt"])
    asked = asked.select("row", "entry", "item_id", "n_shingles", F.explode("own").alias("value"))
    found = asked.join(held.select("row", "doc_id", "value"), ["row", "value"]).groupBy("row", "entry", "item_id", "n_shingles").agg(
        F.max("doc_id").alias("doc_id"), F.count("*").alias("n_shared"))
    found = found.filter(F.col("n_shared") >= containment * F.col("n_shingles") - 1e-9)
    share = (F.col("n_shared") / F.col("n_shingles").cast("double")).alias("containment")
    return scratch.result(found.select("doc_id", "item_id", "n_shared", "n_shingles", share), "found-items")


def remove_contaminated(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", **how) -> DataFrame:  # noqa: ANN003
    """docs without the documents that hold an item; documents with a null id stay."""
    return without(docs, find_items(docs, items, id_col=id_col, **how), id_col=id_col)
