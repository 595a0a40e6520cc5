"""Substring dedup by compressed FM-indexes over shards of repeated passages.

A window is ``window`` consecutive words. Each window's anchor is its least hashed
``gram``-word sequence, so equal windows have equal anchors, and a run of windows with
one anchor is a segment. Only segments whose anchor stands at two places of different
texts or positions can repeat; they are sent to the shard of their anchor, equal ones as
one with their first place. Texts of equal words are one from the start. An anchor of
very many different segments goes to no shard: its windows are counted one by one.

A shard (bounded words) has an FM-index: suffixes sorted as deep as a window, the
Burrows-Wheeler transform in a wavelet matrix of packed bits with block counts. All
segments of the shard are streamed through it by backward search, from their last words to
their first, with the match cut to less than a window before it is extended; a window
that has several places has its first one looked up in the suffix interval.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perispark.llm.common import Scratch, list_array, words
from perispark.llm.containment import Hasher

TEXT = "text_key bigint, doc_id bigint, n_words bigint, packed binary"


class FMIndex:
    """Backward search over a sequence of symbols (0 separates pieces), exact up to ``depth`` symbols."""

    def __init__(self, symbols: np.ndarray, depth: int):
        n = len(symbols)
        rank, k, part = symbols.astype(np.int64), 1, (symbols, 1)
        while True:
            shifted = np.zeros(n, np.int64)
            shifted[: n - k] = rank[k:] + 1
            key = rank * (n + 2) + shifted
            order = np.argsort(key)  # the order of suffixes that are equal up to depth is of no account
            new = np.concatenate(([0], np.cumsum(key[order][1:] != key[order][:-1])))
            rank = np.empty(n, np.int64)
            rank[order] = new
            k *= 2
            if k < depth:
                part = (rank, k)
            if k >= depth or (n and new[-1] == n - 1):
                break
        self.low, self.high = self._groups(order, *part, depth - 1)
        self.suffixes = order
        self.size = int(symbols.max()) + 1 if n else 1
        self.first = np.concatenate(([0], np.cumsum(np.bincount(symbols, minlength=self.size))))
        bwt = symbols[order - 1]
        self.levels = []
        for level in range(max(1, (self.size - 1).bit_length()) - 1, -1, -1):
            bits = (bwt >> level) & 1
            packed = np.zeros((n // 64 + 1) * 8, np.uint8)
            some = np.packbits(bits.astype(np.uint8), bitorder="little")
            packed[: len(some)] = some
            blocks = packed.view(np.uint64)
            before = np.concatenate(([0], np.cumsum(np.bitwise_count(blocks).astype(np.int64))))[:-1]
            self.levels.append((level, blocks, before, n - int(bits.sum())))
            bwt = np.concatenate((bwt[bits == 0], bwt[bits == 1]))
        self.base = self._descend(np.arange(self.size), np.zeros(self.size, np.int64))

    @staticmethod
    def _groups(order: np.ndarray, rank: np.ndarray, covered: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """For each suffix in order, the interval of those that begin with the same ``depth`` symbols;
        rank tells suffixes apart by their first ``covered`` symbols, at least half of depth."""
        n = len(order)
        padded = np.concatenate((rank, np.full(depth, -1)))
        new = np.ones(n, bool)
        for shift in {0, max(0, depth - covered)}:
            here = padded[order + shift]
            new[1:] &= here[1:] == here[:-1]
        new[1:] = ~new[1:]
        starts = np.flatnonzero(new)
        group = np.cumsum(new) - 1
        return starts[group], np.append(starts[1:], n)[group]

    def _descend(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        for level, blocks, before, zeros in self.levels:
            block, inside = i >> 6, (i & 63).astype(np.uint64)
            ones = before[block] + np.bitwise_count(blocks[block] & ((np.uint64(1) << inside) - np.uint64(1)))
            i = np.where((symbol >> level) & 1, zeros + ones, i - ones)
        return i

    def step(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the matches with a symbol put before them."""
        at = self.first[symbol] - self.base[symbol]
        both = self._descend(np.concatenate((symbol, symbol)), np.concatenate((low, high)))
        return at + both[: len(low)], at + both[len(low) :]


def repeated(symbols: np.ndarray, begin: np.ndarray, length: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray,
    np.ndarray]:
    """Which windows of the pieces stand more than once: their first positions, suffix intervals, and the suffixes.

    All pieces are searched backward side by side from their last symbols. A match is cut to
    window - 1 symbols before each further step, so each step past these ends in a window."""
    index = FMIndex(symbols, window)
    last = begin + length - 1
    low, high = index.first[symbols[last]], index.first[symbols[last] + 1]
    out = []
    for t in range(1, int(length.max())):
        more = length > t
        begin, length, last, low, high = begin[more], length[more], last[more], low[more], high[more]
        if t >= window:
            low, high = index.low[low], index.high[low]
        low, high = index.step(symbols[last - t], low, high)
        if t >= window - 1:
            several = high - low > 1
            out.append((last[several] - t, low[several], high[several]))
    at, low, high = (np.concatenate(x) for x in zip(*out, strict=True))
    return at, low, high, index.suffixes


def _anchors(tokens: list[bytes], hasher: Hasher, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one anchor: the anchor's hash, the run's first and last window."""
    grams, width = hasher(tokens), 1
    least = grams
    reach = window - hasher.k + 1  # sequences in a window; their minimum from runs of 1, 2, 4 ...
    while width < reach:
        step = min(width, reach - width)
        least = np.minimum(least[: len(least) - step], least[step:])
        width += step
    # the first place of the least value changes with the value, or where that place is left behind
    starts = np.flatnonzero(np.concatenate(([True], (least[1:] != least[:-1]) | (grams[: len(least) - 1] == least[:-1]))))
    return least[starts].view(np.int64), starts, np.append(starts[1:], len(least)) - 1


def _packed_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pack = zstandard.ZstdCompressor(level=1).compress
    for batch in batches:
        out = []
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            tokens = words(text)
            whole = b" ".join(tokens)
            out.append((xxhash.xxh64_intdigest(whole) - 2**63, doc_id, len(tokens), pack(whole)))
        cols = list(zip(*out, strict=True)) or [[]] * 4
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)],
            ["text_key", "doc_id", "n_words", "packed"])


def _anchor_rows(batches: Iterator[pa.RecordBatch], window: int, gram: int) -> Iterator[pa.RecordBatch]:
    """For each text of a window or more a row with its id and no anchor, and a row for each run of windows."""
    hasher = Hasher(gram)
    for batch in batches:
        keys, ids, anchors, starts = [], [], [], []
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            tokens = words(text)
            if len(tokens) >= window:
                anchor, first, _ = _anchors(tokens, hasher, window)
                keys.append(xxhash.xxh64_intdigest(b" ".join(tokens)) - 2**63)
                ids.append(doc_id)
                anchors.append(anchor)
                starts.append(first.astype(np.int32))
        names = ["anchor", "text_key", "start", "doc_id"]
        n = len(keys)
        yield pa.RecordBatch.from_arrays(
            [pa.nulls(n, pa.int64()), pa.array(keys, pa.int64()), pa.nulls(n, pa.int32()), pa.array(ids, pa.int64())], names)
        if n:
            whole = np.concatenate(anchors)
            repeated_keys = np.repeat(np.array(keys, np.int64), [len(x) for x in anchors])
            yield pa.RecordBatch.from_arrays(
                [pa.array(whole), pa.array(repeated_keys), pa.array(np.concatenate(starts)), pa.nulls(len(whole), pa.int64())], names)


def _segments(batches: Iterator[pa.RecordBatch], window: int, gram: int) -> Iterator[pa.RecordBatch]:
    hasher, unpack = Hasher(gram), zstandard.ZstdDecompressor().decompress
    names = ["anchor", "text_key", "doc_id", "start", "words"]
    for batch in batches:
        anchors, keys, ids, starts, parts = [], [], [], [], []
        for key, doc_id, packed, wanted in zip(batch.column("text_key").to_pylist(), batch.column("doc_id").to_pylist(),
            batch.column("packed").to_pylist(), batch.column("starts"), strict=True):
            tokens = unpack(packed).split()
            anchor, first, last = _anchors(tokens, hasher, window)
            keep = np.flatnonzero(np.isin(first, wanted.values.to_numpy()))
            anchors.append(anchor[keep])
            starts.append(first[keep].astype(np.int32))
            keys += [key] * len(keep)
            ids += [doc_id] * len(keep)
            parts += [b" ".join(tokens[s : e + window]) for s, e in zip(first[keep].tolist(), last[keep].tolist(), strict=True)]
        if keys:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(anchors)), pa.array(keys, pa.int64()), pa.array(ids, pa.int64()),
                pa.array(np.concatenate(starts)), pa.array(parts, pa.binary())], names)


FIRST_PLACES = "anchor bigint, words_key bigint, skip int, docs array<bigint>, starts array<int>"


def _shard(rows: list[tuple], window: int) -> pa.RecordBatch | None:
    """For each segment of the shard that has a repeated window or several places: the
    first place of each of its windows."""
    ids: dict[bytes, int] = {}
    flat: list[int] = []
    begin, length = [], []
    for row in rows:
        begin.append(len(flat))
        tokens = row[2].split()
        flat += [ids.setdefault(w, len(ids) + 1) for w in tokens]
        flat.append(0)
        length.append(len(tokens))
    symbols, begin, length = np.array(flat, np.int64), np.array(begin), np.array(length)
    windows = length - window + 1
    of = np.repeat(np.arange(len(rows)), windows)
    offset = np.arange(len(of)) - np.repeat(np.cumsum(windows) - windows, windows)
    start = begin[of] + offset
    at, low, high, suffixes = repeated(symbols, begin, length, window)
    which = np.searchsorted(start, at)
    doc = np.array([r[3] for r in rows], np.int64)[of]
    place = np.array([r[4] for r in rows], np.int64)[of] + offset
    order = np.lexsort((place, doc))
    rank = np.empty(len(of), np.int64)
    rank[order] = np.arange(len(of))
    least = rank.copy()
    if len(which):
        by_position = np.full(len(symbols), len(of))
        by_position[start] = rank
        sorted_ranks = by_position[suffixes]
        edges, back = np.unique(low, return_inverse=True)
        ends = np.empty(len(edges), np.int64)
        ends[back] = high
        cuts = np.stack((edges, ends), axis=1).ravel()
        if cuts[-1] == len(sorted_ranks):
            sorted_ranks = np.append(sorted_ranks, len(of))
        least[which] = np.minimum.reduceat(sorted_ranks, cuts)[::2][back]
    several = np.zeros(len(rows), bool)
    several[of[which]] = True
    several |= np.array([r[5] for r in rows]) > 1
    keep = several[of]
    if not keep.any():
        return None
    firsts = order[least[keep]]
    some = np.flatnonzero(several)
    offsets = np.concatenate(([0], np.cumsum(windows[some])))
    take = lambda i, t: pa.array([rows[j][i] for j in some], t)
    return pa.RecordBatch.from_arrays(
        [take(0, pa.int64()), take(1, pa.int64()), take(6, pa.int32()), list_array(pa.array(doc[firsts]), offsets),
            list_array(pa.array(place[firsts].astype(np.int32)), offsets)],
        ["anchor", "words_key", "skip", "docs", "starts"],
    )


def _shards(batches: Iterator[pa.RecordBatch], window: int, shard_words: int) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by anchor; a shard ends at an anchor's end."""
    rows: list[tuple] = []
    size, last = 0, None
    for batch in batches:
        cols = [batch.column(c).to_pylist() for c in ("anchor", "words_key", "words", "doc_id", "start", "places", "skip")]
        for row in zip(*cols, strict=True):
            if size >= shard_words and row[0] != last:
                if (out := _shard(rows, window)) is not None:
                    yield out
                rows, size = [], 0
            rows.append(row)
            size += row[2].count(b" ") + 1
            last = row[0]
    if rows and (out := _shard(rows, window)) is not None:
        yield out


def _single_windows(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Segments of a hot anchor window by window."""
    names = ["anchor", "words_key", "words", "doc_id", "start", "places", "skip"]
    for batch in batches:
        out = []
        for anchor, key, text, doc, start, places in zip(*(batch.column(c).to_pylist() for c in names[:6]), strict=True):
            tokens = text.split()
            for i in range(len(tokens) - window + 1):
                out.append((anchor, key, b" ".join(tokens[i : i + window]), doc, start + i, places, i))
        cols = list(zip(*out, strict=True)) or [[]] * 7
        kinds = (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.int64(), pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names)


def _window_places(segments: DataFrame, window: int, scratch: Scratch) -> DataFrame:
    """As a shard gives them, the first places of the repeated windows of hot anchors' segments.

    Equal windows are counted before they meet, and the first place is joined back: no task
    holds all of a window that stands in many different segments."""
    single = (segments.mapInArrow(lambda it: _single_windows(it, window), "anchor bigint, words_key bigint, words binary, doc_id bigint, "
        "start int, places bigint, skip int"))
    firsts = (
        single.groupBy("words").agg(F.min(F.struct("doc_id", "start")).alias("first"),
        F.sum("places").alias("places")).filter("places > 1"))
    firsts = scratch.written(firsts.select("words", "first"), "fm-windows")  # as a table, so that a skewed join with it can be split
    found = single.select("anchor", "words_key", "words", "skip").join(firsts, "words")
    return found.select("anchor", "words_key", "skip", F.array("first.doc_id").alias("docs"), F.array("first.start").alias("starts"))


def _covered(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """text_key and the word spans covered by windows that aren't the first of their kind."""
    names = ["text_key", "begin", "end"]
    for batch in batches:
        key, doc, start, skip = (batch.column(c).to_numpy() for c in ("text_key", "doc_id", "start", "skip"))
        lengths = pc.list_value_length(batch.column("docs")).to_numpy()
        row = np.repeat(np.arange(len(lengths)), lengths)
        here = (start + skip)[row] + np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        first_doc, first_start = batch.column("docs").flatten().to_numpy(), batch.column("starts").flatten().to_numpy()
        later = (first_doc < doc[row]) | ((first_doc == doc[row]) & (first_start < here))
        row, here = row[later], here[later]
        if len(row):
            cut = np.flatnonzero((row[1:] != row[:-1]) | (here[1:] - here[:-1] > window))
            begins, ends = np.append(0, cut + 1), np.append(cut, len(row) - 1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(key[row[begins]]), pa.array(here[begins].astype(np.int32)), pa.array((here[ends] + window).astype(np.int32))],
                names)


def _cut(batches: Iterator[pa.RecordBatch], window: int, keep_text: bool) -> Iterator[pa.RecordBatch]:
    unpack = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        out = []
        for doc_id, n, packed, first, spans in zip(
            *(batch.column(c).to_pylist() for c in ("doc_id", "n_words", "packed", "first_doc", "spans")), strict=True):
            text = unpack(packed)
            kept = np.ones(n, bool)
            if n >= window and doc_id is not None:
                if doc_id > first:
                    kept[:] = False
                for s in spans or ():
                    kept[s["begin"] : s["end"]] = False
            removed = int(n - kept.sum())
            if removed:
                tokens = text.split()
                text = b" ".join([tokens[i] for i in np.flatnonzero(kept)])
            out.append((doc_id, n, removed, hashlib.sha256(text).hexdigest(), text.decode("utf-8", "replace") if keep_text else None))
        cols = list(zip(*out, strict=True)) or [[]] * 5
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)],
            ["doc_id", "n_words", "n_removed", "kept_sha256", "text"])


def remove_repeats(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = 20, gram: int = 8,
    shard_words: int = 500_000, hot_segments: int = 20_000, keep_text: bool = False,
) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, text (null unless keep_text): a row per row.

    Each word goes that lies in a window whose words also start earlier (at a smaller
    doc_id, or earlier in the same document); what stays is joined by single spaces.

    Null, empty and short texts lose nothing. Rows with a null id take no part and lose
    nothing. Rows of one id and the same words are at one place and lose alike; rows of
    one id and other words are compared by their starts. An empty table gives no rows;
    other columns aren't read. An anchor with more than hot_segments different segments
    goes window by window to an aggregation of equal windows instead of to a shard, so no
    shard grows with one phrase.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    texts = rows.mapInArrow(_packed_texts, TEXT)
    scratch = Scratch(docs.sparkSession)
    noted = (
        scratch.written(
        rows.filter("doc_id IS NOT NULL AND text IS NOT NULL").mapInArrow(lambda it: _anchor_rows(it, window, gram),
        "anchor bigint, text_key bigint, start int, doc_id bigint"), "fm-anchors"))
    anchors = noted.filter("anchor IS NOT NULL").select("anchor", "text_key", "start")
    place = F.xxhash64("text_key", "start")
    more = (
        scratch.written(
        anchors.groupBy("anchor").agg(F.min(place).alias("low"), F.max(place).alias("high")).filter("low != high").select("anchor"),
        "fm-repeated"))  # as a table, so that a skewed join with it can be split
    wanted = anchors.join(more, "anchor").groupBy("text_key").agg(F.collect_set("start").alias("starts"))
    firsts = scratch.written(noted.filter("anchor IS NULL").groupBy("text_key").agg(F.min("doc_id").alias("first_doc")), "fm-firsts")
    owners = wanted.join(firsts, "text_key").withColumnRenamed("first_doc", "doc_id")
    segments = (
        scratch.written(
        texts.join(owners, ["text_key", "doc_id"]).select("text_key", "doc_id", "packed",
        "starts").mapInArrow(lambda it: _segments(it, window, gram), "anchor bigint, text_key bigint, doc_id bigint, start int, words "
        "binary").withColumn("words_key", F.xxhash64("words")), "fm-segments"))

    first = F.min(F.struct("doc_id", "start")).alias("first")
    distinct = (
        scratch.written(
        segments.groupBy("anchor", "words_key", "words").agg(first, F.count("*").alias("places")).select("anchor", "words_key", "words",
        F.col("first.doc_id").alias("doc_id"), F.col("first.start").alias("start"), "places"), "fm-distinct"))
    hot = scratch.written(distinct.groupBy("anchor").count().filter(F.col("count") > hot_segments).select("anchor"), "fm-hot")
    usual = distinct.join(hot, "anchor", "left_anti").withColumn("skip", F.lit(0))
    shards = usual.repartition("anchor").sortWithinPartitions("anchor")
    places = shards.mapInArrow(lambda it: _shards(it, window, shard_words), FIRST_PLACES)
    if not hot.isEmpty():
        places = places.unionByName(_window_places(distinct.join(hot, "anchor", "left_semi"), window, scratch))
    found = segments.select("anchor", "words_key", "text_key", "doc_id", "start").join(places, ["anchor", "words_key"])
    spans = (
        found.select("text_key", "doc_id", "start", "skip", "docs", "starts").mapInArrow(lambda it: _covered(it, window),
        "text_key bigint, begin int, end int"))
    covered = spans.groupBy("text_key").agg(F.collect_list(F.struct("begin", "end")).alias("spans"))
    notes = scratch.result(firsts.join(covered, "text_key", "left"), "fm-notes")
    whole = texts.join(notes, "text_key", "left").select("doc_id", "n_words", "packed", "first_doc", "spans")
    return (whole.mapInArrow(lambda it: _cut(it, window, keep_text), "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 "
        "string, text string"))
