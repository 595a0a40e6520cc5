"""Cross-tokenizer alignment: where two tokenizers' tokens end together, and which tokens meet.

Documents are shuffled by their full text, so that each distinct text is tokenised and aligned
once. A task takes the texts of a block together and cuts them into units, stretches between
places that no token of either tokenizer crosses: each distinct unit is tokenised and aligned
once, a text is a row of unit numbers. Every block counts its own pairs, weighted by the
texts' multiplicities, before pairs of all blocks are added up; each block gets back the counts
of the pairs that it holds, and measures are joined to the documents' ids by the texts' hashes.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from perispark.llm.byte_pairs import PIECE, byte_letters
from perispark.llm.common import Scratch, list_array, slices

#: A run of white space and what follows it up to the next blank, line end or tab: see Aligner.
UNIT = re.compile(r"\s*\S+(?:[^\S \n\t]\s*\S+)*(?:[^\S \n\t]\s*\Z)?|\s+\Z")
#: Units that a task keeps from one block for the next, and bytes of text in a block (one text at least).
CACHE, BLOCK = 300_000, 4_000_000
#: Texts that make up at least one row in so many are joined apart, by a broadcast of at most so many rows.
HOT = 1000


class Aligner:
    """first: a tokenizer file (JSON) with byte-level BPE, whose merges' ids ascend with their ranks; second: a
    sentence-piece model that adds a space in front.

    Units begin with a blank, line end or tab that a letter comes before. The first tokenizer splits there
    by its pattern. The second merges only into pieces of its list: if none has a letter before one of the
    three, or a line end or tab beside anything, no token crosses. Else whole texts are the units.
    """

    def __init__(self, first: str, second: bytes):
        from sentencepiece import SentencePieceProcessor
        from tiktoken import Encoding

        model, byte_of = json.loads(first)["model"], {c: b for b, c in enumerate(byte_letters())}
        ids = model["vocab"]
        merged = [ids["".join(x.split(" ") if isinstance(x, str) else x)] for x in model["merges"]]
        if any(x >= y for x, y in itertools.pairwise(merged)):
            raise ValueError("the ids of merges must ascend with their ranks")
        self.a_bytes = {i: bytes(byte_of[c] for c in name) for name, i in ids.items() if all(c in byte_of for c in name)}
        used = {*merged, *(ids[c] for c in byte_of)}
        self.a = Encoding("first", pat_str=PIECE.pattern, mergeable_ranks={v: k for k, v in self.a_bytes.items() if k in used}, special_tokens={})
        self.b = SentencePieceProcessor(model_proto=second)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.a_sizes = np.zeros(max(self.a_bytes) + 1, np.int64)
        self.a_sizes[list(self.a_bytes)] = [len(x) for x in self.a_bytes.values()]
        self.b_sizes = np.array([len(x) for x in self.b_bytes], np.int64)
        crosses = re.compile(r"[^▁]▁|.[\n\t]|[\n\t].", re.DOTALL)
        apart = not any(crosses.search(p) for i, p in enumerate(pieces) if not self.b.is_byte(i))
        self.find = UNIT.findall if apart else lambda text: [text]
        #: Goes before a unit, and ends in a token of its own, so that the unit is tokenised as inside a text.
        self.front = "\n" if apart else ""
        self.skip = len(self.b.encode("\n")) if apart else 0
        #: How an id is written before the next one of its side, before the other side, and before the next group.
        self.written = [np.array([f"{i}{mark}" for i in range(max(len(self.a_sizes), len(pieces)))], object) for mark in ",|;"]
        self.forget()

    def forget(self) -> None:
        #: Each unit's number; by number its tokens of both, groups and links (-1 where a tokenizer changes it), groups, and pairs.
        self.number: dict[str, int] = {}
        self.counts, self.groups = np.zeros((0, 4), np.int64), []
        self.pairs, self.ends = np.zeros(0, np.int64), np.zeros(1, np.int64)

    def learn(self, units: list[str]) -> None:
        """Tokenise and align new units together: as tokens are laid end to end, each stretch between
        neighbouring ends of either tokenizer is one pair of tokens that meet."""
        if len(self.number) > CACHE:
            self.forget()
        new = [u for u in dict.fromkeys(units) if u not in self.number]
        if not new:
            return
        firsts = list(map(self.a.encode_ordinary, new))
        # without a front, the added space stands for the unit's own
        seconds = [x[self.skip :] for x in self.b.encode([self.front + u if self.front else u[1:] for u in new], num_threads=1)]
        raw = [u.encode("utf-8", "surrogatepass") for u in new]
        of_a, of_b = self.a_bytes.__getitem__, self.b_bytes.__getitem__
        same = [b"".join(map(of_a, a)) == u == b"".join(map(of_b, b)) for u, a, b in zip(raw, firsts, seconds, strict=True)]
        if not all(same):
            firsts, seconds = ([x if ok else [] for x, ok in zip(rows, same, strict=True)] for rows in (firsts, seconds))
        n_a, n_b = np.array(list(map(len, firsts)), np.int64), np.array(list(map(len, seconds)), np.int64)
        flat_a = np.fromiter(itertools.chain.from_iterable(firsts), np.int64, int(n_a.sum()))
        flat_b = np.fromiter(itertools.chain.from_iterable(seconds), np.int64, int(n_b.sum()))
        ends_a, ends_b = np.cumsum(self.a_sizes[flat_a]), np.cumsum(self.b_sizes[flat_b])
        ends, cuts = np.union1d(ends_a, ends_b), np.intersect1d(ends_a, ends_b, assume_unique=True)
        pairs = flat_a[np.searchsorted(ends_a, ends)] << 32 | flat_b[np.searchsorted(ends_b, ends)]
        unit_end = np.cumsum([len(u) * ok for u, ok in zip(raw, same, strict=True)])
        of_unit = lambda places: np.diff(np.searchsorted(places, unit_end, side="right"), prepend=0)
        n_groups, n_links = of_unit(cuts), of_unit(ends)
        # tokens in the order they are written: by group, A's before B's
        group_a, group_b = np.searchsorted(cuts, ends_a), np.searchsorted(cuts, ends_b)
        side = np.concatenate((2 * group_a, 2 * group_b + 1))
        order = np.argsort(side, kind="stable")
        side, ids = side[order], np.concatenate((flat_a, flat_b))[order]
        turns = side[1:] != side[:-1]
        mark = np.append(np.where(turns, 1 + side[:-1] % 2, 0), 2) if len(side) else side
        text = np.choose(mark, [w[ids] for w in self.written]).tolist() if len(side) else []
        until = np.cumsum(n_a + n_b).tolist()
        self.groups += ["".join(text[s:e])[:-1] for s, e in zip([0, *until[:-1]], until, strict=True)]
        self.number.update(zip(new, range(len(self.number), len(self.number) + len(new)), strict=True))
        counts = np.stack((n_a, n_b, n_groups, n_links), axis=1)
        counts[~np.array(same)] = -1
        self.counts = np.concatenate((self.counts, counts))
        self.pairs, self.ends = np.concatenate((self.pairs, pairs)), np.concatenate((self.ends, self.ends[-1] + np.cumsum(n_links)))


@functools.lru_cache(maxsize=1)
def aligner_of(first: str, second: bytes) -> Aligner:
    """A worker's tasks share what they read of the same files."""
    return Aligner(first, second)


#: One row a block: of its texts the hash, rows that hold it, tokens, groups, links and the hash of groups;
#: of its pairs the ids (a << 32 | b, in order) and documents; the texts' units and the units' pairs by their places.
BLOCKS = (
    "block bigint, key array<binary>, copies array<bigint>, n_a array<bigint>, n_b array<bigint>, n_groups array<bigint>, n_links array<bigint>, "
    "groups_sha256 array<string>, pair array<bigint>, documents array<bigint>, units binary, unit_ends binary, pairs binary, pair_ends binary")


def _ends(sizes: list[int] | np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)


def _runs(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of each run, one after another."""
    return np.repeat(starts - _ends(sizes)[:-1], sizes) + np.arange(sizes.sum())


def _kind(n: int) -> type:
    """What n numbers from 0 fit in."""
    return np.uint16 if n <= 1 << 16 else np.int32


def block_of(texts: list[str], copies: list[int], aligner: Aligner) -> dict:
    """The columns of one block's row but its number."""
    found = [aligner.find(" " + t) for t in texts]
    aligner.learn(list(itertools.chain.from_iterable(found)))
    counts, hashes, rows = [], [], []
    for units in found:
        numbers = np.array(list(map(aligner.number.__getitem__, units)), np.int64)
        total = aligner.counts[numbers]
        if (total < 0).any():  # a tokenizer changes this text
            numbers, total = numbers[:0], total[:0]
        rows.append(numbers)
        counts.append(total.sum(axis=0))
        groups = ";".join(map(aligner.groups.__getitem__, numbers.tolist()))
        hashes.append(hashlib.sha256(groups.encode()).hexdigest() if groups else "")
    sizes = np.array([len(x) for x in rows], np.int64)
    distinct, units = np.unique(np.concatenate(rows), return_inverse=True)
    spans = np.diff(aligner.ends)[distinct]
    pair, pairs = np.unique(aligner.pairs[_runs(aligner.ends[distinct], spans)], return_inverse=True)
    ends = _ends(spans)
    # each text's distinct units, then its distinct pairs, then what the texts with a pair add up to
    held = np.unique(np.repeat(np.arange(len(texts)), sizes) * len(distinct) + units)
    text, unit = held // max(1, len(distinct)), held % max(1, len(distinct))
    seen = np.unique(np.repeat(text, spans[unit]) * len(pair) + pairs[_runs(ends[unit], spans[unit])])
    documents = np.zeros(len(pair), np.int64)
    np.add.at(documents, seen % max(1, len(pair)), np.array(copies, np.int64)[seen // max(1, len(pair))])
    n_a, n_b, n_groups, n_links = np.array(counts, np.int64).reshape(-1, 4).T
    return {
        "key": [hashlib.sha256(t.encode("utf-8", "surrogatepass")).digest()[:16] for t in texts], "copies": copies,
        "n_a": n_a, "n_b": n_b, "n_groups": n_groups, "n_links": n_links, "groups_sha256": hashes,
        "pair": pair, "documents": documents, "units": units.astype(np.int32).tobytes(),
        "unit_ends": _ends(sizes).tobytes(), "pairs": pairs.astype(_kind(len(pair))).tobytes(), "pair_ends": ends.tobytes(),
    }


def _blocks(batches: Iterator[pa.RecordBatch], first: str, second: bytes) -> Iterator[pa.RecordBatch]:
    aligner, schema = aligner_of(first, second), pa.schema([
        ("block", pa.int64()), ("key", pa.list_(pa.binary())), *[(c, pa.list_(pa.int64())) for c in ("copies", "n_a", "n_b", "n_groups", "n_links")],
        ("groups_sha256", pa.list_(pa.string())), ("pair", pa.list_(pa.int64())), ("documents", pa.list_(pa.int64())),
        *[(c, pa.binary()) for c in ("units", "unit_ends", "pairs", "pair_ends")]])
    at = TaskContext.get().partitionId() << 33
    for batch in batches:
        for part in slices(batch.column(0), BLOCK):
            row = block_of(batch.column(0)[part].to_pylist(), batch.column(1)[part].to_pylist(), aligner)
            yield pa.RecordBatch.from_arrays([pa.array([row[f.name] if f.name != "block" else at], f.type) for f in schema], schema=schema)
            at += 1


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks with ``seen``, the counts of their pairs in order: one row for each text."""
    names = ("key", "copies", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
    for batch in batches:
        for i in range(batch.num_rows):
            get = lambda name, i=i, batch=batch: batch.column(batch.schema.get_field_index(name))[i]
            as_ints = lambda name, kind: np.frombuffer(get(name).as_py(), kind)
            seen = get("seen").values
            n, best = (seen.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (1, 2)) if seen is not None else (np.zeros(0, np.int64),) * 2
            pairs, ends = as_ints("pairs", _kind(len(n))), as_ints("pair_ends", np.int64)
            units, until = as_ints("units", np.int32), as_ints("unit_ends", np.int64)
            totals = []
            for values in (best, n):
                of_pairs = _ends(values[pairs])
                of_units = (of_pairs[ends[1:]] - of_pairs[ends[:-1]])[units]
                sums = _ends(of_units)
                totals.append(pa.array(sums[until[1:]] - sums[until[:-1]]))
            yield pa.RecordBatch.from_arrays([*[get(c).values for c in names], *totals], [*names, "n_best", "count_sum"])


def align(docs: DataFrame, first: str, second: bytes, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) for every row of docs.

    first tokenises a space and the text (A), second the text, to which it adds a space (B); special tokens'
    strings are plain text. Byte offsets where tokens of both end cut them into groups; a link is a token of A
    and one of B whose bytes overlap. A pair of ids counts the rows of docs that hold it linked; n_best are the
    links whose count is the highest of their A id, count_sum adds the counts of all links.

    Null and empty texts, and texts that a tokenizer changes, have no tokens: zeros and ''. Repeated rows
    count as documents of their own and get the same measures; a null id is kept. An empty table gives an
    empty result. Columns of docs other than id and text are not kept, so no name clashes.

    Scale: copies meet by a partial count before the shuffle of full texts; a task holds one block of texts;
    counts of pairs are shuffled, never sent whole. A pair meets once a block, which bounds its share of rows
    by one in the pairs of a block. Texts of many rows are joined to ids by broadcast: those of at least one
    row in HOT, at most HOT of them.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    sent = spark.sparkContext.broadcast((first, second))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    texts = rows.filter("text != ''").groupBy("text").agg(F.count("*").alias("n"))
    blocks = scratch.written(texts.mapInArrow(lambda it: _blocks(it, *sent.value), BLOCKS), "align-blocks")
    each = blocks.select(F.inline(F.arrays_zip("pair", "documents")))
    counts = each.groupBy("pair").agg(F.sum("documents").alias("n"))
    highest = F.max("n").over(Window.partitionBy(F.shiftright("pair", 32)))  # a token of A meets at most B's tokens
    counts = counts.withColumn("best", F.col("n") == highest)
    held = blocks.select("block", F.explode("pair").alias("pair")).join(counts, "pair")
    seen = held.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("pair", "n", "best"))).alias("seen"))
    measures = "key binary, copies bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, n_best bigint, count_sum bigint"
    measured = blocks.drop("pair", "documents").join(seen, "block", "left").mapInArrow(_measured, measures)
    measured = scratch.result(measured, "align-measures")
    names = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    key = F.when(F.col("text") != "", F.unhex(F.substring(F.sha2(F.col("text").cast("binary"), 256), 1, 32)))
    keyed = rows.select("id", key.alias("key"))
    total = measured.agg(F.sum("copies")).first()[0] or 0
    often = F.broadcast(measured.filter(F.col("copies") * HOT >= total))  # HOT rows at most, as copies add up to total
    apart = keyed.join(often, "key", "left").filter("key IS NULL OR copies IS NOT NULL")
    others = keyed.join(often, "key", "left_anti").join(measured.filter(F.col("copies") * HOT < total), "key")
    whole = [F.coalesce(c, F.lit("") if c == "groups_sha256" else F.lit(0)).alias(c) for c in names]
    return apart.unionByName(others).select(F.col("id").alias(id_col), *whole)
