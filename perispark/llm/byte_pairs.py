"""Byte-pair encoding and decoding with a given vocabulary, by a pair occurrence index.

A task takes the distinct pieces (words with their leading space) of a batch of texts
together: it maps each pair of neighbouring symbols to all its positions, takes the
active ranks in ascending order from a heap, merges at all positions of that pair and
moves the neighbours' entries. A merge makes only pairs of later ranks, so one sweep
over the ranks encodes every piece. No model is trained.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from perispark.llm.common import small_batches

#: The pieces that byte-level vocabularies of this family merge within.
PIECE = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")
#: Pieces kept from one batch for the next ones of a task, and the characters taken together.
CACHE, TOGETHER = 200_000, 1_000_000


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable ones
    for themselves, the others numbered from 256."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(256 + rest.index(b)) for b in range(256)]


class Vocabulary:
    def __init__(self, text: str):
        """text: a tokenizer file (JSON) with a byte-level BPE model."""
        file = json.loads(text)
        byte_of = {c: b for b, c in enumerate(byte_letters())}
        ids = file["model"]["vocab"]
        self.bytes_of = {i: bytes(byte_of[c] for c in name) for name, i in ids.items()}
        self.first = np.array([ids[c] for c in byte_letters()], np.int64)
        self.size = max(ids.values()) + 1
        #: first id * size + second id -> rank; rank -> first id, second id, merged id
        self.ranks: dict[int, int] = {}
        self.pairs: list[tuple[int, int, int]] = []
        for rank, pair in enumerate(file["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.ranks[ids[a] * self.size + ids[b]] = rank
            self.pairs.append((ids[a], ids[b], ids[a + b]))
        #: ranks of pairs of single bytes
        self.byte_ranks = np.array([[self.ranks.get(a * self.size + b, -1) for b in self.first.tolist()] for a in self.first.tolist()])
        self.added = {t["content"]: t["id"] for t in file.get("added_tokens", ())}
        self.bytes_of |= {i: name.encode() for name, i in self.added.items()}
        self.split = regex.compile("|".join(regex.escape(x) for x in sorted(self.added, key=len, reverse=True))) if self.added else None
        self.find = PIECE.findall
        self.cache: dict[str, bytes] = {}
        self.forget()

    def forget(self) -> None:
        """Empty the cache of pieces but for the added tokens, which are never split."""
        self.cache.clear()
        self.cache.update((name, np.int32(i).tobytes()) for name, i in self.added.items())

    def merge(self, pieces: list[str]) -> list[bytes]:
        """The ids of each piece, as bytes of int32."""
        raw = [p.encode("utf-8", "surrogatepass") for p in pieces]
        symbols = np.frombuffer(b"".join(raw), np.uint8)
        ids = self.first[symbols].tolist()
        n = len(ids)
        starts = np.concatenate(([0], np.cumsum([len(x) for x in raw]))).astype(np.int64)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        before[starts[starts < n]] = -1
        after[starts[1:] - 1] = -1
        ranks = np.where(after[:-1] >= 0, self.byte_ranks[symbols[:-1], symbols[1:]], -1) if n else np.zeros(0, np.int64)
        order = np.argsort(ranks, kind="stable")
        order = order[np.searchsorted(ranks[order], 0) :]
        active, first = np.unique(ranks[order], return_index=True)
        where = dict(zip(active.tolist(), (x.tolist() for x in np.split(order, first[1:])), strict=False))
        after, before, starts = after.tolist(), before.tolist(), starts.tolist()
        rank_of, size, pairs = self.ranks.get, self.size, self.pairs
        heap = list(where)
        heapq.heapify(heap)
        while heap:
            rank = heapq.heappop(heap)
            a, b, new = pairs[rank]
            positions = where.pop(rank)
            if a == b:
                positions.sort()
            row = new * size
            for i in positions:
                j = after[i]
                if ids[i] != a or j < 0 or ids[j] != b:
                    continue  # an earlier merge took one of the two
                ids[i], ids[j] = new, -1
                k = after[i] = after[j]
                if k >= 0:
                    before[k] = i
                    if (r := rank_of(row + ids[k])) is not None:
                        if r in where:
                            where[r].append(i)
                        else:
                            where[r] = [i]
                            heapq.heappush(heap, r)
                if (h := before[i]) >= 0 and (r := rank_of(ids[h] * size + new)) is not None:
                    if r in where:
                        where[r].append(h)
                    else:
                        where[r] = [h]
                        heapq.heappush(heap, r)
        merged = np.array(ids, np.int32)
        left = merged >= 0
        ends = (4 * np.concatenate(([0], np.cumsum(left)))[starts]).tolist()
        kept = merged[left].tobytes()
        return [kept[s:e] for s, e in zip(ends, ends[1:], strict=False)]

    def pieces(self, text: str) -> list[str]:
        """Pieces in order; added tokens as one piece."""
        if self.split is None or not self.split.search(text):
            return self.find(text)
        out: list[str] = []
        at = 0
        for m in self.split.finditer(text):
            out += self.find(text[at : m.start()])
            out.append(m.group())
            at = m.end()
        return out + self.find(text[at:])

    def learn(self, pieces: set[str]) -> None:
        """Encode the pieces that the cache lacks, together."""
        if len(self.cache) > CACHE:
            self.forget()
        new = [p for p in pieces if p not in self.cache]
        self.cache.update(zip(new, self.merge(new), strict=True))

    def decode(self, ids: list[int]) -> str:
        """The text of ids; unknown ids give nothing, broken UTF-8 replacement characters."""
        try:
            return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")
        except KeyError:
            return b"".join(self.bytes_of.get(i, b"") for i in ids).decode("utf-8", "replace")


@functools.lru_cache(maxsize=2)
def vocabulary_of(text: str) -> Vocabulary:
    """A worker's tasks share what they read of the same file."""
    return Vocabulary(text)


def _encoded(batches: Iterator[pa.RecordBatch], text: str, at: int, decoded: str | None) -> Iterator[pa.RecordBatch]:
    vocabulary = vocabulary_of(text)
    for batch in batches:
        texts = batch.column(at).to_pylist()
        lo = 0
        while lo < len(texts):
            hi, size = lo, 0
            while hi < len(texts) and (hi == lo or size < TOGETHER):
                size += len(texts[hi] or "")
                hi += 1
            split = [vocabulary.pieces(t or "") for t in texts[lo:hi]]
            pieces: set[str] = set()
            for x in split:
                pieces.update(x)
            vocabulary.learn(pieces)
            lists = [np.frombuffer(b"".join(map(vocabulary.cache.__getitem__, x)), np.int32) for x in split]
            offsets = np.concatenate(([0], np.cumsum([len(x) for x in lists]))).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(lists)))
            part = batch.slice(lo, hi - lo)
            arrays, names = [*part.columns, ids], [*batch.schema.names, "ids"]
            if decoded is not None:
                arrays.append(pa.array([vocabulary.decode(x.tolist()) for x in lists], pa.string()))
                names.append(decoded)
            yield pa.RecordBatch.from_arrays(arrays, names)
            lo = hi


def read_vocabulary(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def encode(docs: DataFrame, vocabulary: str, *, text_col: str = "text", decoded_col: str | None = None) -> DataFrame:
    """docs with the added column ``ids`` (array<int>); vocabulary: the tokenizer file's text.

    With decoded_col, the ids are decoded into that column in the same task, which needs one
    Python worker where encode() and decode() need two.

    Strings of added tokens in a text become those tokens, as with the library's default.
    Null and empty texts have no ids. Rows are encoded alone: repeated rows give repeated
    results, an empty table none. Existing columns named ids or as decoded_col are replaced.

    Scale: one scan, no shuffle; a task takes the pieces of TOGETHER characters of texts, one text at least, at a time.
    """
    if decoded_col in (text_col, "ids"):
        raise ValueError(f"decoded_col can't be {decoded_col}")
    docs = docs.drop("ids", *[decoded_col] * (decoded_col is not None)).withColumn(text_col, F.col(text_col).cast("string"))
    schema = T.StructType([*docs.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType()))])
    if decoded_col is not None:
        schema = schema.add(decoded_col, "string")
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)
    at = docs.columns.index(text_col)
    return docs.mapInArrow(lambda it: _encoded(it, sent.value, at, decoded_col), schema)


def decode(encoded: DataFrame, vocabulary: str, *, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """encoded with the texts of its ids; null ids give a null text."""
    sent = encoded.sparkSession.sparkContext.broadcast(vocabulary)

    @F.pandas_udf("string")
    def texts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        words = vocabulary_of(sent.value)
        for ids in batches:
            yield ids.map(lambda x: None if x is None else words.decode(x.tolist()))

    return encoded.withColumn(out_col, texts(F.col(ids_col)))


def ids_sha256(ids: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()


def digest(encoded: DataFrame, *, id_col: str = "doc_id") -> DataFrame:
    """One row per row of decode(encode(docs)): number of ids, hashes of ids and decoded text."""
    return encoded.select(
        F.col(id_col), F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
