"""A quality classifier by supervised subword embeddings.

A document is the average of learned vectors of its words and their character n-grams, all
hashed into one table of buckets; softmax over two outputs gives the score. Both layers are
trained together by stochastic gradient descent in numpy: tasks walk through their shares of
the labelled sample from the same start, and each round's results are averaged.

Words are hashed in bulk: sums of letters times powers of an odd number modulo 2**64 give
the hash of any stretch of a text's words by a subtraction and a product.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perispark.llm.common import Scratch, held_out, list_array, slices, small_batches

#: Buckets of words and n-grams, numbers in a vector, lengths of n-grams.
BUCKETS, SIZE, LENGTHS = 1 << 16, 8, (2, 3, 4)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def _bucket(h: np.ndarray, kind: int) -> np.ndarray:
    """Well-mixed buckets of hashes; kind tells n-grams of each length and whole words apart."""
    h = h ^ np.uint64(kind * 0xA24BAED4963EE407 % (1 << 64))
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return ((h ^ (h >> np.uint64(29))) % np.uint64(BUCKETS)).astype(np.int32)


#: Stands for any word that comes twice in a row: the word pair whose two halves are one.
TWICE = int(_bucket(np.zeros(1, np.uint64), 99)[0])


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of all words, one after another, and where each word's begin (one more at the end).

    A word has one bucket for itself and one for each n-gram of its UTF-8 bytes between two marks.
    """
    raw = [b"<" + w.encode("utf-8", "surrogatepass") + b">" for w in words]
    sizes = np.array([len(x) for x in raw], np.int64)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    letters = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint64) + np.uint64(1)
    n = len(letters)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(letters * _powers(n, _BASE), dtype=np.uint64)))
    back = _powers(n + 1, _INVERSE)
    ids, owner = [_bucket((sums[ends] - sums[starts]) * back[starts], 0)], [np.arange(len(words))]
    word_of = np.repeat(np.arange(len(words)), sizes)
    for k in LENGTHS:
        at = np.flatnonzero(np.arange(n) + k <= np.repeat(ends, sizes))
        ids.append(_bucket((sums[at + k] - sums[at]) * back[at], k))
        owner.append(word_of[at])
    flat, owner = np.concatenate(ids), np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    return flat[order], np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=len(words))))).astype(np.int64)


class Words:
    """The words of some texts: each distinct one once, and the texts as numbers of them."""

    def __init__(self, texts: list[str | None]):
        number: dict[str, int] = {}
        self.texts = []
        for text in texts:
            self.texts.append(np.array([number.setdefault(w, len(number)) for w in (text or "").split()], np.int64))
        self.ids, self.starts = features(list(number))


def twice(numbers: np.ndarray) -> int:
    """How many words are the same as the word before them."""
    return int((numbers[1:] == numbers[:-1]).sum())


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """label, hash of the id, the distinct buckets of each text and how often they occur."""
    for batch in batches:
        for part in slices(batch.column(0)):
            labels, hashes = batch.column(1)[part].to_pylist(), batch.column(2)[part].to_pylist()
            words = Words(batch.column(0)[part].to_pylist())
            spans = np.diff(words.starts)
            for label, h, numbers in zip(labels, hashes, words.texts, strict=True):
                distinct, times = np.unique(numbers, return_counts=True)
                flat = [words.ids[words.starts[w] : words.starts[w + 1]] for w in distinct]
                counts = np.bincount(np.concatenate([*flat, np.zeros(0, np.int32)]).astype(np.int64), np.repeat(times, spans[distinct]), BUCKETS)
                counts[TWICE] += twice(numbers)
                some = np.flatnonzero(counts)
                one = lambda x: list_array(pa.array(x), [0, len(x)])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([label], pa.int32()), pa.array([h], pa.int64()), one(some.astype(np.int32)), one(counts[some].astype(np.float32))],
                    ["label", "h", "features", "times"])


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max())
    return e / e.sum()


class Model:
    """vectors: a row for each bucket; output: a row for each class and a bias behind."""

    def __init__(self, vectors: np.ndarray, output: np.ndarray):
        self.vectors, self.output = vectors, output
        #: What each bucket adds to each class: the output of an average is the average of outputs.
        self.logits = vectors.astype(np.float64) @ output[:, :-1].T.astype(np.float64)
        self.bias = output[:, -1].astype(np.float64)

    def scores(self, texts: list[str | None]) -> list[float]:
        words = Words(texts)
        sums = np.zeros((len(words.ids) + 1, len(self.bias)))
        np.cumsum(self.logits[words.ids], axis=0, out=sums[1:])
        each, spans = sums[words.starts[1:]] - sums[words.starts[:-1]], np.diff(words.starts)
        out = []
        for numbers in words.texts:
            again = twice(numbers)
            total = each[numbers].sum(axis=0) + again * self.logits[TWICE]
            out.append(float(softmax(total / max(1, int(spans[numbers].sum()) + again) + self.bias)[1]))
        return out


WALKED = "vectors binary, output binary, bags bigint"


def _descended(table: pa.Table, vectors: np.ndarray, output: np.ndarray, rates: list[float], seed: int) -> pa.Table:
    """One walk over a share's bags for each rate: both layers, and the number of bags."""
    bags = []
    for y, h, ids, n in zip(table["label"].to_pylist(), table["h"].to_pylist(), table["features"], table["times"], strict=True):
        if len(ids.values):
            times = n.values.to_numpy()
            bags.append((h, int(y), ids.values.to_numpy(), times / times.sum()))
    bags.sort(key=lambda x: x[0])  # the same walk in whatever order rows come
    vectors, output = vectors.copy(), output.copy()
    rng = np.random.default_rng(seed)
    for rate in rates:
        for i in rng.permutation(len(bags)):
            _, y, ids, share = bags[i]
            x = np.append(share @ vectors[ids], np.float32(1))
            error = softmax(output @ x)
            error[y] -= 1
            back = error @ output[:, :-1]
            output -= rate * np.outer(error, x)
            vectors[ids] -= rate * np.outer(share, back)
    columns = [pa.array([vectors.tobytes()], pa.binary()), pa.array([output.tobytes()], pa.binary()), pa.array([len(bags)], pa.int64())]
    return pa.Table.from_arrays(columns, ["vectors", "output", "bags"])


def _walk(sent: Broadcast, rates: list[float], seed: int) -> Callable[[pa.Table], pa.Table]:
    return lambda share: _descended(share, *sent.value, rates, seed)


def train(
    docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
    modulus: int = 4, remainder: int = 2, max_rows: int = 4000, shares: int = 4, rounds: int = 5, walks: int = 4, rate: float = 2.0, seed: int = 1,
) -> Model:
    """Learn from labelled documents that aren't held out, at most max_rows ids of each class by a hash of the id.

    Labels other than 0 and 1 and null ids are left out; of several labels of one id the largest counts.
    Without documents of both classes the model gives the one class that there is (1 without any).
    An id with several rows in docs gives its smallest text. The sample's texts are whole.
    """
    known = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y")).filter("_id IS NOT NULL AND _y IN (0, 1)")
    known = known.filter(~held_out(F.col("_id"), modulus, remainder)).groupBy("_id").agg(F.max("_y").alias("_y"))
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    known = known.join(texts.select("_id"), "_id", "left_semi").withColumn("_h", F.xxhash64("_id"))
    few = [known.filter(F.col("_y") == y).orderBy("_h", "_id").limit(max_rows) for y in (0, 1)]
    chosen = few[0].unionByName(few[1]).select("_id", "_y")  # at most 2 * max_rows ids
    rows = texts.join(F.broadcast(chosen), "_id").groupBy("_id").agg(F.min("_text").alias("_text"), F.first("_y").alias("_y"))
    scratch = Scratch(docs.sparkSession)
    numbered = rows.select("_text", "_y", F.xxhash64("_id").alias("_h"))
    bags = scratch.written(numbered.mapInArrow(_bags, "label int, h bigint, features array<int>, times array<float>"), "quality-bags")
    dealt = bags.groupBy(F.pmod("h", F.lit(shares)).alias("share"))  # at most the whole sample in one share
    there = {r.label: r.n for r in bags.groupBy("label").agg(F.count("*").alias("n")).collect()}
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / SIZE, 1 / SIZE, (BUCKETS, SIZE)).astype(np.float32)
    output = np.zeros((2, SIZE + 1), np.float32)
    if len(there) < 2:
        output[0 if 0 in there else 1, -1] = 30
        scratch.delete(scratch.paths)
        return Model(vectors, output)
    steps = rounds * walks
    for at in range(rounds):
        rates = [rate * (1 - (at * walks + i) / steps) for i in range(walks)]
        sent = docs.sparkSession.sparkContext.broadcast((vectors, output))
        parts = dealt.applyInArrow(_walk(sent, rates, seed + at), WALKED).collect()
        parts.sort(key=lambda p: (p.bags, p.output))  # sums don't depend on which share ends first
        total = max(1, sum(p.bags for p in parts))
        mean = lambda name, like: (sum(np.frombuffer(p[name], np.float32).astype(np.float64) * p.bags for p in parts) / total).astype(np.float32).reshape(like.shape)
        vectors, output = mean("vectors", vectors), mean("output", output)
        sent.unpersist()
    scratch.delete(scratch.paths)
    return Model(vectors, output)


def score_documents(docs: DataFrame, model: Model, *, text_col: str = "text", least: float = 0.7, out_col: str = "quality") -> DataFrame:
    """docs with the added column ``quality``: struct(score, predicted), predicted being 1 from ``least`` on.

    Null and empty texts have no words: their score is that of an average of nothing. Rows are scored
    alone: repeated rows give repeated results, an empty table none. An existing column of that name
    is replaced; other columns stay.

    Scale: one scan, no shuffle; only the text goes to Python, about 1 MB of it at a time as strings, and
    each distinct word of that is hashed once.
    """
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("score double, predicted int")
    def scored(texts: pa.Array) -> pa.Array:
        found = [x for part in slices(texts) for x in sent.value.scores(texts[part].to_pylist())]
        values = [pa.array(found, pa.float64()), pa.array([int(x >= least) for x in found], pa.int32())]
        return pa.StructArray.from_arrays(values, ["score", "predicted"])

    return docs.withColumn(out_col, scored(F.col(text_col).cast("string")))
