"""Toxicity by multiple-instance learning: sentences are the instances, documents the bags.

A sentence's score is logistic over hashed word features (the word and its first four
to six letters); a document is toxic unless all its sentences are clean, so its score is
the noisy-or of theirs. Only documents have labels: the gradient of the document's
likelihood is shared among its sentences by their own scores, which also tells the
offending sentences apart.

Training takes at most ``max_rows`` labelled documents of each class, chosen by a hash
of the id. Their features are a table in the shared folder; a feature counts only if its
document frequency differs between the classes by ``least_g`` in the G-test. Each step's
gradient is summed by tasks over what is left. Scoring is one scan of all texts with no
shuffle.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perispark.llm.common import Scratch, held_out, list_array, slices, small_batches

SENTENCE = re.compile(r"[^.!?\n]*[.!?\n]?")
WORD = re.compile(r"[^\W_]+")
DIM = 1 << 18
PREFIXES = (4, 5, 6)
#: Words kept in a task's cache before it is emptied.
CACHE = 100_000
OFFENDING = "array<struct<start:bigint,end:bigint,score:double>>"


def sentences(text: str) -> list[tuple[int, int]]:
    """Spans that end after . ! ? or a line end; together they are the whole text."""
    return [m.span() for m in SENTENCE.finditer(text) if m.end() > m.start()]


def features(word: str) -> tuple[int, ...]:
    names = [f"w{word}", *(f"{k}{word[:k]}" for k in PREFIXES if len(word) >= k)]
    return tuple(zlib.crc32(x.encode("utf-8", "surrogatepass")) % DIM for x in names)


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """label, features of all sentences one after another, where each sentence begins."""
    cache: dict[str, tuple[int, ...]] = {}
    for batch in batches:
        for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            flat: list[int] = []
            starts = []
            for s, e in sentences(text or "") or [(0, 0)]:
                starts.append(len(flat))
                for w in WORD.findall((text or "")[s:e].lower()):
                    if (f := cache.get(w)) is None:
                        f = cache[w] = features(w)
                    flat += f
            if len(cache) > CACHE:
                cache.clear()
            one = lambda x: list_array(pa.array(np.array(x, np.int32)), [0, len(x)])
            yield pa.RecordBatch.from_arrays([pa.array([float(label)]), one(flat), one(starts)], ["label", "features", "starts"])


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """feature, and the clean and toxic documents that hold it."""
    counts = np.zeros((2, DIM), np.int64)
    for batch in batches:
        for label, flat in zip(batch.column(0).to_numpy(), batch.column(1), strict=True):
            counts[int(label), np.unique(flat.values.to_numpy())] += 1
    keys = np.flatnonzero(counts.sum(axis=0))
    yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts[0, keys]), pa.array(counts[1, keys])],
        ["feature", "clean", "toxic"])


def _kept(batches: Iterator[pa.RecordBatch], chosen: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Bags of the chosen features, numbered anew; the sentences without any only as a number."""
    number = np.full(DIM, -1, np.int32)
    number[chosen] = np.arange(len(chosen))
    for batch in batches:
        for label, flat, starts in zip(batch.column(0).to_numpy(), batch.column(1), batch.column(2), strict=True):
            ids, at = number[flat.values.to_numpy()], starts.values.to_numpy()
            sentence = np.repeat(np.arange(len(at)), np.diff(np.append(at, len(ids))))[ids >= 0]
            some, first = np.unique(sentence, return_index=True)
            one = lambda x: list_array(pa.array(x.astype(np.int32)), [0, len(x)])
            yield pa.RecordBatch.from_arrays([pa.array([label]), one(ids[ids >= 0]), one(first), pa.array([len(at) - len(some)])],
                ["label", "features", "starts", "empty"])


def _gradient(batches: Iterator[pa.RecordBatch], weights: np.ndarray, bias: float) -> Iterator[pa.RecordBatch]:
    """Sums over bags of the log-likelihood's gradient; the last is the bias's."""
    grad, rows = np.zeros(len(weights) + 1), 0
    for batch in batches:
        for label, flat, starts, empty in zip(batch.column(0).to_numpy(), batch.column(1), batch.column(2), batch.column(3).to_numpy(),
            strict=True):
            ids, at = flat.values.to_numpy(), starts.values.to_numpy()
            sums = np.concatenate(([0.0], np.cumsum(weights[ids])))
            ends = np.append(at[1:], len(ids)) if len(at) else at
            z = np.append(sums[ends] - sums[at], 0.0) + bias
            p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            times = np.append(np.ones(len(at)), empty)
            clean = float((times * np.log1p(-p)).sum())
            share = p * np.exp(clean) / max(-np.expm1(clean), 1e-12) if label else -p
            grad[:-1] += np.bincount(ids, np.repeat(share[:-1], ends - at), len(weights))
            grad[-1] += float((share * times).sum())
            rows += 1
    yield pa.RecordBatch.from_arrays([pa.array([grad.tobytes()], pa.binary()), pa.array([rows])], ["grad", "rows"])


class Model:
    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias, self.cache = weights, bias, {}

    def word(self, w: str) -> float:
        if (x := self.cache.get(w)) is None:
            if len(self.cache) > CACHE:
                self.cache.clear()
            x = self.cache[w] = float(self.weights[list(features(w))].sum())
        return x

    def instances(self, text: str) -> tuple[list[tuple[int, int]], np.ndarray]:
        """Each sentence's span and score; an empty text is one empty sentence."""
        where = sentences(text) or [(0, 0)]
        z = np.array([sum(map(self.word, WORD.findall(text[s:e].lower()))) for s, e in where]) + self.bias
        return where, 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def score(self, text: str) -> float:
        """The document's score: the noisy-or of its sentences'."""
        return noisy_or(self.instances(text)[1])


def noisy_or(p: np.ndarray) -> float:
    return float(-np.expm1(np.log1p(-p).sum()))


def train(
    docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
    modulus: int = 5, remainder: int = 0, max_rows: int = 4000, least_g: float = 15.0,
    steps: int = 30, rate: float = 0.5, decay: float = 1e-4,
) -> Model:
    """Learn from labelled documents that aren't held out; a class without rows gives a constant model.

    Rows with a null id or label are left out, of several labels of one id the largest counts.
    """
    known = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y")).filter("_id IS NOT NULL AND _y IN (0, 1)")
    known = (
        known.filter(~held_out(F.col("_id"), modulus, remainder)).groupBy("_id").agg(F.max("_y").alias("_y")).withColumn("_h",
        F.xxhash64("_id")))
    chosen = None
    for y in (0, 1):
        part = known.filter(F.col("_y") == y).orderBy("_h", "_id").limit(max_rows)
        chosen = part if chosen is None else chosen.unionByName(part)
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    rows = texts.join(F.broadcast(chosen.select("_id", "_y")), "_id")  # max_rows ids of each class
    scratch = Scratch(docs.sparkSession)
    bags = (
        scratch.written(
        rows.repartition("_id").select("_text", "_y").mapInArrow(_bags, "label double, features array<int>, starts array<int>"),
        "toxicity-bags"))
    counts = bags.agg(F.count_if(F.col("label") == 0).alias("clean"), F.count_if(F.col("label") == 1).alias("toxic")).first()
    weights, bias = np.zeros(DIM), -5.0
    if not counts.clean or not counts.toxic:
        scratch.delete(scratch.paths)
        return Model(weights, 30.0 if counts.toxic else -30.0)
    seen = (
        bags.mapInArrow(_frequencies, "feature bigint, clean bigint, toxic bigint").groupBy("feature").agg(F.sum("clean").alias("clean"),
        F.sum("toxic").alias("toxic")))
    both, here = F.col("clean") + F.col("toxic"), lambda n, share: F.when(n > 0, n * F.log(n / share)).otherwise(0.0)
    part = counts.toxic / (counts.toxic + counts.clean)
    g = 2 * (here(F.col("toxic"), both * part) + here(F.col("clean"), both * (1 - part)))
    chosen = np.array(sorted(r.feature for r in seen.filter(g >= least_g).select("feature").collect()), np.int64)  # at most DIM
    send = docs.sparkSession.sparkContext.broadcast
    sent = send(chosen)
    small = (scratch.written(bags.mapInArrow(lambda it: _kept(it, sent.value), "label double, features array<int>, starts array<int>, "
        "empty bigint"), "toxicity-kept"))
    m = v = np.zeros(len(chosen) + 1)
    x = np.append(np.zeros(len(chosen)), bias)
    for t in range(1, steps + 1):
        parts = small.mapInArrow(lambda it, x=x: _gradient(it, x[:-1], x[-1]), "grad binary, rows bigint").collect()
        grad = sum(np.frombuffer(r.grad) for r in parts) / max(1, sum(r.rows for r in parts)) - decay * np.append(x[:-1], 0)
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        x = x + rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-6)
    scratch.delete(scratch.paths)
    weights[chosen] = x[:-1]
    return Model(weights, float(x[-1]))


def _scored(texts: pa.Array, model: Model, least: float | None) -> pa.Array:
    scores, starts, ends, each, offsets = [], [], [], [], [0]
    for part in slices(texts):
        for text in texts[part].to_pylist():
            where, p = model.instances(text or "")
            scores.append(noisy_or(p))
            if least is not None:
                for i in np.flatnonzero(p >= least):
                    starts.append(where[i][0])
                    ends.append(where[i][1])
                    each.append(float(p[i]))
                offsets.append(len(starts))
    columns = [pa.array(scores, pa.float64()), pa.array([int(x >= 0.5) for x in scores], pa.int32())]
    names = ["score", "predicted"]
    if least is not None:
        spans = [pa.array(starts, pa.int64()), pa.array(ends, pa.int64()), pa.array(each, pa.float64())]
        columns.append(list_array(pa.StructArray.from_arrays(spans, ["start", "end", "score"]), offsets))
        names.append("offending")
    return pa.StructArray.from_arrays(columns, names)


def score_documents(docs: DataFrame, model: Model, *, text_col: str = "text", least: float | None = 0.5) -> DataFrame:
    """docs with the added column ``toxicity``: struct(score, predicted, offending), where
    offending lists struct(start, end, score) of the sentences of ``least`` and above; with
    least None the struct has no such field.

    Null texts count as empty, and an empty text as one sentence without words. Rows are
    scored alone: repeated rows give repeated results, an empty table none. An existing
    column named toxicity is replaced; other columns stay.

    Scale: one scan, no shuffle; only the text goes to Python, about 1 MB of it at a time
    as strings, and only results come back.
    """
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kind = "score double, predicted int" + (f", offending {OFFENDING}" if least is not None else "")

    @F.arrow_udf(kind)
    def scored(texts: pa.Array) -> pa.Array:
        return _scored(texts, sent.value, least)

    return docs.withColumn("toxicity", scored(F.col(text_col).cast("string")))
