"""Target-distribution importance resampling: documents drawn towards a target text's n-grams.

A task lower-cases A-Z, collapses every run of separators to one space and puts one at both
ends; an overlapped regex scan then gives the span of each n-gram between boundaries, whose
bytes are counted by CRC. The raw corpus and the target are two histograms of hashed n-grams;
a bucket's gain is the logarithm of their smoothed ratio, a document's weight the mean gain
of its n-grams. Gumbel noise from a hash of the id makes the highest scores a weighted draw
without replacement; places are given by a range-partitioned sort.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from perispark.llm.common import Scratch, slices
from perispark.operators.ordering import numbered

#: Bytes of words as they are, all others as a space; A-Z come as a-z.
_SPACED = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256))
_SEPARATORS = regex.compile(rb" {2,}")
#: Histograms and gains take this many bytes a bucket; the bound keeps them small enough to send.
MOST_BUCKETS = 1 << 20


#: A word between boundaries (group 2) and, where one follows, the pair that it begins (group 1).
PAIR = regex.compile(rb" (([^ ]+)(?: [^ ]+)?)(?= )")


@functools.cache
def grams(n: int) -> regex.Pattern:
    """Spans of n words between boundaries."""
    return regex.compile(rb"(?<= )[^ ]+(?: [^ ]+){%d}(?= )" % (n - 1))


def spaced(text: str | None) -> bytes:
    """The words of a text in lower case with one space before, between and after them."""
    if not text:
        return b" "
    return _SEPARATORS.sub(b" ", b" " + text.encode("utf-8", "surrogatepass").lower().translate(_SPACED) + b" ")


def hashes(text: str | None, n: int, buckets: int) -> tuple[int, np.ndarray]:
    """The number of words, and the bucket of each run of 1 to n consecutive words. Scans are overlapped:
    each word begins a span, whether or not the span before covers it."""
    line, crc, found, words = spaced(text), zlib.crc32, [], 0
    add = found.append
    for m in PAIR.finditer(line, overlapped=True):
        both, word = m[1], m[2]
        words += 1
        add(crc(word))
        if n > 1 and len(both) > len(word):
            add(crc(both))
    for k in range(3, n + 1):
        found += [crc(m[0]) for m in grams(k).finditer(line, overlapped=True)]
    return words, (np.array(found, np.uint32) % buckets).astype(np.int32)


def _hashed(batches: Iterator[pa.RecordBatch], n: int, buckets: int, least: int) -> Iterator[pa.RecordBatch]:
    """id, number of features, enough words?, the features' buckets as bytes of int32 (uint16 where they fit)."""
    kind = np.uint16 if buckets <= 1 << 16 else np.int32
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1)
        for part in slices(texts):
            counts, enough, data = [], [], []
            for text in texts[part].to_pylist():
                words, found = hashes(text, n, buckets)
                counts.append(len(found))
                enough.append(words >= least)
                data.append(found.astype(kind).tobytes())
            yield pa.RecordBatch.from_arrays(
                [ids[part], pa.array(counts, pa.int64()), pa.array(enough, pa.bool_()), pa.array(data, pa.binary())],
                ["id", "n_features", "enough", "buckets"])


def _histogram(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """bucket, count over the task's rows."""
    kind = np.uint16 if buckets <= 1 << 16 else np.int32
    counts = np.zeros(buckets, np.int64)
    for batch in batches:
        for data in batch.column(0):
            counts += np.bincount(np.frombuffer(data.as_buffer() or b"", kind), minlength=buckets)
    some = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(counts[some])], ["bucket", "n"])


def _weighed(batches: Iterator[pa.RecordBatch], gains: np.ndarray, kind: type) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sums = [int(gains[np.frombuffer(x.as_buffer() or b"", kind)].sum()) for x in batch.column(3)]
        weight = [s // n if n else 0 for s, n in zip(sums, batch.column(1).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(weight, pa.int64())], ["id", "n_features", "enough", "weight"])


def resample(
    docs: DataFrame, target: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text",
    n: int = 2, buckets: int = 10_000, share: int = 25, least_words: int = 20, seed: int = 7,
) -> DataFrame:
    """(id, n_features, weight, score, rank) for every row of docs, all long but the id.

    Features are all runs of 1 to n consecutive words, words being runs of ASCII letters and digits and
    of anything that isn't ASCII, with A-Z in lower case. A bucket's gain is floor(1000 ln((t+1)(S+B) /
    ((s+1)(T+B)))), for s of the corpus's S features and t of the target's T in it, of B buckets; a
    document's weight is the floored mean of its features' gains (0 without any). Its score adds
    floor(-1000 ln(-ln((h + 0.5) / 2^32))), h being the first eight hex digits of sha256("seed:id").
    Of the rows of least_words words or more, floor(share percent) of the highest scores have a rank from
    1, ties to the smaller id; others have none.

    Null texts count as empty; a null id hashes as an empty one and comes first among ties. Repeated
    rows are rows of their own, of which any may come first. Empty tables give empty results; an empty
    target has t = T = 0. Columns of docs other than id and text are not kept, so no name clashes.

    Scale: one scan of each text, which leaves two bytes a feature in the shared folder; histograms are
    added up per task and per bucket before they meet in the driver, ``buckets`` numbers; ranks by a
    range-partitioned sort of ids and scores.
    """
    if not 1 <= buckets <= MOST_BUCKETS or n < 1:
        raise ValueError(f"buckets must be 1 to {MOST_BUCKETS} and n at least 1")
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    ids = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = T.StructType([ids.schema["id"]]).add("n_features", "long").add("enough", "boolean").add("buckets", "binary")
    hashed = scratch.written(ids.mapInArrow(lambda it: _hashed(it, n, buckets, least_words), schema), "importance-hashed")
    aims = target.select(F.lit(0).alias("id"), F.col(target_col).cast("string").alias("text"))
    aims = aims.mapInArrow(lambda it: _hashed(it, n, buckets, 0), "id int, n_features bigint, enough boolean, buckets binary")

    def histogram(rows: DataFrame) -> np.ndarray:
        parts = rows.select("buckets").mapInArrow(lambda it: _histogram(it, buckets), "bucket int, n bigint")
        out = np.zeros(buckets, np.int64)
        for bucket, count in parts.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # one row a bucket
            out[bucket] = count
        return out

    s, t = histogram(hashed).astype(np.float64), histogram(aims).astype(np.float64)
    total = (s.sum() + buckets, t.sum() + buckets)
    gains = np.floor(1000 * np.log((t + 1) * total[0] / ((s + 1) * total[1]))).astype(np.int64)
    sent, kind = spark.sparkContext.broadcast(gains), np.uint16 if buckets <= 1 << 16 else np.int32
    kept = T.StructType([ids.schema["id"]]).add("n_features", "long").add("enough", "boolean").add("weight", "long")
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10)
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h.cast("double") + 0.5) / F.lit(4294967296.0))))
    scored = hashed.mapInArrow(lambda it: _weighed(it, sent.value, kind), kept).withColumn("score", F.col("weight") + noise)
    scored = scratch.result(scored, "importance-scored")  # the features are read no more
    drawn = scored.filter("enough").count() * share // 100
    placed = numbered(scored.filter("enough"), [F.col("score").desc(), F.col("id").asc_nulls_first()], out="rank")
    rank = F.when(F.col("rank") < drawn, F.col("rank") + 1)
    every = placed.withColumn("rank", rank).unionByName(scored.filter("NOT enough").withColumn("rank", F.lit(None).cast("long")))
    return every.select(F.col("id").alias(id_col), "n_features", "weight", "score", "rank")
