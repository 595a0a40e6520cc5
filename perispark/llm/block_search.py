"""Nearest neighbours by a block matrix join with int8 tiles.

Queries and vectors are packed into blocks of bounded rows; each pair of a query block
and a vector block makes one tile. A vector is scale * int8 + error with its error's
norm kept, so a tile's integer products give bounds on all its distances. Pairs whose
lower bound exceeds the query's k-th least upper bound in the tile fall; the others are
computed again from the original numbers, in double precision, and a heap for each
query keeps the tile's k nearest. Spark merges the tiles' lists.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK = "dim int, ids binary, vectors binary, n int"
#: Vector blocks of one share; each share gets a copy of every query block.
SHARE = 16


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 rows, their scales, and the norm of what rounding left."""
    scale = np.maximum(np.abs(x).max(axis=1), 1e-300) / 127
    q = np.rint(x / scale[:, None])
    return q, scale, np.sqrt(((x - q * scale[:, None]) ** 2).sum(axis=1))


def tile_bounds(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of squared distances between the rows of a and of b, in units of a power
    of four that all pairs share, so that neither huge nor tiny numbers leave the range."""
    unit = 2.0 ** -np.frexp(max(np.abs(a).max(), np.abs(b).max()))[1]
    a, b = a * unit, b * unit
    (qa, sa, ea), (qb, sb, eb) = quantised(a), quantised(b)
    # products of int8 are whole numbers below 2**24 for up to 1,040 dimensions: exact in float32
    kind = np.float32 if a.shape[1] <= 1040 else np.float64
    product = (qa.astype(kind) @ qb.astype(kind).T).astype(float) * sa[:, None] * sb[None, :]
    na, nb = np.sqrt((a * a).sum(axis=1)), np.sqrt((b * b).sum(axis=1))
    error = na[:, None] * eb[None, :] + ea[:, None] * (nb + eb)[None, :]
    near = na[:, None] ** 2 + nb[None, :] ** 2 - 2 * product
    slack = 2 * error + 1e-9 * (na[:, None] + nb[None, :]) ** 2
    return near - slack, near + slack


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of rows pair by pair, summed one dimension after another; where the
    squares leave the range of doubles, in units of the largest difference."""
    total = np.zeros(len(a))
    with np.errstate(over="ignore"):
        for j in range(a.shape[1]):
            total += (a[:, j] - b[:, j]) ** 2
    out = np.sqrt(total)
    for i in np.flatnonzero(~((total > 1e-290) & (total < np.inf))):
        largest = np.abs(a[i] / 2 - b[i] / 2).max()
        if largest > 0:
            out[i] = 2 * largest * np.sqrt((((a[i] / 2 - b[i] / 2) / largest) ** 2).sum())
    return out


def tile(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int) -> list[tuple[int, int, float]]:
    """query, vector, distance: each query's k nearest of the block other than itself."""
    low, high = tile_bounds(queries, vectors)
    itself = query_ids[:, None] == ids[None, :]
    high[itself] = np.inf
    limit = np.partition(high, k - 1, axis=1)[:, k - 1] if high.shape[1] > k else np.full(len(high), np.inf)
    i, j = np.nonzero((low <= limit[:, None]) & ~itself)
    exact = distances(queries[i], vectors[j])
    out, starts = [], np.searchsorted(i, np.arange(len(queries) + 1))
    for q in range(len(queries)):
        s, e = starts[q], starts[q + 1]
        best = heapq.nsmallest(k, zip(exact[s:e].tolist(), ids[j[s:e]].tolist(), strict=True))
        out += [(int(query_ids[q]), v, d) for d, v in best]
    return out


def _packed(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    held: dict[int, list[tuple[int, np.ndarray]]] = {}

    def out(part: list[tuple[int, np.ndarray]], dim: int) -> pa.RecordBatch:
        ids, vectors = np.array([i for i, _ in part], np.int64), np.stack([v for _, v in part])
        values = ((dim, pa.int32()), (ids.tobytes(), pa.binary()), (vectors.tobytes(), pa.binary()), (len(part), pa.int32()))
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in values], ["dim", "ids", "vectors", "n"])

    for batch in batches:
        for i, v in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            x = v.values.to_numpy(zero_copy_only=False).astype(float)
            part = held.setdefault(len(x), [])
            part.append((i, x))
            if len(part) >= rows:
                yield out(part, len(x))
                part.clear()
    for dim, part in held.items():
        if part:
            yield out(part, dim)


def nearest(
    queries: DataFrame, vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 10,
    query_block: int = 1024, vector_block: int = 4096,
) -> DataFrame:
    """Each query's k nearest vectors other than those of its own id: query_id, rank, vec_id, score.

    score is the Euclidean distance in double precision; ties go to the smaller vec_id.
    Vectors that are null, empty, zero, or hold null or non-finite numbers take no part,
    nor do null ids; vectors of other lengths are not compared. Repeated rows of one
    (id, vector) count once as a query; as vectors they are ranked each. Empty tables
    give no rows; other columns aren't read.

    Scale: every tile is one unit of work of bounded memory; query blocks are copied to
    the vector blocks by a join on the numbers of shares, so neither side must fit a task.
    There are as many shares as cores, and more where a share would have over SHARE blocks.
    """
    spark = queries.sparkSession
    numbers = F.col(vector_col)
    finite = ~F.exists(numbers, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    fit = F.col(id_col).isNotNull() & numbers.isNotNull() & finite & F.exists(numbers, lambda x: x != 0)

    def blocks(df: DataFrame, rows: int) -> DataFrame:
        plain = df.filter(fit).select(F.col(id_col).cast("long").alias("id"), numbers.cast("array<double>").alias("x"))
        return plain.mapInArrow(lambda it: _packed(it, rows), BLOCK)

    n_blocks = -(-vectors.count() // vector_block)
    salts = max(1, min(n_blocks, max(spark.sparkContext.defaultParallelism, -(-n_blocks // SHARE))))
    asked = queries.filter(fit).select(F.col(id_col), numbers).distinct()
    left = blocks(asked, query_block).select("dim", F.col("ids").alias("query_ids"), F.col("vectors").alias("queries"))
    left = left.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    right = blocks(vectors, vector_block).withColumn("salt", F.pmod(F.xxhash64("ids"), F.lit(salts)))

    def tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = ("dim", "query_ids", "queries", "ids", "vectors")
            for dim, query_ids, q, ids, v in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
                a, b = np.frombuffer(query_ids, np.int64), np.frombuffer(ids, np.int64)
                rows = tile(a, np.frombuffer(q).reshape(-1, dim), b, np.frombuffer(v).reshape(-1, dim), k)
                cols = list(zip(*rows, strict=True)) or [[]] * 3
                kinds = (pa.int64(), pa.int64(), pa.float64())
                columns = [pa.array(c, t) for c, t in zip(cols, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, ["query_id", "vec_id", "score"])

    near = left.join(right, ["dim", "salt"]).mapInArrow(tiles, "query_id bigint, vec_id bigint, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return near.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
