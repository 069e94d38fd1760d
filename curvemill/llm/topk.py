"""Exact top-k inner products by columnar branch-and-bound.

Vectors are kept in blocks laid out dimension by dimension. For a block of
queries, the products are summed one block of dimensions at a time; by
Cauchy-Schwarz what the remaining dimensions can still add is at most the
product of the remaining norms. Pairs that can't reach the k-th best score
found so far leave; once few are left, only these are summed further. Scores
are integers, so the result is exact.

Every block of candidates meets every block of queries once, in a task that has
some of either: both are read from the shared folder where they meet, neither
is copied for the other, shuffled or sent to the driver. A task returns k rows
for each of its queries, whatever the number of its candidates.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written
from ._bytes import small_batches

#: Rows of a block of candidates and of a block of queries, at most, and bytes of its components at 8 each.
BLOCK, QUERY_BLOCK, BLOCK_BYTES = 8192, 1024, 4 << 20
#: Blocks of a file, at most, so that small inputs are searched by several tasks.
FILE_BLOCKS = 8
#: Dimensions that are summed before pairs are dropped.
STEP = 16
#: Pairs whose products are held at once, and the share of them from which they are summed one by one.
PAIRS, FEW = 1 << 18, 0.02
_NONE = np.iinfo(np.int64).min


def quantised(vector: Column, scale: int = 256) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("bigint"))


def usable(vector: Column) -> Column:
    """Neither null nor empty nor holding a null or non-finite component."""
    whole = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) != float("inf")))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & whole, F.lit(False))


def _blocks(rows: DataFrame, size: int) -> DataFrame:
    """(dim, ids, data): rows of a dimension in blocks, made of what lies in a partition; data: one dimension after the other, in the narrowest integers."""

    def block(dim: int, ids: np.ndarray, matrix: np.ndarray) -> pa.RecordBatch:
        order = np.argsort(ids, kind="stable")
        top = int(max(matrix.max(initial=0), -1 - matrix.min(initial=0)))
        kind = next(t for t in (np.int16, np.int32, np.int64) if top <= np.iinfo(t).max)
        values = ([dim], [ids[order].tobytes()], [np.ascontiguousarray(matrix[order].T.astype(kind)).tobytes()])
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, (pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["dim", "ids", "data"])

    def pack(batches):
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for batch in batches:
            vectors, ids = batch.column(1), batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            at = vectors.offsets.to_numpy()
            values, dims = vectors.values.to_numpy(zero_copy_only=False), np.diff(at)
            for dim in np.unique(dims).tolist():
                own, most = np.flatnonzero(dims == dim), max(1, min(size, BLOCK_BYTES // (8 * max(1, dim))))
                parts = held.setdefault(dim, [])
                parts.append((ids[own], values[at[own][:, None] + np.arange(dim)]))
                if sum(len(x) for x, _ in parts) >= most:
                    named, matrix = (np.concatenate(x) for x in zip(*parts, strict=True))
                    for i in range(0, len(named) - most + 1, most):
                        yield block(dim, named[i : i + most], matrix[i : i + most])
                    left = len(named) // most * most
                    held[dim] = [(named[left:].copy(), matrix[left:].copy())]
        for dim, parts in held.items():
            named, matrix = (np.concatenate(x) for x in zip(*parts, strict=True))
            if len(named):
                yield block(dim, named, matrix)

    return rows.select("id", "vector").mapInArrow(pack, "dim int, ids binary, data binary")


class _Best:
    """The k best (score, id) of each query so far; score _NONE: not found yet."""

    def __init__(self, query_ids: np.ndarray, k: int):
        self.query_ids, self.k = query_ids, k
        self.score = np.full((len(query_ids), k), _NONE)
        self.id = np.zeros((len(query_ids), k), np.int64)

    def merge(self, row: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        """Takes in pairs of a query's row, a score and an id. Ties go to the smaller id."""
        last_score, last_id = self.score[row, -1], self.id[row, -1]
        better = (ids != self.query_ids[row]) & ((score > last_score) | (score == last_score) & (ids < last_id) | (last_score == _NONE))
        row, score, ids = row[better], score[better], ids[better]
        if not len(row):
            return
        rows = np.unique(row)
        row = np.concatenate([np.repeat(rows, self.k), row])
        score, ids = np.concatenate([self.score[rows].ravel(), score]), np.concatenate([self.id[rows].ravel(), ids])
        order = np.lexsort((ids, ~score, row))  # ~score falls as score rises, and can't overflow
        first = np.searchsorted(row[order], rows)
        take = order[first[:, None] + np.arange(self.k)]
        self.score[rows], self.id[rows] = score[take], ids[take]

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query id, id, score) of all that was found."""
        some = self.score != _NONE
        return np.broadcast_to(self.query_ids[:, None], some.shape)[some], self.id[some], self.score[some]


def _remaining(x: np.ndarray, step: int) -> np.ndarray:
    """Norms of what follows each block of dimensions, rounded up; before them that of the whole."""
    square = np.cumsum((x[::-1].astype(float)) ** 2, axis=0)[::-1]
    return np.stack([np.sqrt(square[at]) if at < len(x) else np.zeros(x.shape[1]) for at in range(0, len(x) + step, step)]) * (1 + 1e-6)


def search_block(best: _Best, ids: np.ndarray, columns: np.ndarray, queries: np.ndarray, step: int = STEP) -> None:
    """Merges a block of candidates into the best of a block of queries. columns, queries: dimensions x rows."""
    dims, n = columns.shape
    rest_a, rest_b = _remaining(columns, step), _remaining(queries, step)
    # sums of any dimensions are at most the product of norms; floats hold such integers exactly, and are much faster
    top = rest_a[0].max(initial=0) * rest_b[0].max(initial=0)
    kind, margin = (np.float32, 2) if top < 2**21 else (np.float64, 2) if top < 2**50 else (np.int64, 0)
    a, b = columns.astype(kind), queries.astype(kind)
    if kind == np.float32:
        rest_a, rest_b = rest_a.astype(kind), rest_b.astype(kind)
    steps, repeats = range(0, dims, step), int(np.unique(ids, return_counts=True)[1].max(initial=0))
    for start in range(0, queries.shape[1], each := max(1, PAIRS // max(1, n))):
        part = slice(start, start + each)
        last = best.score[part, -1]
        least = np.where(last == _NONE, -np.inf, last.astype(float) - np.abs(last.astype(float)) * 1e-7).astype(rest_a.dtype)
        score = b[:step, part].T @ a[:step]
        alive, s = np.ones(score.shape, bool), 0
        new = np.flatnonzero(last == _NONE)
        for s, at in enumerate(steps, 1):
            if at:
                score += b[at : at + step, part].T @ a[at : at + step]
            reach = rest_b[s, part, None] * rest_a[s]
            if len(new) and n > (k := best.k + repeats) and (s & (s - 1) == 0 or s == len(steps)):  # the query's own rows may be among these
                lowest = np.partition(score[new] - reach[new], n - k, axis=1)[:, n - k]
                least[new] = np.maximum(least[new], lowest - (margin + np.abs(lowest) * 1e-7))
            reach += score
            reach += margin
            alive = reach >= least[:, None]
            if np.count_nonzero(alive) <= FEW * alive.size:
                break
        row, column = np.nonzero(alive)
        sums = score[row, column]
        for s, at in list(enumerate(steps, 1))[s:]:
            if not len(row):
                break
            sums = sums + np.einsum("ij,ij->j", a[at : at + step, column], b[at : at + step, row + start])
            stay = sums + rest_b[s, row + start] * rest_a[s, column] + margin >= least[row]
            row, column, sums = row[stay], column[stay], sums[stay]
        best.merge(row + start, sums.astype(np.int64), ids[column])


def top_k(vectors: DataFrame, is_query: Column, *, k: int = 5, block: int = BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, rank from 1, vec_id, score): the k highest integer inner products of each query.

    ``vectors`` has id (bigint) and vector (array of bigint, no nulls). Ties go
    to the smaller id. Rows with the query's id are its own and take no part, so
    a repeated id never finds itself; of its vectors the least is the query. Other repeated rows stay candidates.
    Vectors meet those of the same dimension only. Null ids take no part.
    """
    small_batches(vectors.sparkSession)
    rows = vectors.select("id", "vector").where("id is not null")
    asked = rows.where(is_query).groupBy("id").agg(F.min("vector").alias("vector"))
    left = written(_blocks(rows, block), "candidates", maxRecordsPerFile=FILE_BLOCKS)
    right = written(_blocks(asked, query_block), "queries", maxRecordsPerFile=FILE_BLOCKS)

    def search(batches):
        best: dict[tuple[int, bytes], _Best] = {}
        for batch in batches:
            for row in (x for i in range(batch.num_rows) for x in batch.slice(i, 1).to_pylist()):
                ids, query_ids = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["query_ids"], np.int64)
                columns, queries = (np.frombuffer(x, f"i{len(x) // (row['dim'] * n) if row['dim'] else 8}").reshape(row["dim"], n) for x, n in ((row["data"], len(ids)), (row["query_data"], len(query_ids))))
                key = row["dim"], row["query_ids"]
                if key not in best:
                    best[key] = _Best(query_ids, k)
                search_block(best[key], ids, columns, queries)
        for own in best.values():
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in own.found()], names=["query_id", "vec_id", "score"])

    asks = right.select("dim", F.col("ids").alias("query_ids"), F.col("data").alias("query_data"))
    # the hint keeps Spark from a broadcast, which it would choose by the size of files
    met = left.join(asks.hint("shuffle_replicate_nl"), "dim").select("dim", "ids", "data", "query_ids", "query_data")
    found = met.mapInArrow(search, "query_id bigint, vec_id bigint, score bigint")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark, sf_dir):
    """op8: vectors whose id is divisible by 50 against all."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").where(usable(F.col("embedding"))).select(F.col("vec_id").alias("id"), quantised(F.col("embedding")).alias("vector"))
    return top_k(rows, F.col("id") % 50 == 0)


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score FROM v q, v c WHERE q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, rank::INTEGER AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""
