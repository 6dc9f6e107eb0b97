"""Exact top-k search by integer inner product: columnar branch-and-bound.

Vectors are laid out by dimension. For each query the scores of a block of candidates grow a few dimensions at a time;
what the rest can still add is at most the product of the remaining lengths of the two vectors (Cauchy-Schwarz), so
candidates that can't reach the k best are dropped and the survivors compacted. The dimensions with the largest squares
come first. Queries are taken in blocks of bounded size, one at a time, each sent to all tasks and dropped when its results are
stored; every task keeps k rows a query.

Vectors that are null, hold null or non-finite components, or have no id take no part; nor do, for a query, vectors of
another length or with its own id. Repeated rows each count as candidates; queries of one id that are equal once quantised
count once, and of those that aren't the best are ranked together. Scores outside
64 bits are held at its ends. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import narrow, scratch, written

#: Queries sent to the tasks at once and their bytes, candidates in a block, dimensions in a step.
QUERIES, BYTES, CANDIDATES, STEP = 16_384, 64 << 20, 8_192, 8
FOUND = "query_id long, vec_id long, score long"
LONG = np.iinfo(np.int64)


def quantized(ids: pa.Array, vectors: pa.Array, scale: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """ids and floor(scale * x) as float64, a pair for each length of vectors that occurs."""
    vectors = vectors.filter(ids.is_valid())
    ids = ids.filter(ids.is_valid())
    vectors, ids = vectors.filter(vectors.is_valid()), ids.filter(vectors.is_valid()).to_numpy(zero_copy_only=False)
    if not len(ids):
        return
    offsets = np.asarray(vectors.offsets)
    flat = vectors.values.cast(pa.float64()).to_numpy(zero_copy_only=False)  # null becomes NaN
    sizes = np.diff(offsets)
    for n in np.unique(sizes):
        at = np.flatnonzero(sizes == n)
        m = np.floor(scale * flat[offsets[at][:, None] + np.arange(n)])
        ok = np.isfinite(m).all(axis=1)
        if ok.any():
            yield ids[at[ok]].astype(np.int64), m[ok]


class Best:
    """The k best of one query: higher scores first, then smaller ids."""

    def __init__(self, k: int):
        self.k, self.ids, self.scores = k, np.empty(0, np.int64), np.empty(0, np.int64)

    def add(self, ids: np.ndarray, scores: np.ndarray) -> None:
        ids, scores = np.concatenate([self.ids, ids]), np.concatenate([self.scores, scores])
        first = np.lexsort((ids, -scores.astype(np.float64) if len(scores) and np.abs(scores.astype(np.float64)).max() < 2**53 else [-int(x) for x in scores]))[: self.k]
        self.ids, self.scores = ids[first], scores[first]

    @property
    def least(self) -> float:
        return float(self.scores[-1]) if len(self.ids) == self.k else -np.inf


def exact(q: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Inner products of q with the rows of m, as integers whatever their size."""
    return np.array([min(max(sum(int(a) * int(b) for a, b in zip(q, row, strict=True)), LONG.min), LONG.max) for row in m], dtype=np.int64)


def search_block(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, m: np.ndarray, best: list[Best]) -> None:
    """Brings the queries' best up to date with one block of candidates."""
    order = np.argsort(-(m**2).sum(axis=0), kind="stable")
    m, queries = np.ascontiguousarray(m[:, order].T), queries[:, order]
    dims = len(order)
    if dims * np.abs(m).max(initial=0) * np.abs(queries).max(initial=0) >= 2**53:
        for q, own, b in zip(queries, query_ids, best, strict=True):
            other = ids != own
            b.add(ids[other], exact(q, m.T[other]))
        return
    cuts = [*range(0, dims, STEP)]
    left = lambda x, axis: [np.sqrt((x[i + STEP :] ** 2 if axis else x[:, i + STEP :] ** 2).sum(axis=0 if axis else 1)) for i in cuts]
    rest_m, rest_q = left(m, True), left(queries, False)
    for j, (q, own, b) in enumerate(zip(queries, query_ids, best, strict=True)):
        alive = np.flatnonzero(ids != own)
        score, part, rows = np.zeros(len(alive)), m, alive
        for step, i in enumerate(cuts):
            score = score + q[i : i + STEP] @ part[i : i + STEP, rows]
            if i + STEP >= dims:
                break
            reach = rest_q[step][j] * rest_m[step][alive] * (1 + 1e-9) + 0.5
            floor = b.least
            if len(score) > b.k:
                floor = max(floor, np.partition(score - reach, -b.k)[-b.k])
            keep = score + reach >= floor
            if keep.mean() < 0.8:
                alive, score, rows = alive[keep], score[keep], rows[keep]
                if len(rows) * 4 < part.shape[1]:
                    part, rows = np.ascontiguousarray(part[:, rows]), np.arange(len(rows))
        b.add(ids[alive], score.astype(np.int64))


def asked(df: DataFrame, scale: float) -> DataFrame:
    """Quantised queries (vec_id, vector as binary of 64-bit floats) without repeats: rows of one id that are equal once quantised
    are one query. df: vec_id, embedding."""

    def task(batches):
        for b in batches:
            for i in range(0, b.num_rows, CANDIDATES):
                part = b.slice(i, CANDIDATES)
                for ids, m in quantized(part.column(0), part.column(1), scale):
                    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array([(row + 0.0).tobytes() for row in m], pa.binary())], ["vec_id", "vector"])

    return df.mapInArrow(task, "vec_id long, vector binary").distinct()


def blocks(queries: DataFrame) -> Iterator[list[tuple[np.ndarray, np.ndarray]]]:
    """The queries, ids and vectors by length, in blocks of at most QUERIES rows and BYTES bytes (one row at least). The driver
    holds a block and the partition at hand."""
    held: dict[int, list] = {}
    n = size = 0

    def block():
        return [(np.array([k for k, _ in own], np.int64), np.frombuffer(b"".join(v for _, v in own)).reshape(len(own), -1)) for _, own in sorted(held.items())]

    for r in queries.toLocalIterator():
        if n and (n == QUERIES or size + len(r.vector) > BYTES):
            yield block()
            held, n, size = {}, 0, 0
        held.setdefault(len(r.vector), []).append((r.vec_id, r.vector))
        n, size = n + 1, size + len(r.vector)
    if n:
        yield block()


def ranked(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank.cast("int")).filter(F.col("rank") <= k)


def search(vectors: DataFrame, is_query: Column, k: int = 5, scale: float = 256.0, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for each row that is_query picks (over columns vec_id, embedding), its k best among all rows."""
    spark = vectors.sparkSession
    df = narrow(vectors, id, vector).toDF("vec_id", "embedding")
    queries = written(spark, asked(df.filter(is_query & F.col("embedding").isNotNull()), scale), "queries")
    path = scratch(spark, "best")
    ranked(spark.createDataFrame([], FOUND), k).drop("rank").write.parquet(path)
    for block in blocks(queries):
        held = spark.sparkContext.broadcast(block)

        def task(batches, held=held):
            best = [[Best(k) for _ in ids] for ids, _ in held.value]

            def run(rows):
                table = pa.Table.from_batches(rows).combine_chunks()
                for ids, m in quantized(table.column(0).combine_chunks(), table.column(1).combine_chunks(), scale):
                    for (query_ids, own), b in zip(held.value, best, strict=True):
                        if own.shape[1] == m.shape[1]:
                            search_block(query_ids, own, ids, m, b)

            rows, n = [], 0
            for batch in batches:
                for i in range(0, batch.num_rows, CANDIDATES):
                    rows.append(batch.slice(i, CANDIDATES))
                    n += rows[-1].num_rows
                    if n >= CANDIDATES:
                        run(rows)
                        rows, n = [], 0
            if rows:
                run(rows)
            for (query_ids, _), b in zip(held.value, best, strict=True):
                n = [len(x.ids) for x in b]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(query_ids, n)), pa.array(np.concatenate([x.ids for x in b])), pa.array(np.concatenate([x.scores for x in b]))], ["query_id", "vec_id", "score"])

        ranked(df.mapInArrow(task, FOUND), k).drop("rank").write.mode("append").parquet(path)
        held.destroy()
    # An id whose rows differ is several queries, also of several blocks: their best are ranked together.
    return ranked(spark.read.schema(FOUND).parquet(path), k).select("query_id", "rank", "vec_id", "score")
