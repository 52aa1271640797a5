"""Exact nearest neighbours of a whole table of queries: by blocks of matrix products, or through cells around pivots.

A block of queries goes to every task, which keeps the best rows of each query while it reads its chunks: products of matrices find
what can be among the best, and only that is scored exactly. The best of all tasks meet in lanes first, then by query. Queries come in blocks of at most
QUERY_BLOCK, each of which reads the chunks once.

With cells, chunks are laid out by their nearest pivot, and each cell knows how near and how far its chunks are from it. For a query, a cell lies at
least max(d - far, near - d, (d - d0) / 2) away, where d is the query's distance to the pivot and d0 to the nearest pivot: the first two by the triangle
inequality, the third since all its chunks are nearer to their own pivot. Cells around the query are read first; then only those that could still hold
something better than the last of the best found, so the result is that of a full scan, and a query that no cell can be cut for reads all.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources import models as M

QUERY_BLOCK, ROWS, LANES = 1024, 2048, 16
#: Pivots are fitted on at most SAMPLE rows, in a few rounds of means; there are about as many as the square root of the rows, MOST_PIVOTS at most.
SAMPLE, MOST_PIVOTS, FIT_ROUNDS = 8192, 1024, 5
FIRST_CELLS = 4
MARGIN = 1e-9


def _vectors(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.empty((0, 0))


def _gathered(queries: DataFrame) -> Iterator[tuple[list, np.ndarray]]:
    """(ids, vectors) of blocks of (query, vector)."""
    n = queries.count()
    blocks = max(1, -(-n // (QUERY_BLOCK // 2)))  # by hash, so half full on average
    for block in range(blocks):
        rows = queries.filter(F.pmod(F.xxhash64("query"), F.lit(blocks)) == block).select("query", "vector").collect()
        for a in range(0, len(rows), QUERY_BLOCK):
            part = rows[a : a + QUERY_BLOCK]
            yield [r.query for r in part], np.array([r.vector for r in part], float)


def _best_pairs(rows: DataFrame, ids: list, q: np.ndarray, k: int, cells: dict[int, np.ndarray] | None = None) -> DataFrame:
    """(query, ord, score, rank) of the ``k`` best of (ord, embedding[, cell]) for each query; with ``cells``, a row is compared with the queries of its cell only."""
    spark = rows.sparkSession
    sent = spark.sparkContext.broadcast((q, cells))  # QUERY_BLOCK vectors

    def compare(x: np.ndarray, ords: np.ndarray, which: np.ndarray, best: dict[int, tuple], q: np.ndarray) -> None:
        for a in range(0, len(x), ROWS):
            y, o = x[a : a + ROWS], ords[a : a + ROWS]
            near = 1 - ((y * y).sum(1)[:, None] - 2 * (y @ q[which].T) + (q[which] * q[which]).sum(1)[None]) / 2
            least = np.partition(near, max(0, len(y) - k), axis=0)[max(0, len(y) - k)]
            for j, i in enumerate(which):
                held = best.get(int(i))
                floor = max(least[j], held[0][-1] if held is not None and len(held[0]) == k else -np.inf)
                use = np.flatnonzero(near[:, j] >= floor - MARGIN)
                if not len(use):
                    continue
                exact = 1 - ((y[use] - q[i]) ** 2).sum(1) / 2
                s, who = (exact, o[use]) if held is None else (np.r_[held[0], exact], np.r_[held[1], o[use]])
                at = np.lexsort((who, -s))[:k]
                best[int(i)] = s[at], who[at]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, cells = sent.value
        best: dict[int, tuple] = {}
        every = np.arange(len(q))
        for b in batches:
            x, ords = _vectors(b.column("embedding")), b.column("ord").to_numpy()
            if cells is None:
                compare(x, ords, every, best, q)
                continue
            cell = b.column("cell").to_numpy()
            for c in np.unique(cell):
                if int(c) in cells:
                    compare(x[cell == c], ords[cell == c], cells[int(c)], best, q)
        for i, (s, o) in best.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(o), i)), pa.array(o), pa.array(s)], names=["i", "ord", "score"])

    columns = ["ord", "embedding", *(["cell"] if cells is not None else [])]
    found = rows.select(*columns).mapInArrow(search, "i long, ord long, score double")
    order = [F.desc("score"), "ord"]
    lane = F.pmod(F.xxhash64("ord"), F.lit(LANES))
    some = found.withColumn("lane", lane).withColumn("rank", F.row_number().over(Window.partitionBy("i", "lane").orderBy(*order))).filter(F.col("rank") <= k)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("i").orderBy(*order))).filter(F.col("rank") <= k)
    named = spark.createDataFrame(list(enumerate(ids)), "i long, query long")
    return ranked.join(F.broadcast(named), "i").select("query", "ord", "score", "rank")  # QUERY_BLOCK rows


def search_many(chunks: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """(query, ord, score, rank) of the ``k`` best of ``chunks`` (ord, embedding) for each of ``queries`` (query long, vector), by 1 - d*d/2; ties go by ord."""
    out = None
    for ids, q in _gathered(queries):
        if ids:
            found = _best_pairs(chunks, ids, q, k)
            out = found if out is None else out.unionByName(found)
    return out if out is not None else chunks.sparkSession.createDataFrame([], "query long, ord long, score double, rank int")


def retrieve(chunks: DataFrame, questions: DataFrame, model, k: int = 5) -> DataFrame:
    """search_many() for ``questions`` (query long, text), embedded by ``model`` in the executors."""
    return search_many(chunks, M.embed(questions.select("query", "text"), model).select("query", F.col("embedding").alias("vector")), k)


@dataclass
class Cells:
    """Chunks (ord, embedding, ...) under ``path`` by ``cell``, a folder for each pivot that has any; near, far and size by pivot."""

    path: str
    pivots: np.ndarray
    near: np.ndarray
    far: np.ndarray
    size: np.ndarray

    @classmethod
    def build(cls, chunks: DataFrame, path: str) -> Cells:
        """Lay ``chunks`` out. Every row is placed; only the pivots come from a sample, drawn by hash of ord."""
        n = chunks.count()
        some = chunks.select("ord", "embedding").orderBy(F.xxhash64("ord"), "ord").limit(SAMPLE).collect()
        x = np.array([r.embedding for r in some], float)
        pivots = x[: max(1, min(MOST_PIVOTS, int(np.ceil(np.sqrt(n))), len(x)))].copy()
        for _ in range(FIT_ROUNDS if len(x) else 0):
            at = _distances(x, pivots).argmin(1)
            for p in np.unique(at):
                pivots[p] = x[at == p].mean(0)

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                d = _distances(_vectors(b.column(b.schema.get_field_index("embedding"))), pivots) if b.num_rows else np.empty((0, 1))
                at = d.argmin(1)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(at), pa.array(d[np.arange(len(at)), at])], names=[*b.schema.names, "cell", "away"])

        from pyspark.sql import types as P

        schema = P.StructType([*chunks.schema.fields, P.StructField("cell", P.LongType()), P.StructField("away", P.DoubleType())])
        placed = chunks.mapInArrow(place, schema)
        placed.repartitionByRange("cell", "ord").sortWithinPartitions("cell").write.partitionBy("cell").parquet(path)
        near, far, size = np.full(len(pivots), np.inf), np.full(len(pivots), -np.inf), np.zeros(len(pivots), np.int64)
        if n:
            for r in chunks.sparkSession.read.parquet(path).groupBy("cell").agg(F.min("away").alias("near"), F.max("away").alias("far"), F.count(F.lit(1)).alias("n")).collect():  # a row a pivot
                near[r.cell], far[r.cell], size[r.cell] = r.near, r.far, r.n
        return cls(path, pivots, near, far, size)

    def search(self, queries: DataFrame, k: int = 5) -> tuple[DataFrame, dict[str, float]]:
        """search_many() through the cells, and how much of them it took: shares of the cells read, and of the pairs of query and row compared."""
        spark, out, read, compared, asked = queries.sparkSession, None, set(), 0, 0
        if not self.size.sum():
            return search_many(spark.createDataFrame([], "ord long, embedding array<float>"), queries, k), {"cells": 0.0, "pairs": 0.0}
        rows = spark.read.parquet(self.path)
        there = np.flatnonzero(self.size)
        for ids, q in _gathered(queries):
            if not ids:
                continue
            d = _distances(q, self.pivots)[:, there]
            least = np.maximum(np.maximum(d - self.far[there], self.near[there] - d), (d - d.min(1)[:, None]) / 2) - MARGIN
            order = np.argsort(d, axis=1)
            filled = np.cumsum(self.size[there][order], axis=1)
            first = np.zeros(d.shape, bool)
            for i in range(len(q)):
                enough = int(np.searchsorted(filled[i], k)) + 1
                first[i, order[i, : max(FIRST_CELLS, enough)]] = True
            begun = _best_pairs(rows.filter(F.col("cell").isin(there[first.any(0)].tolist())), ids, q, k, _by_cell(first, there)).collect()  # k rows a query
            worst = np.full(len(q), -np.inf)
            at = {query: i for i, query in enumerate(ids)}
            for r in begun:
                if r["rank"] == k:
                    worst[at[r.query]] = r.score
            radius = np.where(np.isfinite(worst), np.sqrt(np.maximum(0.0, 2 * (1 - worst))), np.inf)
            rest = (least <= radius[:, None] + MARGIN) & ~first
            found = spark.createDataFrame([(r.query, r.ord, r.score) for r in begun], "query long, ord long, score double")
            if rest.any():
                more = _best_pairs(rows.filter(F.col("cell").isin(there[rest.any(0)].tolist())), ids, q, k, _by_cell(rest, there))
                found = found.unionByName(more.select("query", "ord", "score"))
            found = found.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "ord"))).filter(F.col("rank") <= k)
            out = found if out is None else out.unionByName(found)
            used = first | rest
            read |= set(there[used.any(0)].tolist())
            compared, asked = compared + int((used * self.size[there]).sum()), asked + len(q)
        if out is None:
            return search_many(rows.limit(0), queries, k), {"cells": 0.0, "pairs": 0.0}
        return out, {"cells": len(read) / len(there), "pairs": compared / (asked * int(self.size.sum()))}


def _by_cell(wanted: np.ndarray, there: np.ndarray) -> dict[int, np.ndarray]:
    return {int(there[c]): np.flatnonzero(wanted[:, c]) for c in np.flatnonzero(wanted.any(0))}


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, (x * x).sum(1)[:, None] - 2 * (x @ y.T) + (y * y).sum(1)[None]))
