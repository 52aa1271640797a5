"""Search for tables of queries, plain and through cells, against all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.operators import retrieval as R
from quire.operators import search as K
from quire.sources import models as M
from quire.sources import scratch as W

CHUNK, QUERY = "ord long, embedding array<float>", "query long, vector array<float>"


def unit(x):
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@pytest.fixture(scope="module")
def groups():
    """Vectors around forty places, with repeated ones among them, and 100 queries."""
    rng = np.random.default_rng(4)
    places = unit(rng.normal(size=(40, 16)))
    x = unit(places[rng.integers(0, 40, 3000)] + 0.08 * rng.normal(size=(3000, 16))).astype(np.float32)
    x[100:140] = x[7]
    return x, unit(places[rng.integers(0, 40, 100)] + 0.08 * rng.normal(size=(100, 16))).astype(np.float32)


def nearest(x, q, k):
    x, q = x.astype(float), q.astype(float)
    out = {}
    for i, v in enumerate(q):
        s = 1 - ((x - v) ** 2).sum(1) / 2
        at = np.lexsort((np.arange(len(x)), -s))[:k]
        out[i] = [(int(o), n + 1) for n, o in enumerate(at)]
    return out


def by_query(found):
    out = {}
    for r in sorted(found.collect(), key=lambda r: (r.query, r["rank"])):
        out.setdefault(r.query, []).append((r.ord, r["rank"]))
    return out


def tables(spark, x, q):
    chunks = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], CHUNK).repartition(5)
    return chunks, spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], QUERY)


def test_table_of_queries(spark, groups, monkeypatch):
    x, q = groups
    chunks, queries = tables(spark, x, np.r_[q, x[7:8]])  # forty rows tie with the last query
    want = nearest(x, np.r_[q, x[7:8]], 5)
    assert by_query(R.search_many(chunks, queries, 5)) == want
    monkeypatch.setattr(R, "QUERY_BLOCK", 20)
    assert by_query(R.search_many(chunks, queries, 5)) == want
    one = K.search(chunks, [float(v) for v in q[3]], 5).collect()
    assert [(r.ord, r["rank"]) for r in sorted(one, key=lambda r: r["rank"])] == want[3]


def test_cells_give_the_rows_of_a_full_scan(spark, groups):
    x, q = groups
    chunks, queries = tables(spark, x, np.r_[q, x[7:8]])
    cells = R.Cells.build(chunks.withColumn("text", F.lit("t")), W.folder(spark, "cells"))
    assert cells.size.sum() == len(x) and (cells.near[cells.size > 0] <= cells.far[cells.size > 0]).all()
    found, used = cells.search(queries, 5)
    assert by_query(found) == nearest(x, np.r_[q, x[7:8]], 5)
    assert used["pairs"] < 0.25, used  # of all pairs of query and row
    one, used = cells.search(queries.filter("query = 3"), 5)
    assert by_query(one)[3] == nearest(x, q, 5)[3] and used["cells"] < 0.35, used


def test_cells_that_cannot_be_cut(spark):
    """Where all distances are about alike, everything is read and the result is still exact."""
    rng = np.random.default_rng(6)
    x, q = unit(rng.normal(size=(400, 64))).astype(np.float32), unit(rng.normal(size=(7, 64))).astype(np.float32)
    chunks, queries = tables(spark, x, q)
    found, used = R.Cells.build(chunks, W.folder(spark, "cells")).search(queries, 12)
    assert by_query(found) == nearest(x, q, 12) and used["pairs"] > 0.9


def test_small_tables(spark):
    chunks, queries = tables(spark, np.eye(3, 4, dtype=np.float32), np.eye(1, 4, dtype=np.float32))
    assert by_query(R.search_many(chunks, queries, 9)) == {0: [(0, 1), (1, 2), (2, 3)]}
    assert by_query(R.Cells.build(chunks, W.folder(spark, "cells")).search(queries, 9)[0]) == {0: [(0, 1), (1, 2), (2, 3)]}
    assert R.search_many(chunks, queries.limit(0)).count() == 0 and R.search_many(chunks.limit(0), queries).count() == 0
    none = R.Cells.build(chunks.limit(0), W.folder(spark, "cells"))
    assert none.search(queries)[0].count() == 0


def test_retrieve_embeds_the_questions(spark):
    model = M.HashEmbedder(32)
    texts = ["gradient descent follows the slope", "soup with carrots", "the bus leaves at noon"]
    chunks = M.embed(spark.createDataFrame(list(enumerate(texts)), "ord long, text string"), model).select("ord", "embedding")
    asked = spark.createDataFrame([(1, "carrots in a soup"), (2, "slope of the gradient"), (3, None)], "query long, text string")
    found = {r.query: r.ord for r in R.retrieve(chunks, asked, model, 1).collect()}
    assert found[1] == 1 and found[2] == 0 and 3 in found
