"""Every query against its SQL in DuckDB, over the smallest tables."""

import math
import os

import duckdb
import pytest

from quire.plans import catalogue


def rows(df):
    def plain(x):
        if x is None or type(x).__name__ == "NAType" or x != x:
            return None
        if isinstance(x, float):
            return int(x) if math.isfinite(x) and x == int(x) else round(x, 6)
        return x.item() if hasattr(x, "item") else x

    df = df[sorted(df.columns)]
    return sorted(repr(tuple(map(plain, r))) for r in df.itertuples(index=False))


@pytest.fixture(scope="module")
def duck(small):
    c = duckdb.connect()
    for f in os.listdir(small):
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from '{small}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, small, duck, name):
    got = catalogue.QUERIES[name](spark, small).toPandas()
    if name not in catalogue.SQL:
        assert len(got)
        return
    if name == "coerce_json":
        want = {0: 2, 1: 0, 2: 1, 3: 3, 4: 1, 8: 0, 9: 1}  # by shape
        assert all(want.get((r.conv_id + r.turn) % 10) == (None if r["items"] is None or r["items"] != r["items"] else int(r["items"])) for _, r in got.iterrows() if (r.conv_id + r.turn) % 10 != 6)
    want = duck.sql(catalogue.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_citations_of_the_whole_material(spark, small):
    """Every document's pages are in the material, and all three outcomes occur."""
    docs = spark.read.parquet(f"{small}/documents.parquet").collect()
    pages = {tuple(r) for r in catalogue.QUERIES["allowed_pages"](spark, small).select("source", "page").collect()}
    assert {(r.source, r.doc_id * 5) for r in docs} <= pages
    got = catalogue.QUERIES["citation_check"](spark, small).collect()
    assert len(got) == len(docs) and {r.status for r in got} == {"kept", "repaired", "dropped"}


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0 and set(e.oracle_sql()) <= set(e.queries())
