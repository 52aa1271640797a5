"""Exact nearest-neighbour search over unit vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as V


def query_column(vector: list[float]):
    return F.array(*[F.lit(float(x)) for x in vector])


def search(chunks: DataFrame, vector: list[float], top_k: int = 5, fetch_k: int | None = None, order: str = "ord") -> DataFrame:
    """The ``top_k`` best of ``chunks`` by 1 - d*d/2, with ``score`` and ``rank``; ties go by ``order``.

    Each partition keeps its own best fetch_k rows (a row limit under a sort), so only those travel.
    """
    pool = max(fetch_k or top_k, top_k)
    scored = chunks.withColumn("score", V.distance_score("embedding", query_column(vector)))
    best = scored.orderBy(F.desc("score"), order).limit(pool).orderBy(F.desc("score"), order).limit(top_k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), order)))
