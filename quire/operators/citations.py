"""Checks of cited sources and pages against the material that was given."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TOLERANCE = 2
PARTS = 64  # that the items of one source are dealt to


def allowed_pages(chunks: DataFrame) -> DataFrame:
    """(source, page): every page that a chunk draws from."""
    last = F.when(F.col("page_end").isNotNull() & (F.col("page_end") >= F.col("page")), F.col("page_end")).otherwise(F.col("page"))
    return chunks.select("source", F.explode(F.sequence("page", last)).alias("page")).distinct()


def check_citations(items: DataFrame, chunks: DataFrame, tolerance: int = TOLERANCE, key: str = "n") -> DataFrame:
    """``items`` (key, source, page, ...) with ``status`` (kept, repaired, dropped), ``cited_page`` and ``reason``.

    A page off by at most ``tolerance`` is repaired to the nearest one that was given, the lower of two. Only pages within
    the tolerance are looked up, so the work does not grow with the pages of a source.
    """
    pages = allowed_pages(chunks).select(F.col("source").alias("of"), F.col("page").alias("given"))
    files = pages.select(F.col("of").alias("file")).distinct().withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    around = items.withColumn("place", F.explode_outer(F.sequence(F.col("page") - tolerance, F.col("page") + tolerance)))
    near = around.join(pages, (F.col("source") == F.col("of")) & (F.col("place") == F.col("given")), "left").withColumn("off", F.abs(F.col("given") - F.col("page")))
    best = near.withColumn("at", F.row_number().over(Window.partitionBy(key).orderBy(F.col("off").isNull(), "off", "given"))).filter("at = 1")
    best = best.join(files, (F.col("source") == F.col("file")) & (F.pmod(F.xxhash64(key), F.lit(PARTS)) == F.col("part")), "left")
    status = F.when(F.col("off") == 0, "kept").when(F.col("off") <= tolerance, "repaired").otherwise("dropped")
    cited = F.concat("source", F.lit(" p"), F.col("page").cast("string"))
    reason = F.when(F.col("file").isNull(), F.concat(cited, F.lit(": no such file in the material"))).when(F.col("off").isNull() & F.col("page").isNotNull(), F.concat(cited, F.lit(": page not among those given")))
    out = best.withColumn("status", status).withColumn("cited_page", F.when(status != "dropped", F.col("given"))).withColumn("reason", reason)
    return out.drop("of", "given", "off", "at", "place", "file", "part")
