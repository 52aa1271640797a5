"""How the tables of the test data are read as files, pages, chunks and vectors; the same in DataFrames and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def line_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files; three lines make a page."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("source"), F.split("text", "\n").alias("l"))
    pages = F.transform(F.sequence(F.lit(0), F.floor((F.size("l") - 1) / 3).cast("int")), lambda i: F.array_join(F.slice("l", i * 3 + 1, F.lit(3)), "\n"))
    return d.select("source", F.posexplode(pages).alias("i", "text")).select("source", (F.col("i") + 1).cast("long").alias("page"), "text")


LINE_PAGES = """line_docs as (select doc_id::varchar as source, string_split(text, chr(10)) as l from documents),
line_pages as (select source, i + 1 as page, array_to_string(l[i * 3 + 1:i * 3 + 3], chr(10)) as text from (select source, l, unnest(range(0, (len(l) - 1) // 3 + 1)) as i from line_docs))"""


def slice_pages(spark: SparkSession, sf_dir: str, size: int = 800) -> DataFrame:
    """Documents as files; 800 characters make a page."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("source"), "text")
    slices = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{size}}}"), F.lit(0))  # in one pass over the text
    pages = F.when(F.coalesce(F.col("text"), F.lit("")) == "", F.array("text")).otherwise(slices)
    return d.select("source", F.posexplode(pages).alias("i", "text")).select("source", (F.col("i") + 1).cast("long").alias("page"), "text")


SLICE_PAGES = "slice_pages as (select source, i + 1 as page, substr(text, i * 800 + 1, 800) as text from (select doc_id::varchar as source, text, unnest(range(0, (greatest(length(text), 1) - 1) // 800 + 1)) as i from documents))"


def html_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Web pages as one-page files; a tag ends a line and blank lines go."""
    t = F.regexp_replace(F.regexp_replace("html", r"<[^>]*>", "\n"), r"\n[ \t\r\f\n]*\n", "\n")
    return table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("source"), F.lit(1).cast("long").alias("page"), F.regexp_replace(t, r"^\n|\n\z", "").alias("text"))


HTML_PAGES = r"html_pages as (select page_id::varchar as source, 1::bigint as page, regexp_replace(regexp_replace(regexp_replace(html, '<[^>]*>', chr(10), 'g'), '\n[ \t\r\f\n]*\n', chr(10), 'g'), '^\n|\n$', '', 'g') as text from pages)"


def turn_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as files; a turn is a page."""
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("source"), (F.col("turn") + 1).alias("page"), "text")


TURN_PAGES = "turn_pages as (select conv_id::varchar as source, turn + 1 as page, text from conversations)"


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a vector as chunks of one page; lengths are taken below the join, so that texts are not shuffled for them."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("ord"), "embedding", "label")
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("ord"), F.col("doc_id").cast("string").alias("id"), "source", "text", F.length("text").alias("chars"))
    return e.join(d, "ord").withColumn("page", (F.col("ord") % 7 + 1).cast("long"))


VECTORS = "vectors as (select vec_id as ord, doc_id::varchar as id, source, text, embedding::double[] as v, label, vec_id % 7 + 1 as page from embeddings join documents on vec_id = doc_id)"


def first_vector(chunks: DataFrame) -> list[float]:
    return [float(x) for x in chunks.select("ord", "embedding").orderBy("ord").first()["embedding"]]
