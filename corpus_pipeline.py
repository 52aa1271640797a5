"""The training-data pipeline over ``documents``: each stage takes (spark, docs, sf_dir) and returns a DataFrame.

A stage works on all that its predecessor kept. All but the last return the columns of ``documents``; other columns are
dropped. Rows are judged one by one: rows that repeat an id, or have none, are rows like others. An empty table
stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import contamination, language, mixture, near_dup, private_data
from quire.llm.shared import discard, documents, kept, scratch

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
LEAST_MARGIN = 0.1  # of the predicted language's score over an even chance, as a share of what is left to 1


def _numbered(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with a number of their own, written, so that every later job sees the same numbers."""
    return kept(docs.select(*COLUMNS).withColumn("row", F.monotonically_increasing_id()), "numbered")


def keep_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go whose text is null or has no letter, whose predicted language scores hardly above an even chance among the learned ones, or that are in none of them.

    The last is told by runs of symbols that no labelled text holds: a text may have no more of them than natural text in a learned language has. The label column ``lang`` is taught from,
    never filtered on. Without any label there is nothing to score by, and only the first rule holds. Texts are judged whole, however long; equal texts are judged alike.
    """
    labelled = docs.select("text", "lang")
    net = language.fit(labelled)
    if net is None:
        return docs.select(*COLUMNS).filter(F.col("text").rlike(r"\p{L}"))
    named = language.language_id(docs, net, carry=("text", "lang", "source", "n_chars"))
    chance = 1 / len(net.languages)
    told = named.filter((F.col("lang_pred") != "und") & (F.col("score") >= chance + LEAST_MARGIN * (1 - chance)))
    known = language.familiar(labelled)
    kept_ = language.with_unfamiliar(told, known, "carried_0").filter(F.col("unfamiliar") <= known.most)
    return kept_.select("doc_id", *[F.col(f"carried_{i}").alias(c) for i, c in enumerate(COLUMNS[1:])])


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate group (five-word shingles, similarity 0.8) stays, the one with the smallest id; of rows with one id, or with none (which come last), the first one read.

    Texts without a word are alike to nothing and stay, null texts too.
    """
    rows = _numbered(docs)
    groups = near_dup.near_duplicates(rows, id_col="row").select(F.col("doc_id").alias("row"), "component_id")
    first = groups.join(rows.select("row", "doc_id"), "row").groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first"))
    return rows.join(first.select("first.row"), "row", "left_semi").select(*COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows go that hold at least 0.8 of the shingles of a benchmark item. Null and empty texts stay."""
    return contamination.uncontaminated(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind in brackets; n_chars follows the text. Every row stays; a null text stays null."""
    found = private_data.private_data(docs, private_data.fit(docs), carry=("lang", "source", "text"))
    text = F.when(F.col("carried_2").isNotNull(), F.col("redacted"))
    return found.select("doc_id", text.alias("text"), F.col("carried_0").alias("lang"), F.col("carried_1").alias("source"), F.length(text).cast("long").alias("n_chars"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix itself: each row as often as it was drawn, with ``copy`` from 1 and its ``size``. Rows without a word are not drawn."""
    rows = _numbered(docs)
    drawn = mixture.mixture(rows, carry=("row",)).filter("copies > 0").select(F.col("carried_0").alias("row"), "size", "copies")
    taken = rows.join(drawn, "row").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return taken.select(*COLUMNS, "size", "copy")


STAGES = [("language", keep_language), ("near_dup", deduplicate), ("decontaminate", decontaminate), ("redact", redact), ("mix", mix)]
ORACLE_SQL = None  # learned stages cannot be written in SQL; tests compare with plain Python


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. What a stage wrote on its way, and its predecessor's result, are deleted behind it."""
    docs = documents(spark, sf_dir)
    for at, (name, stage) in enumerate(STAGES):
        with scratch():
            made = kept(stage(spark, docs, sf_dir), name, stay=True)
        if at:
            discard(docs)
        docs = made
    return docs
