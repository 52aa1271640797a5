"""Exact duplicates by progressive refinement: length, then a prefix hash, then the full hash.

Texts are equal if they are identical without white space. One pass reads the texts and writes a narrow row of each: its
length, a hash of its first characters, and the digest. Rows are then refined in three steps, each only over the rows that the
step before left together with others: rows alone in their length are done, then rows alone in (length, prefix hash), and
only the rest are grouped by their digests, whose column is not read before. No text is shuffled, and a group is never
gathered: it is one row of counts with the row that stays, joined back to its members.

The digest of every text is part of the result, so it is taken in the one pass over the texts and not in a second pass
over the survivors, which would read them again and shuffle what it is joined with.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import documents, kept, scratch

PREFIX = 64
SPACE = r"[\x20\x09-\x0D]+"


def without_space(text: Column) -> Column:
    return F.regexp_replace(text, SPACE, "")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256, and the columns in ``carry`` as carried_0, ...) of each row of ``docs``.

    Of equal texts the row with the most code points in its original text stays, then the one with the smallest id. A null
    text counts as empty; texts of white space alone are equal to it. A null id comes after all others; of rows that repeat an id and a
    length one stays, so each group has one row with ``kept``. Texts of any length are read whole. An empty table gives an empty
    result. Other columns are ignored.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    extra = [f"carried_{i}" for i in range(len(carry))]
    bare = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.length(text).alias("chars"), without_space(text).alias("bare"), *[F.col(c).alias(e) for c, e in zip(carry, extra, strict=True)])
    narrow = bare.select(
        "doc_id", "chars", F.length("bare").alias("size"), F.xxhash64(F.substring("bare", 1, PREFIX)).alias("prefix"), F.sha2(F.col("bare").cast("binary"), 256).alias("digest"), *extra,
        F.monotonically_increasing_id().alias("row"),
    )
    with scratch():
        rows = kept(narrow, "texts", stay=True)
        many = lambda df, *by: df.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(*by)
        by_size = kept(many(rows, "size"), "sizes")
        by_prefix = kept(many(rows.select("size", "prefix").join(by_size, "size", "left_semi"), "size", "prefix"), "prefixes")
        best = F.struct((-F.col("chars")).alias("chars"), F.col("doc_id").isNull().alias("none"), "doc_id", "row")
        same = rows.select("size", "prefix", "digest", "chars", "doc_id", "row").join(by_prefix, ["size", "prefix"], "left_semi")
        groups = same.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min(best).alias("best")).filter("n > 1")
        groups = kept(groups.select(F.col("digest").alias("of"), "n", F.col("best.doc_id").alias("best_id"), F.col("best.row").alias("best_row")), "groups", stay=True)
    out = rows.join(groups, F.col("digest") == F.col("of"), "left")
    alone = F.col("n").isNull()
    return out.select(
        "doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("best_id")).alias("keep_id"), F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("row") == F.col("best_row"))).alias("kept"), F.col("digest").alias("text_sha256"), *extra,
    )


def op12_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_duplicates(documents(spark, sf_dir))


QUERIES = {"op12_exact_dedup": op12_exact_dedup}
SQL = {
    "op12_exact_dedup": """
with d as (select doc_id, length(coalesce(text, '')) as chars, sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g')) as text_sha256 from documents),
r as (select *, row_number() over (partition by text_sha256 order by chars desc, doc_id nulls last) as place from d)
select doc_id, first_value(doc_id) over g as keep_id, count(*) over (partition by text_sha256) as group_size, place = 1 as kept, text_sha256
from r window g as (partition by text_sha256 order by place)
"""
}
