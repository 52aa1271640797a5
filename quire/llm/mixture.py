"""Mixing sources to target weights by systematic sampling.

A source's target over its size is the number of copies that each of its documents is expected to take. Along
a fixed order of the source's documents the expected copies add up; a random offset is added once per
source; a document is emitted once for each whole number that its stretch of the sum reaches. The order goes
by size class (eight classes to an octave) and then by a hash of the id, so that each class is thinned or
repeated alike and the words taken come close to the target.

The prefix sum has two levels: documents are counted in cells of (source, size class, two hex digits of the
hash), the cells are added up per source, and ranks inside a cell complete the place. No task sees a whole
source; cells per source are bounded by the classes (some 400 at most) times 256.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import documents, kept

WEIGHTS = (5, 2, 1)
MOST = 3
SEED = "quire"
WORD = r"[^\x20\x09-\x0D]+"


def size_class(col: str):
    """Bits of the size and the three bits behind the leading one, as one integer; integers only, so engines agree."""
    bits = F.bin(col)
    return F.length(bits) * 8 + F.conv(F.rpad(F.substring(bits, 2, 3), 3, "0"), 2, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size, target) from (source, source_size, n): shares by weight, cut at ``most`` times a source's size, the excess reshared by weight.

    A cut source takes ``most`` times its size; with the sources in order of size over weight the cut ones come
    first, so the level of the others follows from running sums. The table has one row for each source.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.row_number().over(by_name) - 1) % len(weights) + 1)
    s = sizes.withColumn("w", w).withColumn("cap", most * F.col("source_size").cast("double")).withColumn("ratio", F.col("cap") / F.col("w"))
    order = Window.orderBy("ratio", F.col("source").isNull(), "source")
    whole = Window.partitionBy(F.lit(1))
    cut = order.rowsBetween(Window.unboundedPreceding, -1)
    rest = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    s = s.withColumn("level", (F.sum("source_size").over(whole).cast("double") - F.coalesce(F.sum("cap").over(cut), F.lit(0.0))) / F.sum("w").over(rest))
    # Levels rise along the order while the source before was rightly cut and fall afterwards: the largest is the one that holds.
    s = s.withColumn("final", F.max("level").over(whole))
    return s.select("source", "source_size", "n", F.least("cap", F.col("w") * F.col("final")).alias("target"))


def mixture(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: str = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken, and the columns in ``carry`` as carried_0, ...) of each row of ``docs``.

    size counts the words of the text (null: 0). Sources take the weights in turn by code point, null last. copies is
    the number of times that the mix holds the document, taken = size * copies. Reruns agree: order and offsets come
    from hashes of ids, sources and the seed. Rows without words take no part and have no copies; so have all rows of a
    source without words. Repeated rows, and rows with one id, are drawn one by one; a null id counts as the empty text. An empty
    table gives an empty result. Other columns are ignored.
    """
    text, extra = F.col(text_col).cast("string"), [f"carried_{i}" for i in range(len(carry))]
    base = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.xxhash64(text).alias("print"), *[F.col(c).alias(e) for c, e in zip(carry, extra, strict=True)],
    )
    base = base.withColumn("hash", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))).withColumn("class", size_class("size"))
    base = kept(base, "sizes")
    cells = kept(base.groupBy("source", "class", F.substring("hash", 1, 2).alias("cell")).agg(F.count(F.lit(1)).alias("docs"), F.sum("size").alias("words")), "cells")
    counted = cells.groupBy("source").agg(F.sum("words").alias("source_size"), F.sum("docs").alias("n"))
    plan = kept(targets(counted, weights, most), "targets")
    drawn = cells.filter("words > 0")
    run = Window.partitionBy("source").orderBy("class", "cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = drawn.withColumn("before", F.coalesce(F.sum("docs").over(run), F.lit(0)))
    per = drawn.groupBy("source").agg(F.sum("docs").alias("drawn"))
    plan = plan.join(per.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of")), "left").drop("of")
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce("source", F.lit("\x00"))).cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    plan = plan.withColumn("expected", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size"))).withColumn("offset", offset)
    starts = starts.join(plan.select(F.col("source").alias("of"), "source_size", "target", "expected", "offset"), F.col("source").eqNullSafe(F.col("of"))).drop("of", "docs", "words")
    rank = F.row_number().over(Window.partitionBy("source", "class", "cell").orderBy("hash", "size", "doc_id", "print"))
    ranked = base.withColumn("cell", F.substring("hash", 1, 2)).withColumn("rank", rank)
    there = starts.select(F.col("source").alias("of"), F.col("class").alias("of_class"), F.col("cell").alias("of_cell"), "before", "source_size", "target", "expected", "offset")
    on = F.col("source").eqNullSafe(F.col("of")) & (F.col("class") == F.col("of_class")) & (F.col("cell") == F.col("of_cell"))
    out = ranked.join(there, on, "left")
    all_ = plan.select(F.col("source").alias("whole"), F.col("source_size").alias("whole_size"), F.col("target").alias("whole_target"))
    end = F.col("before") + F.col("rank")
    copies = F.floor(end * F.col("expected") + F.col("offset")) - F.floor((end - 1) * F.col("expected") + F.col("offset"))
    out = out.withColumn("copies", F.when(F.col("before").isNotNull(), F.least(copies, F.lit(most))).otherwise(F.lit(0)).cast("long"))
    none = out.filter("before is null").join(all_, F.col("source").eqNullSafe(F.col("whole")), "left")
    columns = ["doc_id", "source", "size", *extra]
    some = out.filter("before is not null").select(*columns, "source_size", "target", "copies")
    none = none.select(*columns, F.col("whole_size").alias("source_size"), F.col("whole_target").alias("target"), "copies")
    return some.unionByName(none).withColumn("taken", F.col("size") * F.col("copies"))


def op8_mixture(spark, sf_dir: str) -> DataFrame:
    return mixture(documents(spark, sf_dir))


QUERIES = {"op8_mixture": op8_mixture}
SQL = {
    "op8_mixture": """
with d as (select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::bigint as size, md5(coalesce(doc_id::varchar, '')) as hash from documents),
c as (select *, length(bin(size)) * 8 + ('0b' || rpad(substr(bin(size), 2, 3), 3, '0'))::bigint as class from d),
s as (select source, sum(size)::bigint as source_size from c group by source),
w as (select *, [5.0, 2.0, 1.0][(row_number() over (order by source is null, source) - 1) % 3 + 1]::double as w, 3 * source_size::double as cap from s),
l as (select *, (sum(source_size) over ()::double - coalesce(sum(cap) over (order by cap / w, source is null, source rows between unbounded preceding and 1 preceding), 0.0))
  / sum(w) over (order by cap / w, source is null, source rows between current row and unbounded following) as level from w),
t as (select source, source_size, least(cap, w * max(level) over ()) as target,
  ('0x' || substr(md5('quire:' || coalesce(source, chr(0))), 1, 8))::bigint::double / 4294967296.0 as off from l),
r as (select *, row_number() over (partition by source order by class, hash, size, doc_id) as rank from c where size > 0),
e as (select r.doc_id, r.source, size, source_size, target,
  least(floor(rank * (target / source_size) + off) - floor((rank - 1) * (target / source_size) + off), 3)::bigint as copies from r join t on r.source is not distinct from t.source)
select *, size * copies as taken from e
union all
select c.doc_id, c.source, c.size, source_size, target, 0::bigint, 0::bigint from c join t on c.source is not distinct from t.source where size = 0
"""
}
