"""Product codes of vectors, with codebooks learned by delta-maintained Lloyd.

Components are turned into integers, vectors are cut into equal parts, and each part position has a codebook. A round gives
every part its nearest entry and moves the entries to the means of their parts. The assignment of the round before is kept in
a written table beside the vectors, and integer sums and counts of each entry run on from round to round: a round reads the
written table once, and what it shuffles are only the contributions of parts whose entry changed, minus at the old entry and plus at the new one,
added up in each task before they leave it (a row for each entry that changed at most). All sums are of integers, so neither the layout nor a rerun
changes a result. The driver holds the codebooks and the running sums, whose size follows from the parameters alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import discard, kept, scratch

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Integer components are cut at this size, so that the error of a vector of up to 256 components fits a long.
LARGEST = 1 << 27
ROWS = 4096  # vectors compared with a codebook at once


def as_integers(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of each component."""
    return F.transform(vector, lambda x: F.floor(F.greatest(F.least(x.cast("double") * scale, F.lit(float(LARGEST))), F.lit(float(-LARGEST)))).cast("int"))


def finite(vector: Column) -> Column:
    """Neither null nor empty, and every component is a number and finite."""
    bad = lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf"))
    return vector.isNotNull() & (F.size(vector) > 0) & ~F.exists(vector, bad)


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the nearest entry, the lower one of two as near; squared distance) of each row, in exact integers."""
    at, error = np.empty(len(x), np.int64), np.empty(len(x), np.int64)
    for a in range(0, len(x), ROWS):
        y = x[a : a + ROWS]
        top = max(int(np.abs(y).max(initial=0)), int(np.abs(entries).max(initial=0)))
        kind = np.float64 if 4 * x.shape[1] * top * top < 1 << 53 else np.int64  # both exact; products of floats are faster
        p, c = y.astype(kind), entries.astype(kind)
        cross = (c * c).sum(1)[None] - 2 * (p @ c.T)
        i = cross.argmin(1)
        at[a : a + ROWS], error[a : a + ROWS] = i, (cross[np.arange(len(y)), i] + (p * p).sum(1)).astype(np.int64)
    return at, error


def _parts(column: pa.Array, parts: int) -> np.ndarray:
    """(rows, parts, width) of a list column whose lists are equally long."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), parts, -1)


def _bytes(column: pa.Array, rows: int, parts: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u2").reshape(rows, parts).astype(np.int64)


def _assigned(table: DataFrame, books: np.ndarray) -> DataFrame:
    """``table`` with ``was``, the assignment it had, and ``at`` and ``error`` by ``books``. An assignment is two bytes for each part."""
    parts = len(books)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _parts(b.column("x"), parts)
            found = [nearest(x[:, p], books[p]) for p in range(parts)]
            at = np.stack([i for i, _ in found], 1).astype("<u2")
            error = np.sum([e for _, e in found], axis=0, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), b.column("x"), b.column("at"), pa.array([r.tobytes() for r in at], pa.binary()), pa.array(error)], names=["vec_id", "label", "x", "was", "at", "error"])

    return table.select("vec_id", "label", "x", "at").mapInArrow(assign, f"vec_id long, label {dict(table.dtypes)['label']}, x array<int>, was binary, at binary, error long")


def _changes(table: DataFrame, parts: int, entries: int, width: int) -> DataFrame:
    """(slot, count, sums) that the parts with another entry than before add to, and take from, each slot = part * entries + entry."""

    def contributions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((parts * entries, width), np.int64), np.zeros(parts * entries, np.int64)
        touched = np.zeros(parts * entries, bool)
        for b in batches:
            x, at = _parts(b.column("x"), parts), _bytes(b.column("at"), b.num_rows, parts)
            first = np.array([not w.is_valid for w in b.column("was")], bool)
            was = np.full_like(at, -1)
            if not first.all():
                was[~first] = _bytes(b.column("was").filter(pa.array(~first)), int((~first).sum()), parts)
            for p in range(parts):
                for slot, sign in ((at[:, p], 1), (was[:, p], -1)):
                    rows = np.flatnonzero((at[:, p] != was[:, p]) & (slot >= 0))
                    np.add.at(sums, p * entries + slot[rows], sign * x[rows, p])
                    np.add.at(counts, p * entries + slot[rows], sign)
                    touched[p * entries + slot[rows]] = True
        some = np.flatnonzero(touched)
        if len(some):
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[some]), pa.array(sums[some].tolist(), pa.list_(pa.int64()))], names=["slot", "n", "sums"])

    changed = table.filter(F.col("was").isNull() | (F.col("was") != F.col("at"))).select("x", "was", "at")
    each = changed.mapInArrow(contributions, "slot long, n long, sums array<long>")
    return each.groupBy("slot").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("sums")[i]) for i in range(width)]).alias("sums"))


def vector_codes(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of each row of ``vectors`` that is kept.

    Rows go whose vector is null, empty or holds a null or a non-finite component. A codebook starts as the parts of the ``entries``
    smallest ids (all rows, if they are fewer); a null id comes after all others, and rows that repeat an id count each, by their components. A part goes to the nearest entry, the lower
    one of two as near; an entry without parts stays. The vector of the smallest id sets the length: rows of another length go, and components
    behind the last whole multiple of ``parts`` are not used. Components of 2**27 and more after scaling are cut there. code has
    two hex digits for each part (four if there are over 256 entries). Errors of equal labels are added up, nulls together. An empty table gives an
    empty result. Other columns are ignored.
    """
    base = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).alias("v")).filter(finite(F.col("v")))
    base = base.select("vec_id", "label", as_integers(F.col("v"), scale).alias("x"))
    order = [F.col("vec_id").asc_nulls_last(), "x"]
    with scratch():
        first = base.filter(F.size("x") >= parts).orderBy(*order).select("x").first()
        size = len(first.x) if first else parts
        width = size // parts
        base = base.filter(F.size("x") == size).withColumn("x", F.slice("x", 1, width * parts))
        start = np.array([r.x for r in base.orderBy(*order).limit(entries).select("x").collect()], np.int64).reshape(-1, parts, width)  # as many as the codebook has
        books = start.transpose(1, 0, 2)
        if not len(start):
            books, rounds = np.zeros((parts, 1, width), np.int64), 0
        have = books.shape[1]
        sums, counts = np.zeros((parts * have, width), object), np.zeros(parts * have, object)
        table = base.withColumn("at", F.lit(None).cast("binary"))
        for _ in range(rounds):
            before, table = table, kept(_assigned(table, books), "assigned")
            if hasattr(before, "_quire_place"):
                discard(before)
            for r in _changes(table, parts, have, width).collect():  # a row for each entry at most
                counts[r.slot] += r.n
                sums[r.slot] += np.array(r.sums, object)
            used = np.flatnonzero(counts > 0)
            flat = books.reshape(parts * have, width).copy()
            flat[used] = (sums[used] // counts[used, None]).astype(np.int64)
            books = flat.reshape(parts, have, width)
        last = kept(_assigned(table, books).select("vec_id", "label", "at", "error"), "codes", stay=True)
    digits = 2 if entries <= 256 else 4
    low_high = [F.lpad(F.hex(F.concat(F.substring("at", 2 * p + 2, 1), F.substring("at", 2 * p + 1, 1))), 4, "0") for p in range(parts)]
    code = F.lower(F.concat(*[F.substring(h, 5 - digits, digits) for h in low_high]))
    by_label = last.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    text = ",".join(map(str, books.ravel().tolist())) if len(start) else ""
    return last.join(by_label, F.col("label").eqNullSafe(F.col("of"))).select("vec_id", code.alias("code"), "error", "label_error", F.lit(hashlib.sha256(text.encode()).hexdigest()).alias("codebooks_sha256"))


def op11_vector_codes(spark, sf_dir: str) -> DataFrame:
    return vector_codes(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def _sql(rounds: int = ROUNDS) -> str:
    """The same rounds, each written out."""
    steps = [
        """kept as materialized (select vec_id, label, [floor(1024 * x::double)::bigint for x in embedding] as x from embeddings
  where embedding is not null and len(embedding) > 0 and len([x for x in embedding if x is null or not isfinite(x)]) = 0)""",
        "v as materialized (select vec_id, label, p, x[p * (len(x) // 4) + 1 : (p + 1) * (len(x) // 4)] as x from kept, range(4) as r(p))",
        "b0 as materialized (select p, e, x from (select p, x, row_number() over (partition by p order by vec_id, x) - 1 as e from v) where e < 256)",
    ]
    for k in range(rounds + 1):
        steps.append(f"a{k} as materialized (select vec_id, label, v.p, v.x, arg_min(struct_pack(e := e, y := c.x), (list_dot_product(c.x::double[], c.x::double[]) - 2 * list_dot_product(c.x::double[], v.x::double[])) * 512 + e) as c from v join b{k} c on c.p = v.p group by vec_id, label, v.p, v.x)")
        if k < rounds:
            steps.append(f"s{k} as (select p, c.e as e, i, floor(sum(x[i]) / count(*))::bigint as y from a{k}, range(1, 17) as r(i) group by all)")
            steps.append(f"b{k + 1} as materialized (select p, e, coalesce(m.y, b{k}.x) as x from b{k} left join (select p, e, list(y order by i) as y from s{k} group by all) m using (p, e))")
    steps.append(f"h as (select sha256(string_agg(array_to_string(x, ','), ',' order by p, e)) as codebooks_sha256 from b{rounds})")
    steps.append(f"o as (select vec_id, label, string_agg(printf('%02x', c.e), '' order by p) as code, sum(list_dot_product(x::double[], x::double[]) - 2 * list_dot_product(x::double[], c.y::double[]) + list_dot_product(c.y::double[], c.y::double[]))::bigint as error from a{rounds} group by vec_id, label)")
    return "with " + ",\n".join(steps) + "\nselect vec_id, code, error, sum(error) over (partition by label)::bigint as label_error, codebooks_sha256 from o, h"


QUERIES = {"op11_vector_codes": op11_vector_codes}
SQL = {"op11_vector_codes": _sql()}
