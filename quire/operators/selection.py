"""Choosing material that covers a corpus: clustering, apportionment and diverse picks.

Candidates are rows (ord, id, source, text, embedding); ``ord`` settles every tie. Vectors stay in the executors. Of texts, only their length counts: candidates that come
from a join may carry ``chars``, taken below it, and then no text is shuffled. Clustering
runs over any number of groups of rows (``g``) at once. It writes the points (g, ord, embedding) once and then reads as little of them as bounds allow:

* A row's likeness to the nearest seed only grows as seeds are added. So a pass brings the AHEAD rows of each group that are least like all seeds, and seeds are
  taken from these until a row outside could come before; if a second pass is needed, the likeness so far is written beside the points, sorted, and later passes read only
  rows below the bound.
* A row keeps its centre while the centres have moved, in all, less than half the gap between its best and its second-best likeness. A round that reads all rows
  counts those whose gap two more such moves would use up. If they are few, one pass brings the AHEAD rows with the least gaps, and rounds go on over these alone; if they are
  less than half, gaps are written with the points, sorted, and a round reads only the rows whose gap is used up; otherwise bounds do not pay and the next
  round reads all rows again. Running sums change by the rows that moved.

What a pass finds are rows or sums of every group in every partition; where there are many partitions, executors bring them down to LANES rows first.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vectors as V
from ..sources.scratch import kept, scratch
from .search import search

#: What counts as substantial and as selectable, and the rounds and topics of a clustering.
SUBSTANTIAL_CHARS, SELECTABLE_CHARS, ROUNDS, MOST_TOPICS = 400, 200, 6, 12
LANES, PARTIALS, AHEAD = 16, 256, 256
MARGIN = 1e-9  # of a gap, for rounding


def _chars(rows: DataFrame) -> Column:
    return F.col("chars") if "chars" in rows.columns else F.length("text")


def substantial(candidates: DataFrame, count: int, least: int = SELECTABLE_CHARS) -> DataFrame:
    """Rows of at least ``least`` characters; if they are fewer than ``count``, the ``count`` longest of all."""
    kept = candidates.filter(F.length("text") >= least)
    if kept.limit(count).count() >= count:
        return kept
    return candidates.orderBy(F.desc(F.length("text")), "ord").limit(count)


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    at = batch.schema.get_field_index("embedding")
    flat = batch.column(at).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(batch.num_rows, -1) if batch.num_rows else np.empty((0, 0))


def _dots(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """(rows, centres); summed alike for each row, so equal vectors tie exactly."""
    return np.stack([(x * c).sum(axis=1) for c in centres], axis=1)


def _by_group(b: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(g, ords, vectors) of each group in a batch of (g, ord, embedding)."""
    g, ords, x = b.column(0).to_numpy(), b.column(1).to_numpy(), _matrix(b)
    for one in np.unique(g):
        yield int(one), ords[g == one], x[g == one]


def _found(rows: DataFrame, per_part: Callable, merge: Callable, schema: str) -> list:
    """What ``per_part`` makes of each partition: a row for each group, brought together by ``merge`` in LANES lanes if there are many partitions."""
    each = rows.mapInArrow(per_part, schema)
    if rows.rdd.getNumPartitions() > PARTIALS:
        names = each.columns

        def per_lane(t: pa.Table) -> pa.Table:
            return pa.Table.from_pylist([merge(t.to_pylist())], schema=t.schema).select(names)

        lane = F.pmod(F.spark_partition_id(), F.lit(LANES)).alias("lane")
        each = each.select("*", lane).groupBy("g", "lane").applyInArrow(lambda t: per_lane(t.drop_columns(["lane"])), schema)
    out: dict[int, list] = {}
    for r in each.collect():  # PARTIALS rows a group at most, or LANES
        out.setdefault(r.g, []).append(r.asDict())
    return [merge(mine) for mine in out.values()]


def _least(rows: DataFrame, value: Callable[[int, np.ndarray], np.ndarray], skip: list[int], count: int) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(values, ords, vectors) of the ``count`` rows of each group with the least (value, ord), not in ``skip``."""

    def cut(v: np.ndarray, o: np.ndarray, x: np.ndarray) -> tuple:
        at = np.lexsort((o, v))[:count]
        return v[at], o[at], x[at]

    def per_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple] = {}
        for b in batches:
            for g, ords, x in _by_group(b):
                use = ~np.isin(ords, skip)
                mine = value(g, x)[use], ords[use], x[use]
                best[g] = cut(*[np.concatenate(p) for p in zip(best[g], mine, strict=True)]) if g in best else cut(*mine)
        best = {g: m for g, m in best.items() if len(m[0])}
        if best:
            v, o, x = zip(*best.values(), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(best.keys(), pa.int64()), pa.array([e.tolist() for e in v]), pa.array([e.tolist() for e in o]), pa.array([e.ravel().tolist() for e in x])], names=["g", "value", "ord", "x"])

    def merge(parts: list[dict]) -> dict:
        x = [np.array(p["x"]).reshape(len(p["ord"]), -1) for p in parts]
        v, o, y = cut(np.concatenate([p["value"] for p in parts]), np.concatenate([p["ord"] for p in parts]), np.concatenate(x))
        return {"g": parts[0]["g"], "value": v.tolist(), "ord": o.tolist(), "x": y.ravel().tolist()}

    found = _found(rows, per_part, merge, "g long, value array<double>, ord array<long>, x array<double>")
    return {r["g"]: (np.array(r["value"]), np.array(r["ord"], np.int64), np.array(r["x"]).reshape(len(r["ord"]), -1)) for r in found}


def _sums(rows: DataFrame, centres: dict[int, np.ndarray] | None, before: dict[int, np.ndarray] | None = None, within: dict[int, float] | None = None) -> dict[int, tuple[np.ndarray, np.ndarray, int, int, int]]:
    """Of each group: (sums, sizes) by nearest centre, how many rows are nearest to another one than of ``before``, how many were read, and how many have a gap ``within``.

    With ``before``, only what the rows that moved add to, and take from, sums and sizes. Without ``centres``, the sum of all rows.
    """
    names = ["g", "sums", "sizes", "moved", "rows", "close"]

    def per_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for b in batches:
            for g, _, x in _by_group(b):
                if centres is None:
                    new = [x.sum(0)[None], np.array([len(x)]), 0, len(x), 0]
                elif before is None:
                    at = _dots(x, centres[g]).argmax(1)
                    sums = np.zeros_like(centres[g])
                    np.add.at(sums, at, x)
                    new = [sums, np.bincount(at, minlength=len(sums)), len(x), len(x), len(x)]
                else:
                    new = [*_moved(x, centres[g], before[g]), int((_gaps(x, centres[g])[1] <= within[g]).sum()) if within else 0]
                held[g] = [p + q for p, q in zip(held[g], new, strict=True)] if g in held else new
        if held:
            s, n, *more = zip(*held.values(), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.int64()), pa.array([v.ravel().tolist() for v in s]), pa.array([v.tolist() for v in n]), *map(pa.array, more)], names=names)

    def merge(parts: list[dict]) -> dict:
        return {"g": parts[0]["g"]} | {n: np.sum([p[n] for p in parts], axis=0).tolist() for n in names[1:]}

    found = _found(rows, per_part, merge, "g long, sums array<double>, sizes array<long>, moved long, rows long, close long")
    return {r["g"]: (np.array(r["sums"]).reshape(len(r["sizes"]), -1), np.array(r["sizes"]), r["moved"], r["rows"], r["close"]) for r in found}


def centroid(candidates: DataFrame, *by: str) -> DataFrame:
    """The element-wise mean vector, not normalised, of each group."""
    each = candidates.select(*by, F.posexplode("embedding").alias("i", "x")).groupBy(*by, "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return each.groupBy(*by).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("centroid"))


def _one_group(candidates: DataFrame) -> DataFrame:
    return candidates.select(F.lit(0).cast("long").alias("g"), "ord", "embedding")


def _seeds(points: DataFrame, counts: dict[int, int]) -> dict[int, list[tuple[int, np.ndarray]]]:
    """(ord, vector) of as many rows of each group as ``counts`` says: the one nearest to the group's mean, then each time the one least like all chosen."""
    means = {g: s[0] / n[0] for g, (s, n, *_) in _sums(points, None).items()}
    chosen = {g: [(int(o[0]), x[0])] for g, (_, o, x) in _least(points, lambda g, x: -_dots(x, means[g][None])[:, 0], [], 1).items()}
    passes, bound = 0, {}
    while open_ := [g for g in chosen if len(chosen[g]) < counts[g]]:
        taken = {g: np.stack([v for _, v in chosen[g]]) for g in open_}
        near = lambda g, x, taken=taken: _dots(x, taken[g]).max(1)
        if passes == 1:
            points = kept(_with_nearest(points.filter(F.col("g").isin(open_)), near).sortWithinPartitions("nearest"), "nearest")
        rows = points.filter(F.col("g").isin(open_))
        if passes > 1:  # a likeness that was written is not above the one of today
            rows = rows.filter(_any(lambda g: (F.col("g") == g) & (F.col("nearest") <= float(bound[g])), open_))
        ahead = _least(rows.select("g", "ord", "embedding"), near, [o for c in chosen.values() for o, _ in c], AHEAD)
        for g in open_:
            if g not in ahead:
                counts = counts | {g: len(chosen[g])}  # no row is left
                continue
            value, ords, x = ahead[g]
            last = (value[-1], ords[-1]) if len(ords) == AHEAD else (np.inf, 0)
            if passes > 1:  # a row that was not read is above the bound
                last = min(last, (bound[g], np.inf))
            while len(chosen[g]) < counts[g] and len(ords):
                i = np.lexsort((ords, value))[0]
                if (value[i], ords[i]) > last:
                    break
                chosen[g].append((int(ords[i]), x[i]))
                value = np.maximum(value, _dots(x, x[i][None])[:, 0])
                value, ords, x = (np.delete(p, i, 0) for p in (value, ords, x))
            bound[g] = value.max() if len(ords) else np.inf
            if len(ords) < AHEAD // 2:
                bound[g] = np.inf
        passes += 1
    return chosen


def _any(condition: Callable[[int], Column], groups: list[int]) -> Column:
    out = F.lit(False)
    for g in groups:
        out = out | condition(g)
    return out


def _with_nearest(points: DataFrame, near: Callable) -> DataFrame:
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for g, ords, x in _by_group(b):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ords), g)), pa.array(ords), pa.array(x.tolist()), pa.array(near(g, x))], names=["g", "ord", "embedding", "nearest"])

    return points.select("g", "ord", "embedding").mapInArrow(add, "g long, ord long, embedding array<double>, nearest double")


def spread_seeds(candidates: DataFrame, count: int) -> list[tuple[int, np.ndarray]]:
    with scratch():
        return _seeds(kept(_one_group(candidates), "points"), {0: count})[0]


def lloyd_step(rows: DataFrame, centres: dict[int, np.ndarray], before: dict[int, np.ndarray] | None = None) -> tuple[dict[int, np.ndarray], dict[int, np.ndarray], int]:
    """(new centres, sizes, rows that moved) of (g, ord, embedding): plain means of the rows nearest to each centre by dot product; a centre without rows stays."""
    found = _sums(rows, centres)
    moved = sum(f[2] for f in (found if before is None else _sums(rows, centres, before)).values())
    return {g: _means(centres[g], *found[g][:2]) if g in found else centres[g] for g in centres}, {g: f[1] for g, f in found.items()}, moved


def _means(centres: np.ndarray, sums: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    out = centres.copy()
    out[sizes > 0] = sums[sizes > 0] / sizes[sizes > 0, None]
    return out


def _gaps(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nearest centre, how far centres may move, in all, before it could be another) of each row."""
    dots, each = _dots(x, centres), np.arange(len(x))
    at = dots.argmax(1)
    own = dots[each, at]
    dots[each, at] = -np.inf
    size = np.sqrt((x * x).sum(1))
    room = np.where(size > 0, (own - dots.max(1)) / np.where(size > 0, 2 * size, 1), np.inf)
    return at, room - MARGIN * (1 + np.abs(centres).max())


def _with_gaps(points: DataFrame, centres: dict[int, np.ndarray]) -> DataFrame:
    """``points`` with ``gap``, sorted by it in each partition."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for g, ords, x in _by_group(b):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ords), g)), pa.array(ords), pa.array(x.tolist()), pa.array(_gaps(x, centres[g])[1])], names=["g", "ord", "embedding", "gap"])

    return points.mapInArrow(add, "g long, ord long, embedding array<double>, gap double").sortWithinPartitions("gap")


def _moved(x: np.ndarray, centres: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray, int, int]:
    """As _sums() with ``before``, of the rows at hand."""
    at, was = _dots(x, centres).argmax(1), _dots(x, before).argmax(1)
    use = np.flatnonzero(at != was)
    sums, sizes = np.zeros_like(centres), np.zeros(len(centres), np.int64)
    for slot, sign in ((at, 1), (was, -1)):
        np.add.at(sums, slot[use], sign * x[use])
        np.add.at(sizes, slot[use], sign)
    return sums, sizes, len(use), len(x)


def _lloyd(points: DataFrame, centres: dict[int, np.ndarray]) -> tuple[dict[int, np.ndarray], dict[int, np.ndarray], list[int]]:
    """(the centres that rows were last compared with, their means, rows compared in each round) of up to ROUNDS rounds."""
    whole = _sums(points, centres)
    sums, sizes, rows = ({g: f[i] for g, f in whole.items()} for i in (0, 1, 3))
    read = [sum(rows.values())]
    before, centres = centres, {g: _means(c, sums[g], sizes[g]) for g, c in centres.items()}
    used = before
    at_hand: dict[int, tuple] = {}  # of a group: gaps and vectors of the rows with the least gaps, and how far these reach
    written: DataFrame | None = None
    in_table: set[int] = set()
    drift: dict[int, float] = {}  # since the gaps of a group were taken
    for _ in range(1, ROUNDS):
        step = {g: float(np.sqrt(((centres[g] - before[g]) ** 2).sum(1)).max()) for g in centres}
        drift = {g: d + step[g] for g, d in drift.items()}
        near = [g for g in at_hand if drift[g] <= at_hand[g][2]]
        found = {g: (*_moved(at_hand[g][1][at_hand[g][0] <= drift[g]], centres[g], before[g]), 0) for g in near}
        due = [g for g in in_table if g not in near]
        full = [g for g in centres if g not in near and g not in due]
        if due:
            found |= _sums(written.filter(_any(lambda g: (F.col("g") == g) & (F.col("gap") <= drift[g]), due)).select("g", "ord", "embedding"), centres, before)  # noqa: B023
        if full:
            found |= _sums(points.filter(F.col("g").isin(full)), centres, before, {g: 2 * step[g] for g in full})
        read.append(sum(f[3] for f in found.values()))
        used = centres
        if not any(f[2] for f in found.values()):
            break
        few = [g for g in full if g in found and (found[g][4] <= AHEAD or rows[g] <= AHEAD)]
        some = [g for g in full if g in found and g not in few and 2 * found[g][4] < rows[g]]
        if few:
            least = _least(points.filter(F.col("g").isin(few)), lambda g, x, base=centres: _gaps(x, base[g])[1], [], AHEAD)
            for g, (gap, _, x) in least.items():
                at_hand[g], drift[g] = (gap, x, np.nextafter(gap[-1], -np.inf) if len(gap) == AHEAD else np.inf), 0.0
        if some:
            table = kept(_with_gaps(points.filter(F.col("g").isin(some)), centres), "gaps")
            written = table if written is None else written.unionByName(table)
            in_table |= set(some)
            drift |= dict.fromkeys(some, 0.0)
        for g, (s, k, *_) in found.items():
            sums[g], sizes[g] = sums[g] + s, sizes[g] + k
        before, centres = centres, {g: _means(c, sums[g], sizes[g]) for g, c in centres.items()}
    return used, centres, read


def _clustered(written: DataFrame, counts: dict[int, int]) -> tuple[dict[int, np.ndarray], dict[int, np.ndarray], list[int]]:
    points = written.select("g", "ord", "embedding")
    with scratch():
        return _lloyd(points, {g: np.stack([v for _, v in c]) for g, c in _seeds(points, counts).items()})


def _placed(candidates: DataFrame, used: dict[int, np.ndarray], centres: dict[int, np.ndarray], chars: Column) -> DataFrame:
    """``candidates`` (with ``g``) with ``seed``, the centre that a row belongs to, and ``fit``."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, groups = _matrix(b), b.column(b.schema.get_field_index("g")).to_numpy()
            at, fit = np.zeros(len(groups), np.int64), np.zeros(len(groups))
            for g in np.unique(groups):
                mine = groups == g
                at[mine] = _dots(x[mine], used[g]).argmax(1)
                fit[mine] = (x[mine] * centres[g][at[mine]]).sum(1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(at), pa.array(fit)], names=[*b.schema.names, "seed", "fit"])

    from pyspark.sql import types as P

    schema = P.StructType([*candidates.schema.fields, P.StructField("seed", P.LongType()), P.StructField("fit", P.DoubleType())])
    return candidates.mapInArrow(place, schema).withColumn("fit", weighted(F.col("fit"), chars))


def weighted(fit: Column, chars: Column | None = None) -> Column:
    """How well a row stands for its group: its likeness to the centre, less for a short text."""
    return fit * F.least((F.length("text") if chars is None else chars) / SUBSTANTIAL_CHARS, F.lit(1.0))


def group_sizes(members: DataFrame, by: str) -> DataFrame:
    """(by, size, weight): rows and sources of each group."""
    return members.groupBy(by).agg(F.count(F.lit(1)).alias("size"), F.count_distinct("source").alias("weight"))


def best_of(members: DataFrame, *by: str) -> DataFrame:
    """(by, rep): the row of each group that fits best, the least ord among equals."""
    shown = [c for c in ("ord", "id", "preview", "fit") if c in members.columns]
    return members.groupBy(*by).agg(F.max_by(F.struct(*shown), F.struct("fit", -F.col("ord"))).alias("rep"))


def representatives(members: DataFrame, by: str) -> DataFrame:
    """(by, rep) with the mean vector of each group as its centre; the groups are few."""
    centred = members.join(F.broadcast(centroid(members, by)), by)
    return best_of(centred.withColumn("fit", weighted(V.dot("embedding", "centroid"), _chars(members))).withColumn("preview", T.preview("text")), by)


@dataclass
class Clustering:
    """topics: (topic, rep_ord, rep_id, size, weight, label), heaviest first by topic number; members: the candidates with ``topic`` and ``representative``; read: the rows that each round read.

    narrow: (topic, ord, chars, embedding) of all members, if it was kept; ``among`` gives the members with some ords, which a join below takes as a filter of its inputs.
    """

    topics: DataFrame
    members: DataFrame
    read: list[int] = field(default_factory=list)
    narrow: DataFrame | None = None
    among: Callable[[list[int]], DataFrame] | None = None


def _topics(members: DataFrame) -> DataFrame:
    """The groups in ``seed`` of (seed, ord, id, source, fit), numbered by (weight, size) descending, then seed."""
    by_source = members.groupBy("seed", "source").agg(F.count(F.lit(1)).alias("n"), F.max_by(F.struct("ord", "id", "fit"), F.struct("fit", -F.col("ord"))).alias("rep"))
    groups = by_source.groupBy("seed").agg(F.sum("n").alias("size"), F.count("source").alias("weight"), F.max_by("rep", F.struct("rep.fit", -F.col("rep.ord"))).alias("rep"))
    order = Window.orderBy(F.desc("weight"), F.desc("size"), "seed")  # a row for each topic
    return groups.withColumn("topic", F.row_number().over(order)).select("topic", "seed", F.col("rep.ord").alias("rep_ord"), F.col("rep.id").alias("rep_id"), "size", "weight")


def cluster(candidates: DataFrame, count: int, keep: bool = False) -> Clustering:
    """At most ``count`` topics of the substantial candidates: spread seeds, then up to ROUNDS rounds of nearest centre by dot product with plain means.

    Topics without members vanish. If ``count`` reaches the pool's size, every row is a topic, the longest text first. Candidates are read once, without their texts.
    keep: for pick_within(), the narrow table of members stays until the scratch() around ends.
    """
    chars = _chars(candidates)
    pool = candidates.filter(chars >= SELECTABLE_CHARS)
    with scratch():
        n, narrow = -1, None
        if count > 0:
            narrow = kept(pool.select(F.lit(0).cast("long").alias("g"), "ord", "id", "source", "embedding", chars.alias("chars")), "narrow")
            n = narrow.limit(count + 1).count()
        if n <= max(count, 0):
            pool = pool if n == count > 0 else candidates.orderBy(F.desc(chars), "ord").limit(max(count, 0))
            rank = F.row_number().over(Window.orderBy(F.desc(chars), "ord"))
            single = pool.withColumn("topic", rank).withColumn("representative", F.lit(True))
            topics = single.select("topic", F.col("ord").alias("rep_ord"), F.col("id").alias("rep_id"), F.lit(1).cast("long").alias("size"), F.lit(1).cast("long").alias("weight"), T.preview("text").alias("label"))
            return Clustering(topics, single)
        used, centres, read = _clustered(narrow, {0: count})
        found = _topics(_placed(narrow, used, centres, F.col("chars")))
        rows = found.collect()  # ``count`` rows, as there are centres
        shown = pool.filter(F.col("ord").isin([r.rep_ord for r in rows])).select("ord", T.preview("text").alias("label"))
        labels = {r.ord: r.label for r in shown.collect()}
        topics = narrow.sparkSession.createDataFrame([(*r, labels[r.rep_ord]) for r in rows], found.withColumn("label", F.lit("")).schema)
        named = {r.seed: (r.topic, r.rep_ord) for r in rows}

        def among(ords: list[int] | None = None) -> DataFrame:
            return _named(pool if ords is None else pool.filter(F.col("ord").isin(ords)), used[0], named)

        table = kept(_named(narrow.select("ord", "chars", "embedding"), used[0], named).select("topic", "ord", "chars", "embedding"), "members", stay=True) if keep else None
    return Clustering(topics.drop("seed"), among(), read, table, among)


def _named(rows: DataFrame, used: np.ndarray, named: dict[int, tuple[int, int]]) -> DataFrame:
    """``rows`` with the ``topic`` of the centre that is nearest, and whether a row is its ``representative``."""
    topic, rep = (np.array([named.get(s, (0, 0))[i] for s in range(len(used))], np.int64) for i in (0, 1))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = _dots(_matrix(b), used).argmax(1) if b.num_rows else np.zeros(0, np.int64)
            mine = b.column(b.schema.get_field_index("ord")).to_numpy() == rep[at]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(topic[at], pa.int32()), pa.array(mine)], names=[*b.schema.names, "topic", "representative"])

    from pyspark.sql import types as P

    return rows.mapInArrow(place, P.StructType([*rows.schema.fields, P.StructField("topic", P.IntegerType()), P.StructField("representative", P.BooleanType())]))


def spread(candidates: DataFrame, count: int) -> DataFrame:
    """The representatives of ``count`` topics."""
    found = cluster(candidates, count)
    members = found.among([t.rep_ord for t in found.topics.collect()]) if found.among else found.members
    return members.filter("representative").orderBy("topic")


def allocate(topics: DataFrame, slots: int) -> DataFrame:
    """``topics`` with ``slots``: one each while they last, the rest by weight with largest remainders, ties in topic order."""
    whole = Window.partitionBy(F.lit(1))  # topics are few
    n = F.count(F.lit(1)).over(whole)
    spare = F.lit(max(slots, 0)) - n
    out = topics.withColumn("spare", spare).withColumn("exact", F.greatest(F.col("spare"), F.lit(0)).cast("double") * F.col("weight") / F.sum("weight").over(whole)).withColumn("part", F.floor("exact"))
    out = out.withColumn("left", F.greatest(F.col("spare"), F.lit(0)) - F.sum("part").over(whole)).withColumn("rank", F.row_number().over(Window.orderBy(F.desc(F.col("exact") - F.col("part")), "topic")))
    out = out.withColumn("first", F.row_number().over(Window.orderBy("topic")))
    mine = F.when(F.col("spare") <= 0, F.lit(1)).otherwise(1 + F.col("part") + (F.col("rank") <= F.col("left")).cast("long"))
    return out.filter(F.col("first") <= max(slots, 0)).withColumn("slots", mine.cast("long")).drop("spare", "exact", "part", "left", "rank", "first")


def pick_within(members: DataFrame | Clustering, slots: dict[int, int]) -> DataFrame:
    """Of ``members`` (with ``topic`` and ``representative``, or of a clustering that kept its narrow table), as many rows of each topic as ``slots`` says, chosen apart, from the substantial ones if they suffice.

    A topic that has no more rows gives all, and one slot takes the representative; otherwise a topic may give fewer. All topics are worked on
    in the same passes, however large they are, over (topic, ord, chars, embedding) written once. What is picked is told by ord: a number for each slot.
    """
    found = members if isinstance(members, Clustering) else None
    if found and found.narrow is None:
        found, members = None, found.members
    with scratch():
        if found:
            narrow = found.narrow.select(F.col("topic").cast("long").alias("g"), "ord", "chars", "embedding")
        else:
            narrow = kept(members.select(F.col("topic").cast("long").alias("g"), "ord", _chars(members).alias("chars"), "embedding"), "narrow")
        size = {r.g: r for r in narrow.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("chars") >= SELECTABLE_CHARS).alias("long")).collect()}  # a row a topic
        slots = {t: n for t, n in slots.items() if n > 0 and t in size}
        whole = [t for t, n in slots.items() if size[t].n <= n]
        single = [t for t, n in slots.items() if n == 1 and t not in whole]
        several = {t: n for t, n in slots.items() if t not in whole and n > 1}
        ords: list[int] = []
        short = [t for t in several if size[t].long < several[t]]  # the longest, as many as there are slots
        if short:
            rank = F.row_number().over(Window.partitionBy("g").orderBy(F.desc("chars"), "ord"))
            wanted = F.create_map(*[F.lit(x) for t in short for x in (t, several[t])])
            ords += [r.ord for r in narrow.filter(F.col("g").isin(short)).withColumn("rank", rank).filter(F.col("rank") <= wanted[F.col("g").cast("int")]).select("ord").collect()]
        enough = narrow.filter(F.col("chars") >= SELECTABLE_CHARS)
        exact = [t for t in several if size[t].long == several[t]]
        if exact:
            ords += [r.ord for r in enough.filter(F.col("g").isin(exact)).select("ord").collect()]
        apart = {t: n for t, n in several.items() if t not in short and t not in exact}
        if apart:
            pool = enough.filter(F.col("g").isin(list(apart)))
            used, centres, _ = _clustered(pool, apart)
            ords += [r.ord for r in best_of(_placed(pool, used, centres, F.col("chars")), "g", "seed").select("rep.ord").collect()]
        if found:  # all that is picked, by ord: at most as many as there are slots
            given = [r.ord for r in narrow.filter(F.col("g").isin(whole)).select("ord").collect()] if whole else []
            shown = [r.rep_ord for r in found.topics.filter(F.col("topic").isin(single)).collect()] if single else []
            members = found.among([*ords, *given, *shown])
    return members.filter(F.col("topic").isin(whole) | (F.col("topic").isin(single) & F.col("representative")) | F.col("ord").isin(ords))


def mmr_order(x: np.ndarray, query: np.ndarray, count: int, diversity: float) -> list[int]:
    """Places of ``count`` rows by maximal marginal relevance; both terms are rescaled over the pool at each step."""

    def scaled(v: np.ndarray) -> np.ndarray:
        span = v.max() - v.min()
        return np.zeros_like(v) if span < 1e-12 else (v - v.min()) / span

    if count >= len(x):
        return list(range(len(x)))
    if count <= 0:
        return []
    relevance = scaled((x * query).sum(1))
    chosen = [int(relevance.argmax())]
    nearest = (x * x[chosen[0]]).sum(1)
    while len(chosen) < count:
        value = (1 - diversity) * relevance - diversity * scaled(nearest)
        value[chosen] = -np.inf
        chosen.append(int(value.argmax()))
        nearest = np.maximum(nearest, (x * x[chosen[-1]]).sum(1))
    return chosen


def mmr(candidates: DataFrame, vector: list[float], count: int, diversity: float = 0.6) -> DataFrame:
    """``count`` candidates with ``pick`` from 1. The pool, a search result, is one group of bounded size."""
    from pyspark.sql import types as P

    def choose(table: pa.Table) -> pa.Table:
        table = table.sort_by("ord")
        x = np.array(table.column("embedding").to_pylist(), float)
        at = mmr_order(x, np.array(vector, float), count, diversity)
        return table.take(pa.array(at, pa.int64())).drop_columns(["one"]).append_column("pick", pa.array(range(1, len(at) + 1), pa.int64()))

    schema = P.StructType([*candidates.schema.fields, P.StructField("pick", P.LongType())])
    return candidates.withColumn("one", F.lit(1)).groupBy("one").applyInArrow(choose, schema)


def rank_topics(candidates: DataFrame, count: int = MOST_TOPICS) -> DataFrame:
    return cluster(candidates, count).topics


def gather_material(candidates: DataFrame, count: int, vector: list[float] | None = None, pool: int = 40, diversity: float = 0.4) -> DataFrame:
    """Chunks to build ``count`` items from, in document order: diverse hits of a query, or shares of every topic. Columns of ``candidates``."""
    if vector is not None:
        hits = search(candidates, vector, max(pool, count), pool).select("ord")
        picked = mmr(candidates.join(F.broadcast(hits), "ord", "left_semi"), vector, count, diversity)
    else:
        with scratch():
            found = cluster(candidates, min(count, MOST_TOPICS), keep=True)
            shares = allocate(found.topics, count).collect()  # MOST_TOPICS rows at most
            picked = pick_within(found, {t.topic: t.slots for t in shares})
    order = ["source", "page", "ord"] if "page" in candidates.columns else ["source", "ord"]
    return picked.select(*candidates.columns).orderBy(*order)


def coverage(chunks: DataFrame) -> DataFrame:
    """(source, chunks, first): how many chunks come from each document, and the first of them."""
    return chunks.groupBy("source").agg(F.count(F.lit(1)).alias("chunks"), F.min("ord").alias("first"))
