"""Queries on vectors: search, clustering and selection."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import retrieval as R
from ..operators import search as K
from ..operators import selection as S
from ..sources import scratch as W
from . import bindings as B

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_Q = f"{B.VECTORS}, q as (select v as qv from vectors order by ord limit 1)"
_DOT = "list_dot_product({}, {})"
_SCORE = "1 - list_sum(list_transform(list_zip(v, qv), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) / 2"


@query(f"with {_Q} select ord, id, source, round({_SCORE}, 6) as score from vectors, q order by {_SCORE} desc, ord limit 10")
def topk_search(spark, sf_dir):
    c = B.vectors(spark, sf_dir)
    return K.search(c, B.first_vector(c), 10).select("ord", "id", "source", F.round("score", 6).alias("score"))


@query(f"with {_Q}, s as (select ord, {_SCORE} as score from vectors, q order by score desc, ord limit 40) select ord, round(score, 6) as score, row_number() over (order by score desc, ord) as rank from s order by rank limit 5")
def search_ranked(spark, sf_dir):
    c = B.vectors(spark, sf_dir)
    return K.search(c, B.first_vector(c), 5, fetch_k=40).select("ord", F.round("score", 6).alias("score"), "rank")


@query(f"with {_Q} select ord, round({_DOT.format('v', 'qv')}, 6) as similarity, round({_SCORE}, 6) as score from vectors, q")
def pairwise_similarity(spark, sf_dir):
    c = B.vectors(spark, sf_dir)
    q = K.query_column(B.first_vector(c))
    return c.select("ord", F.round(V.dot("embedding", q), 6).alias("similarity"), F.round(V.distance_score("embedding", q), 6).alias("score"))


@query(f"with {B.VECTORS}, u as (select ord, unnest(v) as x, unnest(range(0, len(v))) as i from vectors) select ord, i, round(x / sqrt(sum(x * x) over (partition by ord)), 6) + 0.0 as x from u")
def normalise(spark, sf_dir):
    c = B.vectors(spark, sf_dir).withColumn("w", F.transform(V.doubles("embedding"), lambda x: x * 3))
    return c.select("ord", F.posexplode(V.normalise("w")).alias("i", "x")).select("ord", F.col("i").cast("long").alias("i"), (F.round("x", 6) + F.lit(0.0)).alias("x"))


_CENTRES = f"{B.VECTORS}, e as (select label, ord, unnest(v) as x, unnest(range(1, len(v) + 1)) as i from vectors), m as (select label, i, avg(x) as x from e group by label, i), centres as (select label, list(x order by i) as centroid from m group by label)"


@query(f"with {_CENTRES} select label, i - 1 as i, round(x, 6) + 0.0 as x from m")
def centroid(spark, sf_dir):
    means = S.centroid(B.vectors(spark, sf_dir), "label").select("label", F.posexplode("centroid").alias("i", "x"))
    return means.select("label", F.col("i").cast("long").alias("i"), (F.round("x", 6) + F.lit(0.0)).alias("x"))


_FIT = "list_dot_product(v, centroid) * least(length(text) / 400, 1.0)"


@query(f"with {_CENTRES}, r as (select v.label, ord, {_FIT} as fit, row_number() over (partition by v.label order by {_FIT} desc, ord) as rn from vectors v join centres c on c.label = v.label) select label, ord, round(fit, 6) as fit from r where rn = 1")
def representative(spark, sf_dir):
    best = S.representatives(B.vectors(spark, sf_dir), "label")
    return best.select("label", "rep.ord", F.round("rep.fit", 6).alias("fit"))


@query(f"with {B.VECTORS} select label, count(*) as size, count(distinct source) as weight from vectors group by label")
def topic_weight(spark, sf_dir):
    return S.group_sizes(B.vectors(spark, sf_dir), "label")


_TOPICS = "t as (select row_number() over (order by count(*) desc, label) as topic, count(*) as weight from embeddings group by label)"


@query(f"with {_TOPICS}, x as (select *, 27.0::double * weight / sum(weight) over () as e from t), f as (select *, floor(e) as p, row_number() over (order by e - floor(e) desc, topic) as rn from x), l as (select *, 27 - sum(p) over () as more from f) select topic, weight, (1 + p + case when rn <= more then 1 else 0 end)::bigint as slots from l")
def allocate(spark, sf_dir):
    order = Window.orderBy(F.desc("weight"), "label")
    t = B.table(spark, sf_dir, "embeddings").groupBy("label").agg(F.count(F.lit(1)).alias("weight")).withColumn("topic", F.row_number().over(order)).drop("label")
    return S.allocate(t, 37).select("topic", "weight", "slots")


@query(f"with {B.VECTORS} select ord, length(text) as chars from vectors where length(text) >= 200")
def substantial(spark, sf_dir):
    return S.substantial(B.vectors(spark, sf_dir), 12).select("ord", F.length("text").alias("chars"))


@query(f"with {B.VECTORS} select ord, length(text) as chars from vectors order by length(text) desc, ord limit 30")
def substantial_fallback(spark, sf_dir):
    return S.substantial(B.vectors(spark, sf_dir), 30, least=1_000_000).select("ord", F.length("text").alias("chars"))


_MANY = """with e as (select vec_id, embedding::double[] as v from embeddings), p as (select q.vec_id as query, e.vec_id as ord, 1 - list_sum(list_transform(list_zip(e.v, q.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) / 2 as s from e, e q where q.vec_id % 100 = 0)
select query, ord, round(s, 6) as score, row_number() over (partition by query order by s desc, ord)::int as rank from p qualify rank <= 10"""


def _asked(spark, sf_dir):
    e = B.table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("ord"), "embedding"), e.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("vector"))


@query(_MANY)
def retrieve_table(spark, sf_dir):
    """The ten nearest of all vectors for each whose id is divisible by 100, by blocks of matrix products."""
    chunks, queries = _asked(spark, sf_dir)
    return R.search_many(chunks, queries, 10).withColumn("score", F.round("score", 6))


@query(_MANY)
def cell_search(spark, sf_dir):
    """The same through cells around pivots."""
    chunks, queries = _asked(spark, sf_dir)
    return R.Cells.build(chunks, W.folder(spark, "cells")).search(queries, 10)[0].withColumn("score", F.round("score", 6))


@query(f"with {_Q}, s as (select label, ord, {_DOT.format('v', 'qv')} as s from vectors, q) select ord, round(case when max(s) over w - min(s) over w < 1e-12 then 0 else (s - min(s) over w) / (max(s) over w - min(s) over w) end, 6) as scaled from s window w as (partition by label)")
def rescale(spark, sf_dir):
    c = B.vectors(spark, sf_dir)
    s = c.select("ord", "label", V.dot("embedding", K.query_column(B.first_vector(c))).alias("s"))
    w = Window.partitionBy("label")
    return s.select("ord", F.round(V.rescale(F.col("s"), F.min("s").over(w), F.max("s").over(w)), 6).alias("scaled"))


_SUBSET = f"{B.VECTORS}, pool as (select * from vectors where length(text) >= 200)"


def _seed_sql(k: int) -> str:
    steps = [
        f"with {_SUBSET}, e as (select unnest(v) as x, unnest(range(1, len(v) + 1)) as i from pool), c as (select list(x order by i) as m from (select i, avg(x) as x from e group by i))",
        ", s1 as materialized (select ord, v from pool, c order by list_dot_product(v, m) desc, ord limit 1), n1 as materialized (select p.ord, p.v, list_dot_product(p.v, s1.v) as near from pool p, s1)",
    ]
    for j in range(2, k + 1):
        taken = " union all ".join(f"select ord from s{i}" for i in range(1, j))
        steps.append(f", s{j} as materialized (select ord, v from n{j - 1} where ord not in ({taken}) order by near, ord limit 1), n{j} as materialized (select n.ord, n.v, greatest(near, list_dot_product(n.v, s{j}.v)) as near from n{j - 1} n, s{j})")
    return "".join(steps) + " " + " union all ".join(f"select {j} as pick, ord from s{j}" for j in range(1, k + 1))


@query(_seed_sql(4))
def spread_seeds(spark, sf_dir):
    seeds = S.spread_seeds(S.substantial(B.vectors(spark, sf_dir), 4), 4)
    return spark.createDataFrame([(i, o) for i, (o, _) in enumerate(seeds, 1)], "pick int, ord long")


@query(f"with {_CENTRES}, a as (select v.ord, v.v, arg_max(c.label, (list_dot_product(v.v, c.centroid), -c.label)) as topic from vectors v, centres c group by v.ord, v.v), e2 as (select topic, unnest(v) as x, unnest(range(1, len(v) + 1)) as i from a), m2 as (select topic, i, avg(x) as x from e2 group by topic, i) select a.topic, count(distinct a.ord) as members, any_value(s.first_x) as first_x from a join (select topic, round(x, 6) as first_x from m2 where i = 1) s on s.topic = a.topic group by a.topic")
def lloyd_round(spark, sf_dir):
    """One round from the means of the labels: nearest centre by dot product, then new means."""
    c = B.vectors(spark, sf_dir)
    means = S.centroid(c, "label").orderBy("label").collect()  # ten labels
    new, sizes, _ = S.lloyd_step(c.select(F.lit(0).cast("long").alias("g"), "ord", "embedding"), {0: np.array([m.centroid for m in means])})
    rows = [(m.label, int(n), float(x[0])) for m, n, x in zip(means, sizes[0], new[0], strict=True) if n]
    return spark.createDataFrame(rows, "topic int, members long, first_x double").withColumn("first_x", F.round("first_x", 6))


def _grouped_sql(p: str, pool: str, most: int) -> str:
    """Clusters inside each group of ``pool`` (g, ord, source, v, text) as {p}groups (g, seed, size, weight, rep): the seeds, of which {p}want (g, slots) has the numbers, and all rounds written out."""
    mean = lambda rows, by: f"select {by}, list(x order by i) as c from (select {by}, i, avg(x) as x from (select {by}, unnest(v) as x, unnest(range(1, len(v) + 1)) as i from {rows}) group by {by}, i) group by {by}"
    nearest = lambda at: f"select p.g, p.ord, arg_max(c.seed, (list_dot_product(p.v, c.c), -c.seed)) as seed from {pool} p join {p}c{at} c on c.g = p.g group by p.g, p.ord"
    steps = [
        f"{p}m as ({mean(pool, 'g')})",
        f"{p}s1 as materialized (select g, ord, v from (select p.g, ord, v, row_number() over (partition by p.g order by list_dot_product(v, c) desc, ord) as rn from {pool} p join {p}m m on m.g = p.g) where rn = 1)",
        f"{p}n1 as materialized (select p.g, p.ord, p.v, list_dot_product(p.v, s.v) as near, p.ord = s.ord as used from {pool} p join {p}s1 s on s.g = p.g)",
    ]
    for j in range(2, most + 1):
        steps.append(f"{p}s{j} as materialized (select g, ord, v from (select n.*, row_number() over (partition by n.g order by near, ord) as rn from {p}n{j - 1} n join {p}want w on w.g = n.g where not used and w.slots >= {j}) where rn = 1)")
        steps.append(f"{p}n{j} as materialized (select n.g, n.ord, n.v, case when s.v is null then near else greatest(near, list_dot_product(n.v, s.v)) end as near, used or coalesce(n.ord = s.ord, false) as used from {p}n{j - 1} n left join {p}s{j} s on s.g = n.g)")
    steps.append(f"{p}c0 as materialized (" + " union all ".join(f"select g, {j} as seed, v as c from {p}s{j}" for j in range(1, most + 1)) + ")")
    for r in range(1, 7):
        steps.append(f"{p}a{r} as materialized ({nearest(r - 1)})")
        moved = mean(f"(select a.g, a.seed, p.v from {pool} p join {p}a{r} a on a.g = p.g and a.ord = p.ord)", "g, seed")
        steps.append(f"{p}c{r} as materialized (select o.g, o.seed, coalesce(m.c, o.c) as c from {p}c{r - 1} o left join ({moved}) m on m.g = o.g and m.seed = o.seed)")
    fit = "list_dot_product(p.v, c.c) * least(length(p.text) / 400, 1.0)"
    steps.append(f"{p}placed as materialized (select p.g, p.ord, p.source, p.v, p.text, p.id, p.page, a.seed, {fit} as fit from {pool} p join {p}a6 a on a.g = p.g and a.ord = p.ord join {p}c6 c on c.g = a.g and c.seed = a.seed)")
    steps.append(f"{p}groups as (select g, seed, count(*) as size, count(distinct source) as weight, arg_max(ord, (fit, -ord)) as rep from {p}placed group by g, seed)")
    return ", ".join(steps)


def _topics_sql(count: int) -> str:
    """Topics of all substantial vectors as topics (topic, seed, size, weight, rep)."""
    return f"""{B.VECTORS}, pool as materialized (select 0 as g, * from vectors where length(text) >= 200), t_want as (select 0 as g, {count} as slots), {_grouped_sql("t_", "pool", count)},
topics as materialized (select row_number() over (order by weight desc, size desc, seed) as topic, * from t_groups), named as materialized (select t.topic, p.* from t_placed p join topics t on t.seed = p.seed)"""


def _picks_sql(most: int) -> str:
    """The rows of named that shares (topic, slots) takes, as picks (ord)."""
    return f"""sized as materialized (select t.topic, t.rep, t.size, s.slots from topics t join shares s on s.topic = t.topic), p_want as (select topic as g, slots from sized where slots > 1 and size > slots),
apart as materialized (select topic as g, ord, source, v, text, id, page from named where topic in (select g from p_want)), {_grouped_sql("p_", "apart", most)},
picks as (select ord from named n join sized s on s.topic = n.topic where s.size <= s.slots or (s.slots = 1 and n.ord = s.rep) union all select rep from p_groups)"""


_LABEL = r"regexp_replace(regexp_replace(text, '^\s+|\s+$', '', 'g'), '\s+', ' ', 'g')"


@query(f"with {_topics_sql(12)}, l as (select topic, rep as rep_ord, id as rep_id, size, weight, {_LABEL} as t from topics join vectors on ord = rep) select topic, rep_ord, rep_id, size, weight, substr(t, 1, 70) || case when length(t) > 70 then '...' else '' end as label from l")
def cluster_topics(spark, sf_dir):
    return S.rank_topics(B.vectors(spark, sf_dir), 12)


@query(f"with {_topics_sql(8)} select rep as ord, topic, source from topics join vectors on ord = rep")
def spread(spark, sf_dir):
    return S.spread(B.vectors(spark, sf_dir), 8).select("ord", "topic", "source")


@query(f"with {_topics_sql(6)}, shares as (select topic, 3 as slots from topics), {_picks_sql(3)} select p.ord, n.topic, n.source from picks p join named n on n.ord = p.ord")
def pick_within(spark, sf_dir):
    """Three rows of every topic, chosen apart."""
    with W.scratch():
        found = S.cluster(B.vectors(spark, sf_dir), 6, keep=True)
        return S.pick_within(found, dict.fromkeys(range(1, 7), 3)).select("ord", "topic", "source")


def _mmr_sql(k: int, diversity: float = 0.6) -> str:
    near, far = round(1 - diversity, 6), diversity
    steps = [f"with {_Q}, pool as materialized (select ord, v, {_DOT.format('v', 'qv')} as s from (select * from vectors, q order by {_SCORE} desc, ord limit 40)), r as materialized (select ord, v, (s - min(s) over ()) / (max(s) over () - min(s) over ()) as rel from pool), p1 as materialized (select ord, v from r order by rel desc, ord limit 1), n1 as materialized (select r.ord, r.v, rel, list_dot_product(r.v, p1.v) as near from r, p1)"]
    for j in range(2, k + 1):
        taken = " union all ".join(f"select ord from p{i}" for i in range(1, j))
        steps.append(
            f", p{j} as materialized (select ord, v from (select *, (near - min(near) over ()) / (max(near) over () - min(near) over ()) as sc from n{j - 1}) where ord not in ({taken}) order by {near} * rel - {far} * sc desc, ord limit 1)"
            f", n{j} as materialized (select n.ord, n.v, rel, greatest(near, list_dot_product(n.v, p{j}.v)) as near from n{j - 1} n, p{j})"
        )
    return "".join(steps) + " " + " union all ".join(f"select {j} as pick, ord from p{j}" for j in range(1, k + 1))


_SHARES = """x as (select *, 8.0::double * weight / sum(weight) over () as e from topics), f as (select *, floor(e) as part, row_number() over (order by e - floor(e) desc, topic) as rn from x),
shares as materialized (select topic, (1 + part + case when rn <= 8 - (select sum(part) from f) then 1 else 0 end)::bigint as slots from f)"""


@query(_mmr_sql(4))
def mmr(spark, sf_dir):
    c = B.vectors(spark, sf_dir)
    q = B.first_vector(c)
    return S.mmr(K.search(c, q, 40).drop("score", "rank"), q, 4).select("pick", "ord")


@query(f"with {_topics_sql(12)}, {_SHARES}, {_picks_sql(9)} select p.ord, n.source, n.page from picks p join named n on n.ord = p.ord")
def gather_material(spark, sf_dir):
    return S.gather_material(B.vectors(spark, sf_dir), 20).select("ord", "source", "page")


@query(f"select m.ord, d.source, m.ord % 7 + 1 as page from ({_mmr_sql(10, 0.4)}) m join documents d on d.doc_id = m.ord")
def gather_material_topic(spark, sf_dir):
    c = B.vectors(spark, sf_dir)
    return S.gather_material(c, 10, B.first_vector(c)).select("ord", "source", "page")


@query(f"with {B.VECTORS} select source, count(*) as chunks, min(ord) as first from vectors group by source")
def coverage_by_source(spark, sf_dir):
    return S.coverage(B.vectors(spark, sf_dir))
