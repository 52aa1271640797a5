import numpy as np
import pytest

from quire.operators import search as K
from quire.operators import selection as S
from quire.plans import bindings as B

SCHEMA = "ord long, id string, source string, text string, embedding array<float>, page long"


@pytest.fixture(scope="module")
def chunks(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(60, 8))
    v[7] = v[3]
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    rows = [(i, f"c{i}", f"s{i % 5}", "x" * (150 + 13 * (i % 40)), v[i].tolist(), 1) for i in range(60)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).persist()


def plain(chunks):
    rows = sorted(chunks.collect(), key=lambda r: r.ord)
    return rows, np.array([r.embedding for r in rows])


def model_cluster(rows, x, count):
    pool = [i for i, r in enumerate(rows) if len(r.text) >= 200]
    v = x[pool]
    mean = v.mean(0)
    seeds = [max(range(len(v)), key=lambda i: float(v[i] @ mean))]
    near = v @ v[seeds[0]]
    while len(seeds) < count:
        seeds.append(min((i for i in range(len(v)) if i not in seeds), key=lambda i: near[i]))
        near = np.maximum(near, v @ v[seeds[-1]])
    c, old = v[seeds].copy(), None
    for _ in range(6):
        at = (v @ c.T).argmax(1)
        if old is not None and (at == old).all():
            break
        old = at
        for k in set(at):
            c[k] = v[at == k].mean(0)
    out = []
    for k in sorted(set(at)):
        m = np.flatnonzero(at == k)
        best = max(m, key=lambda i: float(v[i] @ c[k]) * min(len(rows[pool[i]].text) / 400, 1))
        out.append((len({rows[pool[i]].source for i in m}), len(m), k, rows[pool[best]].ord))
    return sorted(out, key=lambda t: (-t[0], -t[1], t[2]))


def test_cluster_against_plain_python(chunks):
    rows, x = plain(chunks)
    found = S.cluster(chunks, 5)
    got = [(t.weight, t["size"], t.rep_ord) for t in found.topics.orderBy("topic").collect()]
    assert got == [(w, n, o) for w, n, _, o in model_cluster(rows, x, 5)]
    assert found.members.count() == sum(n for _, n, _ in got)


@pytest.mark.parametrize("ahead", [2, 7])
def test_cluster_in_many_passes(chunks, monkeypatch, ahead):
    """Few rows at hand: seeds and rounds go back to the written tables again and again, with the same topics."""
    monkeypatch.setattr(S, "AHEAD", ahead)
    monkeypatch.setattr(S, "PARTIALS", 1)
    rows, x = plain(chunks)
    for count in (3, 9):
        got = [(t.weight, t["size"], t.rep_ord) for t in S.cluster(chunks, count).topics.orderBy("topic").collect()]
        assert got == [(w, n, o) for w, n, _, o in model_cluster(rows, x, count)]


@pytest.mark.parametrize("ahead", [4, 256])
def test_rounds_compare_fewer_rows(spark, monkeypatch, ahead):
    """Of rows in clear groups only those near a border are compared again, and nothing stays cached."""
    monkeypatch.setattr(S, "AHEAD", ahead)
    rng = np.random.default_rng(9)
    places = rng.normal(size=(4, 3))
    places /= np.linalg.norm(places, axis=1, keepdims=True)
    v = places[rng.integers(0, 4, 3000)] + 0.2 * rng.normal(size=(3000, 3))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    many = spark.createDataFrame([(i, f"c{i}", f"s{i % 5}", "x" * 300, e.astype(np.float32).tolist(), 1) for i, e in enumerate(v)], SCHEMA).repartition(4)
    found = S.cluster(many, 4)
    assert found.read[0] == 3000 and len(found.read) > 4 and max(found.read[4:]) < 300, found.read
    got = [(t.weight, t["size"], t.rep_ord) for t in found.topics.orderBy("topic").collect()]
    rows, x = plain(many)
    assert got == [(w, n, o) for w, n, _, o in model_cluster(rows, x, 4)]
    cached = spark.sparkContext._jsc.getPersistentRDDs().size()
    S.gather_material(many, 7).collect()
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == cached


def test_allocate_more_or_fewer_slots_than_topics(spark):
    topics = spark.createDataFrame([(1, 7), (2, 5), (3, 1)], "topic int, weight long")
    slots = lambda n: [r.slots for r in S.allocate(topics, n).orderBy("topic").collect()]
    assert slots(0) == slots(-2) == [] and slots(2) == [1, 1] and slots(3) == [1, 1, 1] and slots(16) == [8, 6, 2] and S.allocate(topics.limit(0), 3).count() == 0


def test_cluster_small_pools(chunks):
    assert S.cluster(chunks, 0).topics.count() == 0
    few = chunks.filter("ord < 4")
    got = S.cluster(few, 10).topics.orderBy("topic").collect()
    assert [t.rep_ord for t in got] == [3, 2, 1, 0] and all(t["size"] == t.weight == 1 for t in got)
    assert S.cluster(chunks.limit(0), 3).topics.count() == 0


def test_mmr_against_plain_python(chunks):
    rows, x = plain(chunks)
    q = x[0]
    got = [r.ord for r in S.mmr(chunks, q.tolist(), 6, 0.4).orderBy("pick").collect()]
    scale = lambda a: (a - a.min()) / (a.max() - a.min())
    rel = scale(x @ q)
    chosen = [int(rel.argmax())]
    near = x @ x[chosen[0]]
    while len(chosen) < 6:
        value = 0.6 * rel - 0.4 * scale(near)
        chosen.append(max((i for i in range(len(x)) if i not in chosen), key=lambda i: value[i]))
        near = np.maximum(near, x @ x[chosen[-1]])
    assert got == chosen
    assert S.mmr(chunks.filter("ord < 3"), q.tolist(), 5).count() == 3


def test_allocate(spark):
    t = spark.createDataFrame([(1, 5), (2, 3), (3, 3), (4, 1)], "topic int, weight long")
    slots = lambda n: [r.slots for r in S.allocate(t, n).orderBy("topic").collect()]
    assert slots(10) == [4, 3, 2, 1] and slots(3) == [1, 1, 1] and slots(4) == [1] * 4 and slots(0) == []


def test_search_ties_and_scores(chunks):
    v = [r for r in chunks.collect() if r.ord == 3][0].embedding
    got = K.search(chunks, list(v), 3).orderBy("rank").collect()
    assert [r.ord for r in got[:2]] == [3, 7] and abs(got[0].score - 1) < 1e-6 and -1 <= got[2].score <= 1


def test_gather_material(chunks):
    got = S.gather_material(chunks, 14).collect()
    assert 0 < len(got) <= 14 and [(r.source, r.page, r.ord) for r in got] == sorted((r.source, r.page, r.ord) for r in got)
    assert S.gather_material(chunks, 5, [1.0] + [0.0] * 7).count() == 5
    assert S.gather_material(chunks.limit(0), 5).count() == 0


def test_pick_within_many_topics(spark, small):
    """Topics picked together give what each gives by itself in plain Python."""
    members = S.cluster(B.vectors(spark, small), 4).members.persist()
    slots = {1: 3, 2: 5, 3: 1, 4: 2}
    got = {t: sorted(r.ord for r in S.pick_within(members, slots).filter(f"topic = {t}").collect()) for t in slots}
    for t, n in slots.items():
        rows, x = plain(members.filter(f"topic = {t}"))
        want = [r.ord for r in rows] if len(rows) <= n else [r.ord for r in rows if r.representative] if n == 1 else [o for _, _, _, o in model_cluster(rows, x, n)]
        assert got[t] == sorted(want)


def test_pick_within_short_rows(spark):
    rows = [(i, f"c{i}", "s", "x" * n, [float(i % 3 == k) for k in range(3)], 1, 1, i == 0) for i, n in enumerate([50, 60, 70, 300, 400, 80])]
    members = spark.createDataFrame(rows, SCHEMA + ", topic int, representative boolean")
    pick = lambda n: sorted(r.ord for r in S.pick_within(members, {1: n}).collect())
    assert pick(0) == [] and pick(1) == [0] and pick(2) == [3, 4] and pick(3) == [3, 4, 5] and pick(9) == list(range(6))


def _shuffled(spark):
    """Bytes that all stages so far have written to shuffles."""
    gateway = spark.sparkContext._gateway
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


@pytest.mark.parametrize("query", ["gather_material", "pick_within"])
def test_picks_shuffle_no_texts(spark, tmp_path, query):
    """The join of texts and vectors is made once, without the texts; what is picked is the same as by a broadcast join."""
    from quire.plans import vector_queries as Q

    rng = np.random.default_rng(5)
    v = rng.normal(size=(300, 8)).astype(np.float32)
    text = [rng.integers(33, 127, 20_000, dtype=np.uint8).tobytes().decode() for _ in range(300)]
    spark.createDataFrame([(i, t, f"s{i % 5}") for i, t in enumerate(text)], "doc_id long, text string, source string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, e.tolist(), i % 3) for i, e in enumerate(v)], "vec_id long, embedding array<float>, label int").repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    want = sorted(map(tuple, Q.QUERIES[query](spark, str(tmp_path)).collect()))
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = _shuffled(spark)
        got = sorted(map(tuple, Q.QUERIES[query](spark, str(tmp_path)).collect()))
        moved = _shuffled(spark) - before
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    assert got == want and moved < 0.3 * sum(map(len, text)), moved
