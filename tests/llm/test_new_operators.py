"""Vector codes, exact duplicates and collocations against plain Python, on odd rows and on whole tables; op2 on other layouts."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quire.llm import catalogue, collocations, exact_dup, mixing_model, vector_codes

DOC = "doc_id long, text string, lang string, row long, size int, prefix string, digest string, chars int, word string, f long, place long, score double"
VECTOR = "vec_id long, embedding array<float>, label int, x int, at string, was string, error long"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, lang, 1, 2, "p", "d", 3, "w", 4, 5, 0.5) for i, t, lang in rows], DOC).repartition(3)


# -- exact duplicates --


def plain_groups(rows):
    groups = defaultdict(list)
    for at, (i, t, _) in enumerate(rows):
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i is None, i or 0, at))
    out = Counter()
    for text, mine in groups.items():
        best = min(mine)
        for m in mine:
            out[rows[m[3]][0], rows[best[3]][0], len(mine), m[:3] == best[:3], hashlib.sha256(text.encode()).hexdigest()] += 1
    return out


def test_exact_duplicates_of_odd_rows(spark):
    long = "lorem ipsum " * 30_000
    rows = [(1, "a b", "x"), (2, "ab", "x"), (3, "a\tb\n", "x"), (4, None, "x"), (5, "", "x"), (6, " \x0b ", "x"), (7, long, "x"), (8, long.replace(" ", ""), "x"), (9, long + "!", "x"), (None, "only", None), (None, "ab ", "x"), (10, "a b", "x"), (11, "Ab", "x"), (12, "日本 語", "x"), (13, "日本語", "x"), (-5, "a b", "x")]
    got = exact_dup.exact_duplicates(docs(spark, rows), carry=("lang",)).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got) == plain_groups(rows)
    assert {r.doc_id: r.carried_0 for r in got}[7] == "x" and exact_dup.exact_duplicates(docs(spark, [])).count() == 0


def test_exact_duplicates_keep_one_of_repeated_rows(spark):
    got = exact_dup.exact_duplicates(docs(spark, [(1, "same", "x")] * 5 + [(None, "none", "x")] * 3)).collect()
    assert sorted((r.keep_id or 0, r.group_size, r.kept) for r in got) == [(0, 3, False)] * 2 + [(0, 3, True)] + [(1, 5, False)] * 4 + [(1, 5, True)]


def test_exact_duplicates_told_apart_late(spark):
    """Texts of one length, and of one length and prefix, that differ behind it; and a group that most rows belong to."""
    head = "h" * exact_dup.PREFIX
    rows = [(i, head + f"{i % 7:05d}", "x") for i in range(60)] + [(100 + i, f"{i % 5:05d}" + head, "x") for i in range(20)] + [(1000 + i, "copy " * (1 + i % 2) + "copy", "x") for i in range(300)]
    got = Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dup.exact_duplicates(docs(spark, rows)).collect())
    assert got == plain_groups(rows)


# -- vector codes --


def plain_codes(rows, parts, entries, rounds, scale=1024):
    kept = [(i, v, label) for i, v, label in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, [math.floor(scale * float(np.float32(x))) for x in r[1]]))
    kept = [r for r in kept if len(r[1]) == len(kept[0][1])]
    width = len(kept[0][1]) // parts
    cut = [[tuple(math.floor(scale * float(np.float32(x))) for x in v[p * width : (p + 1) * width]) for p in range(parts)] for _, v, _ in kept]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]
    away = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    assign = lambda: [[min(range(len(books[p])), key=lambda e: (away(c[p], books[p][e]), e)) for p in range(parts)] for c in cut]
    for _ in range(rounds):
        at = assign()
        for p in range(parts):
            for e in range(len(books[p])):
                mine = [c[p] for c, a in zip(cut, at, strict=True) if a[p] == e]
                if mine:
                    books[p][e] = tuple(sum(x) // len(mine) for x in zip(*mine, strict=True))
    at = assign()
    errors = [sum(away(c[p], books[p][a[p]]) for p in range(parts)) for c, a in zip(cut, at, strict=True)]
    by_label = Counter()
    for (_, _, label), e in zip(kept, errors, strict=True):
        by_label[label] += e
    sha = hashlib.sha256(",".join(str(x) for book in books for entry in book for x in entry).encode()).hexdigest()
    return Counter((i, "".join(f"{e:02x}" for e in a), err, by_label[label], sha) for (i, _, label), a, err in zip(kept, at, errors, strict=True))


def coded(table, **kw):
    return Counter((r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in vector_codes.vector_codes(table, **kw).collect())


def test_vector_codes_of_odd_rows(spark):
    rng = random.Random(3)
    rows = [(i, [rng.choice((-0.5, 0.25, rng.gauss(0, 0.3))) for _ in range(10)], rng.choice((0, 1, None))) for i in range(70)]
    rows += [(200, None, 1), (201, [], 1), (202, [1.0] * 9 + [None], 1), (203, [1.0] * 9 + [float("nan")], 0), (204, [float("inf")] + [0.0] * 9, 0), (205, [1.0] * 4, 1)]
    rows += [rows[3], (3, [0.1] * 10, 2), (None, [0.2] * 10, None), (-7, [0.0] * 10, 1), (300, [100.0] * 10, 1)]
    table = spark.createDataFrame([(*r, 1, "a", "w", 2) for r in rows], VECTOR)
    for parts, entries in ((2, 8), (5, 300)):
        want = plain_codes(rows, parts, entries, 3)
        for n in (1, 5):
            got = coded(table.repartition(n), parts=parts, entries=entries, rounds=3)
            assert Counter({k: v for k, v in got.items()}) == (want if entries <= 256 else Counter({(i, "".join("00" + c[j : j + 2] for j in range(0, len(c), 2)), *rest): v for (i, c, *rest), v in want.items()}))
    assert vector_codes.vector_codes(table.limit(0)).count() == vector_codes.vector_codes(table.filter("vec_id in (200, 201)")).count() == 0


def test_nearest_is_exact_for_large_components():
    x = np.array([[1 << 26, -(1 << 26)], [5, 5]], np.int64)
    entries = np.array([[(1 << 26) - 1, -(1 << 26)], [(1 << 26) + 1, -(1 << 26)], [5, 6], [6, 5]], np.int64)
    at, error = vector_codes.nearest(x, entries)
    assert at.tolist() == [0, 2] and error.tolist() == [1, 1]


def test_only_changes_are_shuffled(spark):
    """The second round's contributions are those of parts that changed, and sums that run on equal sums made anew."""
    rng = np.random.default_rng(2)
    x = rng.integers(-300, 300, (500, 8))
    table = spark.createDataFrame([(i, 0, v.tolist(), None) for i, v in enumerate(x)], "vec_id long, label int, x array<int>, at binary").repartition(3)
    books = x[:16].reshape(16, 2, 4).transpose(1, 0, 2)
    first = vector_codes._assigned(table, books).persist()
    moved = books + rng.integers(-40, 40, books.shape)
    second = vector_codes._assigned(first, moved).persist()
    changed = second.filter("was <> at").count()
    assert 0 < changed < 500 and first.filter("was is not null").count() == 0
    total = Counter()
    for step in (first, second):
        for r in vector_codes._changes(step, 2, 16, 4).collect():
            total[r.slot] = (total[r.slot] or np.zeros(5, np.int64)) if isinstance(total[r.slot], int) else total[r.slot]
            total[r.slot] = total[r.slot] + np.array([r.n, *r.sums])
    for p in range(2):
        at, _ = vector_codes.nearest(x[:, 4 * p : 4 * p + 4], moved[p])
        for e in range(16):
            have = total[p * 16 + e] if not isinstance(total[p * 16 + e], int) else np.zeros(5, np.int64)
            assert have.tolist() == [int((at == e).sum()), *x[at == e, 4 * p : 4 * p + 4].sum(0).tolist()]


# -- collocations --


def plain_collocations(rows, least, share, limit):
    f, n = defaultdict(Counter), Counter()
    for _, t, lang in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in (1, 2, 3):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, count in f.items():
        found = []
        candidates = {p: a for p, a in count.items() if len(p) > 1 and a >= least}
        dropped = {q for p, a in candidates.items() if len(p) == 3 for q in (p[:2], p[1:]) if q in candidates and 100 * a >= share * candidates[q]}
        for p, a in candidates.items():
            if p not in dropped:
                s, _, left, right = min((1_000_000 * a * a // (count[p[:k]] * count[p[k:]]), k, count[p[:k]], count[p[k:]]) for k in range(1, len(p)))
                found.append((-s, -a, " ".join(p).encode(), left, right))
        out += [(lang, at, p.decode(), -a, left, right, n[lang], -s) for at, (s, a, p, left, right) in enumerate(sorted(found)[:limit], 1)]
    return out


def mined(spark, table, **kw):
    return sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in collocations.collocations(table, **kw).collect())


def some_texts(seed, n):
    """Texts of few words, so that most phrases repeat, with all delimiters, long runs of blanks and other scripts."""
    rng = random.Random(seed)
    words = ["The", "the", "a", "b", "Éa", "éa", "日本", "x-y", "(z)", "ab", "a b", "q'", "=", "w1", "w2", "w3"]
    gaps = [" "] * 8 + ["  ", "\t", ", ", ".", "\n", " ; ", "\r\n", "!", "?:", "\x0b"]
    return [(i, "".join(x for _ in range(rng.randint(0, 60)) for x in (rng.choice(words), rng.choice(gaps))), rng.choice(("en", "en", "fr", None, "und"))) for i in range(n)]


@pytest.mark.parametrize("limit", [2000, 7])
def test_collocations_of_odd_rows(spark, monkeypatch, limit):
    """With few phrases at hand and small blocks, shards and filters, everything takes several turns and gives the same rows."""
    rows = some_texts(1, 900) + [(900, None, "en"), (901, "", None), (902, " ., \t\n", "zz"), (903, "a a " * 20_000, "fr"), (None, "w1 w2 w3 " * 30, "en"), (905, "one", "lone")]
    want = sorted(plain_collocations(rows, 10, 50, limit))
    assert mined(spark, docs(spark, rows), limit=limit) == want and len(want) > (100 if limit == 2000 else 15)
    if limit == 7:
        for name, value in (("AHEAD", 1), ("BLOCK", 60), ("SHARD_RUNS", 3000), ("HELD", 500), ("FILTER_CELLS", 60), ("SEEN", 4), ("LANES", 2)):
            monkeypatch.setattr(collocations, name, value)
        assert mined(spark, docs(spark, rows), limit=limit) == want


def test_collocations_with_bounds_that_are_loose(spark, monkeypatch):
    """A sketch of very few cells: its bounds are far too high, and the counts are exact all the same."""
    monkeypatch.setattr(collocations, "CELL", np.uint64(7))
    rows = some_texts(2, 160)
    assert mined(spark, docs(spark, rows), limit=5) == sorted(plain_collocations(rows, 10, 50, 5))


def test_collocations_drop_what_a_longer_phrase_holds(spark):
    rows = [(i, "red hot iron. red hot. blue sky", "en") for i in range(12)] + [(99, "red hot. " * 13, "en")]
    got = {r.phrase: r for r in collocations.collocations(docs(spark, rows)).collect()}
    assert set(got) == {"red hot iron", "red hot", "blue sky"}  # 12 of 37: a longer phrase is not half as frequent
    got = {r.phrase for r in collocations.collocations(docs(spark, rows[:-1])).collect()}
    assert got == {"red hot iron", "blue sky"}
    assert collocations.collocations(docs(spark, [])).count() == 0


def test_collocations_of_a_table(spark, small):
    table = spark.read.parquet(f"{small}/documents.parquet")
    rows = [(r.doc_id, r.text, r.lang) for r in table.collect()]
    assert mined(spark, table) == sorted(plain_collocations(rows, 10, 50, 2000))


def test_words_as_strings():
    w = collocations.words_of(pa.array(["Ab cd", "", "é, x"]), collocations.WORD)
    assert collocations.spelled(w, np.array([2, 0, 1, 3])).to_pylist() == ["é", "ab", "cd", "x"]


# -- the pipeline's language stage --

FOREIGN = {
    "fi": "Lapset menivät aamulla kouluun ja oppivat kirjoittamaan pitkän kirjeen. Illalla he kertoivat siitä vanhemmilleen, jotka olivat hyvin iloisia uutisesta ja säästä.",
    "pl": "Dzieci poszły rano do szkoły i nauczyły się pisać długi list. Wieczorem opowiedziały o tym rodzicom, którzy bardzo się ucieszyli z tej wiadomości i z pogody.",
    "tr": "Çocuklar sabah okula gittiler ve uzun bir mektup yazmayı öğrendiler. Akşam bunu anne babalarına anlattılar, onlar da çok sevindiler.",
    "ru": "Дети утром пошли в школу и научились писать длинное письмо. Вечером они рассказали об этом родителям, которые очень обрадовались.",
    "ja": "子供たちは朝学校に行き、長い手紙の書き方を学びました。夕方、両親にそのことを話しました。みんなとても喜びました。",
    "code": "for (int i = 0; i < n; i++) { sum += a[i] * b[i]; } if (sum > MAX_VALUE) { throw new RuntimeException(msg); } def f(x): return [y**2 for y in x if y % 2 == 0]",
}
NATURAL = {
    "en": "It was a bright cold day in April, and the clocks were striking thirteen. The committee will meet again on Tuesday to discuss whether the new library should open before winter.",
    "de": "Die Kinder gingen am Morgen in die Schule und lernten dort, wie man einen langen Brief schreibt. Am Abend erzählten sie ihren Eltern davon, und alle freuten sich.",
    "fr": "Les enfants sont partis à l'école ce matin et ils ont appris à écrire une longue lettre. Le soir, ils ont raconté leur journée à leurs parents.",
    "es": "Los niños fueron a la escuela por la mañana y aprendieron a escribir una carta larga. Por la noche contaron todo a sus padres, que estaban muy contentos.",
}


def test_language_stage_drops_what_was_not_learned(spark):
    """Texts in five languages without a label, and code, go; labelled texts stay, and so do natural ones in the languages that were learned."""
    import corpus_pipeline

    sf = "/root/testdata/sf0.01"
    table = spark.read.parquet(f"{sf}/documents.parquet")
    more = spark.createDataFrame([(10_000_000 + i, t, None, "x", len(t)) for i, t in enumerate([*FOREIGN.values(), *NATURAL.values()])], table.schema)
    left = {r.doc_id for r in corpus_pipeline.keep_language(spark, table.unionByName(more), sf).select("doc_id").collect()}
    assert not {10_000_000 + i for i in range(len(FOREIGN))} & left
    assert {10_000_000 + i for i in range(len(FOREIGN), len(FOREIGN) + len(NATURAL))} <= left
    worded = {r.doc_id for r in table.collect() if any(c.isalpha() for c in r.text or "")}
    assert len(worded - left) <= 0.01 * len(worded)


def test_runs_of_symbols_stay_inside_texts(spark):
    from quire.llm import language

    known = language.familiar(spark.createDataFrame([("abc", "x"), ("bcd", "x"), ("zzz", None), (None, "x")], "text string, lang string"))
    assert known.seen.sum() == 2 and known.most == language.MOST_UNFAMILIAR + 1
    got = language.with_unfamiliar(spark.createDataFrame([(1, "abcd"), (2, "abd"), (3, ""), (4, None), (5, "ab"), (6, "ABCx")], "doc_id long, text string"), known).collect()
    assert {r.doc_id: r.unfamiliar for r in got} == {1: 0.0, 2: 1.0, 3: 0.0, 4: 0.0, 5: 0.0, 6: 0.5}
    assert language.familiar(spark.createDataFrame([], "text string, lang string")).most > 1


# -- op2 --


def test_scores_do_not_depend_on_the_layout(spark, small):
    table = spark.read.parquet(f"{small}/documents.parquet")
    before, scores = spark.conf.get("spark.sql.shuffle.partitions"), []
    try:
        for parts, shuffle in ((1, 4), (7, 11)):
            spark.conf.set("spark.sql.shuffle.partitions", shuffle)
            scores.append({r.doc_id: r.score for r in mixing_model.context_mixing_scores(table.repartition(parts), F.col("doc_id") % 7 != 2).collect()})
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(scores[0]) == len(scores[1]) and all(scores[1][i] == pytest.approx(s, rel=1e-9) for i, s in scores[0].items())


def test_scores_with_common_words_and_phrases(spark, small, monkeypatch):
    """What a shard would not bear travels to the tasks; the scores are the same."""
    table = spark.read.parquet(f"{small}/documents.parquet")
    score = lambda: {r.doc_id: (r.score, r.n_known) for r in mixing_model.context_mixing_scores(table, F.col("doc_id") % 7 != 2).collect()}
    want = score()
    for name, value in (("COMMON", 1 << 30), ("SHARD", 64), ("HELD", 100)):
        monkeypatch.setattr(mixing_model, name, value)
    got = score()
    assert all(got[i][1] == n and got[i][0] == pytest.approx(s, rel=1e-9) for i, (s, n) in want.items())


def test_batches_of_texts_and_packed_rows_are_bounded(spark, monkeypatch):
    """By bytes, so that a worker's memory does not follow the length of 10,000 rows; the setting is the caller's again afterwards."""
    key, sizes = "spark.sql.execution.arrow.maxBytesPerBatch", []
    before, usual = spark.conf.get(key), mixing_model.BATCH
    table = spark.createDataFrame([(i, f"{i % 9} some words " * 300) for i in range(60)], "doc_id long, text string").coalesce(1)
    scored = mixing_model._scorer

    def watched(*args):
        sizes.append(spark.conf.get(key))
        return scored(*args)

    monkeypatch.setattr(mixing_model, "_scorer", watched)
    want = {r.doc_id: r.score for r in mixing_model.context_mixing_scores(table, F.col("doc_id") % 7 != 2).collect()}
    monkeypatch.setattr(mixing_model, "BATCH", "20k")
    got = {r.doc_id: r.score for r in mixing_model.context_mixing_scores(table, F.col("doc_id") % 7 != 2).collect()}
    assert sizes == [usual, "20k"] and spark.conf.get(key) == before
    assert len(got) == 60 and all(got[i] == pytest.approx(s, rel=1e-9) for i, s in want.items())
    with mixing_model._batches(spark):
        rows = table.mapInArrow(lambda batches: (pa.record_batch([pa.array([b.num_rows])], names=["n"]) for b in batches), "n long").collect()
    assert max(r.n for r in rows) <= 10 and sum(r.n for r in rows) == 60


def test_registered(spark, small):
    assert {"op11_vector_codes", "op12_exact_dedup", "op13_collocations"} <= set(catalogue.QUERIES) & set(catalogue.SQL)
