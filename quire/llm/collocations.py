"""Phrase collocations: candidates from sketch upper bounds, counted exactly by Aho-Corasick automata.

1. Words are counted exactly, per language.
2. Every run of two or three words adds to one cell of a sketch, by hash. The sketch has as many shards of 2**32 cells as the
   corpus needs, so its bounds stay tight as the corpus grows; tasks add up what they see and send packed cells and counts, and a
   shard is summed where it arrives. A cell's sum is an upper bound of the count of every phrase in it: cells below the least count are gone.
3. A second pass over the texts, with a Bloom filter of the cells that are left (in blocks of bounded size), writes the phrases that
   fall into them. Bounds of a phrase's count and of the counts of its words give an upper bound of its score.
4. The phrases with the highest bounds, the parts that they are cut into and the longer phrases that could drop them compile into automata, a
   phrase guarded by a delimiter on both sides, and a scan of all texts counts all matches, overlapping ones included; the counts of all tasks are summed.
   If the last rank that counts does not yet beat the next bound, the next phrases are counted too, until it does, so the
   result is that of counting everything. How many phrases that takes follows from the ranks asked for, not from the corpus.

Phrases live and die by their exact counts; the sketch only says what need not be counted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import documents, kept, scratch
from .wordhash import U, hash_of, mix, slices, words_of
from .wordhash import shingles as runs

LEAST, SHARE, LIMIT, LONGEST = 10, 50, 2000, 3
DELIMITERS = ".,;:!?\n\x0b\x0c\r"
SHARD_RUNS = 1 << 20  # runs of words for each shard of the sketch, on average
HELD = 2 << 20  # runs that a task adds up before it sends their cells
FILTER_BITS, FILTER_CELLS = 28, 1 << 24  # largest Bloom filter, and how many cells go into one
CHUNK_BITS = 16
CELL = U(0xFFFFFFFF)  # bits of a key that name its cell in the shard
BLOCK = 200_000  # phrases in the automata of one scan
AHEAD = 2  # times LIMIT: phrases of each language that the first scan counts
LANES = 16  # in which the first ranks of a language are found before they meet
SEEN = 1 << 18  # phrases that a task remembers having written
WORD = np.ones(256, bool)
WORD[[0x20, 0x09, *map(ord, DELIMITERS)]] = False
END = np.zeros(256, bool)
END[[*map(ord, DELIMITERS)]] = True
#: A-Z as a-z, a tab as a space, and every delimiter as a line end.
PLAIN = bytes(c + 32 if 65 <= c <= 90 else 0x20 if c == 9 else 10 if chr(c) in DELIMITERS else c for c in range(256))


def spelled(w, at: np.ndarray) -> pa.Array:
    """The words with the numbers ``at`` as strings."""
    size = w.size[at]
    ends = np.cumsum(size)
    place = np.repeat(w.start[at] - (ends - size), size) + np.arange(int(size.sum()))
    return pa.StringArray.from_buffers(len(at), pa.py_buffer(np.r_[0, ends].astype(np.int32).tobytes()), pa.py_buffer(w.low[place].tobytes()))


def _languages(part: pa.RecordBatch) -> tuple[np.ndarray, list[str]]:
    """The number of each row's language, and the names."""
    coded = part.column("lang").dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary.to_pylist()


def _runs(part: pa.RecordBatch, longest: int) -> Iterator[tuple]:
    """(words, k, first word of each run, key of (language, run), language of each row, names) of one slice, for k from 2; runs stay within pieces."""
    w = words_of(part.column("text"), WORD)
    lang, names = _languages(part)
    if len(w.hash) < 2:
        return
    piece = np.cumsum(END[w.low])[w.start]
    salt = np.array([hash_of(n) for n in names], U)[lang]
    for k in range(2, longest + 1):
        m = len(w.hash) - k + 1
        if m <= 0:
            return
        at = np.flatnonzero((w.doc[:m] == w.doc[k - 1 :]) & (piece[:m] == piece[k - 1 :]))
        whole = np.flatnonzero(w.doc[:m] == w.doc[k - 1 :])
        key = runs(w, k, short=False)[1][np.searchsorted(whole, at)]
        yield w, k, at, mix(key ^ salt[w.doc[at]]), lang, names


def _cells(key: np.ndarray, shards: int) -> np.ndarray:
    """shard << 32 | cell of each key."""
    return ((key >> U(32)) % U(shards)) << U(32) | key & CELL


def _texts(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"))


def word_counts(texts: DataFrame) -> DataFrame:
    """(lang, word, f) of (text, lang)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b, "text"):
                w = words_of(part.column("text"), WORD)
                lang, names = _languages(part)
                _, at, n = np.unique(mix(w.hash ^ mix(lang[w.doc].astype(U) + U(1))), return_index=True, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()).take(pa.array(lang[w.doc[at]])), spelled(w, at), pa.array(n)], names=["lang", "word", "f"])

    return texts.mapInArrow(count, "lang string, word string, f long").groupBy("lang", "word").agg(F.sum("f").alias("f"))


def sketch(texts: DataFrame, shards: int, least: int, longest: int) -> DataFrame:
    """(shard, cell, bound) of the cells of (text, lang) with sums of at least ``least``."""

    def packed(keys: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        cell, n = np.unique(np.concatenate(keys), return_counts=True)
        for wide in (False, True):  # counts of one byte, and the few larger ones
            mine = (n > 255) == wide
            c, k = cell[mine], n[mine]
            shard, first = np.unique(c >> U(32), return_index=True)
            last = np.r_[first[1:], len(c)]
            if len(shard):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shard.astype(np.int32)), pa.array([c[a:b].astype("<u4").tobytes() for a, b in zip(first, last, strict=True)], pa.binary()), pa.array([k[a:b].astype("<i8" if wide else "u1").tobytes() for a, b in zip(first, last, strict=True)], pa.binary())],
                    names=["shard", "cells", "counts"],
                )

    def see(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, held = [], 0
        for b in batches:
            for part in slices(b, "text"):
                for _, _, _, key, _, _ in _runs(part, longest):
                    keys.append(_cells(key, shards))
                    held += len(key)
                if held >= HELD:
                    yield from packed(keys)
                    keys, held = [], 0
        if held:
            yield from packed(keys)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        waiting: dict[int, int] = {}
        for b in batches:
            for shard, cells, counts in zip(*[b.column(c).to_pylist() for c in ("shard", "cells", "counts")], strict=True):
                c = np.frombuffer(cells, "<u4")
                mine = held.setdefault(shard, [])
                mine.append((c, np.frombuffer(counts, "u1" if len(counts) == len(c) else "<i8")))
                waiting[shard] = waiting.get(shard, 0) + len(c)
                if waiting[shard] > SHARD_RUNS:
                    held[shard], waiting[shard] = [summed(mine)], 0
        for shard, mine in held.items():
            c, n = summed(mine)
            hot = n >= least
            yield pa.RecordBatch.from_arrays([pa.array(np.full(int(hot.sum()), shard, np.int32)), pa.array(c[hot].astype(np.int64)), pa.array(n[hot])], names=["shard", "cell", "bound"])

    def summed(mine: list) -> tuple[np.ndarray, np.ndarray]:
        cells, counts = np.concatenate([c for c, _ in mine]), np.concatenate([n.astype(np.int64) for _, n in mine])
        order = np.argsort(cells, kind="stable")
        cells, counts = cells[order], counts[order]
        first = np.flatnonzero(np.r_[True, cells[1:] != cells[:-1]]) if len(cells) else np.empty(0, np.int64)
        return cells[first], np.add.reduceat(counts, first) if len(first) else counts

    sent = texts.mapInArrow(see, "shard int, cells binary, counts binary").repartition(shards, "shard")
    return sent.mapInArrow(add, "shard int, cell long, bound long")


def _bits(key: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    h = mix(key)
    return (h & U((1 << bits) - 1)).astype(np.int64), (h >> U(64 - bits)).astype(np.int64)


def cell_filter(cells: DataFrame, n: int) -> np.ndarray:
    """A Bloom filter of the ``n`` cells (shard, cell); built in the executors, of 2**FILTER_BITS bits at most."""
    bits = min(FILTER_BITS, max(CHUNK_BITS, (16 * n).bit_length()))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key = b.column("shard").to_numpy().astype(U) << U(32) | b.column("cell").to_numpy().astype(U)
            bit = np.unique(np.concatenate(_bits(key, bits)))
            chunk, first = np.unique(bit >> CHUNK_BITS, return_index=True)
            yield pa.RecordBatch.from_arrays([pa.array(chunk), pa.array([(x & 0xFFFF).astype("<u2").tobytes() for x in np.split(bit, first[1:])] if len(bit) else [], pa.binary())], names=["chunk", "set"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for b in batches:
            for chunk, set_ in zip(b.column("chunk").to_pylist(), b.column("set").to_pylist(), strict=True):
                held.setdefault(chunk, np.zeros(1 << CHUNK_BITS, bool))[np.frombuffer(set_, "<u2")] = True
        for chunk, x in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([chunk]), pa.array([np.packbits(x, bitorder="little").tobytes()], pa.binary())], names=["chunk", "set"])

    placed = cells.mapInArrow(place, "chunk long, set binary").repartition("chunk").mapInArrow(gather, "chunk long, set binary")
    out = np.zeros(1 << bits >> 3, np.uint8)
    for r in placed.collect():  # 32 MB at most
        out[r.chunk << (CHUNK_BITS - 3) : (r.chunk + 1) << (CHUNK_BITS - 3)] = np.frombuffer(r.set, np.uint8)
    return out


def _held(key: np.ndarray, bitmap: np.ndarray) -> np.ndarray:
    a, b = _bits(key, len(bitmap).bit_length() + 2)
    first = np.flatnonzero(bitmap[a >> 3] >> (a & 7).astype(np.uint8) & 1)
    return first[(bitmap[b[first] >> 3] >> (b[first] & 7).astype(np.uint8) & 1).astype(bool)]


def phrases_in(texts: DataFrame, cells: DataFrame, shards: int, longest: int) -> DataFrame:
    """(lang, phrase, k, bound) of the distinct runs of words of (text, lang) whose cell is in ``cells``."""
    spark, n = texts.sparkSession, cells.count()
    blocks = max(1, -(-n // FILTER_CELLS))
    out = None
    for block in range(blocks):
        mine = cells if blocks == 1 else cells.filter(F.pmod(F.xxhash64("shard", "cell"), F.lit(blocks)) == block)
        sent = spark.sparkContext.broadcast(cell_filter(mine, n // blocks))

        def find(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            seen = np.zeros(SEEN, U)
            for b in batches:
                for part in slices(b, "text"):
                    for w, k, at, key, lang, names in _runs(part, longest):
                        cell = _cells(key, shards)
                        hit = _held(cell, sent.value)
                        hit = hit[np.unique(key[hit], return_index=True)[1]]
                        slot = (key[hit] >> U(20)).astype(np.int64) % SEEN
                        new = seen[slot] != key[hit]
                        hit, slot = hit[new], slot[new]
                        seen[slot] = key[hit]
                        if len(hit):
                            phrase = pc.binary_join_element_wise(*[spelled(w, at[hit] + j) for j in range(k)], " ")
                            yield pa.RecordBatch.from_arrays(
                                [pa.array(names, pa.string()).take(pa.array(lang[w.doc[at[hit]]])), phrase, pa.array(np.full(len(hit), k)), pa.array((cell[hit] >> U(32)).astype(np.int32)), pa.array((cell[hit] & U(0xFFFFFFFF)).astype(np.int64))],
                                names=["lang", "phrase", "k", "shard", "cell"],
                            )

        seen = texts.mapInArrow(find, "lang string, phrase string, k long, shard int, cell long").distinct()
        found = kept(seen.join(mine, ["shard", "cell"]).select("lang", "phrase", "k", "bound"), "phrases")
        sent.destroy()
        out = found if out is None else out.unionByName(found)
    return out


def score(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 * a * a / (left * right)), exact up to counts of 10**15."""
    wide = lambda c: c.cast("decimal(16,0)")
    return F.call_function("div", (wide(a) * wide(a)).cast("decimal(31,0)") * F.lit(1000000).cast("decimal(7,0)"), wide(left) * wide(right))


def bounded(phrases: DataFrame, words: DataFrame, longest: int) -> DataFrame:
    """``phrases`` with ``most``, which no score of theirs exceeds, and ``bound`` cut by the counts of their words.

    A cut's parts occur at least as often as the phrase, so a score is at most the phrase's count over that of its first word, or of its last.
    """
    out = phrases.withColumn("w", F.split("phrase", " "))
    for j in range(longest):
        named = words.select("lang", F.col("word").alias(f"w{j}"), F.col("f").alias(f"f{j}"))
        out = out.withColumn(f"w{j}", F.get("w", F.lit(j))).join(named, ["lang", f"w{j}"], "left")
    enough = F.col("f0").isNotNull()
    for j in range(1, longest):
        enough = enough & ((F.col("k") <= j) | F.col(f"f{j}").isNotNull())
    count = F.least("bound", *[f"f{j}" for j in range(longest)])
    last = F.element_at(F.array(*[f"f{j}" for j in range(longest)]), F.col("k").cast("int"))
    most = F.when(F.col("k") == 2, score(count, F.col("f0"), last)).otherwise(score(count, count, F.greatest("f0", last)))
    return out.filter(enough).select("lang", "phrase", "k", count.alias("bound"), most.alias("most"))


def exact_counts(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """(lang, phrase, f) of all places of the distinct phrases in ``wanted`` (lang, phrase) in (text, lang), in scans of BLOCK phrases."""
    spark, out = texts.sparkSession, None
    wanted = kept(wanted.select("lang", "phrase").distinct(), "wanted")
    blocks = max(1, -(-wanted.count() // BLOCK))
    for block in range(blocks):
        rows = wanted.filter(F.pmod(F.xxhash64("lang", "phrase"), F.lit(blocks)) == block).toArrow().sort_by([("lang", "ascending"), ("phrase", "ascending")])  # about BLOCK
        lists: dict[str, tuple[int, list[str]]] = {}
        for i, (lang, phrase) in enumerate(zip(rows["lang"].to_pylist(), rows["phrase"].to_pylist(), strict=True)):
            lists.setdefault(lang, (i, []))[1].append(phrase)
        sent = spark.sparkContext.broadcast({"lists": lists, "made": {}, "n": rows.num_rows})

        def scan(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            import ahocorasick

            here = sent.value
            counts = np.zeros(here["n"], np.int64)
            for b in batches:
                for text, lang in zip(b.column("text"), b.column("lang").to_pylist(), strict=True):
                    if lang not in here["lists"]:
                        continue
                    if lang not in here["made"]:  # once for each worker
                        automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
                        first, phrases = here["lists"][lang]
                        for i, phrase in enumerate(phrases):
                            automaton.add_word(f" {phrase} ", first + i)
                        automaton.make_automaton()
                        here["made"][lang] = automaton
                    plain = text.as_buffer().to_pybytes().translate(PLAIN).replace(b"\n", b" \n ").decode()
                    hits = [i for _, i in here["made"][lang].iter(f" {' '.join(filter(None, plain.split(' ')))} ")]
                    if hits:
                        np.add.at(counts, hits, 1)
            some = np.flatnonzero(counts)
            lang_of = [lang for lang, (_, phrases) in here["lists"].items() for _ in phrases]
            phrase_of = [p for _, phrases in here["lists"].values() for p in phrases]
            if len(some):
                yield pa.RecordBatch.from_arrays([pa.array([lang_of[i] for i in some], pa.string()), pa.array([phrase_of[i] for i in some], pa.string()), pa.array(counts[some])], names=["lang", "phrase", "f"])

        found = kept(texts.mapInArrow(scan, "lang string, phrase string, f long").groupBy("lang", "phrase").agg(F.sum("f").alias("f")), "counted")
        sent.destroy()
        out = found if out is None else out.unionByName(found)
    return out


def _parts(phrases: DataFrame) -> DataFrame:
    """(lang, phrase, cut, left, right) of every cut of (lang, phrase)."""
    w = F.split("phrase", " ")
    cut = phrases.select("lang", "phrase", F.explode(F.sequence(F.lit(1), F.size(w) - 1)).alias("cut"))
    return cut.select("lang", "phrase", "cut", F.array_join(F.slice(w, F.lit(1), F.col("cut")), " ").alias("left"), F.array_join(F.slice(w, F.col("cut") + 1, F.size(w)), " ").alias("right"))


def _inside(phrases: DataFrame) -> DataFrame:
    """(lang, phrase, longer, bound) for every shorter phrase of at least two words inside (lang, phrase, k, bound)."""
    w = F.split("phrase", " ")
    at = F.flatten(F.transform(F.sequence(F.lit(2), F.col("k").cast("int") - 1), lambda n: F.transform(F.sequence(F.lit(1), F.col("k").cast("int") - n + 1), lambda i: F.array_join(F.slice(w, i, n), " "))))
    return phrases.filter("k > 2").select("lang", F.explode(F.array_distinct(at)).alias("phrase"), F.col("phrase").alias("longer"), "bound")


def collocations(docs: DataFrame, least: int = LEAST, share: int = SHARE, limit: int = LIMIT, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): of each language the ``limit`` phrases of two or three words with the highest scores.

    A-Z is lower-cased; texts fall into pieces at ``.,;:!?`` and line ends, pieces into words at spaces and tabs. A phrase counts with all its
    places inside pieces, overlapping ones too, if they are at least ``least``. Cut after its first word or words its score is floor(1000000 * a * a / (l * r)), with the
    counts of both parts; the lowest-scoring cut counts, the first of equals. A phrase inside a longer one that occurs at least ``share`` percent as often is dropped.
    Order: score, then a, both descending, then the phrase by its bytes. A null language is ``und``, a null text empty. Texts are read whole, however
    long; repeated rows count each. A language without words has no rows; an empty table gives an empty result. Other columns are ignored.
    """
    texts = _texts(docs, text_col, lang_col)
    with scratch():
        words = kept(word_counts(texts), "words")
        totals = kept(words.groupBy("lang").agg(F.sum("f").alias("n")), "totals")
        total = totals.agg(F.sum("n")).first()[0] or 0
        shards = max(16, -(-total * (LONGEST - 1) // SHARD_RUNS))
        cells = kept(sketch(texts, shards, least, LONGEST), "cells")
        words = kept(words.filter(F.col("f") >= least), "frequent")
        phrases = kept(bounded(phrases_in(texts, cells, shards, LONGEST), words, LONGEST), "bounded")
        order = [F.desc("most"), F.desc("bound"), "phrase"]
        counted, open_, ahead = words.select("lang", F.col("word").alias("phrase"), "f").limit(0), None, AHEAD * limit
        inside = _inside(phrases)
        while True:
            here = phrases if open_ is None else phrases.join(open_, "lang", "left_semi")
            ranked = kept(_first(here, order, "place", ahead + 1), "ranked")
            chosen = ranked.filter(F.col("place") <= ahead)
            while True:  # once, and again only where a bound was loose
                got = counted.select("lang", "phrase", "f")
                known = chosen.select("lang", "phrase", "k", F.col("bound").alias("b")).join(got, ["lang", "phrase"], "left").withColumn("b", F.coalesce("f", "b"))
                longer = inside.join(known.filter(F.col("b") >= least).select("lang", "phrase", "b"), ["lang", "phrase"]).filter(100 * F.col("bound") >= share * F.col("b"))
                cut = _parts(chosen.select("lang", "phrase"))
                wanted = chosen.select("lang", "phrase").unionByName(longer.select("lang", F.col("longer").alias("phrase")))
                for side in ("left", "right"):
                    wanted = wanted.unionByName(cut.select("lang", F.col(side).alias("phrase")).filter(F.instr("phrase", " ") > 0))
                missing = kept(wanted.distinct().join(got, ["lang", "phrase"], "left_anti"), "missing")
                if missing.isEmpty():
                    break
                new = exact_counts(texts, missing)
                # A phrase that is only a hash's clash has no place at all.
                new = missing.join(new, ["lang", "phrase"], "left").select("lang", "phrase", F.coalesce("f", F.lit(0)).cast("long").alias("f"))
                counted = kept(counted.unionByName(new), "counts")
            best = _ranked(chosen, counted, words, inside, least, share, limit)
            best = kept(best, "best")
            # A language is settled if nothing is left to count in it, or its last rank beats the best that the next phrase could be.
            last = best.filter(F.col("rank") == limit).select("lang", F.struct(-F.col("score"), -F.col("a"), "phrase").alias("last"))
            next_ = ranked.filter(F.col("place") == ahead + 1).select("lang", F.struct(-F.col("most"), -F.col("bound"), "phrase").alias("next"))
            left = kept(next_.join(last, "lang", "left").filter(F.col("last").isNull() | (F.col("last") > F.col("next"))).select("lang"), "open")
            settled = best.join(left, "lang", "left_anti")
            out = settled if open_ is None else out.unionByName(settled)
            if left.isEmpty():
                break
            open_, ahead = left, 4 * ahead
        out = kept(out.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score"), "collocations", stay=True)
    return out


def _ranked(chosen: DataFrame, counted: DataFrame, words: DataFrame, inside: DataFrame, least: int, share: int, limit: int) -> DataFrame:
    """Scores of the chosen phrases by exact counts, without those dropped by longer ones, ranked in each language up to ``limit``."""
    f = counted.select("lang", "phrase", "f").unionByName(words.select("lang", F.col("word").alias("phrase"), "f"))
    mine = chosen.select("lang", "phrase", "k").join(counted, ["lang", "phrase"]).filter(F.col("f") >= least).withColumnRenamed("f", "a")
    cut = _parts(mine.select("lang", "phrase"))
    for side, name in (("left", "l"), ("right", "r")):
        cut = cut.join(f.select("lang", F.col("phrase").alias(side), F.col("f").alias(name)), ["lang", side])
    cut = cut.join(mine, ["lang", "phrase"]).withColumn("score", score(F.col("a"), F.col("l"), F.col("r")))
    scored = cut.groupBy("lang", "phrase").agg(F.min(F.struct("score", "cut", "a", "l", "r")).alias("c")).select("lang", "phrase", "c.*")
    over = inside.join(mine.select("lang", "phrase", "a"), ["lang", "phrase"]).join(counted.select("lang", F.col("phrase").alias("longer"), "f"), ["lang", "longer"])
    over = over.filter((F.col("f") >= least) & (100 * F.col("f") >= share * F.col("a"))).select("lang", "phrase").distinct()
    left = scored.join(over, ["lang", "phrase"], "left_anti")
    return _first(left, [F.desc("score"), F.desc("a"), "phrase"], "rank", limit).drop("cut")


def _first(rows: DataFrame, order: list, name: str, count: int) -> DataFrame:
    """The first ``count`` rows of each language with their place as ``name``; lanes are ranked first, so what meets in a task does not grow with the rows."""
    lane = F.pmod(F.xxhash64("phrase"), F.lit(LANES))
    some = rows.withColumn("lane", lane).withColumn(name, F.row_number().over(Window.partitionBy("lang", "lane").orderBy(*order))).filter(F.col(name) <= count)
    return some.drop("lane").withColumn(name, F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col(name) <= count)


def op13_collocations(spark, sf_dir: str) -> DataFrame:
    return collocations(documents(spark, sf_dir))


QUERIES = {"op13_collocations": op13_collocations}
SQL = {
    "op13_collocations": r"""
with p as (select coalesce(lang, 'und') as lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece from documents),
w as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as w from p),
g as (select lang, unnest(list_concat(w, [array_to_string(w[i:i+1], ' ') for i in range(1, len(w))], [array_to_string(w[i:i+2], ' ') for i in range(1, len(w) - 1)])) as phrase from w),
f as materialized (select lang, phrase, count(*)::hugeint as f, len(string_split(phrase, ' ')) as k from g group by all),
n as (select lang, sum(f)::bigint as n from f where k = 1 group by 1),
c as materialized (select lang, phrase, f as a, k, string_split(phrase, ' ') as w from f where k > 1 and f >= 10),
cut as (select lang, phrase, a, k, w, unnest(range(1, k)) as cut from c),
s as (select cut.lang, cut.phrase, cut.a, cut.k, cut.cut, x.f as l, y.f as r, 1000000::hugeint * cut.a * cut.a // (x.f * y.f) as score from cut
  join f x on x.lang = cut.lang and x.phrase = array_to_string(w[1:cut], ' ') join f y on y.lang = cut.lang and y.phrase = array_to_string(w[cut+1:], ' ')),
best as (select * from s qualify row_number() over (partition by lang, phrase order by score, cut) = 1),
inside as (select lang, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) as phrase, a from c where k = 3),
longer as (select lang, phrase, max(a) as a from inside group by all),
stay as (select best.* from best left join longer on longer.lang = best.lang and longer.phrase = best.phrase where best.k = 3 or longer.a is null or 100 * longer.a < 50 * best.a)
select lang, row_number() over (partition by lang order by score desc, a desc, phrase)::bigint as rank, phrase, a::bigint as a, l::bigint as l, r::bigint as r, n::bigint as n, score::bigint as score
from stay join n using (lang) qualify rank <= 2000
"""
}
