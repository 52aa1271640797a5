import re

from hypothesis import given, settings
from hypothesis import strategies as st

from quire.operators import chunking as C

PAGES = "source string, page long, text string"


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab. \n!?\"“A", max_size=400), st.integers(20, 80), st.integers(0, 12))
def test_spans_cover_the_text(text, size, overlap):
    got = C.spans(text, size, overlap)
    if not text.strip() and len(text) <= size:
        assert got == []
        return
    if not text:
        return
    assert got[0][0] == 0 and got[-1][1] == len(text)
    starts = [a for a, _ in got]
    assert starts == sorted(set(starts)) and all(b <= d for (_, b), (_, d) in zip(got, got[1:]))
    assert all(c <= b for (_, b), (c, _) in zip(got, got[1:]))
    assert all(b - a <= size for a, b in got[:-1]) and got[-1][1] - got[-1][0] <= size * 1.15 + 1


def test_spans_prefer_strong_breaks():
    text = "a" * 34 + "\n\n" + "b" * 15 + " " + "c" * 40
    assert C.spans(text, 50, 0)[0] == (0, 36)
    assert C.spans("x" * 100, 40, 0) == [(0, 40), (40, 80), (80, 100)]
    assert C.spans("x" * 84, 40, 0) == [(0, 40), (40, 84)]


def test_overlap_starts_at_a_break():
    text = "word " * 40
    spans = C.spans(text, 60, 12)
    assert all(a == 0 or text[a - 1] == " " for a, _ in spans) and any(c < b for (_, b), (c, _) in zip(spans, spans[1:]))


def test_segments_join_running_sentences(spark):
    df = spark.createDataFrame([("a", 1, "It starts here and"), ("a", 2, " "), ("a", 3, "goes on."), ("a", 4, "New one"), ("a", 5, "• point"), ("a", 6, "Capital")], PAGES)
    got = [(r.pages, r.text, r.starts) for r in C.segments(df).orderBy("segment").collect()]
    assert got == [([1, 3], "It starts here and\ngoes on.", [0, 19]), ([4], "New one", [0]), ([5], "• point", [0]), ([6], "Capital", [0])]


def test_chunks_know_their_pages(spark):
    first, second = "alpha beta gamma delta " * 20 + "and", "so it carries on to the end of all this text. " * 20
    df = spark.createDataFrame([("w/n.txt", 1, first), ("w/n.txt", 2, second), ("w/n.txt", 3, "Short."), ("w/n.txt", 4, "A closing page that is long enough to be kept here.")], PAGES)
    rows = C.chunk_documents(df, 250, 25).orderBy("chunk_index").collect()
    assert [r.chunk_index for r in rows] == list(range(len(rows)))
    assert rows[0].page == 1 and rows[0].page_end == 2 and rows[-1].page == 4 and rows[-1].page_end is None
    assert rows[0].id == "w_n_p1_c0" and all(len(r.text) >= 40 and r.section is None for r in rows)
    joined = first + "\n" + second
    assert all(joined[r.start : r.end].strip() == r.text for r in rows if r.segment == rows[0].segment)


def test_chunks_against_plain_python(spark, small):
    from quire.plans import page_queries as Q

    rows = Q.chunk_spans(spark, small).collect()
    docs = {str(r.doc_id): r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    for source in sorted({r.source for r in rows})[:40]:
        body = docs[source]
        pages = [body[i : i + 800] for i in range(0, max(len(body), 1), 800)]
        segs, held = [], []
        for p in pages:
            if not p.strip():
                continue
            if held:
                a, b = held[-1].rstrip(), p.lstrip()
                runs_on = a[-1] not in ".!?:;。！？…\"')]}”’" and not re.match(r"\s*([•●▪–—\-*·]|\d+[.)]|[a-z][.)])\s", b.splitlines()[0]) and b[0].islower()
                if not runs_on:
                    segs.append(held)
                    held = []
            held.append(p)
        want = [x for s in [*segs, held] if s for t in ["\n".join(s)] for a, b in C.spans(t, 1000, 100) if len(x := t[a:b].strip()) >= 40]
        assert want == [r.text for r in sorted((r for r in rows if r.source == source), key=lambda r: r.chunk_index)]


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab. \n!?\"“A", min_size=1, max_size=600), st.integers(20, 60), st.integers(0, 12), st.integers(70, 200))
def test_blocks_give_the_spans_of_the_whole_walk(text, size, overlap, block):
    """Entries and exits of blocks, composed, lead every block into the walk over the whole text."""
    n, right = len(text), size + int(size * C.SHORT_TAIL) + 30
    if n <= size:
        return
    found, at = [], 0
    for k in range(-(-n // block)):
        low = max(0, k * block - 30)
        part = text[low : (k + 1) * block + right]
        if (low and not part[:30].strip()) or (low + len(part) < n and not part[-30:].strip()):
            return
        walk = C.Walk(part, low, n, size, overlap)
        if at >= 0:
            found += walk.spans(k * block + at, (k + 1) * block)
            at = int(walk.exits(k * block, (k + 1) * block, size)[at])
    assert found == C.spans(text, size, overlap) and at == -1


def plain_chunks(pages, size, overlap):
    """(text, page, page_end, segment, start, end) of the chunks of one document, a whole segment at a time."""
    out, segs = [], []
    for number, text in sorted(pages):
        if text.strip():
            runs_on = segs and segs[-1][-1][1].rstrip()[-1] not in ".!?:;。！？…\"')]}”’" and not re.match(r"\s*([•●▪–—\-*·]|\d+[.)]|[a-z][.)])\s", text.lstrip().splitlines()[0]) and text.lstrip()[0].islower()
            segs[-1].append((number, text)) if runs_on else segs.append([(number, text)])
    lower = segs and segs[0][0][1].lstrip()[0].islower()
    for i, seg in enumerate(segs, 0 if lower else 1):  # as if a blank page came before
        whole, starts = "\n".join(t for _, t in seg), [0]
        for _, t in seg:
            starts.append(starts[-1] + len(t) + 1)
        at = lambda o, starts=starts, seg=seg: seg[max(k for k, s in enumerate(starts[:-1]) if s <= o)][0]
        for a, b in C.spans(whole, size, overlap):
            body = whole[a:b].strip()
            if len(body) >= 40:
                out.append((body, at(a), at(b - 1) if at(b - 1) != at(a) else None, i, a, b))
    return out


def test_documents_larger_than_a_task(spark, monkeypatch):
    """Small blocks: documents of many page blocks, segments of many text blocks and groups of them, and blanks that no context holds."""
    import random

    for name, value in (("PAGE_BLOCK", 4), ("TEXT_BLOCK", 1700), ("GROUP", 3), ("CONTEXT", 64)):
        monkeypatch.setattr(C, name, value)
    rng = random.Random(7)
    sentence = lambda: rng.choice(("", "", "", "B", "• ")) + " ".join("w" * rng.randint(1, 9) for _ in range(rng.randint(3, 60))) + rng.choice((" and", ".", "", "\n\nthen", " x"))
    docs = {f"d{i}": [(p, sentence() * rng.randint(1, 9) if rng.random() > 0.1 else "  ") for p in range(1, rng.randint(2, 60))] for i in range(12)}
    docs["long"] = [(1, "word " * 9000 + "and"), (2, "on it goes " * 400)]
    docs["stuck"] = [(1, "y" * 20_000), (7, "z z" * 3000)]
    docs["blank"] = [(1, "start of it" + " " * 3000 + "and " * 900), (2, "more of this " * 300)]
    docs["high"] = [(5000 + p, f"page {p} of a text that runs") for p in range(30)]
    table = spark.createDataFrame([(s, p, t) for s, pages in docs.items() for p, t in pages], PAGES).repartition(5)
    got = {}
    for r in C.chunk_documents(table, 26, 5).orderBy("source", "chunk_index").collect():
        got.setdefault(r.source, []).append(r)
    for s, pages in docs.items():
        mine = got.get(s, [])
        assert [r.chunk_index for r in mine] == list(range(len(mine)))
        want = plain_chunks(pages, 104, 20)
        assert [(r.text, r.page, r.page_end, r.segment, r.start, r.end) for r in mine] == want, s
    placed = C.placed_pages(table).collect()
    assert len(placed) == sum(bool(t.strip()) for pages in docs.values() for _, t in pages)


def test_no_row_holds_a_long_segment(spark, monkeypatch):
    monkeypatch.setattr(C, "TEXT_BLOCK", 4000)
    monkeypatch.setattr(C, "CONTEXT", 100)
    pages = spark.createDataFrame([("d", p, "it runs on and on " * 20 + "and") for p in range(300)], PAGES)
    blocks = C._text_blocks(pages, C.placed_pages(pages), 4000, 215)
    sizes = [len(r.text) for r in blocks.select("text").collect()]
    assert len(sizes) == -(-(300 * 364 - 1) // 4000) and max(sizes) <= 4000 + 100 + 215


def test_empty(spark):
    df = spark.createDataFrame([], PAGES)
    assert C.chunk_documents(df).count() == 0
    assert C.chunk_profile(C.chunk_documents(df)).filter("chunks > 0").count() == 0


def test_profile_cuts_once(spark):
    """The measures of each document and those of all are taken from one pass over the chunks."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    chunks = spark.createDataFrame([("a", "xy", None), ("a", "x", 2), ("b", "xyz", None)], "source string, text string, page_end long").mapInArrow(count, "source string, text string, page_end long")
    got = {r.source: (r.chunks, r.min_chars, r.median_chars, r.max_chars, r.spanning) for r in C.chunk_profile(chunks).collect()}
    assert got == {"a": (2, 1, 2, 2, 1), "b": (1, 3, 3, 3, 0), None: (3, 1, 2, 3, 1)} and seen.value == 3


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab. \n!?\"“A　\x1c", max_size=500), st.integers(5, 80), st.integers(0, 40), st.integers(0, 30), st.sampled_from([3, 4096]))
def test_steps_near_their_targets(text, size, overlap, base, context):
    """A walk that looks for breaks near its targets takes the steps of one that knows all places."""
    kept, C.CONTEXT = C.CONTEXT, context
    try:
        near, every = (C.Walk(text, base, base + len(text), size, min(overlap, size - 1)) for _ in range(2))
        every.find_all()
        assert near.spans(base, base + len(text)) == every.spans(base, base + len(text))
    finally:
        C.CONTEXT = kept


def test_walk_reads_no_more_than_it_needs(monkeypatch):
    monkeypatch.setattr(C, "break_places", lambda *a: 1 / 0)
    assert len(C.spans("Some words. And more " * 500, 1000, 100)) > 10


def test_slices_and_blanks(spark, tmp_path):
    from quire.functions import text as T
    from quire.plans import bindings as B

    texts = [None, "", "\n" * 801, "é😀" * 401, "x" * 800, "a\r\n" * 600]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((int(r.source), r.page, r.text) for r in B.slice_pages(spark, str(tmp_path)).collect())
    assert got == [(i, k // 800 + 1, t if t is None else t[k : k + 800]) for i, t in enumerate(texts) for k in range(0, max(len(t or ""), 1), 800)]
    blanks = [(a + "x y" + b,) for a in T.BLANKS for b in ("", "\n ")] + [("​x",), ("᠎x",)]
    assert [r[0] for r in spark.createDataFrame(blanks, "t string").select(T.strip("t")).collect()] == ["x y"] * (len(blanks) - 2) + ["​x", "᠎x"]
