"""Chunks with page-accurate provenance, of documents and segments of any size.

Which pages run on, and where each lies in its run (its segment), is a two-level prefix scan over narrow rows: windows over blocks of PAGE_BLOCK pages, then over the blocks of a
document, whose sums and edges are a row each. Texts are not looked at again until they are cut.

A segment of up to TEXT_BLOCK characters is a row, cut by a walk over its break places. A longer one is never put together: it is dealt to blocks of so many characters with
some context on both sides. Wherever a walk enters a block (within ``size`` characters of its begin), it leaves it at a place that the block alone decides, so a block is a small
table from entries to exits. Tables are composed in groups of GROUP blocks, the groups one after the other, and back down; then every block knows its entry and is cut by itself.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.scratch import kept, scratch

PAGE_BLOCK, TEXT_BLOCK, GROUP = 1024, 1 << 16, 256
CONTEXT = 1 << 12  # characters around a block; a run of blanks as long as that is left to the walk over the whole segment
#: Chunk sizes, how far back from its target a cut may fall, when a tail is short, and where a sentence ends.
CHUNK_TOKENS, OVERLAP_TOKENS = 250, 25
MIN_CHUNK_CHARS = 40
BACKTRACK, SHORT_TAIL = 0.35, 0.15
GAP = re.compile(r"(?P<sentence>(?<=[.!?])\s+(?=[A-Z\"'“]))|\s+")
SENTENCES = re.compile(r"(?<=[.!?])\s+(?=[A-Z\"'“])")
NEXT = re.compile(r"(?<=\n)|(?<=\s)(?=\S)")
WORD, SENTENCE, LINE, PARAGRAPH = 1, 2, 3, 4  # places where a cut may fall, weakest first


def placed_pages(pages: DataFrame) -> DataFrame:
    """(source, page, segment, start, chars, n) of all non-blank pages: the run of pages whose text carries on, the page's offset in it, and its length; runs are joined by line breaks."""
    narrow = pages.filter(~T.is_blank("text")).select("source", "page", F.floor(F.col("page") / PAGE_BLOCK).alias("block"), F.length("text").cast("long").alias("chars"), T.leaves_open("text").alias("open"), T.carries_on("text").alias("on"))
    narrow = kept(narrow, "pages")  # pages and blocks are made of these rows; texts are looked at once
    inside = Window.partitionBy("source", "block").orderBy("page")
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    last = F.lag("open").over(inside)
    breaks = F.when(last.isNull(), F.lit(0)).otherwise((~(last & F.col("on"))).cast("long"))  # the first page of a block is judged with the block before
    rows = narrow.withColumn("breaks", breaks).withColumn("at", F.coalesce(F.sum(F.col("chars") + 1).over(before), F.lit(0)))
    rows = rows.withColumn("number", F.sum("breaks").over(inside)).withColumn("began", F.max(F.when(F.col("breaks") == 1, F.col("at"))).over(inside))
    blocks = rows.groupBy("source", "block").agg(F.sum(F.col("chars") + 1).alias("size"), F.sum("breaks").alias("breaks"), F.max("began").alias("began"), F.max_by("open", "page").alias("open"), F.min_by("on", "page").alias("on"))
    order = Window.partitionBy("source").orderBy("block")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    previous = F.lag("open").over(order)
    blocks = blocks.withColumn("opens", F.coalesce((~(previous & F.col("on"))).cast("long"), F.lit(0))).withColumn("first", previous.isNull())
    blocks = blocks.withColumn("base", F.coalesce(F.sum("size").over(earlier), F.lit(0))).withColumn("own", F.when((F.col("opens") == 1) | F.col("first"), F.col("base")))
    blocks = blocks.withColumn("base_number", F.coalesce(F.sum(F.col("breaks") + F.col("opens")).over(earlier), F.lit(0)) + F.col("opens"))
    blocks = blocks.withColumn("carry", F.greatest(F.max(F.coalesce(F.col("base") + F.col("began"), F.col("own"))).over(earlier), "own"))
    joined = rows.select("source", "block", "page", "chars", "at", "number", "began").join(blocks.select("source", "block", "base", "base_number", "carry"), ["source", "block"])
    start = F.col("base") + F.col("at") - F.greatest(F.col("carry"), F.col("base") + F.col("began"))
    placed = joined.select("source", "page", (F.col("base_number") + F.col("number")).alias("segment"), start.alias("start"), "chars")
    lengths = placed.groupBy("source", "segment").agg(F.max(F.col("start") + F.col("chars")).alias("n"))
    return placed.join(lengths, ["source", "segment"])


def _assembled(pages: DataFrame, placed: DataFrame) -> DataFrame:
    """(source, segment, text, starts, pages) of whole segments."""
    rows = pages.select("source", "page", "text").join(placed.select("source", "page", "segment", "start"), ["source", "page"])
    rows = rows.groupBy("source", "segment").agg(F.sort_array(F.collect_list(F.struct("page", "start", "text"))).alias("r"))
    return rows.select("source", "segment", F.array_join("r.text", "\n").alias("text"), F.col("r.start").alias("starts"), F.col("r.page").alias("pages"))


def segments(pages: DataFrame) -> DataFrame:
    """(source, segment, text, starts, pages): runs of non-blank pages whose text carries on, joined by line breaks; starts has each page's offset."""
    return _assembled(pages, placed_pages(pages))


def break_places(text: str, begin: int = 0, stop: int | None = None) -> tuple[list[int], dict[int, int]]:
    """Offsets behind each break, ascending, and the strongest rank at each; of a part of ``text`` that cuts no run of blanks."""
    rank: dict[int, int] = {}
    for gap in GAP.finditer(text, begin, len(text) if stop is None else stop):
        rank[gap.end()] = SENTENCE if gap["sentence"] else WORD
        lines = [gap.start() + i for i, c in enumerate(gap[0], 1) if c == "\n"]
        rank.update(dict.fromkeys(lines, LINE))
        if len(lines) > 1:
            rank[lines[-1]] = PARAGRAPH
    return sorted(rank), rank


class Walk:
    """Steps over the break places of a text, or of a part of it from offset ``base`` on; ``n`` is the length of the whole.

    Steps look for breaks near their targets alone. All places are found, once, where steps are many or a run of blanks is over CONTEXT.
    """

    def __init__(self, text: str, base: int, n: int, size: int, overlap: int):
        self.text, self.base, self.places = text, base, None
        self.n, self.size, self.overlap, self.reach, self.tail = n, size, overlap, int(size * BACKTRACK), int(size * SHORT_TAIL)

    def find_all(self) -> None:
        if self.places is None:
            places, rank = break_places(self.text)
            self.places, self.rank = [p + self.base for p in places], {p + self.base: r for p, r in rank.items()}

    def _strongest(self, low: int, high: int) -> int | None:
        """The last of the strongest breaks from ``low`` to ``high``, if there is one."""
        if self.places is None:
            text, a, b = self.text, max(low - self.base, 1), min(high - self.base, len(self.text))
            begin, stop = a - 1, b
            while begin > 0 and text[begin].isspace() and a - begin <= CONTEXT:
                begin -= 1
            while stop < len(text) and text[stop].isspace() and stop - b <= CONTEXT:
                stop += 1
            if a - begin <= CONTEXT >= stop - b:
                if text.find("\n", begin, stop) >= 0:
                    places, rank = break_places(text, begin, min(stop + 1, len(text)))
                    near = [p for p in places if a <= p <= b]
                    return max(near, key=lambda p: (rank[p], p)) + self.base if near else None
                ends = [p for m in SENTENCES.finditer(text, begin, min(stop + 1, len(text))) if a <= (p := m.end()) <= b]
                if ends:
                    return ends[-1] + self.base
                for p in range(b, a - 1, -1):
                    if text[p - 1].isspace() and (p == len(text) or not text[p].isspace()):
                        return p + self.base
                return None
            self.find_all()
        near = self.places[bisect_left(self.places, low) : bisect_right(self.places, high)]
        return max(near, key=lambda p: (self.rank[p], p)) if near else None

    def _first(self, low: int, end: int) -> int:
        """The first break from ``low`` on and before ``end``, or ``low``."""
        if self.places is None:
            at = max(low - self.base, 0)
            found = NEXT.search(self.text, at, max(at, end - self.base))
            return found.start() + self.base if found and found.start() + self.base < end else low
        at = bisect_left(self.places, low)
        return self.places[at] if at < len(self.places) and self.places[at] < end else low

    def step(self, start: int) -> tuple[int, int | None]:
        """(end, next start) of the span from ``start``; the last one has none, and takes a short tail along."""
        if self.n - start <= self.size:
            return self.n, None
        target = start + self.size
        end = self._strongest(max(start + 1, target - self.reach), target)
        end = target if end is None else end
        following = self._first(max(end - self.overlap, start + 1), end)
        return (self.n, None) if self.n - following < self.tail else (end, following)

    def spans(self, start: int | None, stop: int) -> list[tuple[int, int]]:
        """The spans that begin before ``stop``."""
        out = []
        while start is not None and start < stop:
            end, following = self.step(start)
            out.append((start, end))
            start = following
        return out

    def exits(self, begin: int, stop: int, entries: int) -> np.ndarray:
        """For each of the ``entries`` places from ``begin`` on, how far behind ``stop`` the first span outside begins; -1: none does."""
        self.find_all()
        known: dict[int, int] = {}
        out = np.full(entries, -1, np.int32)
        for i in range(min(entries, max(0, self.n - begin))):
            path, at = [], begin + i
            while at is not None and at < stop and at not in known:
                path.append(at)
                at = self.step(at)[1]
            leaves = -1 if at is None else at - stop if at >= stop else known[at]
            known.update(dict.fromkeys(path, leaves))
            out[i] = leaves
        return out


def spans(text: str, size: int, overlap: int) -> list[tuple[int, int]]:
    """Overlapping (start, end) spans of at most ``size`` characters, cut at the strongest break near the target; a short tail joins the last span."""
    n = len(text)
    if n <= size:
        return [(0, n)] if text.strip() else []
    return Walk(text, 0, n, size, overlap).spans(0, n)


CUT = "source string, segment long, start long, end long, text string, page long, page_end long"


def _rows(found: list[tuple[int, int]], text: str, base: int, starts: list[int], pages: list[int], source: str, segment: int) -> list[tuple]:
    out = []
    for a, b in found:
        body = text[a - base : b - base].strip()
        if len(body) >= MIN_CHUNK_CHARS:
            first, last = (pages[max(bisect_right(starts, offset) - 1, 0)] for offset in (a, b - 1))
            out.append((source, segment, a, b, body, first, last if last != first else None))
    return out


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [()] * 7
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["source", "segment", "start", "end", "text", "page", "page_end"])


def _cutter(size: int, overlap: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _batch([x for r in batch.to_pylist() for x in _rows(spans(r["text"], size, overlap), r["text"], 0, r["starts"], r["pages"], r["source"], r["segment"])])

    return cut


def _text_blocks(pages: DataFrame, placed: DataFrame, block: int, right: int) -> DataFrame:
    """(source, segment, k, n, base, text, starts, pages): each segment in blocks of ``block`` characters, with CONTEXT before and ``right`` behind, from offset ``base`` on."""
    rows = pages.select("source", "page", "text").join(placed, ["source", "page"])
    stop = F.col("start") + F.col("chars") + 1
    first = F.greatest(F.floor((F.col("start") - right) / block), F.lit(0))
    last = F.least(F.floor((stop + CONTEXT) / block), F.floor((F.col("n") - 1) / block))
    rows = rows.withColumn("stop", stop).withColumn("body", F.when(F.col("stop") <= F.col("n"), F.concat("text", F.lit("\n"))).otherwise(F.col("text"))).withColumn("k", F.explode(F.sequence(first, last)))
    low, high = F.greatest("start", F.col("k") * block - CONTEXT), F.least("stop", (F.col("k") + 1) * block + right)
    rows = rows.withColumn("low", low).withColumn("high", high).filter("low < high")
    piece = F.substring("body", (F.col("low") - F.col("start") + 1).cast("int"), (F.col("high") - F.col("low")).cast("int"))
    rows = rows.groupBy("source", "segment", "k").agg(F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("low", piece.alias("piece"), "start", "page"))).alias("r"))
    return rows.select("source", F.col("segment").cast("long"), F.col("k").cast("long"), F.col("n").cast("long"), F.col("r.low")[0].cast("long").alias("base"), F.array_join("r.piece", "").alias("text"), F.col("r.start").cast("array<long>").alias("starts"), F.col("r.page").cast("array<long>").alias("pages"))


def _entries(blocks: DataFrame, block: int, size: int, overlap: int) -> tuple[DataFrame, DataFrame]:
    """(source, segment, k, entry) where the walk from the segment's begin enters each block that it enters, and (source, segment) of those that have a run of blanks as long as CONTEXT at an edge."""

    def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for r in b.to_pylist():
                begin, stop = r["k"] * block, (r["k"] + 1) * block
                reaches_end = r["base"] + len(r["text"]) >= r["n"]
                odd = (r["base"] > 0 and not r["text"][:CONTEXT].strip()) or (not reaches_end and not r["text"][-CONTEXT:].strip())
                exits = Walk(r["text"], r["base"], r["n"], size, overlap).exits(begin, stop, size if r["k"] else 1)
                out.append({"source": r["source"], "segment": r["segment"], "k": r["k"], "group": r["k"] // GROUP, "exits": np.resize(exits, size).astype("<i4").tobytes(), "odd": odd})
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("source", pa.string()), ("segment", pa.int64()), ("k", pa.int64()), ("group", pa.int64()), ("exits", pa.binary()), ("odd", pa.bool_())]))

    def composed(t: pa.Table) -> pa.Table:
        t = t.sort_by("k")
        at = np.arange(size)
        for e in t.column("exits").to_pylist():
            at = np.where(at >= 0, np.frombuffer(e, "<i4")[at], -1)
        return pa.table([t.column("source")[:1], t.column("segment")[:1], t.column("group")[:1], pa.array([at.astype("<i4").tobytes()], pa.binary())], names=["source", "segment", "group", "exits"])

    def entered(t: pa.Table) -> pa.Table:
        t = t.sort_by("group")
        out, at = [], 0
        for e in t.column("exits").to_pylist():
            out.append(at)
            at = int(np.frombuffer(e, "<i4")[at]) if at >= 0 else -1
        return t.drop_columns(["exits"]).append_column("at", pa.array(out, pa.int64()))

    def walked(t: pa.Table) -> pa.Table:
        t = t.sort_by("k")
        out, at = [], t.column("at")[0].as_py()
        for e in t.column("exits").to_pylist():
            out.append(at)
            at = int(np.frombuffer(e, "<i4")[at]) if at >= 0 else -1
        entry = [None if i < 0 else k * block + i for k, i in zip(t.column("k").to_pylist(), out, strict=True)]
        return t.select(["source", "segment", "k"]).append_column("entry", pa.array(entry, pa.int64()))

    made = kept(blocks.mapInArrow(tables, "source string, segment long, k long, group long, exits binary, odd boolean"), "exits")
    table = made.drop("odd")
    groups = table.groupBy("source", "segment", "group").applyInArrow(composed, "source string, segment long, group long, exits binary")
    starts = groups.groupBy("source", "segment").applyInArrow(entered, "source string, segment long, group long, at long")
    known = table.join(starts, ["source", "segment", "group"]).groupBy("source", "segment", "group").applyInArrow(walked, "source string, segment long, k long, entry long")
    return known.filter("entry is not null"), made.filter("odd").select("source", "segment").distinct()


def _long_segments(pages: DataFrame, placed: DataFrame, block: int, size: int, overlap: int) -> tuple[DataFrame, DataFrame]:
    """Chunks of segments that are cut by blocks, and (source, segment) of those that cannot be."""
    blocks = kept(_text_blocks(pages, placed, block, size + int(size * SHORT_TAIL) + CONTEXT), "blocks", stay=True)
    entries, odd = _entries(blocks, block, size, overlap)
    entries, odd = kept(entries, "entries", stay=True), kept(odd, "odd", stay=True)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for r in b.to_pylist():
                found = Walk(r["text"], r["base"], r["n"], size, overlap).spans(r["entry"], (r["k"] + 1) * block)
                rows += _rows(found, r["text"], r["base"], r["starts"], r["pages"], r["source"], r["segment"])
            yield _batch(rows)

    return blocks.join(odd, ["source", "segment"], "left_anti").join(entries, ["source", "segment", "k"]).mapInArrow(cut, CUT), odd


def chunk_documents(pages: DataFrame, chunk_size: int = CHUNK_TOKENS, chunk_overlap: int = OVERLAP_TOKENS) -> DataFrame:
    """(source, chunk_index, id, text, page, page_end, section, segment, start, end) of each document's chunks."""
    size = chunk_size * T.CHARS_PER_TOKEN
    overlap = min(chunk_overlap * T.CHARS_PER_TOKEN, size - 1)
    block = max(TEXT_BLOCK, 16 * size)
    with scratch():
        placed = kept(placed_pages(pages), "placed", stay=True)
        whole, long = placed.filter(F.col("n") <= block), placed.filter(F.col("n") > block)
        far = None
        if not long.isEmpty():
            far, odd = _long_segments(pages, long, block, size, overlap)
            whole = whole.unionByName(long.join(odd, ["source", "segment"], "left_semi").select(*whole.columns))
        large = placed.filter(F.col("page") >= PAGE_BLOCK).select("source").distinct()
        some = None if large.isEmpty() else kept(large, "large", stay=True)
    cut = lambda how: _cut(pages, whole, far, size, overlap, some, how)
    number = F.row_number().over(Window.partitionBy("source").orderBy("segment", "start"))
    out = cut("left_anti").withColumn("place", number)
    if some is not None:
        out = out.unionByName(_numbered(kept(cut("left_semi"), "cut")))
    out = out.withColumn("chunk_index", (F.col("place") - 1).cast("long"))
    return out.select("source", "chunk_index", T.chunk_id("source", "page", "chunk_index").alias("id"), "text", "page", "page_end", F.lit(None).cast("string").alias("section"), "segment", "start", "end")


def _cut(pages: DataFrame, whole: DataFrame, far: DataFrame | None, size: int, overlap: int, sources: DataFrame | None, how: str) -> DataFrame:
    """The chunks of the documents that are in ``sources`` (left_semi), or are not (left_anti)."""
    mine = lambda df: df if sources is None else df.join(sources, "source", how)
    parts = _assembled(pages, mine(whole)).select("source", F.col("segment").cast("long"), "text", F.col("starts").cast("array<long>"), F.col("pages").cast("array<long>"))
    cut = parts.mapInArrow(_cutter(size, overlap), CUT)
    return cut if far is None else cut.unionByName(mine(far))


def _numbered(cut: DataFrame) -> DataFrame:
    """``cut`` with ``place``, from 1 in each document: by blocks of pages, then over the blocks of a document."""
    cut = cut.withColumn("block", F.floor(F.col("page") / PAGE_BLOCK))
    many = cut.groupBy("source", "block").agg(F.count(F.lit(1)).alias("many"))
    before = F.coalesce(F.sum("many").over(Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    local = F.row_number().over(Window.partitionBy("source", "block").orderBy("segment", "start"))
    return cut.withColumn("local", local).join(many.select("source", "block", before.alias("before")), ["source", "block"]).withColumn("place", F.col("before") + F.col("local")).drop("block", "local", "before")


def chunk_profile(chunks: DataFrame) -> DataFrame:
    """(source, chunks, min_chars, median_chars, max_chars, spanning), and the same over all with a null source."""
    from .pages import upper_median

    n = kept(chunks.select("source", F.length("text").alias("n"), "page_end"), "lengths")  # chunks are cut once for both
    measures = [F.count(F.lit(1)).alias("chunks"), F.min("n").alias("min_chars"), upper_median("n").alias("median_chars"), F.max("n").alias("max_chars"), F.count("page_end").alias("spanning")]
    return n.groupBy("source").agg(*measures).unionByName(n.agg(*measures).select(F.lit(None).cast("string").alias("source"), "*"))


def systematic_sample(chunks: DataFrame, show: int) -> DataFrame:
    """Every k-th chunk of a document, k = chunks / show, the first ``show`` of them; order by chunk_index."""
    w = Window.partitionBy("source")
    step = F.greatest(F.floor(F.count(F.lit(1)).over(w) / max(show, 1)), F.lit(1))
    at = F.row_number().over(w.orderBy("chunk_index")) - 1
    return chunks.withColumn("step", step).withColumn("at", at).filter((F.col("at") % F.col("step") == 0) & (F.col("at") / F.col("step") < show)).drop("step", "at")
