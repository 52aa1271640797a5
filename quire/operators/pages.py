"""Page cleaning and its audit.

Pages are rows (source, page, text, furniture, structured). What a document's pages have in common (running lines, lines
that a reader labelled) comes from aggregations of short lines, a row for each document, and is sent ahead of its pages, once for
each PART of them: a document of many pages with many labelled lines costs their sum and not their product. A page is then cleaned in one
pass over its lines, in Arrow batches: each line is stripped and judged once, where column expressions over arrays would judge it anew for every place that names it.
The rules for a line stand here alone; queries judge lines by them, too.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

PART = 256  # pages of a document that are cleaned together
MIN_PAGES = 4
REPEAT_RATIO = 0.6
DEBRIS_RUN = 6
SCANNED_RATIO = 0.8
STAGES = ("furniture", "page-number", "figure-debris")
FLAGGED = "source string, page {page}, text string, stay string, gone array<struct<i: long, stage: string, text: string>>"
ANY_BREAK = r"\n\x0B\f\r\x85\u2028\u2029\x1C-\x1E"


def as_pages(df: DataFrame) -> DataFrame:
    """(source, page, text) with empty label arrays where ``df`` has none."""
    for c in ("furniture", "structured"):
        if c not in df.columns:
            df = df.withColumn(c, F.array().cast("array<string>"))
    return df.select("source", "page", F.coalesce("text", F.lit("")).alias("text"), "furniture", "structured")


def _edge_lines(c: str):
    """The first and the last non-blank line of a text, stripped, once if they are equal; null for a blank text."""
    body = T.strip(c)
    first = T.strip(F.regexp_extract(body, rf"\A[^{ANY_BREAK}]*", 0))
    last = T.strip(F.regexp_replace(body, rf"(?s)\A.*[{ANY_BREAK}]", ""))
    return F.when(body != "", F.array_distinct(F.array(first, last)))


def _totals(pages: DataFrame) -> DataFrame:
    """(source, n_pages, numbers): how many pages a document has and a checksum of their numbers."""
    return pages.groupBy("source").agg(F.count(F.lit(1)).alias("n_pages"), F.bit_xor(F.xxhash64("page")).alias("numbers"))


def running_lines(pages: DataFrame, min_pages: int = MIN_PAGES, ratio: float = REPEAT_RATIO) -> DataFrame:
    """(source, line, pages): first or last lines found on at least ``ratio`` of a document's pages."""
    edges = pages.select("source", F.explode(_edge_lines("text")).alias("line")).groupBy("source", "line").agg(F.count(F.lit(1)).alias("pages"))
    total = _totals(pages).filter(F.col("n_pages") >= min_pages)
    return edges.join(total, "source").filter(F.col("pages") >= F.col("n_pages") * F.lit(ratio)).select("source", "line", "pages")


def labelled_lines(pages: DataFrame) -> DataFrame:
    """(source, line, pages): lines that the reader labelled as furniture, with the pages that hold them."""
    return pages.select("source", F.explode(F.array_distinct("furniture")).alias("line")).groupBy("source", "line").agg(F.count(F.lit(1)).alias("pages"))


def document_rules(pages: DataFrame) -> DataFrame:
    """(source, n_pages, numbers, furniture, labelled, protected): what to drop from each document as (line, pages), whether a reader said so, and what to spare."""
    mark = lambda c, kind: F.transform(F.coalesce(F.array_distinct(c), F.array().cast("array<string>")), lambda x: F.struct(x.alias("line"), F.lit(kind).alias("kind")))
    marks = pages.select("source", F.explode(F.concat(mark(_edge_lines("text"), "edge"), mark("furniture", "label"), mark("structured", "spare"))).alias("m"))
    counts = marks.groupBy("source", "m.line", "m.kind").agg(F.count(F.lit(1)).alias("pages"))
    totals = _totals(pages)
    # Of the lines at the edges only a few of each document pass, so what is collected is short.
    often = (F.col("n_pages") >= MIN_PAGES) & (F.col("pages") >= F.col("n_pages") * F.lit(REPEAT_RATIO))
    few = counts.join(totals.select("source", "n_pages"), "source").filter((F.col("kind") != "edge") | often)
    of = lambda kind: F.sort_array(F.collect_list(F.when(F.col("kind") == kind, F.struct("line", "pages"))))
    rules = few.groupBy("source").agg(of("edge").alias("running"), of("label").alias("labels"), of("spare").alias("spare"))
    nothing = F.array().cast("array<struct<line: string, pages: bigint>>")
    labelled = F.coalesce(F.size("labels") > 0, F.lit(False))
    furniture = F.when(labelled, F.col("labels")).otherwise(F.coalesce("running", nothing))
    return totals.join(rules, "source", "left").select("source", "n_pages", "numbers", furniture.alias("furniture"), labelled.alias("labelled"), F.coalesce(F.col("spare.line"), F.array().cast("array<string>")).alias("protected"))


#: What a bare page number, a bullet and a table row look like. The first is matched against a whole stripped line.
_NUMBER = re.compile(r"(page\s*)?\d{1,4}\s*(/\s*\d{1,4})?", re.IGNORECASE)
_BULLET = re.compile(r"([•●▪–—\-*·]|\d+[.)]|[a-z][.)])\s")


def is_page_number(bare: str) -> bool:
    return bool(bare) and bare[-1].isdecimal() and _NUMBER.fullmatch(bare) is not None


def is_bullet(line: str) -> bool:
    return _BULLET.match(line.lstrip()) is not None


def is_table_row(bare: str) -> bool:
    return len(bare) > 1 and bare[0] == "|" == bare[-1]


def is_fragment(line: str, bare: str) -> bool:
    """A line that may be a stray label: short, no table row, no bullet, no finished sentence."""
    return 0 < len(bare) <= T.FRAGMENT_CHARS and bare[-1] not in ".!?:" and not is_table_row(bare) and not is_bullet(line)


def line_kinds(lines: DataFrame, line: str = "line") -> DataFrame:
    """``lines`` with page_number, bullet, table_row and fragment, as cleaning judges each line."""
    from pyspark.sql import types as P

    names = ["page_number", "bullet", "table_row", "fragment"]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            each = [(x, x.strip()) for x in b.column(line).to_pylist()]
            kinds = ([is_page_number(bare) for _, bare in each], [is_bullet(x) for x, _ in each], [is_table_row(bare) for _, bare in each], [is_fragment(*x) for x in each])
            yield pa.RecordBatch.from_arrays([*b.columns, *[pa.array(k, pa.bool_()) for k in kinds]], names=[*b.schema.names, *names])

    return lines.mapInArrow(judge, P.StructType([*lines.schema.fields, *[P.StructField(n, P.BooleanType()) for n in names]]))


def judge_page(text: str, drop: set[str], spare: set[str], active: bool) -> tuple[str, list[tuple[int, str, str]]]:
    """(the lines that stay, (number, stage, stripped line) of those that go). Numbers count the page's lines from 1."""
    gone, left = [], []
    for i, line in enumerate(text.splitlines(), 1):
        bare = line.strip()
        stage = None
        if active and bare:
            stage = STAGES[0] if bare in drop else STAGES[1] if is_page_number(bare) else None
        if stage:
            gone.append((i, stage, bare))
        else:
            left.append((i, line, bare, bare not in spare and is_fragment(line, bare)))
    stay, run = [], []
    for entry in [*left, (0, "", "", False)]:
        if entry[3]:
            run.append(entry)
            continue
        if len(run) >= DEBRIS_RUN:
            gone += [(i, STAGES[2], bare) for i, _, bare, _ in run]
        else:
            stay += [line for _, line, _, _ in run]
        run = []
        if entry[0]:
            stay.append(entry[1])
    return "\n".join(stay), gone


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (source, part, page, text, head, drop, spare, active), sorted so that what holds for a part of a document comes before its pages."""
    kind = pa.list_(pa.struct([("i", pa.int64()), ("stage", pa.string()), ("text", pa.string())]))
    drop, spare, active = set(), set(), False
    for b in batches:
        judged, places = [], []
        text, head, drops, spares, actives = (b.column(c) for c in ("text", "head", "drop", "spare", "active"))
        for i, is_head in enumerate(head.to_pylist()):
            if is_head:
                drop, spare, active = set(drops[i].as_py()), set(spares[i].as_py()), actives[i].as_py()
            else:
                judged.append(judge_page(text[i].as_py(), drop, spare, active))
                places.append(i)
        here = b.take(pa.array(places, pa.int64()))
        gone = pa.array([[{"i": i, "stage": s, "text": t} for i, s, t in g] for _, g in judged], kind)
        yield pa.RecordBatch.from_arrays([here.column("source"), here.column("page"), here.column("text"), pa.array([s for s, _ in judged], pa.string()), gone], names=["source", "page", "text", "stay", "gone"])


def flagged_lines(pages: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """(source, page, text, stay, gone): the text of the lines that stay, and the non-blank lines that go as (i, stage, text). Cleaning and its audit both read this."""
    pages = as_pages(pages)
    rules = rules if rules is not None else document_rules(pages)
    active = F.col("labelled") | (F.col("n_pages") >= MIN_PAGES)
    rows = pages.select("source", F.floor(F.col("page") / PART).alias("part"), "page", "text", F.lit(False).alias("head"))
    heads = rows.select("source", "part").distinct().join(rules, "source").select("source", "part", F.lit(True).alias("head"), F.col("furniture.line").alias("drop"), F.col("protected").alias("spare"), active.alias("active"))
    sent = rows.unionByName(heads, allowMissingColumns=True).repartition("source", "part").sortWithinPartitions("source", "part", F.desc("head"))
    return sent.mapInArrow(_judge, FLAGGED.format(page=pages.schema["page"].dataType.simpleString()))


def clean_pages(pages: DataFrame) -> DataFrame:
    """(source, page, text): every page stays, even an empty one, so page numbers hold."""
    return flagged_lines(pages).select("source", "page", T.clean_page("stay").alias("text"))


def removals(pages: DataFrame) -> DataFrame:
    """(source, page, stage, text) of every non-blank line that cleaning drops."""
    return flagged_lines(pages).select("source", "page", F.explode("gone").alias("x")).select("source", "page", "x.stage", "x.text")


def cleaning_report(pages: DataFrame) -> DataFrame:
    """One row a document: pages, chars before and after, removed_ratio, lines removed by stage, the furniture map and whether it was labelled, numbers_preserved.

    numbers_preserved: the cleaned pages are as many as the raw ones and their numbers have the same checksum.
    """
    rules = document_rules(as_pages(pages))
    flagged = flagged_lines(pages, rules)
    lines = lambda stage: F.size(F.filter("gone", lambda x: x["stage"] == stage))
    sums = flagged.select("source", "page", F.length("text").alias("a"), F.length(T.clean_page("stay")).alias("b"), *[lines(s).alias(s.replace("-", "_")) for s in STAGES])
    report = sums.groupBy("source").agg(
        F.count(F.lit(1)).alias("pages"), F.sum("a").alias("chars_before"), F.sum("b").alias("chars_after"),
        *[F.sum(s.replace("-", "_")).alias(f"{s.replace('-', '_')}_lines") for s in STAGES], F.bit_xor(F.xxhash64("page")).alias("after"),
    )
    ratio = F.when(F.col("chars_before") > 0, 1 - F.col("chars_after") / F.col("chars_before")).otherwise(F.lit(0.0))
    named = F.when(F.size("furniture") > 0, F.map_from_entries("furniture"))
    preserved = (F.col("pages") == F.col("n_pages")) & (F.col("after") == F.col("numbers"))
    out = report.withColumn("removed_ratio", ratio).join(rules, "source")
    return out.select(*report.columns[:-1], "removed_ratio", named.alias("furniture"), F.col("labelled").alias("furniture_labelled"), preserved.alias("numbers_preserved"))


def margin(report: DataFrame) -> DataFrame:
    """(source, line, pages, margin, borderline) of each furniture line in cleaning_report(): its share of the pages, and whether a counted line barely passed."""
    each = report.select("source", F.col("pages").alias("n"), "furniture_labelled", F.explode("furniture").alias("line", "pages"))
    share = F.when(F.col("n") > 0, F.col("pages") / F.col("n")).otherwise(F.lit(0.0))
    return each.select("source", "line", "pages", share.alias("margin"), ((share < 0.75) & ~F.col("furniture_labelled")).alias("borderline"))


def by_stage(log: DataFrame) -> DataFrame:
    return log.groupBy("source", "stage").agg(F.count(F.lit(1)).alias("lines"), F.sort_array(F.collect_set("page")).alias("pages"))


def scanned(pages: DataFrame) -> DataFrame:
    """(source, scanned): whether at least SCANNED_RATIO of the pages hold next to nothing."""
    sparse = F.count_if(F.length("text") < T.NEAR_EMPTY_CHARS)
    return pages.groupBy("source").agg((sparse >= F.count(F.lit(1)) * F.lit(SCANNED_RATIO)).alias("scanned"))


def upper_median(c: str):
    """The middle value, the upper one of two."""
    return F.expr(f"percentile_disc(0.5) within group (order by {c} desc)").cast("bigint")


def profile(pages: DataFrame) -> DataFrame:
    """(source, pages, chars, median_chars, near_empty, longest_page, tokens) of each document."""
    n = F.length("text")
    p = pages.select("source", "page", n.alias("n"))
    longest = F.max(F.struct(F.col("n"), (-F.col("page")).alias("p")))
    out = p.groupBy("source").agg(F.count(F.lit(1)).alias("pages"), F.sum("n").alias("chars"), upper_median("n").alias("median_chars"), F.count_if(F.col("n") < T.NEAR_EMPTY_CHARS).alias("near_empty"), (-longest["p"]).alias("longest_page"))
    return out.withColumn("tokens", T.token_estimate("chars"))


def with_content(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pages of documents with any text, sources of the others)."""
    state = pages.groupBy("source").agg(F.bool_or(~T.is_blank("text")).alias("full"))
    return pages.join(state.filter("full").select("source"), "source", "left_semi"), state.filter("not full").select("source")
