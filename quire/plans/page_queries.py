"""Queries on pages, lines and chunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chunking as C
from ..operators import pages as P
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


#: Literal lines for rules that no table triggers.
LITERALS = ["12", "Page 3", " page 12 / 20 ", "4/20", "PAGE 7", "12345", "Page three", "• item", "1. one", "12) two", "a. alpha", "A. beta", "- dash", "-dash", "* star", "|a|b|", " | x | y | ", "|a|b", "over-\nfitting", "over-  \n  fitting", "a  b\t\tc", "x  \ny \t\nz", "p\n\n\n\nq", "  pad  ", "", "end.", "why?", "plain label", "a much longer line that is not a fragment at all"]


def _literals(spark):
    return spark.createDataFrame(list(enumerate(LITERALS)), "n long, line string")


def _values() -> str:
    quote = lambda s: " || chr(10) || ".join("'" + p.replace("\t", "' || chr(9) || '") + "'" for p in s.split("\n"))
    return "literals(n, line) as (values " + ", ".join(f"({i}::bigint, {quote(s)})" for i, s in enumerate(LITERALS)) + ")"


_CLEAN = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({0}, '\r\n?', chr(10), 'g'), '([\pL\pN_])-[ \t]*\n[ \t]*([\pL\pN_])', '\1\2', 'g'), '[ \t]{{2,}}', ' ', 'g'), '[ \t]+(\n|$)', '\1', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')"
_STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
_BULLET = r"regexp_matches({0}, '^\s*([•●▪–—\-*·]|[0-9]+[.)]|[a-z][.)])\s')"
_TABLE = r"regexp_matches({0}, '^\s*\|[^\n]*\|\s*$')"
_NUMBER = r"regexp_matches({0}, '(?i)^\s*(page\s*)?[0-9]{{1,4}}\s*(/\s*[0-9]{{1,4}})?\s*$')"
_FRAGMENT = "(length({s}) between 1 and 32 and not {t} and not {b} and not contains('.!?:', right({s}, 1)))".format(s=_STRIP, t=_TABLE, b=_BULLET)


@query(f"with {_values()}, {B.LINE_PAGES} select 'line' as kind, n::varchar as source, 0::bigint as page, {_CLEAN.format('line')} as text from literals union all select 'page', source, page, {_CLEAN.format('text')} from line_pages")
def clean_page(spark, sf_dir):
    a = _literals(spark).select(F.lit("line").alias("kind"), F.col("n").cast("string").alias("source"), F.lit(0).cast("long").alias("page"), T.clean_page("line").alias("text"))
    return a.unionByName(B.line_pages(spark, sf_dir).select(F.lit("page").alias("kind"), "source", "page", T.clean_page("text").alias("text")))


_DRESSED = """dressed as (select doc_id, i - 1 as i, case (doc_id + i - 1) % 7 when 0 then '| ' || l || ' |' when 1 then '- ' || l when 2 then 'Page ' || (i - 1) || ' / 12' when 3 then substr(l, 1, 30) when 4 then '  ' || (i - 1) || ') ' || l else l end as line
from (select doc_id, unnest(string_split(text, chr(10))) as l, unnest(range(1, len(string_split(text, chr(10))) + 1)) as i from documents))"""


@query(f"with {_DRESSED} select doc_id, i, {_NUMBER.format('line')} as page_number, {_BULLET.format('line')} as bullet, {_TABLE.format('line')} as table_row, {_FRAGMENT.format('line')} as fragment from dressed")
def line_kinds(spark, sf_dir):
    """Every line of every document, some dressed as table rows, bullets, page numbers and stray labels."""
    lines = B.table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "l")).withColumn("i", F.col("i").cast("long"))
    kind, i = (F.col("doc_id") + F.col("i")) % 7, F.col("i").cast("string")
    line = (
        F.when(kind == 0, F.concat(F.lit("| "), "l", F.lit(" |"))).when(kind == 1, F.concat(F.lit("- "), "l")).when(kind == 2, F.concat(F.lit("Page "), i, F.lit(" / 12")))
        .when(kind == 3, F.substring("l", 1, 30)).when(kind == 4, F.concat(F.lit("  "), i, F.lit(") "), "l")).otherwise(F.col("l"))
    )
    return P.line_kinds(lines.select("doc_id", "i", line.alias("line"))).drop("line")


@query(f"with {B.HTML_PAGES}, l as (select source, unnest(string_split(text, chr(10))) as line from html_pages) select source, count(*) as lines, count_if({_FRAGMENT.format('line')})::bigint as fragments, count_if({_BULLET.format('line')})::bigint as bullets, count_if({_NUMBER.format('line')})::bigint as numbers from l group by source")
def html_line_kinds(spark, sf_dir):
    rows = P.line_kinds(B.html_pages(spark, sf_dir).select("source", F.explode(F.split("text", "\n")).alias("line")))
    return rows.groupBy("source").agg(F.count(F.lit(1)).alias("lines"), F.count_if("fragment").alias("fragments"), F.count_if("bullet").alias("bullets"), F.count_if("page_number").alias("numbers"))


_RUNNING = f"""{B.LINE_PAGES},
n as (select source, count(*) as n from line_pages group by source having count(*) >= 4),
k as (select source, list_filter(list_transform(string_split(text, chr(10)), lambda x: {_STRIP.format('x')}), lambda x: x <> '') as k from line_pages),
e as (select source, unnest(list_distinct([k[1], k[-1]])) as line from k where len(k) > 0),
running as (select source, line, count(*) as pages from e join n using (source) group by source, line, n.n having count(*) >= n.n * 0.6)"""


@query(f"with {_RUNNING} select * from running")
def running_lines(spark, sf_dir):
    return P.running_lines(B.line_pages(spark, sf_dir))


_FIRST = f"""{_RUNNING},
lines as (select source, page, i, l[i] as line, {_STRIP.format('l[i]')} as bare from (select source, page, l, unnest(range(1, len(l) + 1)) as i from (select source, page, case when text like '%' || chr(10) then string_split(text, chr(10))[:-2] when text = '' then [] else string_split(text, chr(10)) end as l from line_pages))),
staged as (select x.*, case when n.n is null then null when bare <> '' and r.line is not null then 'furniture' when {_NUMBER.format('x.line')} then 'page-number' end as stage
  from lines x left join n using (source) left join running r on r.source = x.source and r.line = x.bare)"""


@query(
    f"""with {B.HTML_PAGES}, l as (select source, string_split(text, chr(10)) as l from html_pages),
i as (select source, i, l[i] as line, {_FRAGMENT.format('l[i]')} as f from (select source, l, unnest(range(1, len(l) + 1)) as i from l)),
g as (select *, sum(case when f then 0 else 1 end) over (partition by source order by i) as g from i),
c as (select *, sum(case when f then 1 else 0 end) over (partition by source, g) as n from g)
select source, {_STRIP.format('line')} as line, i from c where f and n >= 6"""
)
def debris_runs(spark, sf_dir):
    """Lines in runs of at least six fragments."""
    gone = P.flagged_lines(B.html_pages(spark, sf_dir)).select("source", F.explode("gone").alias("x"))
    return gone.filter("x.stage = 'figure-debris'").select("source", F.col("x.text").alias("line"), "x.i")


_CLEANED = f"""{_FIRST},
left_ as (select *, row_number() over (partition by source, page order by i) as k, {_FRAGMENT.format('line')} as f from staged where stage is null),
g as (select *, sum(case when f then 0 else 1 end) over (partition by source, page order by k) as g from left_),
c as (select *, f and sum(case when f then 1 else 0 end) over (partition by source, page, g) >= 6 as debris from g),
joined as (select source, page, string_agg(line, chr(10) order by k) filter (not debris) as t, count_if(debris and bare <> '') as debris_lines from c group by source, page),
cleaned as (select p.source, p.page, p.text as raw, {_CLEAN.format("coalesce(j.t, '')")} as text, coalesce(debris_lines, 0) as debris_lines from line_pages p left join joined j on j.source = p.source and j.page = p.page)"""


_GONE = f"{_CLEANED}, gone as (select source, page, bare, stage from staged where stage is not null union all select source, page, bare, 'figure-debris' from c where debris)"


@query(f"with {_GONE} select source, page, bare as line, stage from gone")
def furniture_lines(spark, sf_dir):
    """Lines that cleaning drops."""
    return P.removals(B.line_pages(spark, sf_dir)).select("source", "page", F.col("text").alias("line"), "stage")


@query(f"with {_CLEANED} select source, page, text from cleaned")
def cleaned_pages(spark, sf_dir):
    return P.clean_pages(B.line_pages(spark, sf_dir))


@query(
    f"""with {_CLEANED}, s as (select source, count_if(stage = 'furniture')::bigint as f, count_if(stage = 'page-number' and bare <> '')::bigint as p from staged group by source)
select source, count(*) as pages, sum(length(raw))::bigint as chars_before, sum(length(text))::bigint as chars_after, coalesce(any_value(s.f), 0) as furniture_lines, coalesce(any_value(s.p), 0) as page_number_lines,
sum(debris_lines)::bigint as figure_debris_lines, case when sum(length(raw)) > 0 then 1 - sum(length(text)) / sum(length(raw)) else 0.0 end as removed_ratio, count(*) = any_value(n.n) and bit_xor(cleaned.page) = any_value(n.x) as numbers_preserved from cleaned left join s using (source) join (select source, count(*) as n, bit_xor(page) as x from line_pages group by source) n using (source) group by source"""
)
def cleaning_report(spark, sf_dir):
    return P.cleaning_report(B.line_pages(spark, sf_dir)).drop("furniture", "furniture_labelled")


@query(f"with {_RUNNING} select r.source, r.line, r.pages, r.pages / n.n as margin, r.pages / n.n < 0.75 as borderline from running r join n using (source)")
def furniture_margin(spark, sf_dir):
    return P.margin(P.cleaning_report(B.line_pages(spark, sf_dir)))


@query(f"with {_GONE} select source, stage, count(*) as lines, array_to_string(list_sort(list_distinct(list(page))), ',') as pages from gone group by source, stage")
def removals_by_stage(spark, sf_dir):
    log = P.by_stage(P.removals(B.line_pages(spark, sf_dir)))
    return log.withColumn("pages", F.array_join(F.col("pages").cast("array<string>"), ","))


@query(
    f"""with {B.TURN_PAGES} select source, count(*) as pages, sum(length(text))::bigint as chars, list_sort(list(length(text)))[len(list(text)) // 2 + 1] as median_chars,
count_if(length(text) < 20)::bigint as near_empty, arg_max(page, length(text) * 1000000 - page) as longest_page, sum(length(text))::bigint // 4 as tokens from turn_pages group by source"""
)
def page_profile(spark, sf_dir):
    return P.profile(B.turn_pages(spark, sf_dir))


@query("select source, count(*) as documents, sum(length(text))::bigint as chars, list_sort(list(length(text)))[count(*) // 2 + 1] as median_chars, count_if(length(text) < 20)::bigint as near_empty from documents group by source")
def doc_profile(spark, sf_dir):
    """The profile of each source, with its documents as pages."""
    d = B.table(spark, sf_dir, "documents").select("source", F.col("doc_id").alias("page"), "text")
    return P.profile(d).select("source", F.col("pages").alias("documents"), "chars", "median_chars", "near_empty")


@query(f"with {B.TURN_PAGES} select source, count_if(length(text) < 20) >= 0.8 * count(*) as scanned from turn_pages group by source")
def scanned_flag(spark, sf_dir):
    return P.scanned(B.turn_pages(spark, sf_dir))


_FOLLOWS = f"""{B.SLICE_PAGES},
full_ as (select source, page, text, {_STRIP.format('text')} as s from slice_pages where {_STRIP.format('text')} <> ''),
marked as (select *, not coalesce(not contains('.!?:;。！？…"'')]}}”’', right(lag(s) over w, 1)) and not {_BULLET.format('string_split(s, chr(10))[1]')} and regexp_matches(s, '^\\p{{Ll}}'), true) as opens from full_ window w as (partition by source order by page)),
seg as (select *, sum(case when opens then 1 else 0 end) over (partition by source order by page) as segment from marked),
starts as (select *, coalesce(sum(length(text) + 1) over (partition by source, segment order by page rows between unbounded preceding and 1 preceding), 0) as start from seg)"""


@query(f"with {_FOLLOWS} select source, page, not opens as continues from marked where page > 1")
def page_continues(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("source").orderBy("page")
    pages = B.slice_pages(spark, sf_dir).filter(~T.is_blank("text"))
    return pages.select("source", "page", T.continues(F.lag("text").over(w), F.col("text")).alias("continues")).filter("page > 1")


@query(f"with {_FOLLOWS} select source, min(page) as first_page, max(page) as last_page, string_agg(text, chr(10) order by page) as text from seg group by source, segment")
def segments(spark, sf_dir):
    return C.segments(B.slice_pages(spark, sf_dir)).select("source", F.element_at("pages", 1).alias("first_page"), F.element_at("pages", -1).alias("last_page"), "text")


@query(f"with {_FOLLOWS} select source, page, start::bigint as start from starts")
def segment_offsets(spark, sf_dir):
    s = C.segments(B.slice_pages(spark, sf_dir)).select("source", F.explode(F.arrays_zip("pages", "starts")).alias("x"))
    return s.select("source", F.col("x.pages").alias("page"), F.col("x.starts").cast("long").alias("start"))


#: Of parts (source, segment, text) and starts (source, segment, page, start): the walk over break places, 1000 characters a span, 100 of overlap.
_WALK = rf"""
pieces as (select source, segment, text, length(text) as n, regexp_extract_all(text, '\s+|[^\s]+') as w from parts),
placed as (select source, segment, i, piece, right(lag(piece) over o, 1) as last, left(lead(piece) over o, 1) as next, (sum(length(piece)) over o)::bigint as stop
  from (select source, segment, unnest(w) as piece, unnest(range(1, len(w) + 1)) as i from pieces) window o as (partition by source, segment order by i)),
blanks as materialized (select *, regexp_extract_all(piece, '\n') as lines from placed where regexp_matches(piece, '^\s')),
breaks as (select source, segment, stop as p, case when contains('.!?', coalesce(last, '-')) and last <> '' and regexp_matches(coalesce(next, ''), '^[A-Z"''“]') then 2 else 1 end as r from blanks
  union all select source, segment, stop - length(piece) + k, 3 from (select *, unnest(range(1, length(piece) + 1)) as k from blanks where len(lines) > 0) where substr(piece, k, 1) = chr(10)
  union all select source, segment, stop - length(regexp_extract(piece, '[^\n]*$')), 4 from blanks where len(lines) > 1),
best as (select source, segment, p, max(r) as r from breaks group by source, segment, p),
places as (select source, segment, list({{'p': p, 'r': r}} order by p) as b from best group by source, segment),
whole as materialized (select source, segment, n, text, coalesce(b, []) as b from pieces left join places using (source, segment)),
recursive_walk as (
  with recursive walk as (
    select source, segment, n, b, 0::bigint as start from whole
    union all
    select source, segment, n, b, coalesce(list_min(list_transform(list_filter(b, lambda x: x.p >= again and x.p < e), lambda x: x.p)), again)::bigint from (
      select *, greatest(e - 100, start + 1) as again from (
        select *, coalesce(list_max(list_transform(list_filter(b, lambda x: x.p >= start + 650 and x.p <= start + 1000), lambda x: x.r::bigint * 1000000000 + x.p)) % 1000000000, start + 1000)::bigint as e from walk where n - start > 1000)))
  select source, segment, n, start, coalesce(list_max(list_transform(list_filter(b, lambda x: x.p >= start + 650 and x.p <= start + 1000), lambda x: x.r::bigint * 1000000000 + x.p)) % 1000000000, start + 1000)::bigint as e from walk),
ended as (select *, lead(start) over (partition by source, segment order by start) as following from recursive_walk),
cut as (select source, segment, start, case when n - start <= 1000 then n when n - following < 150 then n else e end as stop from ended where n - start > 1000 or n <= 1000 or n - start >= 150),
bodies as (select c.source, c.segment, c.start, c.stop, {_STRIP.format('substr(w.text, c.start + 1, c.stop - c.start)')} as text from cut c join whole w using (source, segment)),
paged as (select b.source, b.segment, b.start, b.stop, b.text, arg_max(s.page, s.start) filter (s.start <= b.start) as page, arg_max(s.page, s.start) filter (s.start <= b.stop - 1) as last
  from bodies b join starts s on s.source = b.source and s.segment = b.segment where length(b.text) >= 40 group by all),
chunks as (select source, row_number() over (partition by source order by segment, start) - 1 as chunk_index, text, page, case when last <> page then last end as page_end, segment, start, stop as "end" from paged)"""
_SLICED = f"{_FOLLOWS.replace('starts as', 'placed_pages as')}, starts as (select source, segment, page, start::bigint as start from placed_pages), parts as (select source, segment, string_agg(text, chr(10) order by page) as text from seg group by source, segment), {_WALK}"
_SINGLE = f"parts as (select doc_id::varchar as source, 0 as segment, text from documents where {_STRIP.format('text')} <> ''), starts as (select source, 0 as segment, 1::bigint as page, 0::bigint as start from parts), {_WALK}"


@query(f"with {_SINGLE} select source, source || '_p1_c' || chunk_index as id, text, page from chunks")
def chunk_whole_docs(spark, sf_dir):
    """Chunks of all documents, each as one page."""
    d = B.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("source"), F.lit(1).cast("long").alias("page"), "text")
    return C.chunk_documents(d).select("source", "id", "text", "page")


@query(f"with {_SLICED} select source, chunk_index, source || '_p' || page || '_c' || chunk_index as id, text, page, page_end, segment::bigint as segment, start, \"end\" from chunks")
def chunk_spans(spark, sf_dir):
    """All chunks of the sliced documents."""
    return C.chunk_documents(B.slice_pages(spark, sf_dir)).drop("section")


_MEASURES = "count(*) as chunks, min(length(text)) as min_chars, list_sort(list(length(text)))[count(*) // 2 + 1] as median_chars, max(length(text)) as max_chars, count(page_end) as spanning"


@query(f"with {_SLICED} select source, {_MEASURES} from chunks group by source union all select null, {_MEASURES} from chunks")
def chunk_profile(spark, sf_dir):
    return C.chunk_profile(C.chunk_documents(B.slice_pages(spark, sf_dir)))


@query("with c as (select source, row_number() over (partition by source order by doc_id) - 1 as pos, count(*) over (partition by source) as n, doc_id as chunk_index from documents) select source, chunk_index from c where pos % greatest(n // 7, 1) = 0 and pos // greatest(n // 7, 1) < 7")
def systematic_sample(spark, sf_dir):
    return C.systematic_sample(B.table(spark, sf_dir, "documents").select("source", F.col("doc_id").alias("chunk_index")), 7)


@query("select doc_id, case when doc_id % 3 = 1 then source || ' pp' || doc_id % 9 || '-' || doc_id % 9 + 2 else source || ' p' || doc_id % 9 end as citation from documents")
def citation(spark, sf_dir):
    d = B.table(spark, sf_dir, "documents").withColumn("page", F.col("doc_id") % 9)
    end = F.when(F.col("doc_id") % 3 == 1, F.col("page") + 2).when(F.col("doc_id") % 3 == 2, F.col("page"))
    return d.withColumn("page_end", end).select("doc_id", T.citation("source", "page", "page_end").alias("citation"))


@query("select doc_id, 'week' || doc_id % 5 || '_' || source || '_p' || doc_id % 9 || '_c' || doc_id as id from documents")
def chunk_id(spark, sf_dir):
    path = F.concat(F.lit("week"), (F.col("doc_id") % 5).cast("string"), F.lit("/"), "source", F.lit(".txt"))
    return B.table(spark, sf_dir, "documents").select("doc_id", T.chunk_id(path, F.col("doc_id") % 9, "doc_id").alias("id"))


@query(r"with t as (select doc_id, regexp_replace(regexp_replace(text, '^\s+|\s+$', '', 'g'), '\s+', ' ', 'g') as t from documents) select doc_id, substr(t, 1, 70) || case when length(t) > 70 then '...' else '' end as preview from t")
def preview(spark, sf_dir):
    return B.table(spark, sf_dir, "documents").select("doc_id", T.preview("text").alias("preview"))
