"""Queries on files, the index, citations and exams."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import citations as G
from ..operators import exam as X
from ..operators import replies as R
from ..sources import files as S
from ..sources import index as I
from ..sources import page_source as D
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


@query("select doc_id, sha256(text) as hash from documents")
def content_hash(spark, sf_dir):
    return S.with_hash(B.table(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("binary").alias("content"))).drop("content")


@query("select source, count(*) as chunks from documents group by source")
def source_counts(spark, sf_dir):
    return I.source_counts(B.table(spark, sf_dir, "documents"))


@query("select (select count(distinct source) from documents) as documents, (select count(*) from documents) as chunks, (select count(embedding) from documents left join embeddings on vec_id = doc_id) as vectors, (select count(*) = count(embedding) from documents left join embeddings on vec_id = doc_id) as consistent")
def store_stats(spark, sf_dir):
    d = B.table(spark, sf_dir, "documents")
    e = B.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    return I.store_stats(d.select("source").distinct(), d.select("doc_id").join(e, "doc_id", "left"))


@query("with s as (select doc_id::varchar as source, sha256(text) as h from documents where doc_id % 5 <> 1), f as (select doc_id::varchar as source, sha256(case when doc_id % 7 = 0 then text || '!' else text end) as h from documents where doc_id % 11 <> 3) select coalesce(f.source, s.source) as source, case when f.h is null then 'removed' when s.h is null then 'new' when f.h = s.h then 'cached' else 'changed' end as status from f full join s on f.source = s.source")
def incremental_status(spark, sf_dir):
    d = B.table(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").cast("string").alias("source"), "text")
    sha = lambda t: F.sha2(t.cast("binary"), 256).alias("hash")
    stored = d.filter("doc_id % 5 <> 1").select("source", sha(F.col("text")))
    found = d.filter("doc_id % 11 <> 3").select("source", sha(F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))))
    return I.incremental_status(found, stored)


@query("select doc_id as id, source, case when doc_id % 3 = 0 then 'new' else 'old' end as state from documents")
def upsert_chunks(spark, sf_dir):
    """A third of the documents anew, half of them for the first time."""
    d = B.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "source")
    return I.upsert(d.filter("id % 6 <> 3").withColumn("state", F.lit("old")), d.filter("id % 3 = 0").withColumn("state", F.lit("new")), "id")


@query("select doc_id as id, source from documents where source not in ('src3', 'src5')")
def remove_document(spark, sf_dir):
    d = B.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "source")
    return I.without(d, spark.createDataFrame([("src3",), ("src5",)], "source string"))


@query("""select source || '/' || doc_id || '.txt' as source, 1::bigint as page, sha256(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10))) as hash from documents where source <> 'src3'""")
def page_source(spark, sf_dir):
    """Documents written as files in a folder for each source, and read back through the page source."""
    docs = B.table(spark, sf_dir, "documents").select("source", "doc_id", "text")
    place = W.folder(spark, "files")
    fs, root, _ = S.file_system(place)

    def put(batches):
        fs, root, _ = S.file_system(place)
        for b in batches:
            for r in b.to_pylist():
                fs.create_dir(f"{root}/{r['source']}")
                with fs.open_output_stream(f"{root}/{r['source']}/{r['doc_id']}.txt") as f:
                    f.write(r["text"].encode())
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], names=["n"])

    fs.create_dir(root)
    docs.mapInArrow(put, "n long").agg(F.sum("n")).first()
    return D.pages_of(spark, place).filter(~F.col("source").startswith("src3/")).select("source", "page", F.sha2(F.col("text").cast("binary"), 256).alias("hash"))


def _halves(docs, mark):
    """Documents as sources of two chunks each, as the index takes them; the vector is the document's, or a short one of its own."""
    half = F.ceil(F.length("text") / 2).cast("int")
    part = F.when(F.col("chunk_index") == 0, F.substring("text", F.lit(1), half)).otherwise(F.concat(F.substring("text", half + 1, F.length("text")), F.lit(mark)))
    vector = F.coalesce("embedding", F.array(F.lit(1.0).cast("float"))).alias("embedding")
    rows = docs.select("source", F.explode(F.array(F.lit(0), F.lit(1))).alias("chunk_index"), "text", vector)  # not an array of texts, so that chunks are counted without them
    return rows.select("source", F.col("chunk_index").cast("long"), F.concat_ws("_", "source", "chunk_index").alias("id"), part.alias("text"), F.lit(1).cast("long").alias("page"), F.lit(None).cast("long").alias("page_end"), F.lit(None).cast("string").alias("section"), "embedding")


def _hashes(docs):
    return docs.select("source", F.sha2(F.col("text").cast("binary"), 256).alias("hash"), F.col("doc_id").alias("rank"))


@query("""with s as (select doc_id, doc_id::varchar as source, text, ceil(length(text) / 2)::int as half, doc_id % 3 = 0 as anew from documents where (doc_id % 2 = 0 or doc_id % 3 = 0) and doc_id % 5 <> 0),
n as (select doc_id, row_number() over (order by anew, doc_id) as place from s)
select s.source, i as chunk_index, sha256(case when i = 0 then substr(text, 1, half) else substr(text, half + 1) || case when anew then '!' else '' end end) as hash, coalesce(len(embedding), 1)::int as dimension, n.place
from s join n on n.doc_id = s.doc_id left join embeddings on vec_id = s.doc_id, (values (0::bigint), (1::bigint)) as t(i)""")
def index_changes(spark, sf_dir):
    """An index that takes in the documents divisible by 2, then those divisible by 3 (half of them again), and loses those divisible by 5; ``place`` is the order of ingestion of what is left."""
    d = B.table(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").cast("string").alias("source"), "text")
    v = B.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("vec_id").cast("string").alias("source"), "embedding")
    index = I.ChunkIndex.open(spark, W.folder(spark, "index"), {}, create=True)
    for part, mark in (("doc_id % 2 = 0", ""), ("doc_id % 3 = 0", "!")):
        both = d.filter(part).join(v.filter(part).drop("doc_id"), "source", "left")  # by source, as the index joins them on
        index.replace(_halves(both, mark), _hashes(d.filter(part)))
    index.remove(d.filter("doc_id % 5 = 0").select("source"))
    chunks = index.chunks().select("source", "chunk_index", F.sha2(F.col("text").cast("binary"), 256).alias("hash"), F.size("embedding").alias("dimension"))
    return chunks.join(index.places().select("source", "place"), "source").select("source", "chunk_index", "hash", "dimension", "place")


@query(r"with p as (select regexp_replace(regexp_replace(url, '[?#].*$', ''), '^[a-z]+://[^/]*/?', '') as path from pages), s as (select lower(regexp_extract(path, '[^/](\.[^./]+)$', 1)) as suffix from p) select suffix, count(*) as files from s where suffix not in ('', '.txt', '.pdf') group by suffix")
def ext_counts(spark, sf_dir):
    path = F.regexp_replace(F.regexp_replace("url", r"[?#].*$", ""), r"^[a-z]+://[^/]*/?", "")
    return S.ignored(B.table(spark, sf_dir, "pages").select(T.extension(path).alias("suffix")), (".txt", ".pdf"))


#: All documents as material, five pages apart.
_CHUNKS = "chunks as (select source, doc_id * 5 as page, case when doc_id % 4 = 0 then doc_id * 5 + doc_id % 3 end as page_end from documents)"
_ALLOWED = f"{_CHUNKS}, allowed as (select distinct source, unnest(range(page, greatest(coalesce(page_end, page), page) + 1)) as page from chunks)"
_ITEMS = "items as (select doc_id as n, case when doc_id % 10 = 0 then 'nowhere' else source end as source, doc_id * 5 + doc_id % 7 as page from documents)"
_CHECKED = f"""{_ALLOWED}, {_ITEMS},
near as (select n, i.source, i.page, a.page as given, a.source as of, row_number() over (partition by n order by a.page is null, abs(a.page - i.page), a.page) as rn from items i left join allowed a on a.source = i.source),
checked as (select n, source, page, case when of is null then 'dropped' when given = page then 'kept' when abs(given - page) <= 2 then 'repaired' else 'dropped' end as status, given, of from near where rn = 1)"""


def _chunks(spark, sf_dir):
    page = F.col("doc_id") * 5
    return B.table(spark, sf_dir, "documents").select("source", page.alias("page"), F.when(F.col("doc_id") % 4 == 0, page + F.col("doc_id") % 3).alias("page_end"))


@query(f"with {_ALLOWED} select source, page from allowed")
def allowed_pages(spark, sf_dir):
    return G.allowed_pages(_chunks(spark, sf_dir))


@query(f"with {_CHECKED} select n, source, page, status, case when status <> 'dropped' then given end as cited_page, case when of is null then source || ' p' || page || ': no such file in the material' when status = 'dropped' then source || ' p' || page || ': page not among those given' end as reason from checked")
def citation_check(spark, sf_dir):
    n = F.col("doc_id")
    items = B.table(spark, sf_dir, "documents").select(n.alias("n"), F.when(n % 10 == 0, "nowhere").otherwise(F.col("source")).alias("source"), (n * 5 + n % 7).alias("page"))
    return G.check_citations(items, _chunks(spark, sf_dir))


_EXAM = "items as (select doc_id + 1 as n, case when doc_id % 6 = 5 then ' ' else 'topic ' || doc_id % 6 end as topic, 'What is ' || doc_id || '?' as question, 'It is ' || lang || '.' as answer, source, doc_id % 9 + 1 as page from documents)"


def _exam(spark, sf_dir):
    d = B.table(spark, sf_dir, "documents")
    topic = F.when(F.col("doc_id") % 6 == 5, " ").otherwise(F.concat(F.lit("topic "), (F.col("doc_id") % 6).cast("string")))
    text = lambda a, c, b: F.concat(F.lit(a), F.col(c).cast("string"), F.lit(b))
    return d.select((F.col("doc_id") + 1).alias("n"), topic.alias("topic"), text("What is ", "doc_id", "?").alias("question"), text("It is ", "lang", ".").alias("answer"), "source", (F.col("doc_id") % 9 + 1).alias("page"))


@query(f"""with {_EXAM}, t as (select *, case when trim(topic) = '' then 'General' else trim(topic) end as name from items)
select name as topic, min(n) as first, '## ' || name || chr(10) || chr(10) || string_agg('**' || n || '.** ' || question, chr(10) || chr(10) order by n) || chr(10) as paper,
'## ' || name || chr(10) || chr(10) || string_agg('### ' || n || '. ' || question || chr(10) || chr(10) || answer || chr(10) || chr(10) || '> Source: **' || source || '**, page ' || page, chr(10) || chr(10) order by n) || chr(10) as key from t group by name""")
def exam_paper(spark, sf_dir):
    return X.sections(_exam(spark, sf_dir))


@query(f"with {_EXAM} select case when trim(topic) = '' then 'General' else trim(topic) end as topic, count(*) as questions, min(n) as first from items group by 1")
def topics_covered(spark, sf_dir):
    return X.topics_covered(_exam(spark, sf_dir))


#: Replies in the shapes that models send, made of the turns of conversations; both ways of making them give the same JSON but for how they escape.
_REPLIES = """turns as (select conv_id, turn, (conv_id + turn) % 10 as shape, text, to_json(text)::varchar as j, role from conversations where text is not null),
one as (select *, '{"topic": "T", "question": ' || j || ', "answer": "' || role || '", "source": "s", "page": ' as h from turns),
replies as (select conv_id, turn, shape, text, case shape when 0 then '{"items": [' || h || '3}, ' || h || '"4"}]}' when 1 then '```json' || chr(10) || '{"items": []}' || chr(10) || '```' when 2 then 'Here you are: {"questions": [' || h || '"x"}]} Enjoy!'
when 3 then '[' || h || '1}, ' || h || '2}, 7]' when 4 then h || '9}' when 5 then '{"a": [1], "b": [2], "c": ' || j || '}' when 6 then text when 7 then '{"broken": ' || j when 8 then '{"exam": [], "note": ' || j || '}' else 'As asked:' || chr(10) || '```' || chr(10) || '[' || h || '5}]' || chr(10) || '```' end as raw from one),
tries as (select *, nullif(regexp_extract(raw, '(?s)```(?:json)?(.*?)```', 1), '') as fenced, nullif(regexp_extract(raw, '(?s)\\{.*\\}'), '') as braces, nullif(regexp_extract(raw, '(?s)\\[.*\\]'), '') as brackets from replies),
parsed as (select *, case when json_valid(raw) then raw::json when json_valid(fenced) then fenced::json when json_valid(braces) then braces::json when json_valid(brackets) then brackets::json end as v from tries),
listed as (select *, case when json_type(v) = 'OBJECT' then list_filter(list_transform(json_keys(v), lambda k: json_extract(v, '$."' || k || '"')), lambda x: json_type(x) = 'ARRAY') end as lists from parsed),
found as (select *, case when json_type(v) = 'ARRAY' then v when json_type(v) <> 'OBJECT' then null when list_contains(json_keys(v), 'items') then case when json_type(json_extract(v, '$.items')) = 'ARRAY' then json_extract(v, '$.items') end
when list_has_all(json_keys(v), ['question', 'answer', 'source', 'page']) then json_array(v) when len(lists) = 1 then lists[1] end as items from listed)"""


def _replies(spark, sf_dir):
    t = B.table(spark, sf_dir, "conversations").filter("text is not null").select("conv_id", "turn", "text", "role", ((F.col("conv_id") + F.col("turn")) % 10).alias("shape"))
    j = F.regexp_extract(F.to_json(F.struct("text")), r'(?s)^\{"text":(.*)\}$', 1)
    h = F.concat(F.lit('{"topic": "T", "question": '), j, F.lit(', "answer": "'), F.col("role"), F.lit('", "source": "s", "page": '))
    join = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    shapes = [
        join('{"items": [', h, "3}, ", h, '"4"}]}'), F.lit('```json\n{"items": []}\n```'), join('Here you are: {"questions": [', h, '"x"}]} Enjoy!'), join("[", h, "1}, ", h, "2}, 7]"), join(h, "9}"),
        join('{"a": [1], "b": [2], "c": ', j, "}"), F.col("text"), join('{"broken": ', j), join('{"exam": [], "note": ', j, "}"), join("As asked:\n```\n[", h, "5}]\n```"),
    ]
    raw = F.lit(None).cast("string")
    for i, shape in reversed(list(enumerate(shapes))):
        raw = F.when(F.col("shape") == i, shape).otherwise(raw)
    return t.select("conv_id", "turn", raw.alias("raw"))


@query(f"with {_REPLIES} select conv_id, turn, json_array_length(items)::int as items from found")
def coerce_json(spark, sf_dir):
    """How many items each reply holds; null where their place is in doubt or nothing parses."""
    found = R.items_of(R.parsed(F.col("raw")))
    return _replies(spark, sf_dir).select("conv_id", "turn", F.when(found.isNotNull(), F.size(found)).alias("items"))


@query(f"""with {_REPLIES}, e as (select conv_id, turn, unnest(json_extract(items, '$[*]')) as item, unnest(range(0, json_array_length(items)::bigint)) as place from found where json_array_length(items) > 0),
f as (select conv_id, turn, place::int as place, case when json_type(item) = 'OBJECT' then item end as o from e)
select conv_id, turn, place, o->>'$.topic' as topic, sha256(o->>'$.question') as question, o->>'$.answer' as answer, o->>'$.source' as source, try_cast(o->>'$.page' as bigint) as page,
case when o is null then 'question' when try_cast(o->>'$.page' as bigint) is null then 'page' end as fault from f""")
def reply_items(spark, sf_dir):
    """Every item of the replies, with the first field that does not fit."""
    items = R.items_table(_replies(spark, sf_dir), "raw", "conv_id", "turn")
    return items.withColumnRenamed("at", "place").withColumn("question", F.sha2(F.col("question").cast("binary"), 256))
