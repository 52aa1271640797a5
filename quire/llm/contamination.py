"""Benchmark items inside documents: size-partitioned MinHash containment search with exact checks.

An item's sketch is the bottom-k of its distinct shingle hashes. Items are partitioned by the size of
their shingle sets, and k follows from the largest size u of a partition: with k = floor((1-t)*u) + 1, a
document that holds a share t of the item must hold one of the k sketched shingles, so the search has no
false negatives, however long the document. (Banded signatures of whole documents were not used: an item
of 40 words in a document of 20,000 has a similarity near 0.002, at which no band width finds it.)
Documents are probed for sketched shingles only; a document that holds one is a candidate for that item, and
only then are the item's full set and the document's compared.

The benchmark is the stated query set. It goes through in blocks of about BLOCK items and BLOCK_BYTES of text,
whose hashes travel with the job (8 bytes a shingle and 12 a sketched one); every block sees every document.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import documents
from .wordhash import Lookup, U, mix, shingles, slices, words_of

BLOCK, BLOCK_BYTES = 20_000, 32 << 20
PAIR_ITEMS = 1 << 20  # shingles of candidate items that are checked at once
SCHEMA = "doc_id long, item_id long, n_item_shingles long, n_shared long, containment double"


def sketch_size(n: int, threshold: float) -> int:
    """k of the partition that holds sets of n shingles; partitions double in size."""
    upper = 1 << max(0, (n - 1).bit_length())
    return math.floor((1 - threshold) * upper + 1e-9) + 1


class ItemIndex:
    """The sketches and full sets of a block of items, by the width of their shingles: k, or less in items with fewer words."""

    def __init__(self, ids: list, texts: list, k: int, threshold: float):
        self.ids, self.threshold = np.array(ids, np.int64), threshold
        w = words_of(pa.array(texts, pa.string()))
        row, sh = shingles(w, k)
        order = np.lexsort((mix(sh), row))  # a random order, the same in every item
        row, sh = row[order], sh[order]
        keep = np.r_[True, (row[1:] != row[:-1]) | (sh[1:] != sh[:-1])] if len(row) else np.empty(0, bool)
        self.row, self.items = row[keep], sh[keep]
        self.size = np.bincount(self.row, minlength=len(ids))
        self.first = np.r_[0, np.cumsum(self.size)]
        k_of = np.array([sketch_size(int(n), threshold) for n in self.size], np.int64)
        sketched = np.arange(len(self.row)) - self.first[self.row] < k_of[self.row]
        width = np.minimum(w.counts, k)
        self.sketches = {}
        for one in sorted(set(width[self.size > 0].tolist())):
            mine = sketched & (width[self.row] == one)
            keys, at = np.unique(self.items[mine], return_inverse=True)
            order = np.argsort(at, kind="stable")
            self.sketches[one] = Lookup(keys), self.row[mine][order], np.searchsorted(at[order], np.arange(len(keys) + 1))

    def candidates(self, row: np.ndarray, sh: np.ndarray, width: int) -> np.ndarray:
        """Pairs row * items + item whose row holds a sketched shingle of the item."""
        lookup, item, start = self.sketches[width]
        key = lookup.find(sh)
        hit = np.flatnonzero(key >= 0)
        row, key = row[hit].astype(np.int64), key[hit]
        n = start[key + 1] - start[key]
        at = np.repeat(start[key] - np.cumsum(n) + n, n) + np.arange(n.sum())
        return np.unique(np.repeat(row, n) * len(self.ids) + item[at])

    def search(self, w) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, item, shared shingles) of each row of ``w`` that holds the threshold's share of an item."""
        out = [(np.empty(0, np.int64),) * 3]
        for width in self.sketches:  # a short item is found as a run of its own words
            row, sh = shingles(w, width, short=False)
            pairs = self.candidates(row, sh, width)
            if not len(pairs):
                continue
            asked = np.unique(pairs // len(self.ids))
            some = np.isin(row, asked)
            held = np.unique(mix(sh[some] + mix(row[some].astype(U))))  # (row, shingle) of the candidates, whole
            step = np.cumsum(self.size[pairs % len(self.ids)]) // PAIR_ITEMS
            for part in np.split(pairs, np.flatnonzero(np.diff(step)) + 1):
                r, i = part // len(self.ids), part % len(self.ids)
                n = self.size[i]
                at = np.repeat(self.first[i] - np.cumsum(n) + n, n) + np.arange(n.sum())
                asked_for = mix(self.items[at] + mix(np.repeat(r, n).astype(U)))
                place = np.minimum(np.searchsorted(held, asked_for), len(held) - 1)
                shared = np.add.reduceat((held[place] == asked_for).astype(np.int64), np.cumsum(n) - n)
                yes = shared >= self.threshold * n - 1e-9
                out.append((r[yes], i[yes], shared[yes]))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _blocks(benchmark: DataFrame, item_col: str, item_text_col: str) -> Iterator[tuple[list, list, list]]:
    """Ids and texts of the items, block by block, and how often each item stands in the table."""
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).cast("string").alias("text"))
    items = items.filter("item_id is not null and text is not null")
    items = items.groupBy("item_id", "text").agg(F.count(F.lit(1)).alias("times"))
    n, size = items.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    blocks = max(1, math.ceil(n / BLOCK), math.ceil(size / BLOCK_BYTES))
    for b in range(blocks):
        rows = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).orderBy("item_id", "text").collect()
        if rows:
            yield [r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows]


def _searcher(ids: list, texts: list, times: list, k: int, threshold: float):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, often = ItemIndex(ids, texts, k, threshold), np.array(times, np.int64)
        for batch in batches:
            for part in slices(batch, "text"):
                row, item, shared = index.search(words_of(part.column(1)))
                row, item, shared = (np.repeat(x, often[item]) for x in (row, item, shared))
                size = index.size[item]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(row)), pa.array(index.ids[item]), pa.array(size.astype(np.int64)), pa.array(shared.astype(np.int64)), pa.array(shared / size if len(size) else np.empty(0))],
                    names=["doc_id", "item_id", "n_item_shingles", "n_shared", "containment"],
                )

    return search


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8, k: int = 5, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, n_item_shingles, n_shared, containment): each document with each item of which it holds at least ``threshold`` of the k-word shingles.

    Words are runs of non-space bytes with A-Z lower-cased. An item of fewer than k words counts as one
    shingle of its own length and is found anywhere in a document. Null or empty texts on either side match
    nothing; rows with a null item id are passed over; a null document id is returned as null. Repeated
    rows are each matched. Empty tables give an empty result. Other columns are ignored.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out = None
    for ids, texts, times in _blocks(benchmark, item_col, item_text_col):
        part = base.mapInArrow(_searcher(ids, texts, times, k, threshold), SCHEMA)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else docs.sparkSession.createDataFrame([], SCHEMA)


def _keeper(ids: list, texts: list, k: int, threshold: float, text_col: str):
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = ItemIndex(ids, texts, k, threshold)
        for batch in batches:
            for part in slices(batch.append_column("", batch.column(text_col)), ""):
                clean = np.ones(part.num_rows, bool)
                clean[index.search(words_of(part.column(part.num_columns - 1)))[0]] = False
                yield part.select(range(part.num_columns - 1)).filter(pa.array(clean))

    return keep


def uncontaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8, k: int = 5, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, as they are, that contaminated() does not find. No shuffle: rows are judged one by one, whatever their ids."""
    for ids, texts, _ in _blocks(benchmark, item_col, item_text_col):
        docs = docs.mapInArrow(_keeper(ids, texts, k, threshold, text_col), docs.schema)
    return docs


def op6_contamination(spark, sf_dir: str) -> DataFrame:
    return contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_WORDS = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+')"
_SHINGLES = """
  select distinct {id}, unnest(case when len(w) >= 5 then list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
    when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as s, len(w) < 5 as few, array_to_string(w, ' ') as whole
  from (select {id}, {words} as w from {table})"""
QUERIES = {"op6_contamination": op6_contamination}
SQL = {
    "op6_contamination": f"""
with i as ({_SHINGLES.format(id="item_id", words=_WORDS, table="benchmark")}),
d as ({_SHINGLES.format(id="doc_id", words=_WORDS, table="documents")}),
n as (select item_id, count(*) as n from i where not few group by item_id),
m as (select d.doc_id, i.item_id, count(*) as k from i join d on i.s = d.s where not i.few group by d.doc_id, i.item_id)
select doc_id, item_id, n as n_item_shingles, k as n_shared, k / n as containment from m join n using (item_id) where k >= 0.8 * n - 1e-9
union all
select t.doc_id, item_id, 1, 1, 1.0 from (select distinct item_id, s from i where few) q
join (select doc_id, array_to_string({_WORDS}, ' ') as whole from documents) t on contains(' ' || whole || ' ', ' ' || s || ' ')
"""
}
