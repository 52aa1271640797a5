"""MinHash near-duplicate classes by one-permutation hashing.

Every document's set of word shingles is hashed once; the range of the hash is cut into bins and the
smallest value of each bin is kept. Empty bins are filled by optimal densification: an empty bin copies
the first non-empty bin of a pseudo-random sequence that depends on the bin alone, so that two
documents copy alike. Runs of bins form bands; documents with an equal band share a bucket.

Pair counts stay linear: documents with the same words are one node, and a bucket emits star edges from
a hub, its most widely connected member, to the others. An edge counts only after the two full shingle
sets were compared. Where the members of a bucket are then still in several components, those outside the
bucket's largest one become hubs as well, at most HUBS of them a turn, until every pair of the bucket was
either a candidate or joined by other edges; so the star never loses a link that the full bucket has.

Two exact bounds cut the later turns: a link needs enough shared shingles, and a document shares none of the
shingles that only it has. Before full sets are read, a pair must agree in enough of the bins that either fills, kept to eight bits a bin: the
least share allowed lies SIGMAS standard errors below the threshold, which a linked pair misses with a
chance of about 1e-9.

A bucket may hold a third of all nodes. Its rows are dealt to parts of about PART rows by a hash of the node, what
they are joined with (hubs, sums of the bucket) goes to every part once, and sizes add up part by part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import components
from .shared import discard, documents, kept, scratch
from .wordhash import U, mix, powers, sequence_keys, shingles, slices, words_of

BITS = 54  # of a shingle's hash inside a document; the ten above hold the row within a slice
EMPTY = np.iinfo(np.uint64).max
HUBS = 256  # of a bucket and turn, or one of each part
PART, FIRST_PARTS = 2000, 64
SIGMAS = 6.0
LOW = 0x0101010101010101


def shape(threshold: float, miss: float = 1e-5) -> tuple[int, int]:
    """(rows of a band, bands): the longest bands of at most 8 rows whose chance to miss a pair at the threshold is below ``miss`` with 48 bands at most."""
    for rows in range(8, 0, -1):
        p = threshold**rows
        bands = max(8, math.ceil(math.log(miss) / math.log1p(-p))) if p < 1 else 8
        if bands <= 48:
            return rows, bands
    raise ValueError("threshold too low for banding")


def one_permutation(row: np.ndarray, shingle: np.ndarray, rows: int, bins: int) -> tuple[np.ndarray, np.ndarray]:
    """(set size of each row, minima by row and bin; EMPTY where a bin has no shingle)."""
    key = np.sort((row.astype(U) << U(BITS)) | (shingle >> U(64 - BITS)))
    key = key[np.r_[True, key[1:] != key[:-1]]] if len(key) else key
    of = (key >> U(BITS)).astype(np.int64)
    value = key & U((1 << BITS) - 1)
    place = of * bins + ((value * U(bins)) >> U(BITS)).astype(np.int64)
    lead = np.flatnonzero(np.r_[True, place[1:] != place[:-1]]) if len(place) else np.empty(0, np.int64)
    minima = np.full(rows * bins, EMPTY, U)
    minima[place[lead]] = value[lead]
    return np.bincount(of, minlength=rows), minima.reshape(rows, bins)


def densify(minima: np.ndarray) -> np.ndarray:
    """Fill each empty bin from the first filled bin of its own probe sequence; rows without any shingle stay EMPTY."""
    rows, bins = minima.shape
    full = minima != EMPTY
    row, bin_ = np.nonzero(~full & full.any(axis=1)[:, None])
    out = minima.copy()
    attempt = 0
    while len(row):
        attempt += 1
        probe = (mix((np.arange(bins, dtype=U) << U(32)) + U(attempt)) % U(bins)).astype(np.int64)
        source = probe[bin_]
        hit = full[row, source]
        out[row[hit], bin_[hit]] = mix(minima[row[hit], source[hit]] + U(attempt))
        row, bin_ = row[~hit], bin_[~hit]
    return out


def band_keys(signature: np.ndarray, size: int, bands: int) -> np.ndarray:
    steps = powers(0x9FB21C651E98DF25, size)
    keys = np.empty((len(signature), bands), U)
    for b in range(bands):
        keys[:, b] = (signature[:, b * size : (b + 1) * size] * steps).sum(axis=1, dtype=U) + U(b + 1)
    return mix(keys)


def _signer(k: int, size: int, bands: int):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                w = words_of(part.column(1))
                one, two = sequence_keys(w)
                row, sh = shingles(w, k)
                n, minima = one_permutation(row, sh, part.num_rows, size * bands)
                full = densify(minima)
                keys = band_keys(full, size, bands)
                sketch = np.zeros((part.num_rows, -(-size * bands // 8) * 8), np.uint8)
                sketch[:, : size * bands] = np.where(minima == EMPTY, U(0), minima % U(255) + U(1))
                some = n > 0
                lists = [pa.ListArray.from_arrays(np.r_[0, np.cumsum(some * x.shape[1])].astype(np.int32), x[some].ravel().view(np.int64)) for x in (keys, sketch.view(np.int64))]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n.astype(np.int64)), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), *lists], names=["doc_id", "n_shingles", "k1", "k2", "bands", "sketch"])

    return sign


def _sets(k: int):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                row, sh = shingles(words_of(part.column(1)), k)
                order = np.lexsort((sh, row))
                row, sh = row[order], sh[order]
                keep = np.r_[True, (row[1:] != row[:-1]) | (sh[1:] != sh[:-1])] if len(row) else np.empty(0, bool)
                row, sh = row[keep], sh[keep]
                lists = pa.ListArray.from_arrays(np.searchsorted(row, np.arange(part.num_rows + 1)).astype(np.int32), sh.view(np.int64))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], names=["node", "items"])

    return of


def _linked(percent: int):
    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column(2), batch.column(3)
            oa, ob = (np.frombuffer(x.buffers()[1], np.int32)[x.offset : x.offset + len(x) + 1] for x in (a, b))
            va, vb = (x.values.to_numpy(zero_copy_only=False) for x in (a, b))
            yes = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                x, y = va[oa[i] : oa[i + 1]], vb[ob[i] : ob[i + 1]]
                z = np.sort(np.concatenate([x, y]))
                both = int((z[1:] == z[:-1]).sum())
                yes[i] = 100 * both >= percent * (len(x) + len(y) - both) and both > 0
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(yes))

    return check


def _own_shingles(sets: DataFrame) -> DataFrame:
    """(node, own): how many shingles of a node no other node has. Nodes with several sets (a repeated id) are left out."""
    single = sets.groupBy("node").agg(F.count(F.lit(1)).alias("sets")).filter("sets = 1")
    holders = sets.select("node", F.explode("items").alias("item")).groupBy("item").agg(F.count(F.lit(1)).alias("holders"), F.min("node").alias("node"))
    return holders.filter("holders = 1").groupBy("node").agg(F.count(F.lit(1)).alias("own")).join(single, "node", "left_semi")


def _zero_bytes(z: Column) -> Column:
    """The lowest bit of each byte is set where the byte of ``z`` is zero."""
    for step in (4, 2, 1):
        z = z.bitwiseOR(F.shiftrightunsigned(z, step).bitwiseAND(F.lit({4: 0x0F0F0F0F0F0F0F0F, 2: 0x3F3F3F3F3F3F3F3F, 1: 0x7F7F7F7F7F7F7F7F}[step])))
    return F.bitwise_not(z)


def near_duplicates(docs: DataFrame, percent: int = 80, k: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of each row of ``docs``.

    percent: documents are linked if 100 * |intersection| >= percent * |union| of their sets of k-word shingles.
    component_id is the smallest id that links reach; kept marks the documents that have that id.

    Null or empty texts, and texts without a word, have no shingles, are linked with nothing and are kept.
    A row without an id is linked with nothing: its component_id is null and it is kept. Rows that repeat
    an id are one node: a link of any of them is a link of all; each row is returned. An empty table gives
    an empty result. Other columns of ``docs`` are ignored, whatever their names.
    """
    with scratch():
        return kept(_classes(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), percent, k), "near-dup", stay=True)


def _part(node: str, members: str) -> Column:
    """The part of a bucket of so many members that a node is dealt to."""
    return F.pmod(F.xxhash64(node), _parts(members))


def _parts(members: str) -> Column:
    return F.ceil(F.col(members) / PART)


def _every_part(members: str) -> Column:
    return F.explode(F.sequence(F.lit(0).cast("long"), _parts(members) - 1)).alias("part")


def _shared_buckets(banded: DataFrame) -> DataFrame:
    """(bucket, part, members, node, n) of the rows of (bucket, node, n) whose bucket has other members. No key holds more than a FIRST_PARTS-th of a bucket."""
    dealt = banded.withColumn("first", F.pmod(F.xxhash64("node"), F.lit(FIRST_PARTS))).repartition("bucket", "first")  # one exchange for both uses
    some = dealt.groupBy("bucket", "first").agg(F.count(F.lit(1)).alias("some"))
    sizes = some.withColumn("members", F.sum("some").over(Window.partitionBy("bucket"))).filter("members > 1").drop("some")  # FIRST_PARTS rows of a bucket at most
    return dealt.join(sizes, ["bucket", "first"]).select("bucket", _part("node", "members").alias("part"), "members", "node", "n")


def _classes(base: DataFrame, percent: int, k: int) -> DataFrame:
    size, bands = shape(percent / 100)
    signed = kept(base.mapInArrow(_signer(k, size, bands), "doc_id long, n_shingles long, k1 long, k2 long, bands array<long>, sketch array<long>"), "signatures")

    some = signed.filter((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    classes = kept(some.groupBy("k1", "k2").agg(F.min("doc_id").alias("node")), "classes")
    nodes = some.join(classes.select("k1", "k2", F.col("node").alias("doc_id")), ["doc_id", "k1", "k2"], "left_semi").dropDuplicates(["doc_id", "k1", "k2"])
    nodes = kept(nodes.select(F.col("doc_id").alias("node"), F.col("n_shingles").alias("n"), "bands", "sketch"), "nodes")
    whole, signed = signed, kept(signed.select("doc_id", "n_shingles", "k1", "k2"), "keys")
    discard(whole)
    live = kept(_shared_buckets(nodes.select("node", "n", F.explode("bands").alias("bucket"))), "buckets")
    reach = live.groupBy("node").agg(F.sum("members").alias("reach"))
    sketches = nodes.select("node", "n", "sketch")
    sets = kept(
        base.join(reach.select(F.col("node").alias("doc_id")), "doc_id", "left_semi").mapInArrow(_sets(k), "node long, items array<long>").dropDuplicates(["node", "items"]),
        "sets",
    )

    def alike(one: str, other: str, n: str, m: str) -> Column:
        zeros = lambda z: F.bit_count(F.lit(LOW).bitwiseAND(_zero_bytes(z)))
        total = lambda xs: F.aggregate(xs, F.lit(0), lambda t, x: t + x)
        none = total(F.zip_with(one, other, lambda x, y: zeros(x.bitwiseOR(y))))
        equal = total(F.zip_with(one, other, lambda x, y: zeros(x.bitwiseXOR(y)))) - none
        used, p = F.lit(-(-size * bands // 8) * 8) - none, percent / 100
        # Bins sample the union of the two sets, which has (n + m) / (1 + p) shingles at most, without putting any back.
        spread = F.sqrt(p * (1 - p) / used * F.greatest(F.lit(0.05), 1 - used * (1 + p) / (F.col(n) + F.col(m))))
        return equal >= used * (p - SIGMAS * spread)

    def verified(pairs: DataFrame) -> DataFrame:
        """Of (hub, node, members), the pairs that are linked. A hub's set goes once to each part of its bucket; a node is in no more pairs than it has bands and turns."""
        dealt = pairs.withColumn("parts", _parts("members")).withColumn("part", _part("node", "members"))
        of_hub = dealt.select("hub", "parts", "part").distinct().join(sets.select(F.col("node").alias("hub"), F.col("items").alias("of_a")), "hub")
        both = dealt.join(of_hub, ["hub", "parts", "part"]).join(sets.select("node", F.col("items").alias("of_b")), "node")
        return kept(both.select(F.least("hub", "node").alias("a"), F.greatest("hub", "node").alias("b"), "of_a", "of_b").mapInArrow(_linked(percent), "a long, b long").distinct(), "links")

    ends = [F.least("hub", "node").alias("a"), F.greatest("hub", "node").alias("b")]
    once_each = lambda df: df.groupBy(*ends).agg(F.max_by(F.struct("hub", "node"), "members").alias("x"), F.max("members").alias("members")).select("a", "b", "x.hub", "x.node", "members")
    sized = 100 * F.least("n", "hub_n") >= percent * F.greatest("n", "hub_n")
    hub = live.join(reach, "node").groupBy("bucket").agg(F.max(F.struct("reach", (-F.col("node")).alias("minus"), "n")).alias("h"), F.max("members").alias("members"))
    first = kept(hub.select("bucket", (-F.col("h.minus")).alias("hub"), F.col("h.n").alias("hub_n"), F.col("members").alias("of")), "hubs")
    pairs = live.join(first.select("bucket", "hub", "hub_n", _every_part("of")), ["bucket", "part"]).filter((F.col("node") != F.col("hub")) & sized)
    pairs = once_each(pairs.select("hub", "node", "members")).withColumn("parts", _parts("members")).withColumn("part", _part("node", "members"))
    of_hub = pairs.select("hub", "parts", "part").distinct().join(sketches.select(F.col("node").alias("hub"), F.col("n").alias("n_hub"), F.col("sketch").alias("s_hub")), "hub")
    pairs = kept(pairs.join(of_hub, ["hub", "parts", "part"]).join(sketches, "node").filter(alike("s_hub", "sketch", "n_hub", "n")).select("a", "b", "hub", "node", "members"), "pairs")
    seen, edges = pairs.select("a", "b"), verified(pairs)
    roots = components(edges)
    asked, own = first.select("bucket", F.col("hub").alias("node")), None
    while True:
        # Members that were no hub yet, outside the largest component of a bucket that holds several.
        now = live.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        parts = now.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("held"), F.max("members").alias("members"))
        major = parts.groupBy("bucket").agg(F.count(F.lit(1)).alias("parts"), F.max(F.struct("held", "root")).alias("m"), F.max("members").alias("of")).filter("parts > 1")
        now = now.join(major.select("bucket", F.col("m.root").alias("major"), _every_part("of")), ["bucket", "part"])
        now = kept(now.join(asked.withColumn("hit", F.lit(True)), ["bucket", "node"], "left"), "open")
        if own is None:
            own = kept(_own_shingles(sets.join(now.select("node").distinct(), "node", "left_semi")), "own")
        now = now.join(own, "node", "left").withColumn("common", F.col("n") - F.coalesce("own", F.lit(0))).drop("own")
        rank = F.row_number().over(Window.partitionBy("bucket", "part").orderBy("node"))
        linkable = 100 * F.col("common") >= percent * F.col("n")
        hubs = now.filter("hit is null and root <> major").filter(linkable).withColumn("rank", rank).filter(F.col("rank") <= F.greatest(F.lit(1), F.floor(F.lit(HUBS) / _parts("members"))))
        hubs = hubs.join(nodes.select("node", "sketch", "bands"), "node")
        hubs = kept(hubs.select("bucket", F.col("members").alias("of"), F.col("node").alias("hub"), F.col("n").alias("hub_n"), F.col("root").alias("hub_root"), F.col("common").alias("hub_common"), F.col("sketch").alias("hub_sketch"), F.col("bands").alias("hub_bands")), "hubs")
        if hubs.isEmpty():
            break
        open_ = hubs.groupBy("bucket").agg(F.max("of").alias("of")).select("bucket", _every_part("of"))
        live = now.join(open_, ["bucket", "part"], "left_semi").select("bucket", "part", "members", "node", "n")
        rows = now.filter(linkable).join(nodes.select("node", "sketch", "bands"), "node").withColumn("at", F.col("bucket"))
        most = F.least("common", "hub_common")
        enough = 100 * most >= percent * (F.col("n") + F.col("hub_n") - most)
        common_band = F.filter(F.zip_with("bands", "hub_bands", lambda x, y: F.when(x == y, x)), lambda x: x.isNotNull())
        once = F.get(common_band, F.lit(0)) == F.col("at")  # a pair comes from the first bucket that it shares
        plausible = (F.col("node") != F.col("hub")) & (F.col("root") != F.col("hub_root")) & enough & once & alike("sketch", "hub_sketch", "n", "hub_n")
        found = rows.join(hubs.select("*", _every_part("of")), ["bucket", "part"]).filter(plausible)
        pairs = kept(once_each(found.select("hub", "node", "members")).join(seen, ["a", "b"], "left_anti"), "pairs")
        asked = asked.unionByName(hubs.select("bucket", F.col("hub").alias("node")))
        if pairs.isEmpty():
            continue
        seen, links = seen.unionByName(pairs.select("a", "b")), verified(pairs)
        if not links.isEmpty():
            edges = edges.unionByName(links)
            roots = components(edges)
    out = signed.join(classes, ["k1", "k2"], "left")
    out = out.join(roots, "node", "left")
    component = F.when(F.col("n_shingles") > 0, F.coalesce("root", "node")).otherwise(F.col("doc_id"))
    component = F.when(F.col("doc_id").isNull(), F.lit(None)).otherwise(component)
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op5_near_dup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir), percent=85, k=3)


QUERIES = {"op5_near_dup": op5_near_dup}
SQL: dict[str, str] = {}
