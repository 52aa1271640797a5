"""The chunk index: segments of Parquet files, delete bitmaps, and numbered manifests that name what is in force.

A change never rewrites what is there. Documents that come or change are written as one new segment, sorted by source; the rows of documents that
changed or went are marked in bitmaps, by file and block of 32,768 rows, and readers leave marked rows out. So removing a document writes bitmaps alone, a few
kilobytes, and adding one writes its own chunks. A manifest of the next number, which only one writer can take, puts a change in force: readers see all of
it or nothing, and a writer that was overtaken fails and changes nothing.

Compaction keeps reading cheap. Segments of which too much is gone are rewritten; SEGMENTS segments of about one size are merged, so their number grows with
the logarithm of the chunks; and if there come to be over BITMAPS bitmaps, the segments with most of them are rewritten, so that all bitmaps together are small enough to send to
every task. What a change replaces is deleted by the change after it, so that readers of the manifest before have time. Vectors live in the
chunk rows.
"""

from __future__ import annotations

import json
import math
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import IndexConflict, IndexMismatch, IndexMissing

FILE_ROWS = 100_000
#: Segments of one size class (a class spans a factor of SEGMENTS) that are merged, the share of gone chunks at which a segment is rewritten, and the most bitmaps, of 4 KB each.
SEGMENTS, GONE_SHARE, BITMAPS = 8, 0.25, 8192
NAMED = 1000  # sources that a scan is asked for by name
CHUNKS = "source string, chunk_index long, id string, text string, page long, page_end long, section string, embedding array<float>, ordinal long"
DOCUMENTS = "source string, hash string, chunk_count long, indexed_at timestamp, ordinal long"
GONE = "kind string, segment string, file string, block long, bits binary"
SCHEMAS = {"chunks": CHUNKS, "documents": DOCUMENTS}
LARGEST_DOCUMENT = 24  # bits of a chunk's number in its document
IN_PARTITION = 33  # bits of a row's number in its partition, as monotonically_increasing_id() has it


class ChunkIndex:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark._jvm
        self._at = lambda p: jvm.org.apache.hadoop.fs.Path(p)
        self._fs = self._at(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    # -- life --

    @classmethod
    def open(cls, spark: SparkSession, path: str, profile: dict[str, str] | None = None, create: bool = False) -> ChunkIndex:
        """Open, or create with ``create``. With a profile, every key must equal the stored one; a key that is missing there differs."""
        self = cls(spark, path)
        if not self.exists():
            if not create:
                raise IndexMissing(f"no index at {path}")
            self._commit({"profile": profile or {}, "segments": [], "bitmaps": [], "blocks": 0, "version": 0, "stale": []})
        if profile is not None:
            stored = self.profile()
            if wrong := {k: (stored.get(k), v) for k, v in profile.items() if stored.get(k) != v}:
                raise IndexMismatch(wrong)
        return self

    def _manifests(self) -> list[str]:
        found = self._fs.globStatus(self._at(f"{self.path}/manifest-*.json")) or []
        return sorted(f.getPath().toString() for f in found)

    def exists(self) -> bool:
        return bool(self._manifests())

    def drop(self) -> None:
        self._fs.delete(self._at(self.path), True)

    def profile(self) -> dict[str, str]:
        return self._manifest()["profile"]

    def _manifest(self) -> dict:
        found = self._manifests()
        if not found:
            raise IndexMissing(f"no index at {self.path}")
        stream = self._fs.open(self._at(found[-1]))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _commit(self, manifest: dict) -> None:
        """Make ``manifest``, which holds the number of the one it was made from, the one in force. Only one writer can take the next number."""
        number = manifest["version"] + 1
        temp, final = f"{self.path}/part-{uuid.uuid4().hex}", f"{self.path}/manifest-{number:012d}.json"
        self._fs.mkdirs(self._at(self.path))
        out = self._fs.create(self._at(temp), True)
        out.write(bytearray(json.dumps(manifest | {"version": number}).encode()))
        out.close()
        place = self._at(final).toUri() if "://" in final else self._fs.getUri()
        context = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(place, self.spark._jsc.hadoopConfiguration())
        try:
            context.rename(self._at(temp), self._at(final), self.spark.sparkContext._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 0))
        except Py4JJavaError as e:
            self._fs.delete(self._at(temp), True)
            raise IndexConflict(f"{self.path}: another change came first") from e
        for old in self._manifests()[:-2]:
            self._fs.delete(self._at(old), False)

    # -- reading --

    def _located(self, kind: str, manifest: dict, segments: list[str] | None = None) -> DataFrame:
        """The rows in force, of all segments or some, with ``segment``, ``file`` and ``at``, their place in it."""
        names = [s["id"] for s in manifest["segments"]] if segments is None else segments
        if not names:
            return self.spark.createDataFrame([], f"{SCHEMAS[kind]}, segment string, file string, at long")
        rows = self.spark.read.schema(SCHEMAS[kind]).parquet(*[f"{self.path}/segments/{n}/{kind}" for n in names])
        segment = F.regexp_extract("_metadata.file_path", r"^.*/segments/([0-9a-f]+)/", 1)
        rows = rows.select("*", segment.alias("segment"), F.col("_metadata.file_name").alias("file"), (F.col("_metadata.row_index") + 1).alias("at"))
        if not manifest["bitmaps"]:
            return rows
        bits = self._bitmaps(manifest).filter((F.col("kind") == kind) & F.col("segment").isin(names)).select(F.col("file").alias("of"), "block", "bits")
        marked = rows.join(F.broadcast(bits), (F.col("file") == F.col("of")) & (F.bitmap_bucket_number("at") == F.col("block")), "left")  # BITMAPS rows at most
        return marked.filter(F.col("bits").isNull() | ~_marked(F.col("bits"), F.col("at"))).drop("of", "block", "bits")

    def _bitmaps(self, manifest: dict) -> DataFrame:
        """The bitmaps of all changes, one for each block of a file."""
        each = self.spark.read.schema(GONE).parquet(*manifest["bitmaps"])
        return each.groupBy("kind", "segment", "file", "block").agg(F.bitmap_or_agg("bits").alias("bits"))

    def chunks(self) -> DataFrame:
        """All chunks; order by ordinal for the order of ingestion."""
        return self._located("chunks", self._manifest()).drop("segment", "file", "at")

    def candidates(self) -> DataFrame:
        """Chunks as the selection operators take them: with ``ord``, the order of ingestion. Its own for each chunk while a document has less than 2**LARGEST_DOCUMENT."""
        return self.chunks().withColumn("ord", F.shiftleft("ordinal", LARGEST_DOCUMENT) + F.col("chunk_index"))

    def documents(self) -> DataFrame:
        return self._located("documents", self._manifest()).drop("segment", "file", "at")

    def places(self) -> DataFrame:
        """(source, place): 1, 2, 3, ... in the order of ingestion, among the documents in force."""
        table = self.staged(self.documents().orderBy("ordinal").select("source").withColumn("place", F.monotonically_increasing_id()))
        return self._numbered(table, 0).select("source", F.col("ordinal").alias("place"))

    def document_hash(self, source: str) -> str | None:
        row = self.documents().filter(F.col("source") == source).select("hash").first()
        return row[0] if row else None

    def sources(self) -> DataFrame:
        return source_counts(self.chunks())

    def stats(self) -> DataFrame:
        """One row: documents, chunks, vectors, whether the counts agree, and the profile."""
        return store_stats(self.documents(), self.chunks()).withColumn("profile", F.create_map(*[F.lit(x) for kv in sorted(self.profile().items()) for x in kv]) if self.profile() else F.create_map().cast("map<string,string>"))

    # -- changes --

    def staged(self, rows: DataFrame) -> DataFrame:
        """``rows`` written beside the index, so that what was paid for is not asked for again; deleted by the change after the next."""
        path = f"{self.path}/staged/{uuid.uuid4().hex}"
        rows.write.parquet(path)
        self._left = [*getattr(self, "_left", []), path]
        return self.spark.read.schema(rows.schema).parquet(path)

    def replace(self, chunks: DataFrame, hashes: DataFrame) -> None:
        """Put the chunks of the documents in ``hashes`` (source, hash, rank) in place of what the index has of them, as one change.

        Documents are numbered on by rank; a document without chunks is not taken in.
        """
        dim = self.profile().get("dimension")
        if dim and not chunks.filter(F.size("embedding") != int(dim)).isEmpty():
            raise IndexMismatch({"dimension": (dim, "other vectors")})
        manifest, stamp = self._manifest(), uuid.uuid4().hex
        top = self._located("documents", manifest).agg(F.coalesce(F.max("ordinal"), F.lit(0))).first()[0]
        counts = chunks.groupBy("source").agg(F.count(F.lit(1)).alias("chunk_count"))
        sorted_ = hashes.join(counts, "source").select("source", "hash", "chunk_count", "rank").orderBy("rank").drop("rank").withColumn("place", F.monotonically_increasing_id())
        order = self.staged(sorted_)
        new = self._numbered(order, top).select("source", "hash", "chunk_count", F.current_timestamp().alias("indexed_at"), "ordinal")
        documents = f"{self.path}/segments/{stamp}/documents"
        new.write.parquet(documents)
        new = self.spark.read.schema(DOCUMENTS).parquet(documents)
        rows = chunks.select("source", "chunk_index", "id", "text", "page", "page_end", "section", "embedding").join(new.select("source", "ordinal"), "source")
        made = self._segment(stamp, rows)
        gone = self._mark(manifest, hashes.select("source"), stamp)
        self._settle(manifest, gone, [made] if made["documents"] else [])

    def remove(self, sources: list[str] | DataFrame) -> int:
        """Delete documents (names, or a column ``source``); returns how many chunks went. Writes bitmaps only."""
        gone = sources.select("source") if isinstance(sources, DataFrame) else self.spark.createDataFrame([(s,) for s in sources], "source string")
        manifest = self._manifest()
        marks = self._mark(manifest, gone, uuid.uuid4().hex)
        if not marks["segments"]:
            return 0
        self._settle(manifest, marks, [])
        return sum(n for _, n in marks["segments"].values())

    def report(self, outcomes: DataFrame) -> DataFrame:
        """Write the outcomes of a change beside the index and read them back."""
        path = f"{self.path}/reports/{uuid.uuid4().hex}"
        outcomes.write.parquet(path)
        return self.spark.read.schema(outcomes.schema).parquet(path)

    def _numbered(self, order: DataFrame, top: int) -> DataFrame:
        """``order`` with ``ordinal`` from ``top`` + 1 by ``place``: a number within its partition, plus the rows of the partitions before."""
        part = F.shiftright("place", IN_PARTITION)
        sizes = order.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))  # a row for each partition of a sort
        before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        offsets = sizes.select(F.col("part").alias("of"), before.alias("before"))
        number = F.col("place").bitwiseAND(F.lit((1 << IN_PARTITION) - 1)) + F.col("before") + F.lit(top + 1)
        return order.join(offsets, part == F.col("of")).withColumn("ordinal", number.cast("long"))

    def _segment(self, stamp: str, rows: DataFrame) -> dict:
        """Write the chunks of a segment whose documents are written, sorted by source, so that a scan for few sources skips most row groups."""
        n, chunks = self.spark.read.schema(DOCUMENTS).parquet(f"{self.path}/segments/{stamp}/documents").agg(F.count(F.lit(1)), F.coalesce(F.sum("chunk_count"), F.lit(0))).first()
        files = max(1, -(-chunks // FILE_ROWS))
        placed = rows.repartitionByRange(files, "source", "chunk_index").sortWithinPartitions("source", "chunk_index")
        placed.select("source", "chunk_index", "id", "text", "page", "page_end", "section", "embedding", "ordinal").write.parquet(f"{self.path}/segments/{stamp}/chunks")
        return {"id": stamp, "documents": n, "chunks": chunks, "gone_documents": 0, "gone_chunks": 0}

    def _mark(self, manifest: dict, gone: DataFrame, stamp: str) -> dict:
        """Write bitmaps of all rows in force of the documents in ``gone``: their path, their number, and (documents, chunks) that went by segment."""
        doomed = self._located("documents", manifest).join(gone.select("source").distinct(), "source", "left_semi")
        by_segment = {r.segment: (r.documents, r.chunks) for r in doomed.groupBy("segment").agg(F.count(F.lit(1)).alias("documents"), F.sum("chunk_count").alias("chunks")).collect()}
        if not by_segment:
            return {"segments": {}, "path": None, "blocks": 0}
        names = [r.source for r in doomed.select("source").limit(NAMED + 1).collect()]
        rows = self._located("chunks", manifest, sorted(by_segment))
        mine = rows.filter(F.col("source").isin(names)) if len(names) <= NAMED else rows.join(doomed.select("source"), "source", "left_semi")
        places = doomed.select(F.lit("documents").alias("kind"), "segment", "file", "at").unionByName(mine.select(F.lit("chunks").alias("kind"), "segment", "file", "at"))
        bits = places.groupBy("kind", "segment", "file", F.bitmap_bucket_number("at").alias("block")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits"))
        path = f"{self.path}/bitmaps/{stamp}"
        bits.write.parquet(path)
        return {"segments": by_segment, "path": path, "blocks": self.spark.read.parquet(path).count()}

    def _settle(self, manifest: dict, gone: dict, made: list[dict]) -> None:
        """Put a change in force, then compact what has become due, as a change of its own."""
        for path in manifest["stale"]:
            self._fs.delete(self._at(path), True)
        segments = [s | {"gone_documents": s["gone_documents"] + d, "gone_chunks": s["gone_chunks"] + c} for s in manifest["segments"] for d, c in [gone["segments"].get(s["id"], (0, 0))]]
        bitmaps = [*manifest["bitmaps"], *([gone["path"]] if gone["path"] else [])]
        staged, self._left = getattr(self, "_left", []), []
        self._commit(manifest | {"segments": segments + made, "bitmaps": bitmaps, "blocks": manifest["blocks"] + gone["blocks"], "stale": staged})
        due = to_compact(segments + made, manifest["blocks"] + gone["blocks"])
        if due or len(bitmaps) >= SEGMENTS:
            try:
                self.compact(due)
            except IndexConflict:  # the change is in force; the writer that came first, or the next one, will compact
                pass

    def compact(self, names: list[str] | None = None) -> None:
        """Rewrite segments (all of them, if none are named) as one without what is gone, and gather the bitmaps of the others in one table."""
        manifest, stamp = self._manifest(), uuid.uuid4().hex
        names = [s["id"] for s in manifest["segments"]] if names is None else names
        stay = [s for s in manifest["segments"] if s["id"] not in names]
        made = []
        if any(s["documents"] > s["gone_documents"] for s in manifest["segments"] if s["id"] in names):
            left = {kind: self._located(kind, manifest, names).drop("segment", "file", "at") for kind in SCHEMAS}
            left["documents"].write.parquet(f"{self.path}/segments/{stamp}/documents")
            made = [self._segment(stamp, left["chunks"])]
        bitmaps, blocks = [], 0
        if manifest["bitmaps"] and any(s["gone_documents"] for s in stay):
            bitmaps = [f"{self.path}/bitmaps/{stamp}"]
            self._bitmaps(manifest).filter(F.col("segment").isin([s["id"] for s in stay])).write.parquet(bitmaps[0])
            blocks = self.spark.read.parquet(bitmaps[0]).count()
        stale = [*manifest["stale"], *(f"{self.path}/segments/{n}" for n in names), *manifest["bitmaps"]]
        self._commit(manifest | {"segments": stay + made, "bitmaps": bitmaps, "blocks": blocks, "stale": stale})


def to_compact(segments: list[dict], blocks: int) -> list[str]:
    """Segments that are due: of which over GONE_SHARE is gone, SEGMENTS of one size class, and the most marked ones while there are over BITMAPS bitmaps."""
    due = {s["id"] for s in segments if s["gone_documents"] == s["documents"] or s["gone_chunks"] > GONE_SHARE * s["chunks"]}
    classes: dict[int, list[str]] = {}
    for s in segments:
        if s["id"] not in due:
            classes.setdefault(int(math.log(max(1, s["chunks"] - s["gone_chunks"]), SEGMENTS)), []).append(s["id"])
    due |= {i for mine in classes.values() if len(mine) >= SEGMENTS for i in mine}
    if blocks > BITMAPS:
        marked = sorted((s for s in segments if s["id"] not in due and s["gone_documents"]), key=lambda s: -s["gone_chunks"])
        due |= {s["id"] for s in marked[: -(-len(marked) // 2)]}
    return [s["id"] for s in segments if s["id"] in due]


def _marked(bits: Column, at: Column) -> Column:
    """Whether a bitmap of bitmap_construct_agg() has the bit of row ``at``."""
    place = F.bitmap_bit_position(at)
    byte = F.conv(F.hex(F.substring(bits, (F.shiftright(place, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("long")
    return F.getbit(byte, F.pmod(place, F.lit(8)).cast("int")) == 1


def without(chunks: DataFrame, gone: DataFrame) -> DataFrame:
    """``chunks`` but for those of the documents in ``gone`` (source)."""
    return chunks.join(gone.select("source"), "source", "left_anti").select(*chunks.columns)


def upsert(old: DataFrame, new: DataFrame, *keys: str) -> DataFrame:
    """``old`` with the rows of ``new`` in place of those with equal keys."""
    return old.join(new.select(*keys), list(keys), "left_anti").unionByName(new.select(*old.columns))


def source_counts(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("source").agg(F.count(F.lit(1)).alias("chunks")).orderBy("source")


def store_stats(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    d = documents.agg(F.count(F.lit(1)).alias("documents"))
    c = chunks.agg(F.count(F.lit(1)).alias("chunks"), F.count("embedding").alias("vectors"))
    return d.crossJoin(c).withColumn("consistent", F.col("chunks") == F.col("vectors"))  # one row each


def incremental_status(found: DataFrame, stored: DataFrame) -> DataFrame:
    """(source, status) by content: new, changed, cached, or removed for what is stored but no longer found."""
    f, s = found.select("source", F.col("hash").alias("now")), stored.select("source", F.col("hash").alias("then"))
    status = F.when(F.col("now").isNull(), "removed").when(F.col("then").isNull(), "new").when(F.col("now") == F.col("then"), "cached").otherwise("changed")
    return f.join(s, "source", "full").select("source", status.alias("status"))
