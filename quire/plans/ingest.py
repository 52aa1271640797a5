"""From files to an index: read, clean, chunk, embed, and replace what changed, in one change of the index."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import EmptyExtraction
from ..operators.chunking import chunk_documents
from ..operators.pages import clean_pages, with_content
from ..settings import Settings
from ..sources import files as S
from ..sources.index import ChunkIndex, incremental_status
from ..sources.models import embed


@dataclass
class Report:
    """outcomes: (source, status, chunks, detail) with status indexed, cached, failed, failed (stale) or removed."""

    outcomes: DataFrame
    seconds: float

    def count(self, status: str) -> int:
        return self.outcomes.filter(F.col("status") == status).count()

    def failed(self) -> DataFrame:
        return self.outcomes.filter(F.col("status").startswith("failed"))

    def totals(self) -> DataFrame:
        return self.outcomes.groupBy("status").agg(F.count(F.lit(1)).alias("files"), F.sum("chunks").alias("chunks"))


class Progress:
    """Counts of files read and chunks embedded, which grow as tasks end in the executors; ``show`` gets them on the driver, every ``pause`` seconds in which they changed."""

    def __init__(self, spark: SparkSession, show: Callable[[int, int], None], pause: float = 1.0):
        self.files, self.chunks = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)
        self.show, self.pause = show, pause

    @contextmanager
    def watched(self) -> Iterator[None]:
        over, last = threading.Event(), None

        def look() -> None:
            nonlocal last
            now = self.files.value, self.chunks.value
            if now != last:
                last = now
                self.show(*now)

        def watch() -> None:
            while not over.wait(self.pause):
                look()

        thread = threading.Thread(target=watch, daemon=True)
        thread.start()
        try:
            yield
        finally:
            over.set()
            thread.join()
            look()


def ingest_files(spark: SparkSession, files: DataFrame, index: ChunkIndex, model, settings: Settings, prune: bool = False, force: bool = False, progress: Progress | None = None) -> Report:
    """Ingest ``files`` (source, path, suffix, content, hash). A file that cannot be read fails alone and keeps its old chunks.

    prune: documents of the index that are not among the files are removed. force: files are read, cleaned and embedded again although their content is the same.
    Chunks and vectors are written beside the index before the change that takes them in, so a lost executor asks the model for nothing twice.
    """
    began = time.time()
    files = files.persist()
    stored = index.documents().select("source", "hash")
    status = incremental_status(files, stored)
    if force:
        status = status.withColumn("status", F.when(F.col("status") == "cached", "changed").otherwise(F.col("status")))
    status = status.persist()
    todo = files.join(status.filter("status in ('new', 'changed')").select("source"), "source", "left_semi")
    raw = S.read_pages(todo, settings.pdf_backend).persist()
    good, empty = with_content(clean_pages(raw.filter("error is null").drop("error")))
    cut = chunk_documents(good, settings.chunk_size, settings.chunk_overlap)
    spread = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)  # requests are slow, however few the chunks
    chunks = index.staged(embed(cut.repartition(spread), model, done=progress and progress.chunks))
    sizes = chunks.groupBy("source").agg(F.count(F.lit(1)).alias("chunks")).persist()
    fresh = todo.join(sizes, "source", "left_semi").select("source", "hash").withColumn("rank", F.struct(F.lower("source"), F.col("source")))
    if not sizes.isEmpty():
        index.replace(chunks, fresh)
    faults = raw.filter("error is not null").select("source", F.col("error").alias("detail")).unionByName(empty.withColumn("detail", F.lit(f"{EmptyExtraction.__name__}: no text after cleaning")))
    faults = faults.groupBy("source").agg(F.min("detail").alias("detail"))
    done = status.join(sizes, "source", "left").join(faults, "source", "left")
    old = F.when(F.col("status") == "changed", "failed (stale)").otherwise("failed")
    final = F.when(F.col("status").isin("cached", "removed"), F.col("status")).when(F.col("chunks") > 0, "indexed").otherwise(old)
    detail = F.when(final.startswith("failed"), F.coalesce("detail", F.lit("no usable chunks")))
    outcomes = done.select("source", final.alias("status"), F.coalesce("chunks", F.lit(0)).alias("chunks"), detail.alias("detail"))
    told = index.report(outcomes if prune else outcomes.filter("status <> 'removed'"))
    if prune:
        index.remove(told.filter("status = 'removed'"))
    for x in (files, status, raw, sizes):
        x.unpersist()
    return Report(told.orderBy(F.lower("source")), time.time() - began)


def ingest(spark: SparkSession, directory: str, index: ChunkIndex, model, settings: Settings, force: bool = False, show: Callable[[int, int], None] | None = None) -> Report:
    """Ingest a folder; documents deleted on disk leave the index. show gets the numbers of files read and chunks embedded while they grow."""
    found = S.find_documents(spark, directory, settings.suffixes)
    progress = Progress(spark, show) if show else None
    files = S.with_content(spark, found, done=progress and progress.files)
    if progress is None:
        return ingest_files(spark, files, index, model, settings, prune=True, force=force)
    with progress.watched():
        return ingest_files(spark, files, index, model, settings, prune=True, force=force, progress=progress)
