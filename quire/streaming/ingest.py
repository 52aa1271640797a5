"""Ingestion as a stream: what changes in a folder goes through the same steps, batch by batch; what is deleted leaves the index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..plans.ingest import ingest_files
from ..settings import Settings
from ..sources import files as S
from ..sources.index import ChunkIndex
from .folder_source import folder_changes


def stream_ingest(spark: SparkSession, directory: str, index: ChunkIndex, model, settings: Settings, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Keep an index up to date with the files that ingest() takes. A batch that runs again after a failure finds its hashes in the index and changes nothing.

    A batch is the difference of two snapshots of the folder, so deletions are seen whether or not a new file comes.
    """

    def batch(changes: DataFrame, _: int) -> None:
        gone = changes.filter("change = 'gone'").select("source")
        there = changes.filter("change <> 'gone'").select("source", "path", "suffix")
        if not there.isEmpty():
            ingest_files(spark, S.with_content(spark, there), index, model, settings)
        index.remove(gone)

    changes = folder_changes(spark, directory, f"{checkpoint.rstrip('/')}/snapshots", settings.suffixes)
    writer = changes.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="30 seconds")).start()
