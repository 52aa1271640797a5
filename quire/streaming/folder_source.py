"""The changes of a folder as a stream: ``spark.readStream.format("quire_folder")``, rows (source, path, suffix, change) with change added, changed or gone.

An offset names a snapshot, a listing of the folder (relative path, size, time of change) that is written under the option ``snapshots`` by the hash of what it holds.
A batch is the difference of two snapshots, so a batch that runs again is the same batch, and a file that was deleted is a row like any other.
Content is not read here: changed files are few, and whoever needs them reads them in the executors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from ..functions import text as T
from ..sources import files as S
from ..sources.page_source import skipped, suffix_of

NAME, CHANGES = "quire_folder", "source string, path string, suffix string, change string"
ROWS = 1000  # changes in a task
LISTING = pa.schema([("source", pa.string()), ("size", pa.int64()), ("changed", pa.int64())])


@dataclass
class Changes(InputPartition):
    rows: list[tuple[str, str, str, str]] = field(default_factory=list)


class FolderReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.folder, self.snapshots = options["path"], options["snapshots"]
        self.extensions = T.extension_list(options.get("extensions", ",".join(S.SUPPORTED)))

    def initialOffset(self) -> dict:  # noqa: N802
        return {"snapshot": ""}

    def latestOffset(self) -> dict:  # noqa: N802
        fs, root, _ = S.file_system(self.folder)
        rows = []
        for i in fs.get_file_info(pyarrow.fs.FileSelector(root, recursive=True, allow_not_found=True)):
            source = i.path[len(root) :].lstrip("/")
            if i.type == pyarrow.fs.FileType.File and not skipped(source) and suffix_of(source) in self.extensions:
                rows.append((source, i.size, i.mtime_ns or 0))
        rows.sort()
        name = hashlib.sha256(repr(rows).encode()).hexdigest()[:32]
        there, place, _ = S.file_system(self.snapshots)
        there.create_dir(place)
        final = f"{place}/{name}.parquet"
        if there.get_file_info(final).type == pyarrow.fs.FileType.NotFound:
            with there.open_output_stream(f"{final}.part") as out:
                pq.write_table(pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [(), (), ()], LISTING.types, strict=True)], schema=LISTING), out)
            there.move(f"{final}.part", final)
        return {"snapshot": name}

    def _listing(self, offset: dict) -> dict[str, tuple[int, int]]:
        if not offset["snapshot"]:
            return {}
        fs, place, _ = S.file_system(self.snapshots)
        with fs.open_input_file(f"{place}/{offset['snapshot']}.parquet") as f:
            t = pq.read_table(f)
        return dict(zip(t["source"].to_pylist(), zip(t["size"].to_pylist(), t["changed"].to_pylist(), strict=True), strict=True))

    def partitions(self, start: dict, end: dict) -> list[Changes]:
        before, after = self._listing(start), self._listing(end)
        _, root, scheme = S.file_system(self.folder)
        rows = [(s, f"{scheme}{root}/{s}", suffix_of(s), "added" if s not in before else "changed") for s in sorted(after) if after[s] != before.get(s)]
        rows += [(s, f"{scheme}{root}/{s}", suffix_of(s), "gone") for s in sorted(before) if s not in after]
        return [Changes(rows[a : a + ROWS]) for a in range(0, len(rows), ROWS)] or [Changes()]

    def read(self, partition: Changes) -> Iterator[tuple]:
        yield from partition.rows

    def commit(self, end: dict) -> None:
        """Snapshots before the one that is done with are of no more use."""
        fs, place, _ = S.file_system(self.snapshots)
        kept = f"{place}/{end['snapshot']}.parquet"
        done = fs.get_file_info(kept)
        for i in fs.get_file_info(pyarrow.fs.FileSelector(place)) if end["snapshot"] else []:
            if i.path.endswith(".parquet") and i.path != kept and (i.mtime_ns or 0) < (done.mtime_ns or 0):
                fs.delete_file(i.path)


class FolderSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return CHANGES

    def streamReader(self, schema) -> FolderReader:  # noqa: ARG002, N802
        return FolderReader(dict(self.options))


def folder_changes(spark: SparkSession, folder: str, snapshots: str, extensions: tuple[str, ...] = S.SUPPORTED) -> DataFrame:
    spark.dataSource.register(FolderSource)
    return spark.readStream.format(NAME).option("snapshots", snapshots).option("extensions", ",".join(extensions)).load(folder)
