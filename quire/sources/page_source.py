"""The pages of a folder's files as a data source: ``spark.read.format("quire_pages").load(folder)``.

Rows are those of files.read_pages(). Small files share a task; a large PDF is dealt to several tasks, each of which opens it at random access and reads its share of the
pages, so neither the driver nor a worker holds a whole file. A file that cannot be read is one row with its error and no page.

Options: ``backend`` (a reader of files.READERS), ``extensions`` (comma-separated), ``rangeBytes`` (what one task reads, about), ``sources`` (a JSON list of the files that are
wanted), ``firstPage`` and ``lastPage``: files are chosen while the scan is planned, pages before their text is taken out. With ``pushdown`` "true" and spark.sql.python.filterPushdown.enabled,
filters on source and page do the same; but Spark 4.1 keeps what was pushed for all queries of one loaded DataFrame, so that is for loads that are read
once, and pages_of() asks by options.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from ..errors import CourseNotFound, ExtractionFailed
from ..functions import text as T
from . import files as S

NAME, RANGE_BYTES = "quire_pages", 32 << 20
SCHEMA = pa.schema([("source", pa.string()), ("page", pa.int64()), ("text", pa.string()), ("furniture", pa.list_(pa.string())), ("structured", pa.list_(pa.string())), ("error", pa.string())])


@dataclass
class Part:
    """The ``at``-th of ``of`` equal shares of a file's pages."""

    source: str
    path: str
    suffix: str
    at: int = 0
    of: int = 1


@dataclass
class Share(InputPartition):
    parts: list[Part] = field(default_factory=list)


def suffix_of(source: str) -> str:
    name = source.rpartition("/")[2]
    at = name.rfind(".")
    return name[at:].lower() if at > 0 else ""


def skipped(source: str) -> bool:
    """As T.is_skipped() says of a column."""
    return any(p.startswith(".") or p in T.TOOL_FOLDERS for p in source.split("/"))


class PageReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.folder, self.backend = options["path"], options.get("backend", "pypdf")
        if self.backend not in S.READERS:
            raise ValueError(f"unknown reader {self.backend!r}; one of {', '.join(sorted(S.READERS))}")
        self.extensions = T.extension_list(options.get("extensions", ",".join(S.SUPPORTED)))
        self.range_bytes = int(options.get("rangebytes", options.get("rangeBytes", RANGE_BYTES)))
        names, last = options.get("sources"), options.get("lastpage", options.get("lastPage"))
        self.names: set[str] | None = None if names is None else set(json.loads(names))
        self.first, self.last = int(options.get("firstpage", options.get("firstPage", 1))), None if last is None else int(last)

    def partitions(self) -> list[Share]:
        fs, root, scheme = S.file_system(self.folder)
        if fs.get_file_info(root).type != pyarrow.fs.FileType.Directory:
            raise CourseNotFound(f"no such folder: {self.folder}")
        shares, filled = [Share()], 0
        for info in sorted(fs.get_file_info(pyarrow.fs.FileSelector(root, recursive=True)), key=lambda i: i.path):
            source = info.path[len(root) :].lstrip("/")
            suffix = suffix_of(source)
            if info.type != pyarrow.fs.FileType.File or skipped(source) or suffix not in self.extensions or (self.names is not None and source not in self.names):
                continue
            of = max(1, -(-info.size // self.range_bytes)) if suffix == ".pdf" and self.backend == "pypdf" else 1
            for at in range(of):
                if shares[-1].parts and filled + info.size // of > self.range_bytes:
                    shares.append(Share())
                    filled = 0
                shares[-1].parts.append(Part(source, scheme + info.path, suffix, at, of))
                filled += info.size // of
        return shares

    def read(self, partition: Share) -> Iterator[pa.RecordBatch]:
        for part in partition.parts:
            try:
                for page in self._pages(part):
                    yield pa.RecordBatch.from_pylist([dict(zip(SCHEMA.names, (part.source, *page, None), strict=True))], schema=SCHEMA)
            except Exception as e:  # a reader may raise anything; the file becomes a failed row
                if part.at == 0:
                    yield pa.RecordBatch.from_pylist([{"source": part.source, "furniture": [], "structured": [], "error": f"{ExtractionFailed.__name__}: {type(e).__name__}: {e}"[:500]}], schema=SCHEMA)

    def _wanted(self, page: int) -> bool:
        return page >= self.first and (self.last is None or page <= self.last)

    def _pages(self, part: Part) -> Iterator[S.Page]:
        fs, path, _ = S.file_system(part.path)
        if part.suffix in S.TEXT_FORMATS:
            if self._wanted(1):
                with fs.open_input_stream(path) as f:
                    yield 1, f.read().decode("utf-8", "replace").replace("\r\n", "\n").replace("\r", "\n"), [], []
        elif self.backend == "pypdf":
            with fs.open_input_file(path) as f:
                yield from S.pypdf_pages(f, part.at, part.of, self._wanted)
        else:
            with fs.open_input_stream(path) as f:
                yield from (p for p in S.READERS[self.backend](f.read()) if self._wanted(p[0]))


class FilteringReader(PageReader):
    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        """Notes which files and pages are asked for; every filter is left to Spark too, as rows of errors have no page."""
        for f in filters:
            column, value = getattr(f, "attribute", None), getattr(f, "value", None)
            if column == ("source",) and isinstance(f, EqualTo | In):
                mine = set(value) if isinstance(f, In) else {value}
                self.names = mine if self.names is None else self.names & mine
            elif column == ("page",) and value is not None and isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual | LessThan | LessThanOrEqual):
                if not isinstance(f, LessThan | LessThanOrEqual):
                    self.first = max(self.first, value + isinstance(f, GreaterThan))
                if not isinstance(f, GreaterThan | GreaterThanOrEqual):
                    most = value - isinstance(f, LessThan)
                    self.last = most if self.last is None else min(self.last, most)
            yield f


class PageSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return S.PAGES

    def reader(self, schema) -> PageReader:  # noqa: ARG002
        options = dict(self.options)
        return (FilteringReader if options.get("pushdown") == "true" else PageReader)(options)


def pages_of(spark: SparkSession, folder: str, sources: list[str] | None = None, first: int = 1, last: int | None = None, **options: str) -> DataFrame:
    """The pages of a folder's files, or of some files, from page ``first`` to ``last``."""
    spark.dataSource.register(PageSource)
    wanted = {"firstPage": str(first)} | ({} if sources is None else {"sources": json.dumps(list(sources))}) | ({} if last is None else {"lastPage": str(last)})
    return spark.read.format(NAME).options(**options, **wanted).load(folder)
