"""Files of a course as DataFrames: discovery, hashes, and pages by reader.

Folders and files are read by the executors through Arrow's file systems, so a folder may be local or a URI that all executors
reach. Spark's own lister would hide names that begin with an underscore. The driver lists the top folder only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import CourseNotFound, ExtractionFailed, NoDocuments, UnsupportedFormat
from ..functions import text as T

SUPPORTED = (".pdf", ".md", ".markdown", ".txt")
TEXT_FORMATS = (".md", ".markdown", ".txt")
PAGES = "source string, page long, text string, furniture array<string>, structured array<string>, error string"
Page = tuple[int, str, list[str], list[str]]


def file_system(place: str | Path) -> tuple[pyarrow.fs.FileSystem, str, str]:
    """(file system, path in it, what a path is to be preceded by to name a file anywhere) of a local path or URI."""
    uri = str(place) if "://" in str(place) else str(Path(place).absolute())
    fs, path = pyarrow.fs.FileSystem.from_uri(uri)
    path = path.rstrip("/") or "/"
    return fs, path, uri.rstrip("/").removesuffix(path) if "://" in uri else ""


def is_folder(place: str | Path) -> bool:
    fs, path, _ = file_system(place)
    return fs.get_file_info(path).type == pyarrow.fs.FileType.Directory


def list_files(spark: SparkSession, directory: str | Path) -> DataFrame:
    """(source, path, suffix): all files below, without hidden and tool folders; source is the relative path."""
    fs, root, scheme = file_system(directory)
    uri = scheme + root
    folder = pyarrow.fs.FileType.Directory

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, _, _ = file_system(uri)
        for b in batches:
            for path, is_dir in zip(*b.to_pydict().values(), strict=True):
                found = [i.path for i in here.get_file_info(pyarrow.fs.FileSelector(path, recursive=True)) if i.type == pyarrow.fs.FileType.File] if is_dir else [path]
                yield pa.RecordBatch.from_arrays([pa.array([p[len(root) :].lstrip("/") for p in found], pa.string()), pa.array([scheme + p for p in found], pa.string())], names=["source", "path"])

    top = [(i.path, i.type == folder) for i in fs.get_file_info(pyarrow.fs.FileSelector(root))]
    entries = spark.createDataFrame(top, "path string, folder boolean").repartition(max(1, min(len(top), 1000)))
    return entries.mapInArrow(walk, "source string, path string").filter(~T.is_skipped("source")).withColumn("suffix", T.extension("source"))


def wanted(extensions: tuple[str, ...]):
    return F.col("suffix").isin(*[e.lower() for e in extensions])


def find_documents(spark: SparkSession, directory: str | Path, extensions: tuple[str, ...] = SUPPORTED) -> DataFrame:
    """(source, path, suffix) of files with a wanted extension, in the order of the lower-cased relative path."""
    if not is_folder(directory):
        raise CourseNotFound(f"no such folder: {directory}")
    found = list_files(spark, directory).filter(wanted(extensions))
    if found.isEmpty():
        raise NoDocuments(f"{directory}: no file ends in {', '.join(extensions)}")
    return found.orderBy(F.lower("source"))


def ignored(files: DataFrame, extensions: tuple[str, ...] = SUPPORTED) -> DataFrame:
    """(suffix, files) of files that have an extension that is not wanted."""
    return files.filter((F.col("suffix") != "") & ~wanted(extensions)).groupBy("suffix").agg(F.count(F.lit(1)).alias("files"))


def count_ignored(spark: SparkSession, directory: str | Path, extensions: tuple[str, ...] = SUPPORTED) -> DataFrame:
    if not is_folder(directory):
        return spark.createDataFrame([], "suffix string, files long")
    return ignored(list_files(spark, directory), extensions).orderBy("suffix")


def with_hash(files: DataFrame) -> DataFrame:
    """``files`` with the SHA-256 of their ``content`` as ``hash``."""
    return files.withColumn("hash", F.sha2("content", 256))


def with_content(spark: SparkSession, files: DataFrame, done=None) -> DataFrame:
    """``files`` with their bytes as ``content`` and the hash of them; one file is in a worker's memory at a time. done: an accumulator that counts files as tasks end."""

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                fs, path, _ = file_system(r["path"])
                with fs.open_input_stream(path) as f:
                    yield pa.RecordBatch.from_pylist([r | {"content": f.read()}])
                if done is not None:
                    done.add(1)

    return with_hash(files.select("source", "path", "suffix").mapInArrow(load, "source string, path string, suffix string, content binary"))


def decoded(content) -> F.Column:
    """Bytes as text: invalid UTF-8 becomes U+FFFD, CRLF and CR become LF."""
    return F.regexp_replace(F.make_valid_utf8(F.col(content).cast("string")), "\r\n?", "\n")


def pypdf_pages(stream, at: int = 0, of: int = 1, wanted: Callable[[int], bool] = lambda page: True) -> Iterator[Page]:
    """The wanted pages of the ``at``-th of ``of`` equal shares, numbered from 1 in the file; an empty password is tried."""
    from pypdf import PdfReader

    reader = PdfReader(stream)
    if reader.is_encrypted:
        reader.decrypt("")
    n = len(reader.pages)
    for i in range(n * at // of, n * (at + 1) // of):
        if wanted(i + 1):
            yield i + 1, reader.pages[i].extract_text() or "", [], []


def read_pypdf(content: bytes) -> list[Page]:
    """Text page by page."""
    import io

    return list(pypdf_pages(io.BytesIO(content)))


_converters: dict[bool, object] = {}
FURNITURE_LABELS = ("page_header", "page_footer")


def gather_layout(items: list[tuple[int | None, str, str]], n_pages: int) -> list[Page]:
    """Pages from (page, label, text) items: items joined by empty lines, lines of headers and footers labelled, lines of all but plain text structured; missing pages are empty."""
    text: dict[int, list[str]] = {}
    marks: dict[int, tuple[list[str], list[str]]] = {}
    for page, label, body in items:
        if page is None or not body:
            continue
        text.setdefault(page, []).append(body)
        lines = [x.strip() for x in body.splitlines() if x.strip()]
        furniture, structured = marks.setdefault(page, ([], []))
        if label in FURNITURE_LABELS:
            furniture += lines
        elif label != "text":
            structured += lines
    last = max([n_pages, *text], default=0)
    return [(n, "\n\n".join(text.get(n, [])), *marks.get(n, ([], []))) for n in range(1, last + 1)]


def read_docling(content: bytes, formulas: bool = False) -> list[Page]:
    """Layout-aware reading; one converter a worker, without character recognition."""
    import io

    from docling.datamodel.base_models import DocumentStream, InputFormat
    from docling.datamodel.pipeline_options import PdfPipelineOptions
    from docling.document_converter import DocumentConverter, PdfFormatOption

    if formulas not in _converters:
        options = PdfPipelineOptions(do_ocr=False, do_formula_enrichment=formulas)
        _converters[formulas] = DocumentConverter(format_options={InputFormat.PDF: PdfFormatOption(pipeline_options=options)})
    document = _converters[formulas].convert(DocumentStream(name="file.pdf", stream=io.BytesIO(content))).document

    def body(item) -> str:
        table = getattr(item, "export_to_markdown", None)
        return (table(document) if table and "table" in str(item.label) else getattr(item, "text", "") or "").strip()

    items = [((item.prov[0].page_no if getattr(item, "prov", None) else None), str(getattr(item.label, "value", item.label)), body(item)) for item, _ in document.iterate_items()]
    return gather_layout(items, len(getattr(document, "pages", ())))


READERS: dict[str, Callable[[bytes], list[Page]]] = {"pypdf": read_pypdf, "docling": read_docling, "docling+formula": lambda c: read_docling(c, True)}


def read_pages(files: DataFrame, backend: str = "pypdf") -> DataFrame:
    """Raw pages (source, page, text, furniture, structured, error) of ``files`` with content. A file that fails is one row with its error and no page."""
    if backend not in READERS:
        raise ValueError(f"unknown reader {backend!r}; one of {', '.join(sorted(READERS))}")
    reader = READERS[backend]
    none = F.array().cast("array<string>")
    plain = files.filter(F.col("suffix").isin(*TEXT_FORMATS)).select("source", F.lit(1).cast("long").alias("page"), decoded("content").alias("text"), none.alias("furniture"), none.alias("structured"), F.lit(None).cast("string").alias("error"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("source", pa.string()), ("page", pa.int64()), ("text", pa.string()), ("furniture", pa.list_(pa.string())), ("structured", pa.list_(pa.string())), ("error", pa.string())])
        for b in batches:
            for r in b.to_pylist():
                try:
                    rows = [(r["source"], *p, None) for p in reader(r["content"])]
                except Exception as e:  # a reader may raise anything; the file becomes a failed row
                    rows = [(r["source"], None, None, [], [], f"{ExtractionFailed.__name__}: {type(e).__name__}: {e}"[:500])]
                yield pa.RecordBatch.from_pylist([dict(zip(schema.names, x, strict=True)) for x in rows], schema=schema)

    pdf = files.filter(F.col("suffix") == ".pdf").select("source", "content").mapInArrow(read, PAGES)
    other = files.filter(~F.col("suffix").isin(*SUPPORTED)).select("source", F.lit(None).cast("long").alias("page"), F.lit(None).cast("string").alias("text"), none.alias("furniture"), none.alias("structured"), F.concat(F.lit(f"{UnsupportedFormat.__name__}: "), "suffix").alias("error"))
    return plain.unionByName(pdf).unionByName(other)
