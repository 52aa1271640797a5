"""The page source and the PDF reader, with a PDF library made for the test: pages are parted by form feeds."""

import pytest
from pyspark.sql import functions as F

from quire.errors import CourseNotFound
from quire.sources import files as S
from quire.sources import page_source as P

LIBRARY = '''
class Page:
    def __init__(self, text):
        self.text = text

    def extract_text(self):
        if "UNREADABLE" in self.text:
            raise KeyError("/Contents")
        return self.text.replace("NONE", "") or None


class PdfReader:
    def __init__(self, stream):
        data = stream.read()
        if not data.startswith(b"%STUB"):
            raise ValueError("not a PDF")
        self.is_encrypted = data.startswith(b"%STUBLOCKED") or data.startswith(b"%STUBEMPTYKEY")
        self.open = not data.startswith(b"%STUBLOCKED")
        self.tried = not self.is_encrypted
        self.parts = data.decode().split("\\n", 1)[1].split("\\f")

    def decrypt(self, password):
        self.tried = password == ""

    @property
    def pages(self):
        if not (self.open and self.tried):
            raise PermissionError("locked")
        return [Page(p) for p in self.parts]
'''


@pytest.fixture(scope="module")
def library(spark, tmp_path_factory):
    place = tmp_path_factory.mktemp("library") / "pypdf.py"
    place.write_text(LIBRARY)
    spark.sparkContext.addPyFile(str(place))


@pytest.fixture
def folder(tmp_path):
    for name, body in {
        "a.txt": b"one\r\ntwo\xff", "b/n.md": b"# head", "b/long.pdf": b"%STUB\n" + b"\f".join(b"page %d" % i for i in range(1, 41)), "c.pdf": b"%STUB\nfirst\fNONE\fthird",
        "locked.pdf": b"%STUBLOCKED\nx", "key.pdf": b"%STUBEMPTYKEY\nopened", "broken.pdf": b"junk", "half.pdf": b"%STUB\ngood\fUNREADABLE", "x.csv": b"1", ".hid/q.txt": b"no", "node_modules/r.txt": b"no", "_u.txt": b"kept",
    }.items():
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(body)
    return str(tmp_path)


def rows(df):
    return sorted((r.source, r.page or 0, r.text, r.error.split(": ")[1] if r.error else None) for r in df.collect())


def test_pages_of_a_folder(spark, library, folder):
    got = rows(P.pages_of(spark, folder))
    assert [r for r in got if r[0] != "b/long.pdf"] == [
        ("_u.txt", 1, "kept", None), ("a.txt", 1, "one\ntwo�", None), ("b/n.md", 1, "# head", None), ("broken.pdf", 0, None, "ValueError"), ("c.pdf", 1, "first", None), ("c.pdf", 2, "", None), ("c.pdf", 3, "third", None),
        ("half.pdf", 0, None, "KeyError"), ("half.pdf", 1, "good", None), ("key.pdf", 1, "opened", None), ("locked.pdf", 0, None, "PermissionError"),
    ]
    assert [(p, t) for s, p, t, _ in got if s == "b/long.pdf"] == [(i, f"page {i}") for i in range(1, 41)]


def test_a_large_file_is_dealt_to_tasks(spark, library, folder):
    small = P.pages_of(spark, folder, rangeBytes="64")
    parts = small.filter("source = 'b/long.pdf'").withColumn("task", F.spark_partition_id())
    assert parts.select("task").distinct().count() >= 5 and rows(small) == rows(P.pages_of(spark, folder))


def test_filters_choose_files_and_pages():
    reader = P.FilteringReader({"path": "/", "backend": "pypdf"})
    left = list(reader.pushFilters([P.In(("source",), ("a", "b")), P.EqualTo(("source",), "b"), P.GreaterThan(("page",), 3), P.LessThanOrEqual(("page",), 9), P.LessThan(("page",), 9), P.EqualTo(("text",), "t")]))
    assert len(left) == 6 and reader.names == {"b"} and (reader.first, reader.last) == (4, 8)
    with pytest.raises(ValueError):
        P.PageReader({"path": "/", "backend": "other"})


def test_files_and_pages_are_chosen_before_they_are_read(spark, library, folder, tmp_path):
    """A page that is not asked for is not read: the one that cannot be does no harm."""
    assert rows(P.pages_of(spark, folder, ["half.pdf"], last=1)) == [("half.pdf", 1, "good", None)]
    assert rows(P.pages_of(spark, folder, ["c.pdf", "a.txt"], 2, 3)) == [("c.pdf", 2, "", None), ("c.pdf", 3, "third", None)]
    assert rows(P.pages_of(spark, folder, [])) == []
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        assert rows(P.pages_of(spark, folder, pushdown="true").filter("source = 'half.pdf' and page = 1")) == [("half.pdf", 1, "good", None)]
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    with pytest.raises(Exception, match=CourseNotFound.__name__):
        P.pages_of(spark, str(tmp_path / "none")).collect()


def test_the_file_reader_gives_the_same(spark, library, folder):
    """read_pages(), which ingestion uses, from the same files."""
    files = S.with_content(spark, S.find_documents(spark, folder))
    got = rows(S.read_pages(files))
    assert [r for r in got if r[0] != "half.pdf"] == [r for r in rows(P.pages_of(spark, folder)) if r[0] != "half.pdf"]
    assert [r for r in got if r[0] == "half.pdf"] == [("half.pdf", 0, None, "KeyError")]
