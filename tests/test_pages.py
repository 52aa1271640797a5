"""Cleaning invariants whose breakage would be silent."""

import pytest
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import pages as P

PAGES = "source string, page long, text string, furniture array<string>, structured array<string>"
CELLS = ["age", "income", "high risk", "low risk", "12 34", "north", "south", "total"]


def pages(spark, *rows):
    return spark.createDataFrame([(s, n, t, list(f), list(c)) for s, n, t, f, c in rows], PAGES)


def texts(df):
    return [r.text for r in df.orderBy("page").collect()]


def test_page_numbers_survive(spark):
    out = P.clean_pages(pages(spark, ("a", 1, "One.", (), ()), ("a", 2, "  \n ", (), ()), ("a", 3, "Three.", (), ())))
    assert [(r.page, r.text) for r in out.orderBy("page").collect()] == [(1, "One."), (2, ""), (3, "Three.")]


def test_structured_lines_are_kept_and_loose_cells_go(spark):
    body = "\n".join(CELLS)
    assert texts(P.clean_pages(pages(spark, ("a", 1, body, (), CELLS)))) == [body]
    assert texts(P.clean_pages(pages(spark, ("a", 1, body, (), ())))) == [""]


def test_five_fragments_stay_and_a_blank_ends_a_run(spark):
    assert texts(P.clean_pages(pages(spark, ("a", 1, "\n".join(CELLS[:5]), (), ())))) == ["\n".join(CELLS[:5])]
    split = "\n".join(CELLS[:4]) + "\n\n" + "\n".join(CELLS[4:])
    assert texts(P.clean_pages(pages(spark, ("a", 1, split, (), ())))) == [split]


def test_labelled_furniture_beats_frequency(spark):
    body = ["Heading {0}\nA sentence of page {0}.\nCOMP1 notes".format(i) for i in range(3)]
    marked = pages(spark, *[("a", i, t, ("COMP1 notes",), ()) for i, t in enumerate(body, 1)])
    assert all("COMP1" not in t and "sentence" in t for t in texts(P.clean_pages(marked)))
    plain = pages(spark, *[("a", i, t, (), ()) for i, t in enumerate(body, 1)])
    assert all("COMP1" in t for t in texts(P.clean_pages(plain)))


def test_running_lines_and_page_numbers_need_four_pages(spark):
    rows = [("a", i, f"Unit 7\nText of page {i} goes on.\n{i} / 5", (), ()) for i in range(1, 6)] + [("b", i, f"Unit 7\nText {i}.\n{i}", (), ()) for i in range(1, 4)]
    df = pages(spark, *rows)
    assert [(r.source, r.line, r.pages) for r in P.running_lines(df).collect()] == [("a", "Unit 7", 5)]
    out = {(r.source, r.page): r.text for r in P.clean_pages(df).collect()}
    assert out["a", 2] == "Text of page 2 goes on." and out["b", 2] == "Unit 7\nText 2.\n2"
    report = {r.source: r for r in P.cleaning_report(df).collect()}
    assert report["a"].furniture == {"Unit 7": 5} and report["a"].page_number_lines == 5 and not report["a"].furniture_labelled
    assert all(r.numbers_preserved for r in report.values())
    assert P.margin(P.cleaning_report(df)).first().margin == 1.0


@pytest.mark.parametrize(
    "raw,clean",
    [("over-\nfitting", "overfitting"), ("éé-\nfitté", "ééfitté"), ("a-\r\nb", "ab"), ("a \t b", "a b"), ("x  \ny", "x\ny"), ("p\n\n\n\nq", "p\n\nq"), (" \xa0 t\x1c\n", "t"), ("", "")],
)
def test_clean_page(spark, raw, clean):
    assert spark.createDataFrame([(raw,)], "t string").select(T.clean_page("t")).first()[0] == clean


def test_lines_match_python(spark):
    raw = ["", "\n", "a", "a\n", "a\n\n", "a\r\nb\rc", "a\x0bb\x0cc\x1cd\x1de\x1ef\x85g h i", "\r\n"]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(raw)], "i int, t string").orderBy("i").select(T.lines("t")).collect()
    assert [r[0] for r in got] == [t.splitlines() for t in raw]


def test_line_rules(spark):
    rows = [("PAGE ３", "n"), ("4 / 20", "n"), ("12345", ""), ("• x", "b"), ("1) x", "b"), ("a. x", "b"), ("A. x", ""), ("-x", ""), ("| a | b |", "t"), ("|a", "")]
    df = spark.createDataFrame(rows, "t string, kind string")
    got = P.line_kinds(df, "t").select("kind", F.concat(F.when(F.col("page_number"), "n").otherwise(""), F.when(F.col("bullet"), "b").otherwise(""), F.when(F.col("table_row"), "t").otherwise("")).alias("got"))
    assert all(r.kind == r.got for r in got.collect())
    bullets = spark.createDataFrame(rows, "t string, kind string").select(T.is_bullet("t").alias("column"), (F.col("kind") == "b").alias("b"))
    assert all(r.column == r.b for r in bullets.collect())  # chunking judges by a column


def test_many_labelled_lines(spark, monkeypatch):
    """A document of 2,000 pages and 20,000 labelled lines is cleaned in seconds, its parts apart, with the result of a page by itself."""
    import time

    rows = [("a", i, f"Footer {i % 7}\nText of page {i} goes on.\n" + "\n".join(f"c{i}-{j}" for j in range(10)), (f"Footer {i % 7}",), [f"c{i}-{j}" for j in range(10)]) for i in range(1, 2001)]
    rows += [("b", i, f"Footer 1\nText {i}.\n" + "\n".join(CELLS), (), ()) for i in range(1, 3)]
    df = pages(spark, *rows).repartition(4).persist()
    df.count()
    began = time.time()
    out = {(r.source, r.page): r.text for r in P.clean_pages(df).collect()}
    assert time.time() - began < 30 and len(out) == 2002
    assert all(out["a", i] == f"Text of page {i} goes on.\n" + "\n".join(f"c{i}-{j}" for j in range(10)) for i in range(1, 2001))
    assert out["b", 1] == "Footer 1\nText 1."


def test_scanned_and_blank_documents(spark):
    df = pages(spark, ("a", 1, " ", (), ()), ("a", 2, "", (), ()), ("b", 1, "x" * 50, (), ()))
    assert {r.source: r.scanned for r in P.scanned(df).collect()} == {"a": True, "b": False}
    good, empty = P.with_content(df)
    assert [r.source for r in empty.collect()] == ["a"] and [r.source for r in good.collect()] == ["b"]


def test_empty_table(spark):
    df = spark.createDataFrame([], PAGES)
    assert P.clean_pages(df).count() == P.cleaning_report(df).count() == P.removals(df).count() == P.profile(df).count() == 0
