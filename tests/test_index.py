import pytest

from quire.cli import App, main
from quire.errors import CourseNotFound, EmbeddingFailed, IndexMismatch, IndexMissing, NoDocuments
from quire.functions.text import extension_list, safe_name
from quire.settings import Settings
from quire.sources import files as SF
from quire.sources import models as M
from quire.sources.index import ChunkIndex

TEXT = "Gradient descent follows the slope of the loss downhill. It needs a step size and it may stop in a valley. "


@pytest.fixture
def course(tmp_path):
    root = tmp_path / "courses" / "ml"
    for name, body in {"a.txt": TEXT * 6, "week1/b.md": "Regularisation keeps weights small so that a model does not memorise. " * 8, "_c.txt": TEXT * 3, ".hid/x.txt": "no", "__MACOSX/y.txt": "no", "blank.txt": " \n", "d.PDF": "%PDF broken", "e.csv": "1,2"}.items():
        p = root / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(body)
    return Settings(courses_dir=str(tmp_path / "courses"), outputs_dir=str(tmp_path / "out"), index_dir=str(tmp_path / "index"), extensions=".txt,.md,.pdf")


class Chat:
    def __init__(self, *replies):
        self.replies, self.asked = list(replies), []

    def complete(self, messages, kind, on_token=None):
        self.asked.append((messages, kind))
        r = self.replies.pop(0)
        if isinstance(r, Exception):
            raise r
        return r


def test_find_and_count(spark, course, tmp_path):
    found = SF.find_documents(spark, course.course_dir("ml"), course.suffixes).collect()
    assert [r.source for r in found] == ["_c.txt", "a.txt", "blank.txt", "d.PDF", "week1/b.md"]
    assert [(r.suffix, r.files) for r in SF.count_ignored(spark, course.course_dir("ml"), course.suffixes).collect()] == [(".csv", 1)]
    assert SF.count_ignored(spark, tmp_path / "none").count() == 0
    with pytest.raises(CourseNotFound):
        SF.find_documents(spark, tmp_path / "none")
    with pytest.raises(NoDocuments):
        SF.find_documents(spark, course.course_dir("ml"), (".doc",))


def test_decoding(spark, tmp_path):
    (tmp_path / "x.txt").write_bytes(b"a\xffb\r\nc\rd")
    files = SF.with_content(spark, SF.find_documents(spark, tmp_path))
    assert SF.read_pages(files).first().text == "a�b\nc\nd"
    with pytest.raises(ValueError):
        SF.read_pages(files, "other")


def test_layout_pages():
    items = [(1, "page_header", "Unit 7"), (1, "text", "Body."), (3, "table", "|a|\n|b|"), (None, "text", "lost")]
    assert SF.gather_layout(items, 4) == [(1, "Unit 7\n\nBody.", ["Unit 7"], []), (2, "", [], []), (3, "|a|\n|b|", [], ["|a|", "|b|"]), (4, "", [], [])]


def test_life_of_an_index(spark, course, capsys):
    good = '{"questions": [{"topic": "GD", "question": "Why?", "answer": "Slope.", "source": "a.txt", "page": 2}, {"topic": " ", "question": "Q", "answer": "A", "source": "nowhere", "page": 1}]}'
    app = App(spark, course, M.HashEmbedder(16), Chat(ValueError("no schema"), "prose", good))
    with pytest.raises(IndexMissing):
        app.status("ml")
    out = app.ingest("ml")
    assert any("a.txt: indexed" in x for x in out) and any("blank.txt: failed" in x and "EmptyExtraction" in x for x in out) and any("d.PDF: failed" in x for x in out)
    again = app.ingest("ml")
    assert any("a.txt: cached" in x for x in again) and not any("indexed" in x for x in again)
    root = course.course_dir("ml")
    (root / "a.txt").write_text(TEXT * 12)
    (root / "_c.txt").unlink()
    changed = app.ingest("ml")
    assert any("a.txt: indexed" in x for x in changed) and any("_c.txt: removed" in x for x in changed)
    index = ChunkIndex.open(spark, course.index_path("ml"))
    assert {r.source for r in index.sources().collect()} == {"a.txt", "week1/b.md"}
    assert index.stats().first().consistent and index.document_hash("nope") is None and len(index.document_hash("a.txt")) == 64
    (root / "a.txt").write_text(" ")
    assert any("a.txt: failed (stale)" in x for x in app.ingest("ml"))
    assert app.search("ml", "step size of gradient descent", 2)[1].startswith("1.") and len(app.search("ml", "x", 2)) == 3
    assert app.topics("ml", 2, 4) and app.coverage("ml", 3) and app.coverage("ml", 2, "weights") and app.chunks("ml")
    assert any("1 x .csv" in x for x in app.inspect("ml", True)) and app.embed_check()[0] == "16 dimensions"
    made = app.mock("ml", 2)
    assert any("wrote" in x for x in made) and any("dropped nowhere p1" in x for x in made)
    paper, key = (course.output_path("ml", k).read_text() for k in ("mock_exam", "answers"))
    assert "**1.** Why?" in paper and "ml_answers.md" in paper and "a.txt**, page 1" in key
    assert index.remove(["a.txt"]) > 0 and index.document_hash("a.txt") is None
    with pytest.raises(IndexMismatch):
        ChunkIndex.open(spark, course.index_path("ml"), Settings(chunk_size=300).profile(16))
    assert main(["status", "ml"], app) == 0 and "documents 1" in capsys.readouterr().out
    assert main(["status", "zz"], app) == 1 and main([]) == 0


def test_stream_ingest(spark, course):
    from quire.streaming.ingest import stream_ingest

    index = ChunkIndex.open(spark, course.index_path("ml"), course.profile(16), create=True)
    root = course.course_dir("ml")

    def run():
        q = stream_ingest(spark, str(root), index, M.HashEmbedder(16), course, str(root.parent.parent / "ck"))
        q.awaitTermination(120)
        assert q.exception() is None
        return {r.source: r.chunks for r in index.sources().collect()}

    first = run()
    assert set(first) == {"_c.txt", "a.txt", "week1/b.md"} and run() == first
    (root / "_c.txt").unlink()  # nothing but a deletion
    assert set(run()) == {"a.txt", "week1/b.md"}
    (root / "n.txt").write_text(TEXT * 4)
    (root / "a.txt").write_text(TEXT * 40)
    (root / "week1/b.md").unlink()
    last = run()
    assert set(last) == {"a.txt", "n.txt"} and last["a.txt"] > first["a.txt"]


def test_folder_snapshots(tmp_path):
    from quire.streaming.folder_source import FolderReader

    root = tmp_path / "f"
    root.mkdir()
    (root / "a.txt").write_text("1")
    (root / "skip.csv").write_text("1")
    reader = FolderReader({"path": str(root), "snapshots": str(tmp_path / "s"), "extensions": ".txt"})
    told = lambda a, b: [(r[0], r[3]) for p in reader.partitions(a, b) for r in reader.read(p)]
    zero, one = reader.initialOffset(), reader.latestOffset()
    assert reader.latestOffset() == one and told(zero, one) == [("a.txt", "added")] and told(one, one) == []
    (root / "b.txt").write_text("2")
    (root / "a.txt").write_text("22")
    two = reader.latestOffset()
    assert told(one, two) == [("a.txt", "changed"), ("b.txt", "added")] and told(two, one) == [("a.txt", "changed"), ("b.txt", "gone")]
    (root / "b.txt").unlink()
    three = reader.latestOffset()
    assert told(two, three) == [("b.txt", "gone")] and told(zero, two) == [("a.txt", "added"), ("b.txt", "added")]
    reader.commit(three)
    assert told(three, three) == [] and len(list((tmp_path / "s").iterdir())) == 1


ROW = "source string, chunk_index long, id string, text string, page long, page_end long, section string, embedding array<float>"


def chunk_rows(spark, names, n, text="t"):
    return spark.createDataFrame([(s, c, f"{s}{c}", text, 1, None, None, [1.0]) for s in names for c in range(n)], ROW)


def hashes(spark, names):
    return spark.createDataFrame([(s, "h" + s, s) for s in names], "source string, hash string, rank string")


def written(path):
    return {str(p.relative_to(path)): p.stat().st_size for p in path.rglob("*.parquet")}


def test_removal_writes_bitmaps_only(spark, tmp_path):
    index = ChunkIndex.open(spark, str(tmp_path / "i"), {}, create=True)
    index.replace(chunk_rows(spark, "abcdefghij", 200), hashes(spark, "abcdefghij"))
    before = written(tmp_path / "i")
    assert index.remove(["c"]) == 200 and index.remove(["c", "nobody"]) == 0
    new = {p: n for p, n in written(tmp_path / "i").items() if p not in before}
    assert new and all(p.startswith("bitmaps/") for p in new) and sum(new.values()) < 20_000
    assert set(before) - set(written(tmp_path / "i")) == {p for p in before if p.startswith("staged/")}
    assert {r.source: r.chunks for r in index.sources().collect()} == dict.fromkeys("abdefghij", 200) and index.documents().count() == 9
    assert index.document_hash("c") is None and [r.source for r in index.documents().orderBy("ordinal").collect()] == list("abdefghij")


def test_any_changes_equal_a_rebuild(spark, tmp_path, monkeypatch):
    """Changes at random, with small limits so that every rule of compaction fires, leave what a plain dictionary holds."""
    import random

    from quire.sources import index as I

    monkeypatch.setattr(I, "SEGMENTS", 3)
    monkeypatch.setattr(I, "FILE_ROWS", 4)
    monkeypatch.setattr(I, "BITMAPS", 3)
    rng, index, want = random.Random(5), ChunkIndex.open(spark, str(tmp_path / "i"), {}, create=True), {}
    for step in range(6):
        names = rng.sample("abcdefgh", 3)
        if step % 3 == 2:
            n = sum(want.pop(x)[0] for x in names if x in want)
            assert index.remove(names) == n
        else:
            size = rng.randint(1, 6)
            index.replace(chunk_rows(spark, names, size, f"step {step}"), hashes(spark, names))
            for x in sorted(names):
                want.pop(x, None)
                want[x] = size, f"step {step}"
        got = {}
        for r in index.chunks().collect():
            got.setdefault(r.source, []).append(r.text)
        assert {x: (len(t), t[0]) for x, t in got.items()} == want and all(len(set(t)) == 1 for t in got.values())
        assert [r.source for r in index.documents().orderBy("ordinal").collect()] == list(want)
        assert [(r.source, r.place) for r in index.places().orderBy("place").collect()] == list(zip(want, range(1, len(want) + 1), strict=True))
        m = index._manifest()
        assert sum(s["chunks"] - s["gone_chunks"] for s in m["segments"]) == index.chunks().count() == sum(n for n, _ in want.values())
    index.compact()
    m = index._manifest()
    assert len(m["segments"]) == 1 and not m["bitmaps"] and index.chunks().count() == sum(n for n, _ in want.values()) and index.candidates().select("ord").distinct().count() == index.chunks().count()


def test_rules_of_compaction():
    from quire.sources import index as I

    seg = lambda i, chunks, gone=0, docs=10, gone_docs=0: {"id": i, "documents": docs, "chunks": chunks, "gone_documents": gone_docs, "gone_chunks": gone}
    assert I.to_compact([seg("a", 1000), seg("b", 100, 26, gone_docs=3), seg("c", 100, 25, gone_docs=3), seg("d", 9, 9, 1, 1)], 5) == ["b", "d"]
    assert I.to_compact([seg(str(i), 100 + i) for i in range(8)] + [seg("x", 9000)], 0) == [str(i) for i in range(8)]
    assert I.to_compact([seg("a", 10**6, 9, gone_docs=1), seg("b", 10**6, 99, gone_docs=2), seg("c", 10**6)], I.BITMAPS + 1) == ["b"]


def test_writers_that_were_overtaken(spark, tmp_path):
    """They change nothing; and what a change replaces is deleted by the one after it."""
    from quire.errors import IndexConflict

    index = ChunkIndex.open(spark, str(tmp_path / "i"), {}, create=True)
    index.replace(chunk_rows(spark, "ab", 3), hashes(spark, "ab"))
    index.replace(chunk_rows(spark, "ab", 4), hashes(spark, "ab"))
    late = index._manifest()
    gone = [p.removeprefix("file:") for p in late["stale"]]
    assert gone and index.chunks().count() == 8
    index.replace(chunk_rows(spark, "c", 2), hashes(spark, "c"))
    assert not any(__import__("os").path.exists(p) for p in gone)
    with pytest.raises(IndexConflict):
        index._commit(late)
    assert index.chunks().count() == 10 and index.stats().first().documents == 3


def test_documents_of_many_chunks_spread(spark, tmp_path, monkeypatch):
    from quire.sources import index as I

    monkeypatch.setattr(I, "FILE_ROWS", 100)
    index = ChunkIndex.open(spark, str(tmp_path / "i"), {}, create=True)
    index.replace(chunk_rows(spark, "z", 1000), hashes(spark, "z"))
    assert len([p for p in written(tmp_path / "i") if "/chunks/" in p]) >= 8


def test_rebuild(spark, course):
    app = App(spark, course, M.HashEmbedder(16), Chat())
    app.ingest("ml")
    assert main(["ingest", "ml", "--rebuild"], app) == 0 and any("a.txt: cached" in x for x in app.ingest("ml"))


def test_progress_grows_and_force_embeds_again(spark, tmp_path):
    import time

    class Slow(M.HashEmbedder):
        def request(self, texts):
            time.sleep(0.9)
            return super().request(texts)

    root = tmp_path / "c" / "x"
    root.mkdir(parents=True)
    for i in range(12):
        (root / f"{i}.txt").write_text(f"Text {i}. " + TEXT * 12)
    app = App(spark, Settings(courses_dir=str(tmp_path / "c"), index_dir=str(tmp_path / "i"), extensions=".txt"), Slow(16))
    seen = []
    lines = app.ingest("x", show=lambda files, chunks: seen.append((files, chunks)))
    total = sum(int(x.rsplit(", ", 1)[1].split()[0]) for x in lines if ": indexed, " in x)
    assert seen == sorted(seen) and seen[-1] == (12, total) and len({c for _, c in seen}) > 2, seen
    assert all("cached" in x for x in app.ingest("x", show=lambda *n: None) if x.startswith("1.txt"))
    again = []
    assert any("1.txt: indexed" in x for x in app.ingest("x", force=True, show=lambda *n: again.append(n))) and again[-1] == (12, total)
    index = ChunkIndex.open(spark, app.settings.index_path("x"))
    assert index.chunks().count() == total and index.documents().count() == 12


def test_what_cleaning_removed_is_shown(spark, tmp_path):
    root = tmp_path / "c" / "x"
    root.mkdir(parents=True)
    (root / "a.txt").write_text("A sentence that stays.\n" + "\n".join(["age", "income", "high risk", "low risk", "north", "south", "age"]))
    app = App(spark, Settings(courses_dir=str(tmp_path / "c"), extensions=".txt"), M.HashEmbedder(16))
    lines = app.inspect("x", True)
    assert "a.txt p1 figure-debris: 'age' x 2" in lines and "a.txt p1 figure-debris: 'north'" in lines


def test_env_file(tmp_path, monkeypatch):
    (tmp_path / ".env").write_text("# a comment\nTOP_K=7\nexport LLM_MODEL='one'\nEMBED_BASE_URL = http://h:1/v1\nbroken\nCHUNK_SIZE=300\n")
    monkeypatch.setenv("TOP_K", "9")
    s = Settings.from_environment(tmp_path / ".env")
    assert (s.top_k, s.chunk_size, s.llm.model, s.embed.base_url) == (9, 300, "one", "http://h:1/v1")


def test_embed_check_tells_weak_models(spark, course):
    class Good:
        def request(self, texts):
            return [[1.0, 0.1] if any(w in t for w in ("model", "modèle")) else [0.1, 1.0] for t in texts]

    assert App(spark, course, Good()).embed_check()[-1].startswith("ok") and App(spark, course, M.HashEmbedder(4)).embed_check()[0] == "4 dimensions"


def test_embedding_retries():
    class Flaky:
        n = 0

        def request(self, texts):
            self.n += 1
            if self.n < 3:
                raise OSError("down")
            return [[1.0]] * len(texts)

    slept = []
    assert M.embed_batch(Flaky(), ["a"], slept.append) == [[1.0]] and slept == [1.5, 3.0]

    class Short:
        def request(self, texts):
            return []

    with pytest.raises(EmbeddingFailed):
        M.embed_batch(Short(), ["a"])


def test_names_and_settings():
    assert safe_name(" a b/c ") == "a_b_c" and extension_list(" .PDF, ,.md") == (".pdf", ".md")
    for bad in ("", "..", " "):
        with pytest.raises(ValueError):
            safe_name(bad)
    for kw in ({"chunk_overlap": 250}, {"chunk_size": 10}, {"temperature": 3}, {"pdf_backend": "x"}):
        with pytest.raises(ValueError):
            Settings(**kw)


def test_stream_parts():
    part = lambda **d: {"choices": [{"delta": d}]}
    seen = []
    assert M.collect_stream([{"choices": []}, part(reasoning="hm"), part(content="a"), part(content="b")], lambda *x: seen.append(x)) == "ab"
    assert seen == [(0, 1), (1, 1), (2, 1)]


def test_changes_shuffle_texts_twice(spark, tmp_path):
    """A change moves its texts to the vectors and to their files, and no more: not to count chunks, nor to number them, nor to hash them."""
    import numpy as np

    from quire.plans import store_queries as Q

    rng = np.random.default_rng(5)
    text = [rng.integers(33, 127, 20_000, dtype=np.uint8).tobytes().decode() for _ in range(300)]
    spark.createDataFrame(list(enumerate(text)), "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, [float(i), 1.0]) for i in range(0, 300, 2)], "vec_id long, embedding array<float>").repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")

    def shuffled():
        gateway = spark.sparkContext._gateway
        stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
        return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))

    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = shuffled()
        assert Q.QUERIES["index_changes"](spark, str(tmp_path)).count() == 2 * sum((i % 2 == 0 or i % 3 == 0) and i % 5 != 0 for i in range(300))
        moved = (shuffled() - before) / sum(map(len, text))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    assert moved < 2.4, moved  # 2 * (1/2 + 1/3), and 1/3 of the segment that is compacted
