"""Command line: inspect, chunks, ingest, search, mock, topics, coverage, status, embed-check."""

from __future__ import annotations

import argparse
import sys
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import EmptyExtraction, QuireError
from .functions import text as T
from .functions import vectors as V
from .operators import chunking as C
from .operators import exam as X
from .operators import pages as P
from .operators import search as K
from .operators import selection as S
from .plans.ingest import ingest
from .settings import Settings
from .sources import files as SF
from .sources import models as M
from .sources.index import ChunkIndex

QUERY = "Why does a model do well on its training data and badly on new data?"
#: What an embedding model should find near to the query or far from it; the second in another language.
PROBES = (
    ("near", "A model that memorises its training data does not generalise."),
    ("near, French", "Le modèle apprend par cœur les données d'entraînement et généralise mal."),
    ("far", "Bring the soup to the boil and add the carrots."),
    ("far", "The bus leaves the station every twenty minutes."),
)


class App:
    """The commands over given models; each returns the lines that it prints."""

    def __init__(self, spark: SparkSession, settings: Settings, embedder=None, chat=None):
        self.spark, self.settings = spark, settings
        self.embedder = embedder or M.HttpEmbedder(settings.embed, settings.request_timeout)
        self.chat = chat or M.HttpChat(settings.llm, settings.temperature, settings.request_timeout)

    def _pages(self, course: str) -> DataFrame:
        found = SF.find_documents(self.spark, self.settings.course_dir(course), self.settings.suffixes)
        return SF.read_pages(SF.with_content(self.spark, found), self.settings.pdf_backend)

    def _index(self, course: str, create: bool = False) -> ChunkIndex:
        """Only ``create`` asks the embedding server for its width; readers take it from the index."""
        path = self.settings.index_path(course)
        if create:
            return ChunkIndex.open(self.spark, path, self.settings.profile(M.dimension(self.embedder)), create=True)
        index = ChunkIndex.open(self.spark, path)
        ChunkIndex.open(self.spark, path, self.settings.profile(int(index.profile().get("dimension", 0))))
        return index

    def inspect(self, course: str, show_removed: bool = False) -> list[str]:
        raw = self._pages(course).persist()
        pages = raw.filter("error is null").drop("error")
        cleaned = P.clean_pages(pages)
        rows = P.profile(cleaned).join(P.scanned(cleaned), "source").join(P.cleaning_report(pages).select("source", "removed_ratio", "numbers_preserved"), "source").orderBy(F.lower("source")).collect()
        out = [f"{r.source}: {r.pages} pages, {r.chars} chars (~{r.tokens} tokens), median {r.median_chars}, near-empty {r.near_empty}, longest page {r.longest_page}, removed {r.removed_ratio:.1%}" + (", probably scanned" if r.scanned else "") + ("" if r.numbers_preserved else ", PAGE NUMBERS LOST") for r in rows]
        out += [f"{r.source}: {r.error}" for r in raw.filter("error is not null").collect()]
        out += [f"{r.source}: {EmptyExtraction.__name__}" for r in P.with_content(cleaned)[1].collect()]
        out += [f"ignored {r.files} x {r.suffix}" for r in SF.count_ignored(self.spark, self.settings.course_dir(course), self.settings.suffixes).collect()]
        if show_removed:
            out += [f"{r.source} furniture {r.line!r}: {r.margin:.0%} of pages" + (" (borderline)" if r.borderline else "") for r in P.margin(P.cleaning_report(pages)).orderBy("source", "line").collect()]
            gone = P.removals(pages).persist()
            out += [f"{r.source} {r.stage}: {r.lines} lines on pages {r.pages}" for r in P.by_stage(gone).orderBy("source", "stage").collect()]
            out += [f"{r.source} p{r.page} {r.stage}: {r.text!r}" + (f" x {r.n}" if r.n > 1 else "") for r in gone.groupBy("source", "page", "stage", "text").agg(F.count(F.lit(1)).alias("n")).orderBy("source", "page", "stage", "text").collect()]
            gone.unpersist()
        return out

    def chunks(self, course: str, show: int = 3) -> list[str]:
        pages, _ = P.with_content(P.clean_pages(self._pages(course).filter("error is null").drop("error")))
        found = C.chunk_documents(pages, self.settings.chunk_size, self.settings.chunk_overlap).persist()
        out = [f"{r.source or 'all'}: {r.chunks} chunks, {r.min_chars}/{r.median_chars}/{r.max_chars} chars, {r.spanning} across pages" for r in C.chunk_profile(found).orderBy(F.col("source").isNull(), "source").collect() if r.chunks]
        sample = C.systematic_sample(found, show).orderBy("source", "chunk_index").select(T.citation("source", "page", "page_end"), T.preview("text", 100)).collect() if show else []
        return out + [f"[{c}] {t}" for c, t in sample]

    def ingest(self, course: str, rebuild: bool = False, force: bool = False, show=None) -> list[str]:
        """force: unchanged files are cleaned and embedded again, too. show: gets the numbers of files read and chunks embedded while they grow; the error stream does, by default."""
        if rebuild:
            ChunkIndex(self.spark, self.settings.index_path(course)).drop()
        told = show or (lambda files, chunks: print(f"{files} files read, {chunks} chunks embedded", file=sys.stderr))
        report = ingest(self.spark, str(self.settings.course_dir(course)), self._index(course, create=True), self.embedder, self.settings, force, told)
        out = [f"{r.source}: {r.status}" + (f", {r.chunks} chunks" if r.chunks else "") + (f" ({r.detail})" if r.detail else "") for r in report.outcomes.collect()]
        totals = [f"{r.status}: {r.files} files, {r.chunks} chunks" for r in report.totals().orderBy("status").collect()]
        return [*out, *totals, f"{report.seconds:.1f} s"]

    def search(self, course: str, text: str, top_k: int | None = None) -> list[str]:
        k = top_k or self.settings.top_k
        hits = K.search(self._index(course).candidates(), M.embed_one(self.embedder, text), k).orderBy("rank")
        rows = hits.select("rank", "score", T.citation("source", "page", "page_end").alias("c"), T.preview("text", 160).alias("t")).collect()
        return [f"top {k}", *(f"{r['rank']}. {r.score:.3f} [{r.c}] {r.t}" for r in rows)]

    def mock(self, course: str, questions: int | None = None, topic: str | None = None, material: int | None = None) -> list[str]:
        n = questions or self.settings.num_questions
        vector = M.embed_one(self.embedder, topic) if topic else None
        chunks = S.gather_material(self._index(course).candidates(), material or 2 * n, vector).persist()
        began = time.time()
        made = X.mock_exam(self.chat, chunks, course, n, topic, self.settings.max_retries + 1, self._on_token(began))
        took = f"{time.time() - began:.1f} s, {made.attempts} attempt{'s' * (made.attempts > 1)}"
        if made.items.isEmpty():
            passages = chunks.orderBy("source", "page", "ord").select(T.citation("source", "page", "page_end"), T.preview("text", 160)).collect()
            return [took, "no questions: the material did not support any", *made.dropped, made.raw[:500], *(f"[{c}] {t}" for c, t in passages)]
        self.settings.ensure_dirs()
        paths = [self.settings.output_path(course, kind) for kind in ("mock_exam", "answers")]
        for path, body in zip(paths, X.render(course, made.items), strict=True):
            path.write_text(body, encoding="utf-8")
        covered = [f"{r.topic}: {r.questions}" for r in X.topics_covered(made.items).collect()]
        return [took, *(f"wrote {p}" for p in paths), *covered, *(f"dropped {d}" for d in made.dropped)]

    def _on_token(self, began: float):
        """Progress on the error stream while a reply comes in, every 50 parts."""

        def show(written: int, thought: int) -> None:
            if (written + thought) % 50 == 0:
                rate = (written + thought) / max(time.time() - began, 1e-3)
                print(f"{time.time() - began:.0f} s: {written} parts of the reply, {thought} of reasoning, {rate:.1f} a second", file=sys.stderr)

        return show

    def topics(self, course: str, count: int = S.MOST_TOPICS, slots: int = 0) -> list[str]:
        topics = S.rank_topics(self._index(course).candidates(), count)
        rows = (S.allocate(topics, slots) if slots else topics.withColumn("slots", F.lit(0))).orderBy("topic").collect()
        return [f"{r.topic}. {r.label}: {r.weight} documents, {r.size} chunks" + (f", {r.slots} questions" if slots else "") for r in rows]

    def coverage(self, course: str, count: int = 20, topic: str | None = None) -> list[str]:
        vector = M.embed_one(self.embedder, topic) if topic else None
        chunks = S.gather_material(self._index(course).candidates(), count, vector).persist()
        by = S.coverage(chunks).orderBy(F.desc("chunks"), "first").collect()
        return [*(f"{r.source}: {r.chunks}" for r in by), *(f"[{c}] {t}" for c, t in chunks.orderBy("source", "page", "ord").select(T.citation("source", "page", "page_end"), T.preview("text")).collect())]

    def status(self, course: str) -> list[str]:
        index = self._index(course)
        s = index.stats().first()
        return [f"documents {s.documents}, chunks {s.chunks}, vectors {s.vectors}" + ("" if s.consistent else ", INCONSISTENT"), *(f"{k} = {v}" for k, v in sorted(s.profile.items())), *(f"{r.source}: {r.chunks}" for r in index.sources().collect())]

    def embed_check(self) -> list[str]:
        """The width, each probe's likeness to the query, and whether all near ones come before all far ones."""
        query = M.embed_one(self.embedder, QUERY)
        probes = M.embed(self.spark.createDataFrame(list(PROBES), "kind string, text string"), self.embedder)
        rows = probes.select("kind", "text", V.dot("embedding", K.query_column(query)).alias("s")).orderBy(F.desc("s")).collect()
        lowest, highest = min(r.s for r in rows if r.kind != "far"), max(r.s for r in rows if r.kind == "far")
        told = "ok: near probes are closer than far ones" if lowest > highest else "WEAK: a far probe is as close as a near one; choose another embedding model"
        return [f"{len(query)} dimensions", f"query: {QUERY}", *(f"{r.s:.3f} [{r.kind}] {r.text}" for r in rows), f"{told} ({lowest:.3f} against {highest:.3f})"]


def main(argv: list[str] | None = None, app: App | None = None) -> int:
    parser = argparse.ArgumentParser(prog="quire", description="Document analytics on Spark.")
    sub = parser.add_subparsers(dest="command")
    for name in ("inspect", "chunks", "ingest", "search", "mock", "topics", "coverage", "status"):
        p = sub.add_parser(name)
        p.add_argument("course")
        if name == "inspect":
            p.add_argument("--show-removed", action="store_true")
        elif name == "chunks":
            p.add_argument("--show", type=int, default=3)
        elif name == "ingest":
            p.add_argument("--rebuild", action="store_true")
            p.add_argument("--force", action="store_true")
        elif name == "search":
            p.add_argument("text")
            p.add_argument("--top-k", type=int)
        elif name == "mock":
            p.add_argument("--questions", type=int)
            p.add_argument("--topic")
            p.add_argument("--material", type=int)
        elif name == "topics":
            p.add_argument("--count", type=int, default=S.MOST_TOPICS)
            p.add_argument("--slots", type=int, default=0)
        elif name == "coverage":
            p.add_argument("--count", type=int, default=20)
            p.add_argument("--topic")
    sub.add_parser("embed-check")
    args = vars(parser.parse_args(argv))
    command = args.pop("command")
    if not command:
        print("quire: document analytics on Spark; see --help")
        return 0
    app = app or App(SparkSession.builder.appName("quire").getOrCreate(), Settings.from_environment())
    try:
        for line in getattr(app, command.replace("-", "_"))(**args):
            print(line)
    except (QuireError, ValueError) as e:
        print(f"{type(e).__name__}: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
