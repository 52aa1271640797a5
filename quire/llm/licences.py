"""Licence scans with a generalised suffix automaton over the words of licence templates.

The templates and the base phrases make one automaton. Streaming a text through it gives the matching
statistics: after each word, the longest run of words that ends there and stands in some template. A base
phrase is found where its own state is the current one or a suffix of it. Runs of MIN_RUN words and more
are anchors; anchors of one template that advance both in the text and in the template are chained, and
a chain that covers enough words is a licence span with the template's label: MIN_COVER of the template, or of FULL words of
a longer one, so that a clause from the middle of a licence is found too. The templates are a parameter.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .licence_texts import TEMPLATES
from .shared import documents
from .wordhash import ALNUM, U, Lookup, hash_of, slices, words_of

#: The base phrases and their labels.
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
MIN_RUN = 3
MIN_COVER, FULL = 0.7, 28
MAX_GAP = 12
SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans string"


class Automaton:
    """A suffix automaton of several word sequences; each state has a longest run, a suffix link and, for runs of MIN_RUN words and more, every place where it ends."""

    def __init__(self, texts: list[list[int]]):
        self.step, self.link, self.size, self.ends = [{}], [-1], [0], [[]]
        for t, words in enumerate(texts):
            last = 0
            for i, w in enumerate(words):
                last = self._extend(last, w)
                self.ends[last].append((t, i))
        for v in sorted(range(1, len(self.step)), key=self.size.__getitem__, reverse=True):
            up = self.link[v]
            if up > 0:
                self.ends[up] = sorted({*self.ends[up], *self.ends[v]})

    def _new(self, size: int) -> int:
        self.step.append({})
        self.link.append(0)
        self.size.append(size)
        self.ends.append([])
        return len(self.step) - 1

    def _split(self, p: int, w: int, q: int) -> int:
        twin = self._new(self.size[p] + 1)
        self.step[twin] = dict(self.step[q])
        self.link[twin], self.link[q] = self.link[q], twin
        while p >= 0 and self.step[p].get(w) == q:
            self.step[p][w] = twin
            p = self.link[p]
        return twin

    def _extend(self, p: int, w: int) -> int:
        q = self.step[p].get(w)
        if q is not None:
            return q if self.size[q] == self.size[p] + 1 else self._split(p, w, q)
        new = self._new(self.size[p] + 1)
        while p >= 0 and w not in self.step[p]:
            self.step[p][w] = new
            p = self.link[p]
        if p >= 0:
            q = self.step[p][w]
            self.link[new] = q if self.size[q] == self.size[p] + 1 else self._split(p, w, q)
        return new

    def state_of(self, words: list[int]) -> int:
        v = 0
        for w in words:
            v = self.step[v][w]
        return v


def _words(text: str) -> list[str]:
    return re.findall(r"[0-9a-z\x80-\U0010FFFF]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))


class Scanner:
    """templates: (label, text) of each licence text or notice; words are those that are scanned for."""

    def __init__(self, phrases=PHRASES, templates=TEMPLATES):
        texts = [_words(p) for p, _ in phrases] + [_words(t) for _, t in templates]
        vocabulary = sorted({w for t in texts for w in t})
        number = {w: i for i, w in enumerate(vocabulary)}
        self.lookup = Lookup(np.array([hash_of(w) for w in vocabulary], U))
        coded = [[number[w] for w in t] for t in texts]
        self.auto = Automaton(coded)
        self.labels = [x for _, x in phrases] + [x for x, _ in templates]
        self.length = [len(t) for t in texts]
        self.n_base = len(phrases)
        self.base: dict[int, list[tuple[int, int]]] = {}
        own = {self.auto.state_of(coded[i]): i for i in range(self.n_base)}
        for v in range(len(self.auto.step)):
            u, found = v, []
            while u > 0:
                if u in own:
                    found.append((own[u], self.length[own[u]]))
                u = self.auto.link[u]
            if found:
                self.base[v] = found

    def runs(self, words: list[int], at: int, hits: list, anchors: list) -> None:
        """Stream one run of vocabulary words that begins at word ``at``: base hits (start, phrase) and right-maximal anchors."""
        step, link, size, base = self.auto.step, self.auto.link, self.auto.size, self.base
        v = length = 0
        for i, w in enumerate(words):
            nxt = step[v].get(w)
            if nxt is None:
                if length >= MIN_RUN:
                    anchors.append((at + i, length, v))
                while v > 0 and w not in step[v]:
                    v = link[v]
                    length = size[v]
                nxt = step[v].get(w)
            if nxt is None:
                v = length = 0
                continue
            v, length = nxt, length + 1
            if v in base:
                hits += [(at + i + 1 - n, p) for p, n in base[v] if n <= length]
        if length >= MIN_RUN:
            anchors.append((at + len(words), length, v))

    def chain(self, anchors: list) -> tuple[list, float]:
        """((start, end, template) of covered spans, the best share of a template covered). anchors: (end, length, state), by end."""
        by: dict[int, list] = {}
        for end, length, v in anchors:
            for t, last in self.auto.ends[v]:
                if t >= self.n_base:
                    by.setdefault(t, []).append((end - length, end, last + 1 - length, last + 1))
        spans, best = [], 0.0
        for t, parts in by.items():
            parts.sort()
            cover, back = [], []
            for i, (a, b, x, y) in enumerate(parts):
                most, frm = b - a, -1
                j = i - 1
                while j >= 0:
                    pa_, pb, px, py = parts[j]
                    if a - pb > MAX_GAP + self.length[t]:
                        break
                    skip = max(0, pb - a, py - x)  # words that both would cover
                    if pa_ < a and pb < b and px < x and py < y and a - pb <= MAX_GAP and x - py <= MAX_GAP and cover[j] + b - a - skip > most:
                        most, frm = cover[j] + b - a - skip, j
                    j -= 1
                cover.append(most)
                back.append(frm)
            for i, n in enumerate(cover):
                share = min(1.0, n / min(self.length[t], FULL))
                best = max(best, share)
                if share >= MIN_COVER:
                    j = i
                    while back[j] >= 0:
                        j = back[j]
                    spans.append((parts[j][0], parts[i][1], t))
        return spans, best

    def scan(self, part: pa.RecordBatch) -> pa.RecordBatch:
        w = words_of(part.column(1), ALNUM)
        code = self.lookup.find(w.hash)
        known = code >= 0
        edge = np.zeros(len(known) + 1, bool)
        edge[w.first] = True
        begin = known.copy()
        begin[1:] &= ~known[:-1] | edge[1:-1]
        stop = known.copy()
        stop[:-1] &= ~known[1:] | edge[1:-1]
        a, b = np.flatnonzero(begin), np.flatnonzero(stop) + 1
        least = min(MIN_RUN, *self.length)  # shorter runs hold neither a phrase nor an anchor
        long = b - a >= least
        found: dict[int, tuple[list, list]] = {}
        for i, j in zip(a[long].tolist(), b[long].tolist(), strict=True):
            row = int(w.doc[i])
            self.runs(code[i:j].tolist(), i - int(w.first[row]), *found.setdefault(row, ([], [])))
        n = part.num_rows
        out = {"n_base": [0] * n, "first_word": [None] * n, "last_word": [None] * n, "base_labels": [""] * n, "labels": [""] * n, "score": [0.0] * n, "spans": [""] * n}
        for row, (hits, anchors) in found.items():
            if not hits and not anchors:
                continue
            spans, best = self.chain(anchors)
            base = {self.labels[p] for _, p in hits}
            if hits:
                out["n_base"][row], out["first_word"][row], out["last_word"][row] = len(hits), min(hits)[0], max(hits)[0]
                out["base_labels"][row] = ",".join(sorted(base))
            out["labels"][row] = ",".join(sorted(base | {self.labels[t] for _, _, t in spans}))
            out["score"][row] = 1.0 if hits else best
            out["spans"][row] = ",".join(f"{self.labels[t]}:{x}:{y}" for x, y, t in sorted(set(spans) | {(s, s + self.length[p], p) for s, p in hits}))
        types = {"n_base": pa.int64(), "first_word": pa.int64(), "last_word": pa.int64(), "score": pa.float64()}
        cols = [part.column(0), pa.array(w.counts.astype(np.int64)), *(pa.array(v, types.get(k, pa.string())) for k, v in out.items())]
        return pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_words", *out])


def _scan(templates: tuple):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates=templates)
        for batch in batches:
            for part in slices(batch, "text"):
                yield scanner.scan(part)

    return scan


def licence_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: tuple[tuple[str, str], ...] = TEMPLATES) -> DataFrame:
    """Each row's licence spans: (doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans).

    n_base counts every place of a base phrase, first_word and last_word are the smallest and largest start of
    one (words from 0), spans lists label:start:end in words, end exclusive. score is 1 with a base phrase, else the
    best share that a chain covers of a template, or of FULL words of a longer one. templates: (label, text) of licences, some thousand words in
    all, which travel with the job. A null or empty text has no words and no labels, null
    first_word and last_word and score 0. Repeated rows, null ids and empty tables pass through; other columns are ignored.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return base.mapInArrow(_scan(tuple(templates)), SCHEMA)


def op9_licences(spark, sf_dir: str) -> DataFrame:
    return licence_scan(documents(spark, sf_dir))


QUERIES = {"op9_licences": op9_licences}
SQL: dict[str, str] = {}
