"""Personal data: fixed patterns, completed by a skip-chain conditional random field.

The patterns give the base spans. Tokens that hold a digit or an at-sign are the nodes of the field, with the
four kinds and "none" as labels; adjacent nodes share a chain potential, and consecutive occurrences of one
token (or of the same digits) in a document share a skip potential, so that n occurrences take n-1 edges.
Tokens inside base spans are fixed to their kind. Loopy sum-product message passing spreads them; a run of
tokens whose marginal for a kind reaches SURE is added as a span, unless it meets a base span. A slice of
documents is one graph, so messages are passed for all of them at once.

The base spans of all texts serve as labels. Node weights, chain and skip potentials are fitted together by
composite likelihood: the label of a node given its shape alone (nodes far from any pattern have no labelled
neighbours), and given its shape and the labels of its neighbours in both kinds of edges (pseudo-likelihood).
Nodes that agree in all of these count as one weighted row, so what comes to the driver is bounded by the shapes
that the features can tell apart, not by the corpus, and no text is sampled or cut.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import documents
from .wordhash import slices

KINDS = ("email", "ip", "card", "phone")
SURE = 0.95
ROUNDS = 12
SMOOTH = 5.0  # pairs that stand behind each pair potential before any is seen
#: The base patterns. The look-behind only skips starts inside a run of digits, where no match can begin.
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
TOKEN = re.compile(r"[^\x20\x09-\x0D]*[0-9@][^\x20\x09-\x0D]*")
HINT = re.compile(r"[0-9@]")
NEXT = re.compile(r"[\x20\x09-\x0D]*([^\x20\x09-\x0D]*)")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the patterns: leftmost and not overlapping within a kind; a match that fails its check is dropped."""
    out = []
    at, last = text.find("@"), 0
    while at >= 0:
        a = at
        while a > last and text[a - 1] in LOCAL:
            a -= 1
        m = DOMAIN.match(text, at) if a < at else None
        if m:
            last = m.end()
            out.append((0, a, last))
            at = text.find("@", last)
        else:
            at = text.find("@", at + 1)
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append((1, m.start(), m.end()))
    for m in CARD.finditer(text):
        if 13 <= m.end() - m.start() <= 40 and 13 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            out.append((2, m.start(), m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= len(_digits(m[0])) <= 15:
                out.append((3, m.start(), m.end()))
    return sorted(out)


N_FEATURES = 32


def _features(token: str, before: str, after: str) -> list[int]:
    d = _digits(token)
    n, core = len(d), token.strip(".,;:!?()[]\"'")
    on = [0, 1 + min(7, n // 3), 9 + min(3, token.count(".")), 13 + min(3, token.count("-"))]
    flags = (
        "@" in token, token.startswith("("), token.startswith("+"), ")" in token, core.isdigit(), any(c.isalpha() for c in token),
        13 <= n <= 19 and core.isdigit() and luhn(d), bool(re.fullmatch(r"(?:[0-9]{1,3}\.){3}[0-9]{1,3}", core)), before.startswith("+"),
        before.endswith(")"), bool(HINT.search(before)), bool(HINT.search(after)), bool(re.fullmatch(r"[0-9]{3}[-.][0-9]{4}", core)),
        bool(re.fullmatch(r"\(?[0-9]{3}\)?", core)), "@" in token and "." in token.rpartition("@")[2],
    )
    return on + [17 + i for i, f in enumerate(flags) if f]


class Graph:
    """The candidate tokens of some texts as nodes: rows, spans, features, base labels (-1: none), chain and skip edges."""

    def __init__(self, texts: list[str], base: list[list[tuple[int, int, int]]]):
        self.row, self.span, chain, skip, feats, label = [], [], [], [], [], []
        for r, text in enumerate(texts):
            if not text or not HINT.search(text):
                continue
            found = [(m.start(), m.end()) for m in TOKEN.finditer(text)]
            spans, at, seen = sorted((a, b, k) for k, a, b in base[r]), 0, {}
            for i, (a, b) in enumerate(found):
                node = len(self.row)
                prev = text[found[i - 1][0] : found[i - 1][1]] if i and a - found[i - 1][1] == 1 else ""
                token = text[a:b]
                feats.append(_features(token, prev, NEXT.match(text, b)[1]))
                if prev:
                    chain.append((node - 1, node))
                key = _digits(token) if "@" not in token else token.lower().strip(".,;:!?()[]\"'")
                if len(key) >= 4:
                    if key in seen:
                        skip.append((seen[key], node))
                    seen[key] = node
                while at < len(spans) and spans[at][1] <= a:
                    at += 1
                kind, j = -1, at
                while kind < 0 and j < len(spans) and spans[j][0] < b:
                    kind, j = (spans[j][2] if spans[j][1] > a else -1), j + 1
                label.append(kind)
                self.row.append(r)
                self.span.append((a, b))
        self.x = np.zeros((len(self.row), N_FEATURES))
        for i, f in enumerate(feats):
            self.x[i, f] = 1
        self.label = np.array(label, np.int64).reshape(-1)
        self.chain, self.skip = (np.array(e, np.int64).reshape(-1, 2) for e in (chain, skip))


class Field:
    def __init__(self, k: int = len(KINDS) + 1):
        self.node, self.chain, self.skip = np.zeros((N_FEATURES, k)), np.zeros((k, k)), np.zeros((k, k))

    def fit(self, rows: list[tuple[int, int, int, int, int, int, int]], steps: int = 600, rate: float = 0.5, ridge: float = 2e-3) -> None:
        """rows: (features as bits, label, label of the chain's previous and next node, of the skip edges' previous and next node, how many); -1 for no neighbour.

        Labels are base kinds, and "none" (the last) elsewhere. The potentials are drawn towards smoothed mutual information.
        """
        if not rows:
            return
        k = self.node.shape[1]
        bits, label, *around, many = (np.array(c, np.int64) for c in zip(*sorted(rows), strict=True))
        x = ((bits[:, None] >> np.arange(N_FEATURES)) & 1).astype(float)
        weight = many / many.sum()
        y = np.eye(k)[label]
        near = [np.vstack([np.eye(k), np.zeros(k)])[c] for c in around]
        prior = {}
        for name, after in (("chain", near[1]), ("skip", near[3])):
            # How much more often than by chance two labels meet; a pair that never could is neutral, and skip edges lean to agreement.
            joint = (y * many[:, None]).T @ after
            if name == "skip":
                joint = (joint + joint.T) / 2
            chance = np.outer(joint.sum(1), joint.sum(0)) / max(joint.sum(), 1)
            lean = 1.0 if name == "chain" else (1 + k * np.eye(k)) / 2
            prior[name] = np.clip(np.log((joint + SMOOTH * lean) / (chance + SMOOTH)), -4, 4)
        self.chain, self.skip = prior["chain"].copy(), prior["skip"].copy()


        def error(z: np.ndarray) -> np.ndarray:
            p = np.exp(z - z.max(1, keepdims=True))
            return (y - p / p.sum(1, keepdims=True)) * weight[:, None]

        for _ in range(steps):
            alone = x @ self.node
            e = error(alone + near[0] @ self.chain + near[1] @ self.chain.T + (near[2] + near[3]) @ self.skip)
            self.node += rate * (x.T @ (e + error(alone)) - ridge * self.node)
            self.chain += rate * (near[0].T @ e + e.T @ near[1] - ridge * (self.chain - prior["chain"]))
            both = (near[2] + near[3]).T @ e
            self.skip += rate * ((both + both.T) / 2 - ridge * (self.skip - prior["skip"]))

    def marginals(self, g: Graph) -> np.ndarray:
        """Loopy sum-product in the log domain, all edges at once, damped by half."""
        k = self.node.shape[1]
        own = g.x @ self.node
        fixed = np.flatnonzero(g.label >= 0)
        own[fixed] = -50.0
        own[fixed, g.label[fixed]] = 0.0
        own -= own.max(1, keepdims=True)
        a = np.concatenate([g.chain[:, 0], g.chain[:, 1], g.skip[:, 0], g.skip[:, 1]])
        b = np.concatenate([g.chain[:, 1], g.chain[:, 0], g.skip[:, 1], g.skip[:, 0]])
        nc, ns = len(g.chain), len(g.skip)
        back = np.concatenate([np.arange(nc) + nc, np.arange(nc), np.arange(ns) + 2 * nc + ns, np.arange(ns) + 2 * nc]).astype(np.int64)
        pots = np.concatenate([np.broadcast_to(m, (n, k, k)) for m, n in ((self.chain, nc), (self.chain.T, nc), (self.skip, ns), (self.skip.T, ns))])
        msg = np.zeros((len(a), k))
        for _ in range(ROUNDS if len(a) else 0):
            belief = own.copy()
            np.add.at(belief, b, msg)
            out = (belief[a] - msg[back])[:, :, None] + pots
            top = out.max(1)
            new = top + np.log(np.exp(out - top[:, None]).sum(1))
            msg = 0.5 * msg + 0.5 * (new - new.max(1, keepdims=True))
        belief = own.copy()
        np.add.at(belief, b, msg)
        p = np.exp(belief - belief.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)

    def more_spans(self, texts: list[str], base: list[list[tuple[int, int, int]]]) -> list[list[tuple[int, int, int]]]:
        """The spans that the field adds to each text's base spans."""
        added: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        g = Graph(texts, base)
        if not len(g.row):
            return added
        p = self.marginals(g)
        kind = p.argmax(1)
        good = (kind < len(KINDS)) & (p.max(1) >= SURE) & (g.label < 0)
        joined = {(int(x), int(y)) for x, y in g.chain}
        i = 0
        while i < len(good):
            if not good[i]:
                i += 1
                continue
            j = i
            while (j, j + 1) in joined and good[j + 1] and kind[j + 1] == kind[i] and kind[i] != 0:
                j += 1
            r, a, b = g.row[i], g.span[i][0], g.span[j][1]
            text = texts[r]
            while a < b and text[a] in ".,;:!?[]\"'<>":
                a += 1
            while b > a and text[b - 1] in ".,;:!?[]\"'<>":
                b -= 1
            if a < b and not any(x < b and y > a for _, x, y in base[r]):
                added[r].append((int(kind[i]), a, b))
            i = j + 1
        return added


def _digest(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


def redact(text: str | None, spans: list[tuple[int, int, int]]) -> str | None:
    """The text with each span, or run of overlapping spans, replaced by the first one's kind in brackets."""
    if not spans:
        return text
    out, at = [], 0
    for a, b, k in sorted((a, b, k) for k, a, b in spans):
        if a >= at:
            out += [text[at:a], f"[{KINDS[k].upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def _finder(field: Field):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                texts = part.column(1).to_pylist()
                base = [base_spans(t) if HINT.search(t) else [] for t in texts]
                more = field.more_spans(texts, base)
                count = lambda k: pa.array([sum(x == k for x, _, _ in b) for b in base], pa.int64())  # noqa: B023, E731
                sha = [hashlib.sha256(_digest(b).encode()).hexdigest() for b in base]
                both = [b + m for b, m in zip(base, more, strict=True)]
                cols = [part.column(0), *(count(k) for k in range(4)), pa.array(sha), pa.array([_digest(x) for x in both], pa.string()), pa.array([redact(t, x) for t, x in zip(texts, both, strict=True)], pa.string())]
                names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "redacted"]
                yield pa.RecordBatch.from_arrays([*cols, *part.columns[2:]], names=[*names, *part.schema.names[2:]])

    return find


def training_rows(texts: list[str]) -> dict[tuple[int, int, int, int, int, int], int]:
    """What Field.fit() takes of some whole texts, with counts."""
    g = Graph(texts, [base_spans(t) if HINT.search(t) else [] for t in texts])
    n = len(g.row)
    if not n:
        return {}
    label = np.where(g.label < 0, len(KINDS), g.label)
    around = np.full((4, n), -1, np.int64)
    for at, edges in ((0, g.chain), (2, g.skip)):
        around[at, edges[:, 1]] = label[edges[:, 0]]
        around[at + 1, edges[:, 0]] = label[edges[:, 1]]
    bits = (g.x.astype(np.int64) << np.arange(N_FEATURES)).sum(1)
    rows, many = np.unique(np.stack([bits, label, *around], 1), axis=0, return_counts=True)
    return dict(zip(map(tuple, rows.tolist()), many.tolist(), strict=True))


NAMES = ("bits", "label", "before", "after", "skip_before", "skip_after")


def _training(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[tuple, int] = {}
    for batch in batches:
        for part in slices(batch, "text"):
            for row, n in training_rows(part.column(0).to_pylist()).items():
                total[row] = total.get(row, 0) + n
    cols = list(zip(*total, strict=True)) or [()] * len(NAMES)
    yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols), pa.array(list(total.values()), pa.int64())], names=[*NAMES, "n"])


def fit(docs: DataFrame, text_col: str = "text") -> Field:
    """Fit on the candidate tokens of all texts; the driver holds one row for each combination of features and labels that occurs."""
    field = Field()
    texts = docs.select(F.col(text_col).cast("string").alias("text")).filter(F.col("text").rlike("[0-9@]"))
    counted = texts.mapInArrow(_training, "".join(f"{n} long, " for n in NAMES) + "n long").groupBy(*NAMES).agg(F.sum("n").alias("n"))
    field.fit([tuple(r) for r in counted.collect()])
    return field


def private_data(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, redacted, and the columns in ``carry`` as carried_0, ...) of each row.

    The counts and base_sha256 are of the base spans, spans lists them and the field's as kind:start:end in code points,
    by kind, then start; redacted is the text with all of them replaced. A null text counts as empty and has no span.
    Repeated rows, null ids and empty tables pass through; other columns are ignored.
    """
    extra = [F.col(c).alias(f"carried_{i}") for i, c in enumerate(carry)]
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *extra)
    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, redacted string"
    schema += "".join(f", carried_{i} {base.schema[f'carried_{i}'].dataType.simpleString()}" for i in range(len(carry)))
    return base.mapInArrow(_finder(field), schema)


def op4_private_data(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return private_data(docs, fit(docs)).drop("redacted")


QUERIES = {"op4_private_data": op4_private_data}
SQL: dict[str, str] = {}
