"""Language ID with a byte convolutional network, trained and applied in numpy.

Bytes fold to 64 symbols (letters without case, blanks, digits, punctuation, lead bytes, and continuation
bytes modulo 32, which also drops the case of accented Latin letters). Filters of two, three and four symbols
slide over windows of WINDOW bytes; the largest response of each filter in a window goes through a
rectifier and a softmax layer. A text is cut into consecutive windows, all of it, with blanks behind its end, and
its language is the one of the largest mean probability, windows weighing as many bytes as they hold. What a row
gets depends on its own text only, to the last bit.

The network is fitted on labelled windows: every labelled text is cut whole, and of all windows of a language
about MAX_WINDOWS are drawn by a hash of the text and the window's place.

A convolution of one-hot symbols is a sum of table rows, so the filters are applied as two lookups by symbol
pairs for each byte.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import documents, id_remainder
from .wordhash import U, mix, raw_bytes, slices

WINDOW, FILTERS, WIDTHS = 256, 16, (2, 3, 4)
MAX_WINDOWS = 6000  # labelled windows of each language that the classifier is fitted on, in expectation
BLANK = 26


def _alphabet() -> np.ndarray:
    fold = np.full(256, 28, np.uint8)  # punctuation and the rest
    fold[65:91] = fold[97:123] = np.arange(26)
    fold[[32, 9, 10, 11, 12, 13, 0]] = BLANK
    fold[48:58] = 27
    fold[0x80:0xC0] = 32 + (np.arange(0x80, 0xC0) & 31)
    fold[0xC0:] = 31
    fold[0xC2], fold[0xC3] = 29, 30
    return fold


FOLD = _alphabet()


class Network:
    def __init__(self, languages: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        self.languages, k = languages, len(languages)
        self.conv = [rng.normal(0, 0.3, (width, 64, FILTERS)).astype(np.float32) for width in WIDTHS]
        self.bias = np.zeros(FILTERS * len(WIDTHS), np.float32)
        self.out = rng.normal(0, 0.1, (FILTERS * len(WIDTHS), k)).astype(np.float32)
        self.out_bias = np.zeros(k, np.float32)

    def _responses(self, x: np.ndarray) -> np.ndarray:
        """(windows, places, filters) of symbol windows with three further symbols behind each."""
        n = x.shape[1] - 3
        return np.concatenate([sum(w[j][x[:, j : j + n]] for j in range(len(w))) for w in self.conv], axis=2)

    def train(self, x: np.ndarray, y: np.ndarray, steps: int = 900, batch: int = 128, rate: float = 0.01, seed: int = 7) -> None:
        """Adam on the cross-entropy, for ``steps`` batches and six passes at least; only the places of the largest responses carry gradients to the filters."""
        rng = np.random.default_rng(seed)
        epochs = max(6, -(-steps * batch // max(1, len(x))))
        params = [*self.conv, self.bias, self.out, self.out_bias]
        m, v, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
        for epoch in range(epochs):
            order = rng.permutation(len(x))
            for a in range(0, len(x), batch):
                i = order[a : a + batch]
                xb, yb = x[i], y[i]
                r = self._responses(xb)
                place = r.argmax(axis=1)
                top = np.take_along_axis(r, place[:, None], 1)[:, 0] + self.bias
                h = np.maximum(top, 0)
                z = h @ self.out + self.out_bias
                p = np.exp(z - z.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                p[np.arange(len(yb)), yb] -= 1
                p /= len(yb)
                dh = (p @ self.out.T) * (top > 0)
                grads = []
                for f, w in enumerate(self.conv):
                    cols = slice(f * FILTERS, (f + 1) * FILTERS)
                    g = np.zeros_like(w)
                    for j in range(len(w)):
                        np.add.at(g[j], (np.take_along_axis(xb, place[:, cols] + j, 1), np.arange(FILTERS)[None]), dh[:, cols])
                    grads.append(g)
                grads += [dh.sum(0), h.T @ p, p.sum(0)]
                t += 1
                step = rate * (1 - epoch / epochs)
                for q, g, mm, vv in zip(params, grads, m, v, strict=True):
                    mm += 0.1 * (g - mm)
                    vv += 0.001 * (g * g - vv)
                    q -= step * (mm / (1 - 0.9**t)) / (np.sqrt(vv / (1 - 0.999**t)) + 1e-8)

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        """Filter responses by the pair of symbols at a place, and by the pair two places on."""
        two, three, four = self.conv
        pair = lambda a, b: (a[:, None] + b[None]).reshape(4096, FILTERS)
        first = np.concatenate([pair(w[0], w[1]) for w in self.conv], axis=1)
        zero = np.zeros_like(three[2])
        second = np.concatenate([pair(three[2], zero), pair(four[2], four[3])], axis=1)
        return np.ascontiguousarray(first), np.ascontiguousarray(second)

    def probabilities(self, symbols: np.ndarray, start: np.ndarray, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Of the windows that begin at ``start`` in ``symbols``, with three further symbols behind each."""
        out = []
        wide = symbols.astype(np.int32)
        pairs = wide[:-1] * 64 + wide[1:]
        for a in range(0, len(start), 64):
            at = (start[a : a + 64, None] + np.arange(WINDOW)).ravel()
            r = first[pairs[at]]
            r[:, FILTERS:] += second[pairs[at + 2]]
            h = np.maximum(r.reshape(-1, WINDOW, r.shape[1]).max(axis=1) + self.bias, 0)
            z = self.out_bias + (h[:, :, None] * self.out).sum(axis=1)  # not a matrix product, whose rounding follows the batch
            p = np.exp(z - z.max(1, keepdims=True))
            out.append(p / p.sum(1, keepdims=True))
        return np.concatenate(out) if out else np.empty((0, len(self.languages)), np.float32)

    def predict(self, text: pa.Array, tables) -> tuple[list[str], np.ndarray]:
        data, off = raw_bytes(text)
        n = np.diff(off)
        windows = np.maximum(1, -(-n // WINDOW))
        size = windows * WINDOW + 3  # no window reads on into the next text
        begin = np.cumsum(size) - size
        symbols = np.full(int(size.sum()), BLANK, np.uint8)
        symbols[np.arange(len(data)) + np.repeat(begin - off[:-1], n)] = FOLD[data]
        row = np.repeat(np.arange(len(n)), windows)
        place = np.arange(len(row)) - np.repeat(np.cumsum(windows) - windows, windows)
        p = self.probabilities(symbols, begin[row] + place * WINDOW, *tables)
        weight = np.maximum(np.minimum(n[row] - place * WINDOW, WINDOW), 0)
        total = np.zeros((len(n), len(self.languages)))
        np.add.at(total, row, p * weight[:, None])
        total /= np.maximum(n, 1)[:, None]
        best = total.argmax(1)
        plain = np.r_[0, np.cumsum((FOLD[data] < 26))]
        letters = plain[off[1:]] > plain[off[:-1]]
        names, score = [], np.clip(total[np.arange(len(n)), best], 0, 1)
        for r in range(len(n)):
            ok = letters[r] or (n[r] and any(c.isalpha() for c in text[r].as_py()))
            names.append(self.languages[best[r]] if ok else "und")
            if not ok:
                score[r] = 0.0
        return names, score


def _drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows of (lang, text, hash, share), each with the chance ``share``; every fourth is cut short, so that short texts are learned too."""
    for batch in batches:
        for part in slices(batch, "text"):
            data, off = raw_bytes(part.column(1))
            windows = -(-np.diff(off) // WINDOW)
            row = np.repeat(np.arange(part.num_rows), windows)
            place = np.arange(len(row)) - np.repeat(np.cumsum(windows) - windows, windows)
            luck = mix(part.column(2).to_numpy().astype(np.int64).view(U)[row] + place.astype(U))
            took = np.flatnonzero((luck >> U(11)).astype(float) < part.column(3).to_numpy()[row] * 2.0**53)
            bits = (luck[took] & U(31)).astype(np.int64)
            start = off[row[took]] + place[took] * WINDOW
            end = np.minimum(off[row[took] + 1], start + np.where(bits < 8, 16 + 24 * bits, WINDOW))
            pieces = [bytes(data[a:b]) for a, b in zip(start.tolist(), end.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row[took])), pa.array(pieces, pa.binary())], names=["lang", "piece"])


def fit(labelled: DataFrame, max_windows: int = MAX_WINDOWS) -> Network | None:
    """Fit on (text, lang): about ``max_windows`` windows of each language, drawn from all windows of all texts. None without any.

    Repeated texts draw the same windows, which count once. The driver holds that many pieces of WINDOW bytes a language.
    """
    rows = labelled.filter("lang is not null and text is not null").select("lang", F.col("text").cast("string").alias("text"))
    windows = F.sum(F.ceil(F.octet_length("text") / WINDOW))
    shares = rows.groupBy("lang").agg(F.least(F.lit(1.0), F.try_divide(F.lit(float(max_windows)), windows)).alias("share"))  # a row for each language
    drawn = rows.join(F.broadcast(shares), "lang").select("lang", "text", F.xxhash64("text").alias("hash"), "share")
    got = drawn.mapInArrow(_drawn, "lang string, piece binary").distinct().toPandas()
    if got.empty:
        return None
    got = got.sort_values(["lang", "piece"])
    languages = sorted(got.lang.unique())
    x = np.full((len(got), WINDOW + 3), BLANK, np.uint8)
    for i, piece in enumerate(got.piece):
        x[i, : len(piece)] = FOLD[np.frombuffer(piece, np.uint8)]
    net = Network(languages)
    net.train(x, np.array([languages.index(v) for v in got.lang]))
    return net


def _predictor(net: Network):
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = net.tables()
        for batch in batches:
            for part in slices(batch, "text"):
                names, score = net.predict(part.column(1), tables)
                yield pa.RecordBatch.from_arrays([*part.columns[:1], pa.array(names, pa.string()), pa.array(score), *part.columns[2:]], names=["doc_id", "lang_pred", "score", *part.schema.names[2:]])

    return predict


def language_id(docs: DataFrame, net: Network | None, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, lang_pred, score, and the columns of ``docs`` named in ``carry`` as carried_0, ...) of each row.

    lang_pred is ``und`` and score 0 where the text is null or has no letter, or where there was nothing to learn from.
    Repeated rows, null ids and empty tables pass through; other columns are ignored.
    """
    extra = [F.col(c).alias(f"carried_{i}") for i, c in enumerate(carry)]
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *extra)
    if net is None:
        return base.select("doc_id", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), *[f"carried_{i}" for i in range(len(carry))])
    more = "".join(f", carried_{i} {base.schema[f'carried_{i}'].dataType.simpleString()}" for i in range(len(carry)))
    return base.mapInArrow(_predictor(net), "doc_id long, lang_pred string, score double" + more)


RUN = 3  # symbols of a run whose being seen before tells a learned language from others
MOST_UNFAMILIAR = 0.35


def _run_codes(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, code) of every run of RUN symbols inside a text."""
    data, off = raw_bytes(text)
    symbol, n = FOLD[data].astype(np.int64), max(0, len(data) - RUN + 1)
    code = np.zeros(n, np.int64)
    for j in range(RUN):
        code = code * 64 + symbol[j : n + j]
    row = np.repeat(np.arange(len(off) - 1), np.diff(off))
    at = np.flatnonzero(row[:n] == row[RUN - 1 :]) if n else np.empty(0, np.int64)
    return row[at], code[at]


@dataclass
class Familiar:
    """Which runs of symbols the labelled texts hold, and what share of others a text may have."""

    seen: np.ndarray
    most: float


def familiar(labelled: DataFrame) -> Familiar:
    """From all of (text, lang). What is yet unseen of the learned languages themselves, by the share of runs that were met once, is added to MOST_UNFAMILIAR.

    Natural text in a learned language has up to a third of runs that the invented prose of the tables lacks; text in other languages of the same script and source code have over
    two fifths, and text in other scripts nearly all. 64**RUN counts at most come to the driver.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(64**RUN, np.int64)
        for batch in batches:
            for part in slices(batch, "text"):
                total += np.bincount(_run_codes(part.column(0))[1], minlength=64**RUN)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["code", "n"])

    rows = labelled.filter("lang is not null and text is not null").select(F.col("text").cast("string").alias("text"))
    got = rows.mapInArrow(count, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).toArrow()
    seen, n = np.zeros(64**RUN, bool), got["n"].to_numpy()
    seen[got["code"].to_numpy()] = True
    return Familiar(seen, MOST_UNFAMILIAR + (float((n == 1).sum() / n.sum()) if len(n) else 1.0))


def with_unfamiliar(docs: DataFrame, known: Familiar, text_col: str = "text") -> DataFrame:
    """``docs`` with ``unfamiliar``, the share of each text's runs that are not in ``known``; 0 for a text shorter than a run, or null."""
    from pyspark.sql import types as P

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_col):
                row, code = _run_codes(part.column(part.schema.get_field_index(text_col)))
                share = np.bincount(row, ~known.seen[code], part.num_rows) / np.maximum(np.bincount(row, minlength=part.num_rows), 1)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(share)], names=[*part.schema.names, "unfamiliar"])

    return docs.mapInArrow(judge, P.StructType([*docs.schema.fields, P.StructField("unfamiliar", P.DoubleType())]))


def op7_language(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    net = fit(docs.filter(id_remainder("doc_id", 5) != 0).select("text", "lang"))
    return language_id(docs, net).withColumn("held_out", id_remainder("doc_id", 5) == 0)


QUERIES = {"op7_language": op7_language}
SQL: dict[str, str] = {}
