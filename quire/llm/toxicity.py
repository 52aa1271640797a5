"""Toxic passages as maximum-scoring segments of token log-odds.

Weights: log-odds of a token's document frequency in toxic against clean texts with an informative
Dirichlet prior (PRIOR times its overall frequency), kept where the log-odds exceed Z standard errors;
each token also costs COST, the log of the share of other tokens that a toxic passage may hold. The
linear-time scan of Ruzzo and Tompa finds every maximal segment of positive score. Segments are calibrated
by the extreme-value law of local scores: with E = K * n * exp(-lambda * S) for a text of n tokens, the
evidence of a text is -log E of its best segment and half that of each further significant one, and a
logistic fit on the training texts turns evidence into a probability.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import documents, id_remainder, kept
from .wordhash import ALNUM, U, Lookup, slices, words_of

MAX_TRAIN = 40_000  # labelled texts that the classifier is fitted on
PRIOR, Z, COST, CLIP = 0.1, 3.0, 0.3, 30.0


def segments(positive: np.ndarray, before: np.ndarray, after: np.ndarray) -> list[tuple[float, int, int]]:
    """All maximal segments as (score, first token, last token). positive: tokens of positive weight; before, after: the running sum at each."""
    left, right, start, end, below = [], [], [], [], []
    for i, lo, hi in zip(positive.tolist(), before.tolist(), after.tolist(), strict=True):
        a, j = i, len(left) - 1
        while True:
            while j >= 0 and left[j] >= lo:
                j = below[j]
            if j < 0 or right[j] >= hi:
                break
            lo, a = left[j], start[j]
            del left[j:], right[j:], start[j:], end[j:]
            j, rest = below[j], below[:j]
            below[:] = rest
        left.append(lo)
        right.append(hi)
        start.append(a)
        end.append(i)
        below.append(j)
    return [(r - x, a, b) for x, r, a, b in zip(left, right, start, end, strict=True)]


class Model:
    def __init__(self, hashes: np.ndarray, weights: np.ndarray, clean_share: np.ndarray):
        self.lookup = Lookup(hashes)
        self.weight = np.append(weights, 0.0) - COST
        self.lam, self.log_k, self.slope, self.bias = _decay(weights - COST, clean_share), 0.0, 0.0, 0.0

    def found(self, text: pa.Array) -> tuple[np.ndarray, list[list[tuple[float, int, int]]]]:
        """(number of tokens, segments) of each text."""
        w = words_of(text, ALNUM)
        s = self.weight[self.lookup.find(w.hash)]
        total = np.r_[0.0, np.cumsum(s)]
        hot = np.flatnonzero(s > 0)
        cut = np.searchsorted(hot, w.first)
        out = []
        for r in range(len(w.first) - 1):
            h = hot[cut[r] : cut[r + 1]]
            first = w.first[r]
            out.append(segments(h - first, total[h] - total[first], total[h + 1] - total[first]) if len(h) else [])
        return w.counts, out

    def evidence(self, n: np.ndarray, found: list[list[tuple[float, int, int]]]) -> np.ndarray:
        out = np.full(len(n), -CLIP)
        for r, segs in enumerate(found):
            if segs:
                e = sorted((self.lam * s - self.log_k - np.log(n[r]) for s, _, _ in segs), reverse=True)
                out[r] = e[0] + 0.5 * sum(x for x in e[1:] if x > 0)
        return np.clip(out, -CLIP, CLIP)

    def score(self, evidence: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.slope * evidence / CLIP + self.bias)))


def _decay(scores: np.ndarray, share: np.ndarray) -> float:
    """lambda with sum(share * exp(lambda * score)) = 1 over clean tokens; the rest of them score -COST."""
    rest = max(0.0, 1 - share.sum())

    def excess(lam: float) -> float:
        return float((share * np.exp(np.minimum(lam * scores, 700))).sum() + rest * np.exp(-lam * COST) - 1)

    low, high = 1e-3, 5.0
    if not len(scores) or excess(high) < 0 or excess(low) > 0:
        return 1.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if excess(mid) < 0 else (low, mid)
    return low


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and bias by Newton's method with a weak ridge."""
    X, w = np.stack([x, np.ones_like(x)], 1), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(X @ w, -30, 30)))
        h = X.T @ (X * (p * (1 - p))[:, None]) + np.diag([1e-2, 1e-4])
        d = np.linalg.solve(h, X.T @ (y - p) - np.array([1e-2, 1e-4]) * w)
        w += d
        if abs(d).max() < 1e-8:
            break
    return float(w[0]), float(w[1])


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            w = words_of(part.column(1), ALNUM)
            order = np.lexsort((w.hash, w.doc))
            h, d = w.hash[order], w.doc[order]
            once = np.r_[True, (h[1:] != h[:-1]) | (d[1:] != d[:-1])] if len(h) else np.empty(0, bool)
            h, y = h[once], np.asarray(part.column(0).to_pylist())[d[once]] if len(h) else h[once]
            keys, at = np.unique(h, return_inverse=True)
            toxic = np.bincount(at, weights=y, minlength=len(keys)).astype(np.int64) if len(keys) else np.empty(0, np.int64)
            clean = np.bincount(at, minlength=len(keys)).astype(np.int64) - toxic if len(keys) else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(toxic), pa.array(clean)], names=["token", "toxic", "clean"])


def _found(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                n, segs = model.found(part.column(1))
                best = [max((s for s, _, _ in x), default=0.0) for x in segs]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n.astype(np.int64)), pa.array(best, pa.float64()), pa.array([[s for s, _, _ in x] for x in segs], pa.list_(pa.float64()))], names=["y", "n", "best", "all_scores"])

    return run


def fit(labelled: DataFrame, max_train: int = MAX_TRAIN) -> Model:
    """Fit on about ``max_train`` texts at most of (text, y) with y 0 or 1, as labelled_texts() cuts them; a repeated text counts once, as 1 if any of its rows has it."""
    some = labelled.filter("y is not null and text is not null").groupBy("text").agg(F.max("y").alias("y"))
    sample = kept(some.select("y", "text"), "labelled")
    if (n := sample.count()) > max_train:  # ids that repeat; a share by the hash of the text
        sample = sample.filter(F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < F.lit(int(max_train / n * (1 << 30))))
    counts = kept(sample.mapInArrow(_frequencies, "token long, toxic long, clean long").groupBy("token").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")), "frequencies")
    nt, nc = (float(x or 0) for x in counts.agg(F.sum("toxic"), F.sum("clean")).first())
    if not nt or not nc:
        return Model(np.empty(0, U), np.empty(0), np.empty(0)) if not nc and not nt else _constant(sample)
    a = F.lit(PRIOR) * (F.col("toxic") + F.col("clean"))
    t, c = F.col("toxic") + a, F.col("clean") + a
    whole = PRIOR * (nt + nc)
    odds = F.log(t / (F.lit(nt + whole) - t)) - F.log(c / (F.lit(nc + whole) - c))
    # At most MAX_TRAIN texts stand behind these rows, so what passes the test is bounded too.
    rows = counts.withColumn("w", odds).filter(F.abs("w") >= Z * F.sqrt(1 / t + 1 / c)).select("token", "w", (c / F.lit(nc + whole)).alias("share")).orderBy("token").toPandas()
    model = Model(rows.token.to_numpy(np.int64).view(U), np.maximum(rows.w.to_numpy(), -1.0), rows.share.to_numpy())
    got = sample.mapInArrow(_found(model), "y int, n long, best double, all_scores array<double>").select("y", "n", "all_scores").toArrow()
    n, y, found = got["n"].to_numpy(), got["y"].to_numpy().astype(float), got["all_scores"].to_pylist()
    clean = y == 0
    low = 2.0
    hits = sum(sum(s >= low for s in x) for x, ok in zip(found, clean, strict=True) if ok)
    model.log_k = float(np.log((hits + 0.5) / max(1, n[clean].sum())) + model.lam * low)
    x = model.evidence(np.maximum(n, 1), [[(s, 0, 0) for s in v] for v in found])
    model.slope, model.bias = _logistic(x / CLIP, y)
    return model


def _constant(sample: DataFrame) -> Model:
    model = Model(np.empty(0, U), np.empty(0), np.empty(0))
    model.bias = 5.0 if sample.filter("y = 1").limit(1).count() else -5.0
    return model


def _scorer(model: Model):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                n, segs = model.found(part.column(1))
                s = model.score(model.evidence(np.maximum(n, 1), segs))
                spans = [",".join(f"{a}:{b + 1}" for x, a, b in v if model.lam * x > model.log_k + np.log(k)) for v, k in zip(segs, np.maximum(n, 1), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(s), pa.array(spans, pa.string())], names=["doc_id", "score", "spans"])

    return score


def toxicity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", cut: float = 0.7) -> DataFrame:
    """(doc_id, score, predicted, spans) of each row: score is the probability of label 1, predicted is 1 from ``cut`` on, spans lists the significant segments as first:last+1 in tokens.

    Null and empty texts have no segments and the score of least evidence. Repeated rows, null ids and empty
    tables pass through; other columns are ignored. Without labelled rows every score is 0.5.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out = base.mapInArrow(_scorer(model), "doc_id long, score double, spans string")
    return out.withColumn("predicted", (F.col("score") >= cut).cast("int"))


def labelled_texts(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> DataFrame:
    """(text, y) for fit(). The label rows are cut, by the hash of their id, to ``max_train`` first, so that at most so many ids are broadcast."""
    rows = labels.filter("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("y"))
    few = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)
    return docs.select("doc_id", "text").join(F.broadcast(few), "doc_id").select("text", "y")


def op1_toxicity(spark, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = fit(labelled_texts(docs, labels.filter(id_remainder("doc_id", 3) != 1)))
    out = toxicity(docs, model)
    return out.select("doc_id", (id_remainder("doc_id", 3) == 1).alias("held_out"), "score", "predicted", "spans")


QUERIES = {"op1_toxicity": op1_toxicity}
SQL: dict[str, str] = {}
