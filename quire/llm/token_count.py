"""Token counts of a byte-fallback BPE vocabulary by heap-and-linked-list merging.

The symbols of a word form a linked list; a heap holds the adjacent pairs that the vocabulary joins, best
score first and leftmost among equals. Popping a pair merges it and offers its two new neighbours. A text
has as many tokens as initial symbols less merges, and as many more as the bytes of symbols that the
vocabulary lacks; no identifiers are made.

No piece of the vocabulary has a space mark behind another character (checked when it is read), so no merge
crosses the start of a run of spaces. The text is therefore cut there, and counts of short parts are kept
in a bounded table. Long parts are merged like the others, in O(n log n).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import documents
from .wordhash import slices

MARK = "▁"
CACHE = 1_000_000  # parts whose counts a worker keeps
LONGEST = 32  # characters of a part that is kept
_loaded: dict = {}


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Merges:
    """Scores of the pieces that merges may form."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        spec, kinds = model.normalizer_spec, pb.ModelProto.SentencePiece
        plain = not spec.precompiled_charsmap and spec.escape_whitespaces and not spec.remove_extra_whitespaces
        if model.trainer_spec.model_type != 2 or not plain or any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in model.pieces):
            raise ValueError(f"{path}: not a BPE vocabulary with plain normalisation")
        self.fallback = model.trainer_spec.byte_fallback
        self.prefix = spec.add_dummy_prefix
        self.score = {p.piece: p.score for p in model.pieces if p.type == kinds.NORMAL}
        if any(re.search(f"[^{MARK}]{MARK}", p) for p in self.score):
            raise ValueError(f"{path}: pieces cross the start of a word")
        self.seen: dict[str, int] = {}

    def count_part(self, part: str) -> int:
        score, n = self.score, len(part)
        right = list(range(1, n + 1))
        left = list(range(-1, n - 1))
        end = right[:]  # of the symbol that starts here, or 0 once it is part of another
        heap = [(-score[p], i, i + 2) for i in range(n - 1) if (p := part[i : i + 2]) in score]
        heapify(heap)
        merges = 0
        while heap:
            _, i, e = heappop(heap)
            j = right[i]
            if not end[i] or j >= n or end[j] != e:
                continue
            merges += 1
            end[i], end[j] = e, 0
            right[i] = k = right[j]
            if k < n:
                left[k] = i
                if (p := part[i : end[k]]) in score:
                    heappush(heap, (-score[p], i, end[k]))
            h = left[i]
            if h >= 0 and (p := part[h:e]) in score:
                heappush(heap, (-score[p], h, e))
        more = 0
        for c in set(part):
            if c not in score and self.fallback:
                more += part.count(c) * (len(c.encode("utf-8", "surrogatepass")) - 1)
        return n - merges + more

    def count(self, text: str) -> int:
        if not text:
            return 0
        text = text.replace(" ", MARK)
        if self.prefix:
            text = MARK + text
        seen, total = self.seen, 0
        for part in _parts(text):
            n = seen.get(part)
            if n is None:
                n = self.count_part(part)
                if len(part) <= LONGEST:
                    if len(seen) >= CACHE:
                        seen.clear()
                    seen[part] = n
            total += n
        return total


def _parts(text: str) -> list[str]:
    """The text cut before each run of space marks."""
    if MARK * 2 in text or text[0] != MARK:
        return re.findall(f"{MARK}*[^{MARK}]+|{MARK}+", text)
    return [MARK + x for x in text[1:].split(MARK)]


def merges_of(path: str) -> Merges:
    if path not in _loaded:
        _loaded[path] = Merges(path)
    return _loaded[path]


def _counter(path: str):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges = merges_of(path)
        for batch in batches:
            for part in slices(batch, "text"):
                texts = part.column(1)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.compute.binary_length(texts).cast(pa.int64()), pa.array(np.array([merges.count(t) for t in texts.to_pylist()], np.int64))], names=["doc_id", "n_bytes", "n_tokens"])

    import pyarrow.compute  # noqa: F401

    return count


def token_counts(docs: DataFrame, model_path: str | None = None, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of each row of ``docs``: UTF-8 bytes and tokens of the whole text, without begin and end tokens.

    model_path: a sentencepiece BPE model, at a place that every executor has. A null text counts as empty and an
    empty text has no tokens. Repeated rows, null ids and empty tables pass through; other columns are ignored.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out = base.mapInArrow(_counter(model_path or default_model()), "doc_id long, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)


def op10_token_count(spark, sf_dir: str) -> DataFrame:
    return token_counts(documents(spark, sf_dir))


QUERIES = {"op10_token_count": op10_token_count}
SQL: dict[str, str] = {}
