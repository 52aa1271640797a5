"""Embedding and language models behind small interfaces, with deterministic ones for tests."""

from __future__ import annotations

import hashlib
import json
import time
import urllib.request
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import EmbeddingFailed
from ..functions import text as T
from ..functions import vectors as V
from ..settings import Endpoint

BATCH, ATTEMPTS, PAUSE = 16, 4, 1.5


class HashEmbedder:
    """Signed hashes of words, summed; equal texts have equal vectors and shared words bring texts closer."""

    def __init__(self, dimension: int = 64):
        self.dimension = dimension

    def request(self, texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), self.dimension))
        for i, t in enumerate(texts):
            for w in t.lower().split() or [" "]:
                h = hashlib.blake2b(w.encode(), digest_size=8).digest()
                out[i, int.from_bytes(h[:4], "little") % self.dimension] += 1 if h[4] & 1 else -1
        return out.tolist()


class HttpEmbedder:
    """A server with the usual ``/embeddings`` route; answers are put in the order of their index."""

    def __init__(self, endpoint: Endpoint, timeout: float = 900.0):
        self.endpoint, self.timeout = endpoint, timeout

    def request(self, texts: list[str]) -> list[list[float]]:
        body = json.dumps({"model": self.endpoint.model, "input": texts}).encode()
        head = {"Content-Type": "application/json", "Authorization": f"Bearer {self.endpoint.api_key}"}
        with urllib.request.urlopen(urllib.request.Request(f"{self.endpoint.base_url}/embeddings", body, head), timeout=self.timeout) as r:
            data = json.load(r)["data"]
        return [d["embedding"] for d in sorted(data, key=lambda d: d["index"])]


def embed_batch(model, texts: list[str], sleep: Callable[[float], None] = time.sleep) -> list[list[float]]:
    """One request, tried ATTEMPTS times with doubling pauses."""
    for i in range(ATTEMPTS):
        try:
            out = model.request(texts)
            break
        except Exception as e:
            if i == ATTEMPTS - 1:
                raise EmbeddingFailed(f"{type(e).__name__}: {e}") from e
            sleep(PAUSE * 2**i)
    if len(out) != len(texts):
        raise EmbeddingFailed(f"{len(out)} vectors for {len(texts)} texts")
    return out


def embed(df: DataFrame, model, text: str = "text", done=None) -> DataFrame:
    """``df`` with unit vectors of ``text`` as ``embedding`` array<float>. Requests run in the executors, BATCH texts each; a failed task is tried again by Spark.

    done: an accumulator that counts embedded texts as tasks end.
    """
    from pyspark.sql import types as P

    prepared = df.withColumn("__prepared", F.coalesce(F.nullif(T.strip(F.coalesce(text, F.lit(""))), F.lit("")), F.lit(" ")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a in range(0, b.num_rows, BATCH):
                part = b.slice(a, BATCH)
                vectors = embed_batch(model, part.column(part.num_columns - 1).to_pylist())
                if done is not None:
                    done.add(part.num_rows)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(vectors, pa.list_(pa.float64()))], names=[*part.schema.names[:-1], "embedding"])

    schema = P.StructType([*df.schema.fields, P.StructField("embedding", P.ArrayType(P.DoubleType()))])
    return prepared.mapInArrow(run, schema).withColumn("embedding", V.normalise("embedding").cast("array<float>"))


def embed_one(model, text: str) -> list[float]:
    v = np.array(embed_batch(model, [text.strip() or " "])[0])
    n = np.linalg.norm(v)
    return (v / n if n else v).tolist()


def dimension(model) -> int:
    known = getattr(model, "dimension", None)
    return known or len(embed_one(model, "probe"))


class HttpChat:
    """A server with the usual streamed ``/chat/completions`` route."""

    def __init__(self, endpoint: Endpoint, temperature: float = 0.3, timeout: float = 900.0):
        self.endpoint, self.temperature, self.timeout = endpoint, temperature, timeout

    def complete(self, messages: list[dict], response_format: dict | None, on_token: Callable[[int, int], None] | None = None) -> str:
        body = {"model": self.endpoint.model, "messages": messages, "temperature": self.temperature, "stream": True}
        if response_format:
            body["response_format"] = response_format
        head = {"Content-Type": "application/json", "Authorization": f"Bearer {self.endpoint.api_key}"}
        with urllib.request.urlopen(urllib.request.Request(f"{self.endpoint.base_url}/chat/completions", json.dumps(body).encode(), head), timeout=self.timeout) as r:
            parts = (json.loads(line[5:]) for line in r if line.startswith(b"data:") and line[5:].strip() != b"[DONE]")
            return collect_stream(parts, on_token)


def collect_stream(parts, on_token=None) -> str:
    """The content of a streamed reply; reasoning is counted apart and parts without choices are passed over."""
    out, thought = [], 0
    for part in parts:
        if not part.get("choices"):
            continue
        delta = part["choices"][0].get("delta") or {}
        thinking, piece = delta.get("reasoning_content") or delta.get("reasoning"), delta.get("content")
        thought += bool(thinking)
        if piece:
            out.append(piece)
        if on_token and (thinking or piece):
            on_token(len(out), thought)
    return "".join(out)
