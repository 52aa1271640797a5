"""Words of whole Arrow string columns as 64-bit hashes, in numpy over the column's own bytes.

A batch is cut into slices of about ``SLICE`` bytes (a longer text is a slice of its own), so that
working memory follows the slice and not the batch. Two words are equal if their 64-bit hashes are;
the chance of any clash among v distinct words is about v*v / 2**65.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE = 1 << 20
MAX_ROWS = 1000
U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x.astype(U, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], U)
_BASE, _STEP = 0xD6E8FEB86659FD93, 0xA24BAED4963EE407
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Words are maximal runs of these bytes. A byte over 0x7F belongs to a word in both classes.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_powers = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(1024, 1 << (n - 1).bit_length())
        have = _powers[base] = np.concatenate([[U(1)], np.cumprod(np.full(size - 1, base, U))]) if size > 1 else np.ones(1, U)
    return have[:n]


@dataclass
class Words:
    """hash: of each word in reading order; doc: its row in the slice; first: the index of each row's first word, and one past the last; start, size: its place in ``low``, the slice's bytes with A-Z lower-cased."""

    hash: np.ndarray
    doc: np.ndarray
    first: np.ndarray
    start: np.ndarray
    size: np.ndarray
    low: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def slices(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """Runs of rows with about SLICE bytes of ``column`` and at most MAX_ROWS rows."""
    at = batch.schema.get_field_index(column)
    text = batch.column(at)
    if pa.types.is_large_string(text.type) or text.null_count:
        text = text.fill_null("").cast(pa.string())
        batch = batch.set_column(at, pa.field(column, pa.string()), text)
    n = batch.num_rows
    off = offsets(text)
    a = 0
    while a < n:
        b = int(np.searchsorted(off, off[a] + SLICE, "right")) - 1
        b = max(a + 1, min(n, b, a + MAX_ROWS))
        yield batch.slice(a, b - a)
        a = b


def offsets(text: pa.Array) -> np.ndarray:
    return np.frombuffer(text.buffers()[1], np.int32)[text.offset : text.offset + len(text) + 1].astype(np.int64)


def raw_bytes(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The column's bytes and each row's first offset in them (and the end)."""
    off = offsets(text) if len(text) else np.zeros(1, np.int64)
    buf = text.buffers()[2]
    data = np.frombuffer(buf, np.uint8)[off[0] : off[-1]] if buf is not None and off[-1] > off[0] else np.empty(0, np.uint8)
    return data, off - off[0]


def words_of(text: pa.Array, kind: np.ndarray = NOT_SPACE) -> Words:
    """Words of each row, with A-Z lower-cased."""
    data, off = raw_bytes(text)
    rows = len(off) - 1
    n = len(data)
    inside = kind[data]
    begins = np.zeros(n + 1, bool)
    begins[off] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | begins[1:n]
    end = inside.copy()
    end[:-1] &= ~inside[1:] | begins[1:n]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    first = np.searchsorted(starts, off)
    low = np.zeros(n + 8, np.uint8)
    np.take(_LOWER, data, out=low[:n])
    eights = np.ndarray((n + 1,), "<u8", low, strides=(1,))  # the 8 bytes from each place on
    size = ends - starts
    out = size.astype(U) * U(_BASE)
    few = np.minimum(size, 8)
    out ^= eights[starts] & _MASKS[few]
    left = np.flatnonzero(size > 8)
    step = 8
    while len(left):
        more = size[left] - step
        if step > 256:  # some very long words: each by itself
            for i in left:
                part = low[starts[i] + step : ends[i]]
                out[i] = mix(out[i : i + 1])[0] + (mix(part.astype(U) + U(1)) * powers(_BASE, len(part))).sum(dtype=U)
            break
        out[left] = mix(out[left]) ^ (eights[starts[left] + step] & _MASKS[np.minimum(more, 8)])
        left = left[more > 8]
        step += 8
    return Words(mix(out), np.repeat(np.arange(rows), np.diff(first)), first, starts, size, low)


def hash_of(word: str) -> int:
    """The hash that words_of gives ``word``."""
    return int(words_of(pa.array([word])).hash[0])


def shingles(w: Words, k: int, short: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of each run of k words; a row of fewer words has its whole sequence as one if ``short``."""
    h, n = w.hash, len(w.hash)
    steps = powers(_STEP, k)
    m = max(0, n - k + 1)
    s = np.zeros(m, U)
    for j in range(k):
        s += h[j : m + j] * steps[j]
    whole = w.doc[:m] == w.doc[k - 1 :] if m else np.empty(0, bool)
    rows, found = [w.doc[:m][whole]], [mix(s[whole] + U(k))]
    if short:
        counts = w.counts
        for length in range(1, k):
            few = np.flatnonzero(counts == length)
            if len(few):
                s = np.zeros(len(few), U)
                for j in range(length):
                    s += h[w.first[few] + j] * steps[j]
                rows.append(few)
                found.append(mix(s + U(length)))
    return np.concatenate(rows), np.concatenate(found)


def sequence_keys(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit keys of each row's word sequence; rows have equal keys if they have equal sequences."""
    rows = len(w.first) - 1
    place = (np.arange(len(w.hash)) - w.first[w.doc]).astype(U)
    out = []
    for salt in (0x8CB92BA72F3D8DD7, 0xAEF17502108EF2D9):
        k = np.zeros(rows, U)
        some = np.flatnonzero(w.counts)
        if len(some):
            k[some] = np.add.reduceat(mix(w.hash + (place + U(1)) * U(salt)), w.first[some])
        out.append(mix(k + w.counts.astype(U)))
    return out[0], out[1]


class Lookup:
    """An open-addressed table from 64-bit hashes to row numbers 0..n-1, read for whole arrays at once."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(10, int(len(keys) * 4 - 1).bit_length()) if len(keys) else 10
        self.keys = np.zeros(1 << self.bits, U)
        self.rows = np.full(1 << self.bits, -1, np.int32)
        left, at = np.arange(len(keys)), self._slot(keys.astype(U))
        self.depth = 0
        while len(left):
            self.depth += 1
            free = self.rows[at] < 0
            slots, who = np.unique(at[free], return_index=True)
            took = left[free][who]
            self.rows[slots], self.keys[slots] = took, keys[took]
            rest = np.ones(len(left), bool)
            rest[np.flatnonzero(free)[who]] = False
            left, at = left[rest], (at[rest] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys >> U(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The row of each key, or -1."""
        at = self._slot(keys)
        row = self.rows[at]
        out = np.where(self.keys[at] == keys, row, -1)
        open_ = np.flatnonzero((out < 0) & (row >= 0))
        at = at[open_]
        for _ in range(1, self.depth):
            if not len(open_):
                break
            at = (at + 1) & ((1 << self.bits) - 1)
            row = self.rows[at]
            hit = (self.keys[at] == keys[open_]) & (row >= 0)
            out[open_[hit]] = row[hit]
            go = ~hit & (row >= 0)
            open_, at = open_[go], at[go]
        return out
