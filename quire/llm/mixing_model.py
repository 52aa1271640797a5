"""Language-model scores by online logistic context mixing.

A text is a sequence of lower-cased words and one end mark. A word is coded byte by byte and closed by a blank, the end
mark is a blank alone, and a byte is coded by binary decisions, along a Huffman tree of the training bytes. Each decision
has several predictors: the last two, three and four bytes of the word so far, the two along with the last short word of
the text, name with the decision a slot of a hashed table that counts ones over all training texts. Their predictions,
stretched and scaled by confidence, are combined by weights that the decision and the place in the word select
(the gate) and that are learned online by the coding error; a final table refines the result adaptively. So every
string has a price, unknown words pay for their bytes, and the prices of all strings add up to one.

Words of the training texts also have a share of their own, by their count; the short word before says how far it is
trusted. And a text falls into phrases, each closed by a word whose hash says so (one in PHRASE): a phrase is priced as the mean
of its words and of its own share among all training phrases. Words and phrases are counted over all training
texts, exactly, by shuffles that grow with them; only the counts of words that make up more than 1/HEAVY of all tokens, of
which there are less than HEAVY, travel to the tasks. Rarer words, and phrases, meet their counts in shards by hash, in packed arrays; one that makes up more
than 1/COMMON of what is sent does not go to a shard, but its count travels to the tasks. How far a text trusts phrases is told by the text itself: its
probability is the mean over trials, one without phrases and one for each of LAMBDAS. (Beside phrases, rare words
have no share: two joined counts do not make one sum of logarithms.)

A training text is scored by what the others taught: its own tokens are taken out of the counts of words and phrases. (Not out
of the byte tables, where no slot hangs on one text.) What the byte model learns depends on the distinct words, the short
words before them and how often each occurs; they are counted first, and the model learns from that table. These counts too
are added up from packed arrays, shard by shard. What a byte adds to the tables, and its price, depend on its event alone (see
Spelling), so both are worked out once for bytes of one event.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from contextlib import contextmanager
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import discard, documents, id_remainder, kept, scratch
from .wordhash import U, Lookup, mix, slices, words_of

END = 0x1D8AF066F1E2C7B3
BLANK = 32
SHORT, CUES = 3, 64  # bytes of a word that is a cue at most, and classes of them; 0: none yet
CONTEXTS = ((2, True), (3, False), (4, False))  # last bytes, and whether with the cue
DEPTH = CONTEXTS[-1][0]
ORDERS, SLOT_BITS = len(CONTEXTS), 19  # slots of each context's table, as a power of two
SLOTS, N_SLOTS = 1 << SLOT_BITS, ORDERS << SLOT_BITS
PLACES = 3  # of a byte in its word: first, second, later
PHRASE = 6
HEAVY = 1 << 21
COMMON, SHARD, HELD = 1 << 17, 1 << 19, 1 << 18  # keys that a shard gets on average, and that a task gathers before it sends them
LAMBDAS = (2.0**-5, 0.5, 1 - 2.0**-5)
START_TRUST = 0.5
BLOCK, STEP, RATE = 8192, 64.0, 0.004  # bytes of an online step, and those of a gate that count in full
UNITS_A_TASK, LEAST_TASKS = 500_000, 8  # distinct words that one task learns from; both follow from the data alone, and so does what is learned
FINE = 16  # steps of a worth in an octave
UNITS_HELD, UNIT_SHARDS = 400_000, 4096  # distinct words of slices that a task adds up before it sends them or reads them again, and shards in which it sends them
SLOTS_SENT, BATCH = 4096, "4m"  # slots that are added up together, and bytes that travel between Spark and Python at once
EVENTS_HELD = 1 << 18  # bytes of words that a task adds up before it counts them
PRICED, PRICED_BYTES = 1 << 18, 1 << 20  # slots in which a task remembers the prices of words, and of bytes in their contexts


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order of the keys, where in it each distinct one begins)."""
    order = np.argsort(keys)
    keys = keys[order]
    return order, np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]][: len(keys)])


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place of one of each distinct key, ascending; which distinct key each one is; how many there are of each). Equal keys are not kept in order, so it sorts faster than np.unique."""
    order, first = _runs(keys)
    many = np.diff(np.append(first, len(keys)))
    which = np.empty(len(keys), np.int64)
    which[order] = np.repeat(np.arange(len(first)), many)
    return order[first], which, many


class Slice:
    """The tokens of some texts: hash, doc, cue, own (how often the text has it); and units, the distinct words by cue."""

    def __init__(self, text: pa.Array):
        w = words_of(text)
        rows = len(w.first) - 1
        self.n, self.low = w.counts + 1, w.low
        self.first = w.first[:-1] + np.arange(rows)
        at = np.arange(len(w.hash)) + w.doc
        self.hash = np.full(len(w.hash) + rows, END, U)
        self.hash[at] = w.hash
        self.doc = np.repeat(np.arange(rows), self.n)
        start, size = np.zeros(len(self.hash), np.int64), np.zeros(len(self.hash), np.int64)
        start[at], size[at] = w.start, w.size
        place = np.arange(len(self.hash))
        near = np.where((size > 0) & (size <= SHORT), place, -1)
        last = np.r_[-1, np.maximum.accumulate(near)[:-1]]
        self.cue = np.where(last >= self.first[self.doc], 1 + (self.hash[last] >> U(58)).astype(np.int64), 0)
        key = mix(self.hash + self.cue.astype(U))
        lead, self.unit, self.many = _distinct(key)
        self.key, self.lead, self.start, self.size = key[lead], lead, start[lead], size[lead]

    @cached_property
    def own(self) -> np.ndarray:
        return self.count(self.hash)

    def in_doc(self, keys: np.ndarray, doc: np.ndarray | None = None) -> np.ndarray:
        return mix(keys + mix((self.doc if doc is None else doc).astype(U)))

    def count(self, keys: np.ndarray) -> np.ndarray:
        """How often each token's key occurs in its text."""
        _, each, count = _distinct(self.in_doc(keys))
        return count[each]

    def closes(self) -> np.ndarray:
        """The last token of each phrase."""
        return np.flatnonzero((self.hash % U(PHRASE) == 0) | (self.hash == U(END)))

    def phrases(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first token, doc, key) of each phrase; the end mark closes the last one."""
        begin = np.r_[0, self.closes()[:-1] + 1]
        since = np.arange(len(self.hash)) - np.repeat(begin, np.diff(np.r_[begin, len(self.hash)]))
        key = np.add.reduceat(mix(self.hash + mix(since.astype(U) + U(0x5851F42D))), begin)
        return begin, self.doc[begin], mix(key)


class Codes:
    """A Huffman tree over the 256 bytes: the decisions on the way to each, as (node, bit)."""

    def __init__(self, counts: np.ndarray):
        heap = [(float(c) + 0.5, i, i) for i, c in enumerate(counts)]
        heapq.heapify(heap)
        children: dict[int, tuple[int, int]] = {}
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            children[256 + len(children)] = (a[2], b[2])
            heapq.heappush(heap, (a[0] + b[0], 255 + len(children), 255 + len(children)))
        paths: list[list[tuple[int, int]]] = [[] for _ in range(256)]
        stack = [(heap[0][2], [])]
        while stack:
            node, path = stack.pop()
            if node < 256:
                paths[node] = path
            else:
                stack += [(child, [*path, (node - 256, bit)]) for bit, child in enumerate(children[node])]
        self.length = np.array([len(p) for p in paths])
        self.start = np.cumsum(self.length) - self.length  # of each byte's decisions in node and bit
        self.node, bit = np.array([step for path in paths for step in path], np.int32).T.copy()
        self.bit = bit.astype(bool)
        self.step = (np.arange(256, dtype=np.int64) * 0x9E3779B1 & (SLOTS - 1)).astype(np.int32)[self.node]


_SHOWN = np.array([(0xFFFFFFFF << 8 * (DEPTH - k)) & 0xFFFFFFFF for k in range(DEPTH + 1)], np.uint32)  # of the last bytes, those that the word has so far
_HIDDEN = np.uint32(BLANK * 0x01010101) & ~_SHOWN


class Spelling:
    """The bytes and closing blanks of distinct words, and a hash of each context.

    All that prices a byte is its event: the cue, the last bytes of the word so far (blanks before its first) and the byte.
    """

    def __init__(self, codes: Codes, low: np.ndarray, start: np.ndarray, size: np.ndarray, cue: np.ndarray, many: np.ndarray):
        n = size + 1
        self.codes, self.many = codes, many
        self.first = np.cumsum(n) - n
        self.word = np.repeat(np.arange(len(n)), n)
        self.place = np.arange(len(self.word)) - np.repeat(self.first, n)
        text = np.full(len(self.word) + DEPTH, BLANK, np.uint8)
        self.symbol = text[DEPTH:]
        inside = np.ones(len(self.word), bool)
        inside[self.first + size] = False
        self.symbol[inside] = low[(np.repeat(start, n) + self.place)[inside]]
        so_far = np.minimum(self.place, DEPTH)
        last = np.ndarray((len(self.word),), "<u4", text, strides=(1,))  # the last byte is the highest
        self.event = (np.repeat(cue.astype(U) << U(40), n)) | (((last & _SHOWN[so_far]) | _HIDDEN[so_far]).astype(U) << U(8)) | self.symbol

    @classmethod
    def of_events(cls, codes: Codes, event: np.ndarray, many: np.ndarray) -> Spelling:
        """Each event by itself."""
        self = cls.__new__(cls)
        self.codes, self.many, self.event = codes, many, event
        self.first = self.word = np.arange(len(event))
        self.symbol = (event & U(255)).astype(np.uint8)
        one, two = ((event >> U(at) & U(255)) != U(BLANK) for at in (32, 24))
        self.place = one.astype(np.int64) + (one & two)  # as far as gates tell them apart
        return self

    @cached_property
    def context(self) -> list[np.ndarray]:
        last, told = self.event >> U(8) & U(0xFFFFFFFF), self.event >> U(40) << U(40)
        return [(mix((last >> U(8 * (DEPTH - size))) + (U(size) << U(56)) + (told if with_cue else U(0))) & U(SLOTS - 1)).astype(np.int32) for size, with_cue in CONTEXTS]

    def decisions(self, a: int, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
        """(first decision of each byte from a to b, and of each decision: its byte, gate, bit and the slot of each context)."""
        symbol, codes = self.symbol[a:b], self.codes
        n = codes.length[symbol]
        first = np.cumsum(n) - n
        of = np.repeat(np.arange(b - a), n)
        at = np.arange(len(of)) + (codes.start[symbol] - first)[of]
        step = codes.step[at]
        gate = codes.node[at] + (256 * np.minimum(self.place[a:b], PLACES - 1))[of]
        return first, of + a, gate, codes.bit[at], [((h[a:b][of] + step) & np.int32(SLOTS - 1)) + np.int32(k << SLOT_BITS) for k, h in enumerate(self.context)]


def summed_by(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct keys, ascending, and the sum of n of each)."""
    order, first = _runs(keys)
    return keys[order[first]], np.add.reduceat(n[order], first) if len(first) else n


def stretch(ones: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.log((ones + np.float32(0.4)) / (n - ones + np.float32(0.4))) * (n / (n + np.float32(2.0)))


def squash(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -14, 14)))


class Mixer:
    """Counts of the slots, weights of the gates, the refining table and the trust in words' own shares by cue."""

    def __init__(self, n: np.ndarray, ones: np.ndarray):
        self.n, self.ones = n.astype(np.float32), ones.astype(np.float32)
        self.weight = np.full((256 * PLACES, ORDERS + 1), 0.3, np.float32)
        self.weight[:, -1] = 0
        self.refine = squash(np.arange(-16, 17) / 2)
        self.trust = np.full(CUES + 1, START_TRUST)

    def prepare(self) -> None:
        """Predictions of each slot without one occurrence, of a nought and of a one."""
        less = np.maximum(self.n - 1, 0)
        self.without = np.concatenate([stretch(np.clip(self.ones - bit, 0, less), less) for bit in (0, 1)])

    def freeze(self) -> None:
        self.table = stretch(self.ones, self.n).astype(np.float32)
        self.n = self.ones = None

    @staticmethod
    def cell(z: np.ndarray) -> np.ndarray:
        return (np.clip(z * 2, -16, 16) + np.float32(16.5)).astype(np.int32)

    def learn(self, s: Spelling, seen: np.ndarray, seen_refine: np.ndarray) -> np.ndarray:
        """Online, block by block; a decision's own occurrence is taken out of its predictions. Returns log p of each word; seen: get the visits of gates and cells."""
        cost, m = np.zeros(len(s.symbol)), s.many[s.word].astype(np.float32)
        for a in range(0, len(s.symbol), BLOCK):
            first, of, gate, bit, slots = s.decisions(a, min(a + BLOCK, len(s.symbol)))
            mass = m[of]
            one = np.multiply(bit, mass, dtype=float)
            z, x, side = self.weight[:, -1][gate], [], bit * np.int32(N_SLOTS)
            for k, slot in enumerate(slots):
                x.append(self.without[slot + side])
                z += x[k] * self.weight[:, k][gate]
            p = squash(z)
            cost[a : a + BLOCK] = np.add.reduceat(np.log(np.where(bit, p, 1 - p)), first)
            error = one - p * mass
            visits = np.bincount(gate, mass, len(self.weight))
            rate = RATE * np.minimum(1, STEP / np.maximum(visits, 1))
            for k in range(ORDERS):
                self.weight[:, k] += rate * np.bincount(gate, error * x[k], len(self.weight))
            self.weight[:, -1] += rate * np.bincount(gate, error, len(self.weight))
            cell = self.cell(z).astype(np.int64)
            cells = np.bincount(cell, mass, 33)
            mean = np.bincount(cell, one, 33) / np.maximum(cells, 1)
            self.refine += (1 - 0.9995**cells) * (mean - self.refine)
            seen += visits
            seen_refine += cells
        return np.add.reduceat(cost, s.first) if len(s.first) else cost

    def log_p(self, s: Spelling) -> np.ndarray:
        """The natural logarithm of each word's probability."""
        cost = np.zeros(len(s.symbol))
        refine = self.refine.astype(np.float32)
        for a in range(0, len(s.symbol), BLOCK):
            first, _, gate, bit, slots = s.decisions(a, min(a + BLOCK, len(s.symbol)))
            z = self.weight[:, -1][gate]
            for k, slot in enumerate(slots):
                z += self.weight[:, k][gate] * self.table[slot]
            p = (squash(z) + refine[self.cell(z)]) / 2
            cost[a : a + BLOCK] = np.add.reduceat(np.log(np.where(bit, p, 1 - p)), first, dtype=float)
        return np.add.reduceat(cost, s.first) if len(s.first) else cost


def _grouped(group: np.ndarray, columns: dict[str, np.ndarray], name: str = "shard") -> pa.RecordBatch:
    """A row for each group: its number, and of each column the bytes of the group's values, in their order."""
    order = np.argsort(group, kind="stable")
    first = np.flatnonzero(np.diff(group[order], prepend=-1))
    arrays = [pa.array(group[order[first]].astype(np.int32))]
    for values in columns.values():
        ends = np.append(first, len(group)) * values.itemsize
        arrays.append(pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(values[order].tobytes())]))
    return pa.RecordBatch.from_arrays(arrays, names=[name, *columns])


def _values(column: pa.Array, kind: str) -> np.ndarray:
    """What all rows of a packed column hold, one row after another."""
    off = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int32)
    return np.frombuffer(column.buffers()[2], np.uint8)[off[0] : off[-1]].view(kind) if off[-1] > off[0] else np.empty(0, kind)


@contextmanager
def _batches(spark: SparkSession) -> Iterator[None]:
    """Rows of packed arrays, and texts, go to Python in batches of BATCH bytes."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, BATCH)
    try:
        yield
    finally:
        spark.conf.set(key, before)


class Counts:
    """What travels of the word counts: those of heavy words, and how many tokens and phrases there are."""

    def __init__(self, total: int, phrases: int, heavy: np.ndarray, count: np.ndarray):
        self.total, self.phrases, self.lookup, self.count = total, phrases, Lookup(heavy), np.append(count, 0)

    def of(self, hashes: np.ndarray) -> np.ndarray:
        """The count of each word that is heavy, else 0."""
        return self.count[self.lookup.find(hashes)]


def _binary(low: np.ndarray, start: np.ndarray, size: np.ndarray) -> pa.Array:
    off = np.r_[0, np.cumsum(size)]
    data = low[np.arange(off[-1]) + np.repeat(start - off[:-1], size)]
    return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(off.astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())])


ALL_PHRASES = -1  # stands for the cue in the row that counts phrases


def _unit_counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, cue, n) of the distinct words by cue, and how many phrases the texts hold."""
    held, size, phrases = [], 0, 0

    def flush() -> pa.RecordBatch:
        token, cue, n, words = zip(*held, strict=True)
        token, cue, n = np.concatenate(token), np.concatenate(cue), np.concatenate(n)
        lead, at, _ = _distinct(mix(token + cue.astype(U)))
        return pa.RecordBatch.from_arrays([pa.concat_arrays(words).take(pa.array(lead)), pa.array(cue[lead].astype(np.int32)), pa.array(np.bincount(at, n).astype(np.int64))], names=["word", "cue", "n"])

    for batch in batches:
        for part in slices(batch, "text"):
            s = Slice(part.column(0))
            held.append((s.hash[s.lead], s.cue[s.lead], s.many, _binary(s.low, s.start, s.size)))
            size, phrases = size + len(s.lead), phrases + len(s.closes())
            if size > UNITS_HELD:
                yield flush()
                held, size = [], 0
    if held:
        yield flush()
    if phrases:
        yield pa.RecordBatch.from_arrays([pa.array([b""], pa.binary()), pa.array([ALL_PHRASES], pa.int32()), pa.array([phrases], pa.int64())], names=["word", "cue", "n"])


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, cue, n) with the hash of the word as ``token``."""
    for batch in batches:
        words = words_of(batch.column(0).view(pa.string()))
        token = np.full(batch.num_rows, END, U)  # the empty word
        token[words.doc] = words.hash
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(token.view(np.int64))], names=["word", "cue", "n", "token"])


UNITS = "shard int, token binary, cue binary, n binary, size binary, word binary"


def _send_units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packed rows of what _unit_counter gives, by shards of the words' hashes."""
    for b in _tokens(_unit_counter(batches)):
        token = b.column(3).to_numpy().view(U)
        shard = (token >> U(30)).astype(np.int64) % UNIT_SHARDS
        order = np.argsort(shard, kind="stable")
        words = b.column(0).take(pa.array(order))
        size = pa.compute.binary_length(words).to_numpy().astype("<u4")
        out = _grouped(shard[order], {"token": token[order].astype("<u8"), "cue": b.column(1).to_numpy()[order].astype("<i4"), "n": b.column(2).to_numpy()[order].astype("<i8"), "size": size})
        ends = np.append(0, np.cumsum(size, dtype=np.int64))[np.append(0, np.cumsum(pa.compute.binary_length(out.column("size")).to_numpy() // 4))]
        data = pa.Array.from_buffers(pa.binary(), out.num_rows, [None, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(_values(words, "<u1").tobytes())])
        yield pa.RecordBatch.from_arrays([*out.columns, data], names=[*out.schema.names, "word"])


def _add_units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, cue, n, token, c) of packed rows that come shard by shard; c: how often the word occurs with any cue, in one row of each word, else 0."""
    held, size, last = [], 0, None

    def flush() -> pa.RecordBatch:
        token, cue, n, length, word = (np.concatenate(x) for x in zip(*held, strict=True))
        key = mix(token + cue.astype(U))
        order, first = _runs(key)
        lead, n = order[first], np.add.reduceat(n[order], first)
        token, cue, length, start = token[lead], cue[lead], length[lead].astype(np.int64), (np.cumsum(length, dtype=np.int64) - length)[lead]
        order, first = _runs(token)
        c = np.zeros(len(token), np.int64)
        c[order[first]] = np.add.reduceat(np.where(cue == ALL_PHRASES, 0, n)[order], first)
        return pa.RecordBatch.from_arrays([_binary(word, start, length), pa.array(cue), pa.array(n), pa.array(token.view(np.int64)), pa.array(c)], names=["word", "cue", "n", "token", "c"])

    for batch in batches:
        shards = batch.column("shard").to_numpy()
        begins = np.flatnonzero(np.diff(shards, prepend=-1))
        for a, b in zip(begins, np.append(begins[1:], len(shards)), strict=True):
            if size > UNITS_HELD and shards[a] != last:
                yield flush()
                held, size = [], 0
            held.append(tuple(_values(batch.column(name).slice(a, b - a), kind).copy() for name, kind in (("token", "<u8"), ("cue", "<i4"), ("n", "<i8"), ("size", "<u4"), ("word", "<u1"))))
            size, last = size + len(held[-1][0]), shards[a]
    if held:
        yield flush()


def _spelled(part: pa.RecordBatch, codes: Codes) -> Spelling:
    """Of a part of (word, cue, n)."""
    words = part.column(0)
    off = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    low = np.frombuffer(words.buffers()[2], np.uint8) if words.buffers()[2] is not None and off[-1] else np.full(1, BLANK, np.uint8)
    return Spelling(codes, low, off[:-1], np.diff(off), part.column(1).to_numpy().astype(np.int64), part.column(2).to_numpy())


def _byte_counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(256)
    flat = Codes(np.zeros(256))
    for batch in batches:
        s = _spelled(batch, flat)
        total += np.bincount(s.symbol, s.many[s.word], 256)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(256, dtype=np.int32)), pa.array(total)], names=["symbol", "n"])


def _slot_counter(codes: Codes):
    """(slot, n, ones) of the slots that the task's words reach. Equal bytes in equal contexts are added up before they are taken apart into decisions."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, ones = np.zeros(N_SLOTS), np.zeros(N_SLOTS)
        held, size = [], 0

        def flush() -> None:
            event, total = summed_by(*(np.concatenate(x) for x in zip(*held, strict=True)))
            for k, (length, with_cue) in enumerate(CONTEXTS):
                tells = 255 | int(_SHOWN[length]) << 8 | (0xFFFFFF << 40 if with_cue else 0)
                s = Spelling.of_events(codes, *summed_by(event & U(tells), total))
                for a in range(0, len(s.symbol), BLOCK):
                    _, of, _, bit, slots = s.decisions(a, min(a + BLOCK, len(s.symbol)))
                    many_of, one = s.many[of], np.flatnonzero(bit)
                    np.add.at(n, slots[k], many_of)
                    np.add.at(ones, slots[k][one], many_of[one])

        for batch in batches:
            s = _spelled(batch, codes)
            held.append((s.event, s.many[s.word].astype(float)))
            size += len(s.event)
            if size > EVENTS_HELD:
                flush()
                held, size = [], 0
        if size:
            flush()
        some = np.flatnonzero(n)
        for a in range(0, len(some), 100_000):
            at = some[a : a + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(n[at].astype(np.int64)), pa.array(ones[at].astype(np.int64))], names=["slot", "n", "ones"])

    return count


def _send_slots(count):
    """Packed rows of what a slot counter gives, by runs of SLOTS_SENT slots."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in count(batches):
            slot, n, ones = (c.to_numpy() for c in b.columns)
            yield _grouped(slot // SLOTS_SENT, {"slot": slot, "n": n, "ones": ones})

    return send


def _add_slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for b in batches:
        for i, shard in enumerate(b.column("shard").to_pylist()):
            slot, n, ones = (_values(b.column(name).slice(i, 1), kind) for name, kind in (("slot", "<i4"), ("n", "<i8"), ("ones", "<i8")))
            mine = total.setdefault(shard, np.zeros((2, SLOTS_SENT), np.int64))
            mine[:, slot - shard * SLOTS_SENT] += np.stack([n, ones])  # a slot occurs once in a row
    for shard, (n, ones) in total.items():
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array((some + shard * SLOTS_SENT).astype(np.int32)), pa.array(n[some]), pa.array(ones[some])], names=["slot", "n", "ones"])


def _learner(codes: Codes, mixer: Mixer, counts: Counts):
    """What a task makes of the parameters with its words, as sums weighted by visits. The slots: weights, the refining table, the trusts."""

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = mixer.weight, mixer.refine
        mixer.weight, mixer.refine = before[0].copy(), before[1].copy()
        mixer.prepare()
        seen, seen_refine = np.zeros(len(mixer.weight)), np.zeros(len(mixer.refine))
        trusted, met = np.zeros(CUES + 1), np.zeros(CUES + 1)
        for batch in batches:
            s = _spelled(batch, codes)
            log_p, cue = mixer.learn(s, seen, seen_refine), batch.column(1).to_numpy()
            a = START_TRUST * np.maximum(counts.of(batch.column(3).to_numpy().astype(np.int64).view(U)) - 1, 0) / max(counts.total - 1, 1)
            b = (1 - START_TRUST) * np.exp(log_p)
            trusted += np.bincount(cue, s.many * a / np.maximum(a + b, 1e-300), CUES + 1)
            met += np.bincount(cue, s.many, CUES + 1)
        value = np.concatenate([mixer.weight.ravel(), mixer.refine, trusted / np.maximum(met, 1)])
        visits = np.concatenate([np.repeat(seen, mixer.weight.shape[1]), seen_refine, met])
        mixer.weight, mixer.refine = before
        mixer.without = None
        some = np.flatnonzero(visits)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(value[some] * visits[some]), pa.array(visits[some])], names=["slot", "value", "visits"])

    return learn


def _worth(log_ratio: np.ndarray) -> np.ndarray:
    """What one occurrence elsewhere adds, relative to what is there without it: rounded down, so that chances never sum to more than one."""
    return np.clip(np.floor(log_ratio / np.log(2) * FINE), -32768, 32767).astype(np.int32)


def _scorer(codes: Codes, mixer: Mixer, counts: Counts):
    def packed(keys: np.ndarray, own: np.ndarray, worth: np.ndarray, doc: np.ndarray, s: Slice) -> list[pa.Array]:
        """Of each text the distinct (key, worth), with their number and how often the text has the key: four columns of bytes."""
        lead, _, tf = _distinct(s.in_doc(mix(keys + worth.astype(np.int64).view(U)), doc))
        order = np.argsort(doc[lead], kind="stable")
        lead, tf = lead[order], tf[order]
        off = np.searchsorted(doc[lead], np.arange(len(s.n) + 1))
        values = (keys[lead].astype("<u8"), tf.astype("<u4"), own[lead].astype("<u4"), worth[lead].astype("<i2"))
        return [pa.Array.from_buffers(pa.binary(), len(s.n), [None, pa.py_buffer((off * v.itemsize).astype(np.int32).tobytes()), pa.py_buffer(v.tobytes())]) for v in values]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logs = np.append(np.log10(counts.count[:-1] + 1.0), 0.0)
        named, prices = np.zeros(PRICED, U), np.zeros(PRICED)
        told, costs = np.zeros(PRICED_BYTES, U), np.zeros(PRICED_BYTES)  # no event is 0

        def spelled_out(s: Spelling) -> np.ndarray:
            """The same as the mixer's log_p: an event has one price."""
            slot = (s.event * U(0x9E3779B97F4A7C15) >> U(40)).astype(np.int64) % PRICED_BYTES
            cost = costs[slot]
            new = np.flatnonzero(told[slot] != s.event)
            lead, at, _ = _distinct(s.event[new])
            event = s.event[new[lead]]
            price = mixer.log_p(Spelling.of_events(codes, event, np.ones(len(event))))
            cost[new] = price[at]
            told[slot[new[lead]]], costs[slot[new[lead]]] = event, price
            return np.add.reduceat(cost, s.first) if len(s.first) else cost

        def priced(s: Slice) -> np.ndarray:
            """The natural logarithm of each distinct word's probability; most were priced in a slice before."""
            slot = (s.key % U(PRICED)).astype(np.int64)
            log_p = prices[slot]
            new = np.flatnonzero(named[slot] != s.key)
            log_p[new] = spelled_out(Spelling(codes, s.low, s.start[new], s.size[new], s.cue[s.lead[new]], s.many[new]))
            named[slot[new]], prices[slot[new]] = s.key[new], log_p[new]
            return log_p

        for batch in batches:
            for part in slices(batch, "text"):
                s = Slice(part.column(1))
                trained = np.array(part.column(2).to_pylist(), bool)
                spelled = priced(s)[s.unit]
                trust, at = mixer.trust[s.cue], counts.lookup.find(s.hash)
                others = np.maximum(counts.total - (s.n * trained)[s.doc], 1)
                share = np.maximum(counts.count[at] - s.own * trained[s.doc], 0) / others
                spelled += np.log(1 - trust)
                with np.errstate(divide="ignore"):
                    log_p = np.logaddexp(np.log(trust * share), spelled)
                rare = np.flatnonzero(at < 0)
                words = packed(s.hash[rare], s.own[rare], _worth(np.log(trust / others) - spelled)[rare], s.doc[rare], s)
                begin, doc, key = s.phrases()
                _, each, many = _distinct(s.in_doc(key, doc))
                left = np.maximum(counts.phrases - (np.bincount(doc, minlength=len(s.n)) * trained)[doc], 1)
                phrases = packed(key, many[each], _worth(-np.add.reduceat(log_p, begin) - np.log(left)), doc, s)
                total = lambda x: pa.array(np.add.reduceat(x, s.first))  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(2), pa.compute.binary_length(part.column(1)).cast(pa.int64()), pa.array(s.n), total((at >= 0).astype(np.int64)), total(logs[at]), total(log_p / np.log(10)), pa.array(np.bincount(doc, minlength=len(s.n))), *[pa.array(pa.compute.binary_length(x[0]).to_numpy().astype(np.int64) // 8) for x in (words, phrases)], *words, *phrases],
                    names=["doc_id", "trained", "n_bytes", "n_tokens", "known", "logs", "coded", "n_phrases", "words_entries", "phrases_entries", *_columns("words"), *_columns("phrases")],
                )

    import pyarrow.compute  # noqa: F401

    return score


def _model(learn: DataFrame) -> tuple[Codes, Mixer, Counts, int, int]:
    """(codes, mixer, counts, training tokens, distinct ones) of the column ``text``.

    Words are dealt to learning tasks by their hash, in an order by hash, and the number of tasks follows from the number of words: the layout of the table does not matter.
    """
    import pyarrow.compute  # noqa: F401

    sent = learn.mapInArrow(_send_units, UNITS).repartition("shard").sortWithinPartitions("shard")
    table = units = kept(sent.mapInArrow(_add_units, "word binary, cue int, n long, token long, c long"), "units")
    here = F.col("cue") != ALL_PHRASES
    phrases, total, distinct, n_units = units.agg(*[F.coalesce(F.sum(F.when(kind, x)), F.lit(0)) for kind, x in ((~here, F.col("n")), (here, F.col("n")), (F.col("c") > 0, F.lit(1)), (here, F.lit(1)))]).first()
    heavy = units.filter(F.col("c") > total / HEAVY).orderBy("token").select("token", "c").toArrow()  # less than HEAVY rows
    units = units.filter(here)
    counts = Counts(total, phrases, heavy["token"].to_numpy().astype(np.int64).view(U), heavy["c"].to_numpy().astype(np.int64))
    # Few enough tasks that what each reaches of the tables is less than what it reads.
    tasks = max(LEAST_TASKS, n_units // UNITS_A_TASK)
    each = units.select("word", "cue", "n", "token").coalesce(tasks)
    bytes_ = each.mapInArrow(_byte_counter, "symbol int, n double").groupBy("symbol").agg(F.sum("n").alias("n")).toArrow()
    many = np.zeros(256)
    many[bytes_["symbol"].to_numpy()] = bytes_["n"].to_numpy()
    codes = Codes(many)
    sent = each.mapInArrow(_send_slots(_slot_counter(codes)), "shard int, slot binary, n binary, ones binary").repartition("shard")
    slots = sent.mapInArrow(_add_slots, "slot int, n long, ones long").toArrow()  # N_SLOTS rows at most
    n, ones = np.zeros(N_SLOTS, np.float32), np.zeros(N_SLOTS, np.float32)
    n[slots["slot"].to_numpy()], ones[slots["slot"].to_numpy()] = slots["n"].to_numpy(), slots["ones"].to_numpy()
    mixer = Mixer(n, ones)
    del slots, heavy
    if total:
        dealt = units.select("word", "cue", "n", "token").repartition(max(1, n_units // UNITS_A_TASK), "word", "cue").sortWithinPartitions(F.xxhash64("word", "cue"), "word", "cue")
        got = dealt.mapInArrow(_learner(codes, mixer, counts), "slot int, value double, visits double").groupBy("slot").agg((F.sum("value") / F.sum("visits")).alias("mean")).toArrow()
        value = np.concatenate([mixer.weight.ravel(), mixer.refine, mixer.trust])
        value[got["slot"].to_numpy()] = got["mean"].to_numpy()
        a, b = mixer.weight.size, mixer.weight.size + mixer.refine.size
        mixer.weight, mixer.refine = value[:a].reshape(mixer.weight.shape).astype(np.float32), value[a:b]
        mixer.trust = np.clip(value[b:], 1e-6, 1 - 1e-3)
    mixer.freeze()
    discard(table)
    return codes, mixer, counts, total, distinct


def _columns(name: str) -> list[str]:
    return [f"{name}_{c}" for c in ("key", "tf", "own", "worth")]


def _flat(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, ...]:
    """(place of the row in the batch, key, tf, own, worth) of all entries of packed columns."""
    out = [_values(batch.column(column), kind) for column, kind in zip(_columns(name), ("<u8", "<u4", "<u4", "<i2"), strict=True)]
    each = pa.compute.binary_length(batch.column(f"{name}_key")).to_numpy() // 8
    return (np.repeat(np.arange(batch.num_rows), each), *out)


def _shard(keys: np.ndarray, shards: int) -> np.ndarray:
    return ((keys >> U(20)) % U(shards)).astype(np.int64)


PACKED = "shard int, key binary, row binary, tf binary, own binary, worth binary, c binary, held binary"


_KINDS = {"key": "<u8", "row": "<i8", "tf": "<u4", "own": "<u4", "worth": "<i2", "c": "<u8", "held": "<u8"}


def _packed(shard: np.ndarray, **columns: np.ndarray) -> pa.RecordBatch:
    out = _grouped(shard, {n: c.astype(_KINDS[n]) for n, c in columns.items()})
    none = pa.array([b""] * out.num_rows, pa.binary())
    return pa.RecordBatch.from_arrays([out.column(n) if n in out.schema.names else none for n in ("shard", *_KINDS)], names=["shard", *_KINDS])


def _key_counts(scored: DataFrame, name: str, shards: int) -> DataFrame:
    """Packed (key, c, held) by shard: how often training texts have each key, and how many entries it has. Tasks add up theirs first."""

    def send(keys: list, c: list, held: list) -> Iterator[pa.RecordBatch]:
        key, c, held = summed(list(zip(keys, c, held, strict=True)))
        yield _packed(_shard(key, shards), key=key, c=c, held=held)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = ([], [], []), 0
        for b in batches:
            at, key, tf, _, _ = _flat(b, name)
            trained = np.array(b.column("trained").to_pylist(), bool)
            for part, value in zip(held, (key, (tf * trained[at]).astype(np.int64), np.ones(len(key), np.int64)), strict=True):
                part.append(value)
            size += len(key)
            if size > HELD:
                yield from send(*held)
                held, size = ([], [], []), 0
        if size:
            yield from send(*held)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, list] = {}
        for b in batches:
            for i, shard in enumerate(b.column("shard").to_pylist()):
                mine = parts.setdefault(shard, [])
                mine.append(tuple(_values(b.column(n).slice(i, 1), _KINDS[n]).copy() for n in ("key", "c", "held")))
                if len(mine) > 1 and sum(len(k) for k, _, _ in mine[1:]) > max(SHARD, len(mine[0][0])):
                    parts[shard] = [summed(mine)]
        for shard, mine in parts.items():
            key, c, held = summed(mine)
            use = c > 0
            yield _packed(np.full(use.sum(), shard), key=key[use], c=c[use], held=held[use])

    def summed(mine: list) -> tuple[np.ndarray, ...]:
        key, c, held = (np.concatenate(x) for x in zip(*mine, strict=True))
        order, first = _runs(key)
        return key[order[first]], np.add.reduceat(c[order], first), np.add.reduceat(held[order], first)

    sent = scored.select("trained", *_columns(name)).mapInArrow(count, PACKED)
    return kept(sent.repartition(shards, "shard").mapInArrow(add, PACKED), f"{name}-counts")


def _elsewhere(scored: DataFrame, name: str, values, n_values: int) -> DataFrame:
    """(row, v0, v1, ...): sums over the entries of each row of ``values`` (tf, c, gain), where gain is the binary logarithm of what a key's occurrences in other training texts are worth."""
    spark = scored.sparkSession
    entries = scored.agg(F.sum(f"{name}_entries")).first()[0] or 0
    shards = max(16, -(-entries // SHARD))
    counted = _key_counts(scored, name, shards)

    def common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key, c, held = (_values(b.column(n), _KINDS[n]) for n in ("key", "c", "held"))
            use = held > max(SHARD // 64, entries / COMMON)
            yield pa.RecordBatch.from_arrays([pa.array(key[use].view(np.int64)), pa.array(c[use].astype(np.int64))], names=["key", "c"])

    far = counted.mapInArrow(common, "key long, c long").orderBy("key").toArrow()  # less than COMMON rows
    sent = spark.sparkContext.broadcast((far["key"].to_numpy().astype(np.int64).view(U), np.append(far["c"].to_numpy().astype(float), 0.0)))

    def gains(tf: np.ndarray, own: np.ndarray, worth: np.ndarray, c: np.ndarray) -> np.ndarray:
        """own: 0 where the row is not trained on."""
        with np.errstate(divide="ignore"):
            return values(tf.astype(float), c, np.log2(np.maximum(c - own, 0)) + worth.astype(float) / FINE)

    def summed(row: np.ndarray, found: np.ndarray) -> pa.RecordBatch:
        rows, at = np.unique(row, return_inverse=True)
        return pa.RecordBatch.from_arrays([pa.array(rows), *[pa.array(np.bincount(at, v, len(rows))) for v in found]], names=["row", *[f"v{i}" for i in range(n_values)]])

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = sent.value
        lookup = Lookup(keys)
        for b in batches:
            at, key, tf, own, worth = _flat(b, name)
            place = lookup.find(key)
            mine = np.flatnonzero(place >= 0)
            if len(mine):
                trained = np.array(b.column("trained").to_pylist(), bool)[at[mine]]
                yield summed(b.column("row").to_numpy()[at[mine]], gains(tf[mine], own[mine] * trained, worth[mine], counts[place[mine]]))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = Lookup(sent.value[0])
        held, size = [[] for _ in range(5)], 0

        def flush() -> pa.RecordBatch:
            row, key, tf, own, worth = (np.concatenate(p) for p in held)
            return _packed(_shard(key, shards), key=key, row=row, tf=tf, own=own, worth=worth)

        for b in batches:
            at, key, tf, own, worth = _flat(b, name)
            use = np.flatnonzero(lookup.find(key) < 0)
            at = at[use]
            trained = np.array(b.column("trained").to_pylist(), bool)[at]
            for part, value in zip(held, (b.column("row").to_numpy()[at].astype("<i8"), key[use], tf[use], (own[use] * trained).astype("<u4"), worth[use]), strict=True):
                part.append(value)
            size += len(use)
            if size > HELD:
                yield flush()
                held, size = [[] for _ in range(5)], 0
        if size:
            yield flush()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, keys, c = None, np.empty(0, U), np.empty(0)
        for b in batches:
            for i, shard in enumerate(b.column("shard").to_pylist()):
                part = {n: _values(b.column(n).slice(i, 1), kind) for n, kind in _KINDS.items()}
                if len(part["c"]):  # comes first in its shard, and is sorted
                    known, keys, c = shard, part["key"].copy(), part["c"].astype(float)
                elif known == shard:
                    at = np.minimum(np.searchsorted(keys, part["key"]), len(keys) - 1)
                    use = np.flatnonzero(keys[at] == part["key"])
                    if len(use):
                        yield summed(part["row"][use], gains(part["tf"][use], part["own"][use], part["worth"][use], c[at[use]]))

    import pyarrow.compute  # noqa: F401

    schema = "row long, " + ", ".join(f"v{i} double" for i in range(n_values))
    rows = scored.select("row", "trained", *_columns(name))
    shared = rows.mapInArrow(send, PACKED).unionByName(counted).repartition(shards, "shard").sortWithinPartitions("shard", F.octet_length("c").desc()).mapInArrow(meet, schema)
    found = rows.mapInArrow(near, schema).unionByName(shared)
    return kept(found.groupBy("row").agg(*[F.sum(f"v{i}").alias(f"v{i}") for i in range(n_values)]), f"{name}-sums")


def _word_values(tf: np.ndarray, c: np.ndarray, gain: np.ndarray) -> np.ndarray:
    return np.stack([tf * np.log10(c + 1), tf, tf * np.logaddexp2(0, gain) * np.log10(2)])


def _phrase_values(tf: np.ndarray, c: np.ndarray, gain: np.ndarray) -> np.ndarray:
    return np.stack([tf * np.logaddexp2(0, gain + np.log2(x / (1 - x))) * np.log10(2) for x in LAMBDAS])


def context_mixing_scores(docs: DataFrame, training: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte) of each row of ``docs``, learned from the rows where ``training`` holds.

    base_score sums log10((c+1) / (N+V+1)) over the tokens, with counts of all training texts; score is the model's log10 probability,
    for a training text of the model without it. A null or empty text is one end mark; its bits_per_byte is null. With nothing
    to learn from, c, N and V are 0 and all decisions are even. Repeated rows, null ids and empty tables pass through; other
    columns are ignored.
    """
    trained = F.coalesce(training.cast("boolean"), F.lit(False))
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), trained.alias("trained"))
    with scratch(), _batches(docs.sparkSession):
        codes, mixer, counts, total, distinct = _model(base.filter("trained").select("text"))
        entry = ", ".join(f"{c} binary" for name in ("words", "phrases") for c in _columns(name))
        scored = base.mapInArrow(_scorer(codes, mixer, counts), f"doc_id long, trained boolean, n_bytes long, n_tokens long, known long, logs double, coded double, n_phrases long, words_entries long, phrases_entries long, {entry}")
        scored = kept(scored.withColumn("row", F.monotonically_increasing_id()), "scored")
        words = _elsewhere(scored, "words", _word_values, 3).toDF("row", "more_logs", "more_known", "words_gain")
        phrases = _elsewhere(scored, "phrases", _phrase_values, len(LAMBDAS)).toDF("row", *[f"gain_{i}" for i in range(len(LAMBDAS))])
        out = scored.drop("words_entries", "phrases_entries", *_columns("words"), *_columns("phrases")).join(words, "row", "left").join(phrases, "row", "left")
        logs = F.col("logs") + F.coalesce("more_logs", F.lit(0.0))
        trials = [F.coalesce("words_gain", F.lit(0.0)), *[F.col("n_phrases") * F.log10(F.lit(1 - x)) + F.coalesce(f"gain_{i}", F.lit(0.0)) for i, x in enumerate(LAMBDAS)]]
        best = F.greatest(*trials)
        score = F.col("coded") + best + F.log10(sum((F.pow(F.lit(10.0), t - best) for t in trials), F.lit(0.0)) / len(trials))
        out = out.withColumn("score", score).select(
            "doc_id",
            "n_tokens",
            (F.col("known") + F.coalesce("more_known", F.lit(0.0))).cast("long").alias("n_known"),
            F.lit(int(total)).cast("long").alias("train_tokens"),
            (logs - F.col("n_tokens") * F.log10(F.lit(float(total + distinct + 1)))).alias("base_score"),
            "score",
            F.when(F.col("n_bytes") > 0, -F.col("score") / F.log10(F.lit(2.0)) / F.col("n_bytes")).alias("bits_per_byte"),
        )
        return kept(out, "scores", stay=True)


def op2_context_mixing(spark, sf_dir: str) -> DataFrame:
    out = context_mixing_scores(documents(spark, sf_dir), id_remainder("doc_id", 7) != 2)
    return out.withColumn("held_out", id_remainder("doc_id", 7) == 2)


QUERIES = {"op2_context_mixing": op2_context_mixing}
SQL: dict[str, str] = {}
