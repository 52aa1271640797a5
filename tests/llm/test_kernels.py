"""The numpy kernels against plain Python."""

import hashlib
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quire.llm import contamination, language, licences, mixing_model, near_dup, private_data, toxicity
from quire.llm import token_count as tc
from quire.llm.wordhash import ALNUM, NOT_SPACE, Lookup, U, hash_of, sequence_keys, shingles, slices, words_of

TEXT = st.text(alphabet="aAbB \t\n.é日\x1c", max_size=60)
lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t)


@settings(max_examples=150, deadline=None)
@given(st.lists(TEXT, max_size=6))
def test_words_and_shingles(texts):
    for kind, pattern in ((NOT_SPACE, r"[^\x20\x09-\x0D]+"), (ALNUM, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")):
        want = [re.findall(pattern, lower(t)) for t in texts]
        w = words_of(pa.array(texts, pa.string()), kind)
        assert w.counts.tolist() == [len(x) for x in want]
        assert w.hash.tolist() == [hash_of(x) for t in want for x in t] or kind is ALNUM
        row, sh = shingles(w, 3)
        sets = [{tuple(t[i : i + 3]) for i in range(len(t) - 2)} or ({tuple(t)} if t else set()) for t in want]
        assert [len(set(sh[row == r].tolist())) for r in range(len(texts))] == [len(s) for s in sets]
        one, two = sequence_keys(w)
        for i in range(len(texts)):
            for j in range(i):
                assert (want[i] == want[j]) == (one[i] == one[j] and two[i] == two[j])


def test_long_words_and_slices():
    words = ["x" * n for n in (1, 7, 8, 9, 16, 255, 256, 257, 300, 5000)] + ["y" + "x" * 4999]
    assert len({hash_of(w) for w in words}) == len(words)
    assert words_of(pa.array([" ".join(words)])).hash.tolist() == [hash_of(w) for w in words]
    batch = pa.record_batch([pa.array([1, 2, 3]), pa.array(["a", None, "b" * 3_000_000])], names=["doc_id", "text"])
    parts = list(slices(batch, "text"))
    assert sum(p.num_rows for p in parts) == 3 and parts[0].column(1)[1].as_py() == ""
    assert list(slices(batch.slice(0, 0), "text")) == []


def test_lookup():
    keys = np.random.default_rng(0).integers(0, 1 << 63, 5000).astype(U)
    table = Lookup(keys)
    assert (table.find(keys) == np.arange(5000)).all() and (table.find(keys + U(1)) == -1).all()
    assert (Lookup(np.empty(0, U)).find(keys) == -1).all()


def test_one_permutation_estimates_similarity():
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 1 << 62, 1500).astype(U) * U(4)
    row = np.r_[np.zeros(1000, int), np.ones(1000, int), 2]
    n, minima = near_dup.one_permutation(row, np.r_[pool[:1000], pool[500:], pool[:1]], 4, 296)
    assert n.tolist() == [1000, 1000, 1, 0]
    full = near_dup.densify(minima)
    assert abs((full[0] == full[1]).mean() - 1 / 3) < 0.12 and (full[2] != near_dup.EMPTY).all() and (full[3] == near_dup.EMPTY).all()
    for t in (0.8, 0.85):
        size, bands = near_dup.shape(t)
        assert (1 - t**size) ** bands <= 1e-5


def brute_segments(w):
    """Maximal segments by the definition: recursively the best one, then both sides of it."""
    if not len(w) or max(w) <= 0:
        return []
    best = max(((sum(w[a:b]), -(b - a), -a), a, b) for a in range(len(w)) for b in range(a + 1, len(w) + 1))
    a, b = best[1], best[2]
    return [(x, i, j) for x, i, j in brute_segments(w[:a])] + [(sum(w[a:b]), a, b - 1)] + [(x, i + b, j + b) for x, i, j in brute_segments(w[b:])]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from([-3, -1.25, -0.5, 0.75, 1.5, 4]), max_size=14))
def test_maximal_segments(w):
    w = np.array(w, float)
    total, hot = np.r_[0.0, np.cumsum(w)], np.flatnonzero(w > 0)
    got = toxicity.segments(hot, total[hot], total[hot + 1])
    assert sorted(round(s, 6) for s, _, _ in got) == sorted(round(s, 6) for s, _, _ in brute_segments(w.tolist()))


def test_token_counts_equal_the_library():
    import sentencepiece

    sp, mine = sentencepiece.SentencePieceProcessor(model_file=tc.default_model()), tc.Merges(tc.default_model())
    rng = random.Random(5)
    alphabet = list("aeiouthnsr  \n\t▁éß日\x00​😀<>0x41.,'") + ["the", "<s>", "<0x41>", "  ", "aaaa", "<unk>"]
    texts = ["", " ", "▁", "a" * 5000, "hello world"] + ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    assert [mine.count(t) for t in texts] == [len(x) for x in sp.encode(texts)]


def test_base_spans_equal_the_patterns():
    email = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    ip, card = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), re.compile(r"[0-9]([\x20-]?[0-9])+")
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    rng = random.Random(2)
    for _ in range(8000):
        t = "".join(rng.choice(["1", "2", "99", "255", ".", "@", "a", "-", " ", "+", "(", ")", "4111111111111111", "_", "b.c", "é"]) for _ in range(rng.randint(0, 25)))
        want = [(0, m.start(), m.end()) for m in email.finditer(t)]
        want += [(1, m.start(), m.end()) for m in ip.finditer(t) if all(int(x) <= 255 for x in m[0].split("."))]
        want += [(2, m.start(), m.end()) for m in card.finditer(t) if 13 <= len(digits(m)) <= 19 and private_data.luhn(digits(m))]
        want += [(3, m.start(), m.end()) for m in private_data.PHONE.finditer(t) if 9 <= len(digits(m)) <= 15]
        assert private_data.base_spans(t) == sorted(want)


def test_skip_edges_find_a_repeated_number():
    rng = random.Random(3)
    train = [f"call +1 ({rng.randint(200, 999)}) 555-{rng.randint(1000, 9999)} or mail u{i}.x@mail.example.com, room {rng.randint(1, 99)} in {rng.randint(1900, 2020)}" for i in range(200)]
    field = private_data.Field()
    rows = private_data.training_rows(train)
    assert sum(rows.values()) == sum(len(private_data.TOKEN.findall(x)) for x in train)
    field.fit([(*r, n) for r, n in rows.items()])
    t = ["dial +1 (523) 555-1055 now, later (523) 555-1055 again, room 12 in 1999", "nothing here", ""]
    base = [private_data.base_spans(x) for x in t]
    more = field.more_spans(t, base)
    assert [t[0][a:b] for _, a, b in more[0]] == ["555-1055"] and more[1:] == [[], []]
    assert private_data.redact(t[0], base[0] + more[0]) == "dial [PHONE] now, later (523) [PHONE] again, room 12 in 1999"
    p = field.marginals(private_data.Graph(t, base))
    assert np.allclose(p.sum(1), 1)


def test_marginals_are_exact_on_a_chain():
    field = private_data.Field()
    rng = np.random.default_rng(0)
    field.node, field.chain = rng.normal(size=field.node.shape), rng.normal(size=field.chain.shape)
    g = private_data.Graph(["11 22 33"], [[]])
    own = g.x @ field.node
    joint = np.exp(own[0][:, None, None] + field.chain[:, :, None] + own[1][None, :, None] + field.chain[None] + own[2][None, None])
    joint /= joint.sum()
    want = [joint.sum((1, 2)), joint.sum((0, 2)), joint.sum((0, 1))]
    assert np.allclose(field.marginals(g), want, atol=2e-3)


def test_licence_scan():
    texts = ["", "cc by cc by All Rights Reserved. Released under the MIT License.", "the license", "licensed under the apache license foo version 2 0", "general public", "GENERAL PUBLIC LICENSE"]
    batch = pa.record_batch([pa.array(range(len(texts))), pa.array(texts)], names=["doc_id", "text"])
    got = licences.Scanner().scan(batch).to_pylist()
    assert [r["n_base"] for r in got] == [0, 3, 0, 0, 0, 1] and (got[1]["first_word"], got[1]["last_word"]) == (0, 4)
    assert got[1]["labels"] == "MIT,cc-by,reserved" and got[1]["base_labels"] == "cc-by,reserved" and got[3]["labels"] == "Apache-2.0" and got[5]["base_labels"] == "gpl"
    assert got[0]["score"] == got[2]["score"] == 0 and 0 < got[3]["score"] <= 1 and got[0]["first_word"] is None


def test_clauses_from_inside_a_licence():
    """The warranty clause of one licence alone, and a text given as a parameter."""
    clause = "prose before. In no event shall the authors or copyright holders be liable for any claim, damages or other liability, whether in an action of contract, tort or otherwise, arising from it. Prose after."
    batch = pa.record_batch([pa.array([1, 2]), pa.array([clause, "one two three four five six seven eight nine ten"])], names=["doc_id", "text"])
    got = licences.Scanner().scan(batch).to_pylist()
    assert got[0]["labels"] == "MIT" and got[0]["score"] >= 0.7 and got[0]["base_labels"] == "" and got[1]["labels"] == ""
    own = licences.Scanner(templates=(("Own-1.0", "Three four, FIVE six; seven eight"),)).scan(batch).to_pylist()
    assert own[1]["labels"] == "Own-1.0" and own[1]["spans"] == "Own-1.0:2:8" and own[1]["score"] == 1


def test_a_phrase_of_one_word():
    scan = licences.Scanner((("copyleft", "left"), ("cc by", "cc-by")), ())
    got = scan.scan(pa.record_batch([pa.array([1]), pa.array(["All copyleft, copyleft cc by"])], names=["doc_id", "text"])).to_pylist()[0]
    assert (got["n_base"], got["first_word"], got["last_word"], got["base_labels"]) == (3, 1, 3, "cc-by,left")


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=25), st.lists(st.lists(st.sampled_from("abc"), min_size=1, max_size=6), min_size=1, max_size=4))
def test_matching_statistics(words, templates):
    code = {c: i for i, c in enumerate("abc")}
    auto = licences.Automaton([[code[c] for c in t] for t in templates])
    v = length = 0
    for i, c in enumerate(words):
        w = code[c]
        while v > 0 and w not in auto.step[v]:
            v = auto.link[v]
            length = auto.size[v]
        v, length = (auto.step[v][w], length + 1) if w in auto.step[v] else (0, 0)
        subs = {tuple(t[a:b]) for t in templates for a in range(len(t)) for b in range(a + 1, len(t) + 1)}
        assert length == max([n for n in range(i + 2) if tuple(words[i + 1 - n : i + 1]) in subs or n == 0])


def mixing_state(texts):
    """(codes, mixer, counts) after one round over some texts, as the tasks of a job would make them."""
    m = mixing_model
    found, phrases = m._tokens(m._unit_counter(iter([pa.record_batch([pa.array(texts)], names=["text"])])))
    part = found
    assert phrases["cue"].to_pylist() == [m.ALL_PHRASES]
    token, at = np.unique(found["token"].to_numpy().view(U), return_inverse=True)
    c = np.bincount(at, found["n"].to_numpy()).astype(np.int64)
    counts = m.Counts(int(c.sum()), phrases["n"][0].as_py(), token, c)
    codes = m.Codes(next(m._byte_counter(iter([part])))["n"].to_numpy())
    n, ones = np.zeros(m.N_SLOTS), np.zeros(m.N_SLOTS)
    for slots in m._slot_counter(codes)(iter([part])):
        n[slots["slot"].to_numpy()], ones[slots["slot"].to_numpy()] = slots["n"].to_numpy(), slots["ones"].to_numpy()
    mixer = m.Mixer(n, ones)
    mixer.prepare()
    mixer.learn(m._spelled(part, codes), np.zeros(len(mixer.weight)), np.zeros(len(mixer.refine)))
    mixer.freeze()
    return codes, mixer, counts


def spelled(codes, text):
    s = mixing_model.Slice(pa.array([text]))
    return s, mixing_model.Spelling(codes, s.low, s.start, s.size, s.cue[s.lead], s.many)


def test_mixing_model_is_a_distribution():
    """The chances of all strings of one letter, of some of two and of the end mark stay below one, those of all next bytes make one."""
    codes, mixer, counts = mixing_state(["ab ba ab a", "b ab abab", "", "aab b"] * 5)
    assert counts.total == 65 and counts.count.sum() == 65

    def first(text):
        s, spelling = spelled(codes, text)
        return math.exp(mixer.log_p(spelling)[s.unit][0])

    one = {chr(c): first(chr(c)) for c in range(33, 127) if not chr(c).isupper()}
    assert 0.5 < first("") + sum(one.values()) + sum(first(x + y) for x in "ab" for y in "ab") <= 1 and one["a"] > 20 * one["z"]
    _, spelling = spelled(codes, "ab")
    spelling.symbol, spelling.first = np.arange(256), np.arange(256)  # every byte in one and the same context
    spelling.place, spelling.word = np.ones(256, np.int64), np.zeros(256, np.int64)
    spelling.context = [np.full(256, h[1]) for h in spelling.context]
    assert np.exp(mixer.log_p(spelling)).sum() == pytest.approx(1)


def test_mixing_model_without_training():
    codes, mixer = mixing_model.Codes(np.zeros(256)), mixing_model.Mixer(np.zeros(mixing_model.N_SLOTS), np.zeros(mixing_model.N_SLOTS))
    mixer.freeze()
    s, spelling = spelled(codes, "deux mots")
    assert mixer.log_p(spelling)[s.unit].tolist() == pytest.approx([-5 * 8 * math.log(2)] * 2 + [-8 * math.log(2)])


def many_words(n=6000):
    rng = random.Random(12)
    return [" ".join("".join(rng.choice("abc") for _ in range(rng.choice((2, 6, 7, 8, 9)))) for _ in range(60)) for _ in range(n // 60)]


def test_equal_bytes_in_equal_contexts_are_taken_apart_once(monkeypatch):
    """Counting and pricing cost what the distinct events cost, not what the bytes of all words cost; the results are those of the words."""
    m, texts, seen = mixing_model, many_words(), []
    codes, mixer, counts = mixing_state(texts)
    part = next(m._tokens(m._unit_counter(iter([pa.record_batch([pa.array(texts)], names=["text"])]))))
    s = m._spelled(part, codes)
    n, ones = np.zeros(m.N_SLOTS), np.zeros(m.N_SLOTS)
    _, of, _, bit, slots = s.decisions(0, len(s.symbol))
    for slot in slots:
        np.add.at(n, slot, s.many[s.word[of]].astype(float))
        np.add.at(ones, slot, s.many[s.word[of]] * bit.astype(float))
    whole, prices = m.Slice(pa.array(texts)), mixer.log_p(s)
    events = len(np.unique(s.event))
    assert 3.5 * events < len(s.symbol)  # so that words would take more than ORDERS times as much

    decisions = m.Spelling.decisions
    monkeypatch.setattr(m.Spelling, "decisions", lambda self, a, b: seen.append(b - a) or decisions(self, a, b))
    got = list(m._slot_counter(codes)(iter([part])))
    for column, want in (("n", n), ("ones", ones)):
        total = np.zeros(m.N_SLOTS)
        for b in got:
            total[b["slot"].to_numpy()] = b[column].to_numpy()
        assert (total == want).all()
    assert sum(seen) <= m.ORDERS * events
    seen.clear()
    batch = pa.record_batch([pa.array(range(len(texts))), pa.array(texts), pa.array([False] * len(texts))], names=["doc_id", "text", "trained"])
    priced = next(m._scorer(codes, mixer, counts)(iter([batch])))
    assert sum(seen) <= events
    by_key = dict(zip(m.mix(part["token"].to_numpy().view(U) + part["cue"].to_numpy().astype(U)).tolist(), prices.tolist(), strict=True))
    spelled_out = np.array([by_key[k] for k in whole.key.tolist()])[whole.unit]
    trust, share = mixer.trust[whole.cue], counts.of(whole.hash) / counts.total
    want = np.add.reduceat(np.logaddexp(np.log(trust * share), spelled_out + np.log(1 - trust)), whole.first) / np.log(10)
    assert priced["coded"].to_numpy() == pytest.approx(want, rel=1e-12)


def test_units_and_slots_are_added_up_from_packed_rows(monkeypatch):
    """Shard by shard, with little held at a time; words may be of any bytes, and the empty one."""
    m, texts = mixing_model, [*many_words(1200), "", "\u00e9t\u00e9 \U0001f600 x", "the the a the " * 50]
    monkeypatch.setattr(m, "UNITS_HELD", 40)
    parts = [pa.record_batch([pa.array(t)], names=["text"]) for t in (texts[::2], texts[1::2], texts[:5])]
    want, words, rows = {}, {}, []
    for part in parts:
        for b in m._unit_counter(iter([part])):
            for word, cue, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
                want[word, cue] = want.get((word, cue), 0) + n
                words[word] = words.get(word, 0) + n * (cue != m.ALL_PHRASES)
        rows += [b.slice(i, 1) for b in m._send_units(iter([part])) for i in range(b.num_rows)]
    rows.sort(key=lambda r: r["shard"][0].as_py())
    flat = pa.Table.from_batches(rows).combine_chunks().to_batches(max_chunksize=7)
    out = list(m._add_units(iter(flat)))
    got = [r for b in out for r in b.to_pylist()]
    assert len(out) > 5 and len(got) == len(want) and {(r["word"], r["cue"]): r["n"] for r in got} == want
    assert {w: c for w, c in words.items() if c} == {r["word"]: r["c"] for r in got if r["c"]} and sum(r["c"] > 0 for r in got) == len(words)

    def counter(batches):
        for _ in batches:
            yield pa.record_batch([pa.array([3, 5000, 5001], pa.int32()), pa.array([7, 8, 9]), pa.array([0, 8, 1])], names=["slot", "n", "ones"])

    sums = [tuple(r.values()) for b in m._add_slots(m._send_slots(counter)(iter(parts))) for r in b.to_pylist()]
    assert sorted(sums) == [(3, 21, 0), (5000, 24, 24), (5001, 27, 3)]


def test_codes_are_a_tree():
    codes = mixing_model.Codes(np.arange(256) ** 3.0)
    assert sum(2.0 ** -int(n) for n in codes.length) == 1 and codes.length[255] < codes.length[1]
    paths = [tuple(zip(codes.node[a : a + n].tolist(), codes.bit[a : a + n].tolist(), strict=True)) for a, n in zip(codes.start, codes.length, strict=True)]
    assert len(set(paths)) == 256 and not any(p == q[: len(p)] for p in paths[:40] for q in paths if p is not q)


def test_phrases_depend_on_their_words_alone():
    rng = random.Random(3)
    words = [f"w{rng.randint(0, 500)}" for _ in range(400)]
    one, two = (mixing_model.Slice(pa.array([t])).phrases() for t in (" ".join(words), "some other words " + " ".join(words)))
    assert one[0][0] == 0 and len(set(one[2].tolist()) & set(two[2].tolist())) >= len(set(one[2].tolist())) - 1
    assert set(mixing_model.Slice(pa.array(["", "x", ""])).phrases()[1].tolist()) == {0, 1, 2}


def test_network_tables_equal_the_convolution():
    net = language.Network(["a", "b"])
    x = np.random.default_rng(0).integers(0, 64, (3, language.WINDOW + 3)).astype(np.uint8)
    x[:, -3:] = language.BLANK
    want = net._responses(x).max(1) + net.bias
    for i in range(3):
        p = net.probabilities(x[i], np.zeros(1, np.int64), *net.tables())
        z = np.maximum(want[i], 0) @ net.out + net.out_bias
        assert np.allclose(p[0], np.exp(z) / np.exp(z).sum(), atol=1e-5)


def test_network_sees_one_row_at_a_time():
    net, rng = language.Network(["a", "b", "c"], seed=3), random.Random(6)
    texts = ["", "a", "x" * 20, "y" * 256, "z" * 255, "w" * 254, "q" * 253] + ["".join(rng.choice("abcdefgh é日.") for _ in range(rng.randint(0, 900))) for _ in range(60)]
    together = net.predict(pa.array(texts), net.tables())
    for i, t in enumerate(texts):
        names, score = net.predict(pa.array([t]), net.tables())
        assert (names[0], score[0]) == (together[0][i], together[1][i])


def test_drawn_windows_cover_whole_texts():
    text = "".join(chr(97 + i // 256 % 26) for i in range(256 * 60))
    batch = pa.record_batch([pa.array(["x"] * 2), pa.array([text, "short"]), pa.array([5, 6]), pa.array([1.0, 1.0])], names=["lang", "text", "hash", "share"])
    got = next(language._drawn(iter([batch])))
    pieces = got.column(1).to_pylist()
    assert len(pieces) == 61 and all(p[:1] == text[i * 256].encode() for i, p in enumerate(pieces[:60])) and sum(len(p) == 256 for p in pieces) > 30


def test_item_search_against_sets():
    rng = random.Random(4)
    word = lambda: rng.choice(["aa", "bb", "cc", "dd", "ee", "ff", "gg"])
    items = [" ".join(word() for _ in range(rng.choice([0, 2, 3, 5, 9, 30]))) for _ in range(30)]
    docs = [" ".join(word() for _ in range(40)) + " " + rng.choice(items) + " " + " ".join(word() for _ in range(rng.randint(0, 300))) for _ in range(60)] + ["", " "]
    index = contamination.ItemIndex(list(range(30)), items, 5, 0.8)
    row, item, shared = index.search(words_of(pa.array(docs)))
    got = set(zip(row.tolist(), item.tolist(), shared.tolist(), strict=True))
    want = set()
    for d, text in enumerate(docs):
        w = text.split()
        for i, t in enumerate(items):
            v = t.split()
            k = min(5, len(v))
            if k:
                s = {tuple(v[a : a + k]) for a in range(len(v) - k + 1)}
                n = len(s & {tuple(w[a : a + k]) for a in range(len(w) - k + 1)})
                if n >= 0.8 * len(s) - 1e-9 and n:
                    want.add((d, i, n))
    assert got == want
    # The search goes through the sketches alone: none is left, nothing is found.
    index.sketches = {k: (type(v[0])(np.empty(0, U)), *v[1:]) for k, v in index.sketches.items()}
    assert not len(index.search(words_of(pa.array(docs)))[0])


def test_digest():
    assert private_data._digest([]) == "" and private_data._digest([(3, 9, 12), (0, 20, 25), (0, 5, 8)]) == "email:5:8,email:20:25,phone:9:12"
