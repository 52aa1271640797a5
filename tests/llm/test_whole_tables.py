"""Queries over whole tables against brute force."""

import hashlib
import re
import zlib

import pytest
from pyspark.sql import functions as F

from quire.llm import catalogue, fingerprint, private_data, token_count


@pytest.fixture(scope="module")
def texts(spark, small):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{small}/documents.parquet").collect()}


def rows(spark, small, name):
    return {r.doc_id: r for r in catalogue.QUERIES[name](spark, small).collect()}


@pytest.mark.parametrize("name,modulus,held", [("op1_toxicity", 3, 1), ("op7_language", 5, 0)])
def test_held_out_rows(spark, small, texts, name, modulus, held):
    got = rows(spark, small, name)
    assert {i: r.held_out for i, r in got.items()} == {i: zlib.crc32(str(i).encode()) % modulus == held for i in texts}
    assert all(0 <= r.score <= 1 for r in got.values())
    if name == "op1_toxicity":
        assert all(r.predicted == int(r.score >= 0.7) for r in got.values())


def test_base_spans_of_a_table(spark, small, texts):
    digits = lambda s: re.sub("[^0-9]", "", s)

    def luhn(s):
        total = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(s)))
        return total % 10 == 0

    kinds = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda s: 13 <= len(digits(s)) <= 19 and luhn(digits(s))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(digits(s)) <= 15),
    }
    found = 0
    for i, r in rows(spark, small, "op4_private_data").items():
        spans = [f"{k}:{m.start()}:{m.end()}" for k, (pattern, ok) in kinds.items() for m in re.finditer(pattern, texts[i]) if ok(m[0])]
        assert r.base_sha256 == hashlib.sha256(",".join(spans).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s.startswith(k + ":") for s in spans) for k in kinds]
        assert set(spans) <= set(r.spans.split(","))  if spans else True
        found += len(spans)
    assert found > 20 and len(private_data.KINDS) == 4


def test_base_phrases_of_a_table(spark, small, texts):
    phrases = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
    hits = 0
    for i, r in rows(spark, small, "op9_licences").items():
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), texts[i]))
        places = sorted((at, label) for p, label in phrases.items() for at in range(len(w)) if w[at : at + len(p.split())] == p.split())
        assert (r.n_words, r.n_base) == (len(w), len(places))
        assert (r.first_word, r.last_word) == ((places[0][0], places[-1][0]) if places else (None, None))
        assert r.base_labels == ",".join(sorted({x for _, x in places})) and {x for _, x in places} <= set(r.labels.split(",")) and 0 <= r.score <= 1
        hits += len(places)
    assert hits


def test_token_counts_of_a_table(spark, small, texts):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=token_count.default_model())
    for i, r in rows(spark, small, "op10_token_count").items():
        n = len(sp.encode(texts[i]))
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(texts[i].encode()), n, n > 4096)


def test_edited_fingerprints_of_a_table(spark, small, texts):
    got, ids = rows(spark, small, "op3_fingerprint"), sorted(texts)
    edited = []
    for k, i in enumerate(ids):
        cut, after = len(texts[i]) // 4, texts[ids[(k + 1) % len(ids)]]
        edited.append((i, texts[i][: len(texts[i]) - cut] + after[:cut], texts[i]))
    prints = fingerprint.with_fingerprint(spark.createDataFrame(edited, "doc_id long, text string, raw string"), "text", "print").withColumn("hex", fingerprint.as_text(F.col("print")))
    hexes = {r.doc_id: r.hex for r in prints.collect()}
    error = []

    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", t.lower())
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    for i, t, raw in edited:
        assert got[i].edited_fingerprint == hexes[i] and got[i].edited_sha256 == hashlib.sha256(t.encode()).hexdigest()
        a, b = shingles(raw), shingles(t)
        error.append(got[i].near_edited - (len(a & b) / len(a | b) if a | b else 1.0))
    assert abs(sum(error) / len(error)) < 0.02 and max(map(abs, error)) < 0.25
