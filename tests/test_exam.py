from datetime import date

import pytest

from quire.errors import GenerationFailed
from quire.operators import citations as G
from quire.operators import exam as X
from quire.operators import replies as R

ITEM = {"topic": "t", "question": "q", "answer": "a", "source": "s", "page": "3"}


class Chat:
    def __init__(self, *replies):
        self.replies, self.kinds, self.last = list(replies), [], None

    def complete(self, messages, kind, on_token=None):
        self.kinds.append(kind and kind["type"])
        self.last = messages
        r = self.replies.pop(0)
        if isinstance(r, Exception):
            raise r
        return r


def test_coerce_and_validate():
    assert R.with_items([1]) == {"items": [1]} and R.with_items({"q": [1], "n": 2}) == {"items": [1]} and R.with_items(ITEM) == {"items": [ITEM]}
    two = {"a": [1], "b": [2]}
    assert R.with_items(two) is two and R.with_items({"items": [], "x": [1]}) == {"items": [], "x": [1]}
    assert X.validate({"items": [ITEM]})[0]["page"] == 3 and X.validate({"items": []}) == []
    for bad in ({}, {"items": None}, {"items": [ITEM | {"page": "x"}]}, {"items": [{}]}, [1], {"items": [ITEM | {"page": True}]}):
        with pytest.raises(ValueError):
            X.validate(bad)


def test_extract_json():
    assert R.read_json('```json\n{"a": 1}\n```') == {"a": 1} and R.read_json('Sure: {"a": {"b": 2}} ok') == {"a": {"b": 2}}
    assert R.read_json('As in [1], {"a": "}", "b": ["]"]} or {') == {"a": "}", "b": ["]"]} and R.read_json('```json\n[{"page": 1}]\n```') == [{"page": 1}]
    assert R.read_json('so "it" is {"a": "say \\"{\\""}') == {"a": 'say "{"'}
    with pytest.raises(ValueError):
        R.read_json("none")


def test_advice_by_the_error_behind():
    from urllib.error import URLError

    assert "memory" in R.help_for([ValueError("x"), URLError(TimeoutError("slow"))], "") and "server at http://h:1" in R.help_for([URLError(ConnectionRefusedError(111, "no"))], "http://h:1/v1")
    assert "format" in R.help_for([ValueError("x")], "") == R.help_for([], "")


def test_retry_ladder():
    chat = Chat(OSError("no"), "", "[]")
    items, attempts, raw = X.complete(chat, "s", "u", 4)
    assert (items, attempts, raw) == ([], 2, "[]") and chat.kinds == ["json_schema", "json_object", "json_object"]
    chat = Chat("bad", "[]")
    X.complete(chat, "s", "u", 2)
    assert chat.last[2] == {"role": "assistant", "content": "bad"} and len(chat.last) == 4
    with pytest.raises(GenerationFailed, match="memory"):
        X.complete(Chat(*[OSError("timed out")] * 5), "s", "u", 2)


def test_citations(spark):
    chunks = spark.createDataFrame([("s", 2, 4), ("s", 9, None), ("u", 1, 1)], "source string, page long, page_end long")
    items = spark.createDataFrame([(1, "s", 3), (2, "s", 6), (3, "s", 7), (4, "x", 1), (5, "u", 9)], "n int, source string, page long")
    got = {r.n: (r.status, r.cited_page) for r in G.check_citations(items, chunks).collect()}
    assert got == {1: ("kept", 3), 2: ("repaired", 4), 3: ("repaired", 9), 4: ("dropped", None), 5: ("dropped", None)}
    assert sorted(r.page for r in G.allowed_pages(chunks).filter("source = 's'").collect()) == [2, 3, 4, 9]


def test_render(spark):
    items = spark.createDataFrame([(1, "B", "q1", "a1", "s", 1), (2, " ", "q2", "a2", "r", 2), (3, "B", "q3", "a3", "s", 1)], X.ITEM)
    paper, key = X.render("My course", items, date(2024, 5, 1))
    assert "3 questions from 2 source documents, 2024-05-01" in paper and "My_course_answers.md" in paper
    assert paper.index("## B") < paper.index("**3.** q3") < paper.index("## General") and "> Source: **r**, page 2" in key
    assert [(r.topic, r.questions) for r in X.topics_covered(items).collect()] == [("B", 2), ("General", 1)]
