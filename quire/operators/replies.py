"""What a language model sent back: the JSON in it, the exam items in that, and what may help where there are none."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The fields of an item, in the order in which it is written.
FIELDS = ("topic", "question", "answer", "source", "page")
ITEM = {"type": "object", "required": list(FIELDS), "properties": {f: {"type": "integer" if f == "page" else "string"} for f in FIELDS}}
SCHEMA = {"type": "object", "required": ["items"], "properties": {"items": {"type": "array", "items": ITEM}}}


class Format(NamedTuple):
    """A way to ask for JSON. The strict ones come first; ``once``: not asked for again after a reply that did not fit."""

    wire: dict | None
    once: bool = False


FORMATS = (
    Format({"type": "json_schema", "json_schema": {"name": "exam", "schema": SCHEMA, "strict": True}}, once=True),
    Format({"type": "json_object"}),
    Format(None),
)


def formats(attempt: int) -> list[dict | None]:
    """What to ask an endpoint for, in turn, until it takes one."""
    return [f.wire for f in FORMATS if attempt == 1 or not f.once]


# -- finding the JSON --

CLOSER = {"{": "}", "[": "]"}


def closed_runs(text: str) -> Iterator[str]:
    """Outermost runs from an opening bracket to the one that closes it; brackets inside strings do not count."""
    open_, start, quoted, skip = [], 0, False, False
    for i, c in enumerate(text):
        if skip:
            skip = False
        elif quoted:
            skip, quoted = c == "\\", c != '"'
        elif c == '"' and open_:
            quoted = True
        elif c in CLOSER:
            start = start if open_ else i
            open_.append(CLOSER[c])
        elif open_ and c == open_[-1]:
            open_.pop()
            if not open_:
                yield text[start : i + 1]


def read_json(reply: str):
    """The JSON value that a reply is, or else the longest list or object that stands closed within its prose and fences."""
    best = None
    for part in (reply, *sorted(closed_runs(reply), key=len, reverse=True)):
        try:
            return json.loads(part)
        except ValueError as e:
            best = best or e
    raise ValueError(f"the reply holds no JSON ({best}); it begins {reply.strip()[:80]!r}")


# -- finding the items --


def _only_list(data: dict) -> list | None:
    lists = [v for v in data.values() if isinstance(v, list)]
    return lists[0] if len(lists) == 1 else None


#: Shapes other than {"items": [...]} whose items are beyond doubt, with the way to them.
SHAPES: tuple[tuple[type, Callable], ...] = (
    (list, lambda data: data),
    (dict, lambda data: [data] if all(f in data for f in FIELDS[1:]) else None),
    (dict, _only_list),
)


def with_items(data):
    """``data`` as {"items": [...]}, or unchanged where it is that already or where the items' place is in doubt."""
    if isinstance(data, dict) and "items" in data:
        return data
    for kind, find in SHAPES:
        if isinstance(data, kind) and (found := find(data)) is not None:
            return {"items": found}
    return data


def item_list(reply: str) -> list | None:
    """The raw items of a reply, unchecked; None if it holds no JSON or their place is in doubt."""
    try:
        data = with_items(read_json(reply))
    except ValueError:
        return None
    found = data.get("items") if isinstance(data, dict) else None
    return found if isinstance(found, list) else None


# -- tables of replies --


def parsed(reply: Column) -> Column:
    """The JSON value of each reply as a variant: the whole, or what stands in a fence, or from the first to the last brace, or bracket; null if none parses."""
    inside = lambda pattern, group: F.try_parse_json(F.nullif(F.regexp_extract(reply, pattern, group), F.lit("")))
    return F.coalesce(F.try_parse_json(reply), inside(r"(?s)```(?:json)?(.*?)```", 1), inside(r"(?s)\{.*\}", 0), inside(r"(?s)\[.*\]", 0))


def _is(value: Column, kind: str) -> Column:
    return F.schema_of_variant(value).startswith(kind)


def items_of(value: Column) -> Column:
    """The raw items of a parsed reply as array<variant>, by the shapes that with_items() takes; null where their place is in doubt."""
    array = lambda v: v.try_cast("array<variant>")
    fields = value.try_cast("map<string, variant>")
    lists = F.filter(F.map_values(fields), lambda v: _is(v, "ARRAY"))
    named = F.try_element_at(fields, F.lit("items"))
    whole = F.lit(True)
    for f in FIELDS[1:]:
        whole = whole & F.map_contains_key(fields, f)
    of_object = F.when(F.map_contains_key(fields, "items"), F.when(_is(named, "ARRAY"), array(named))).when(whole, F.array(value)).when(F.size(lists) == 1, array(F.get(lists, F.lit(0))))
    return F.when(_is(value, "ARRAY"), array(value)).when(_is(value, "OBJECT"), of_object)


def items_table(replies: DataFrame, reply: str, *keys: str) -> DataFrame:
    """(keys, at, topic, question, answer, source, page, fault) of every item of a table of replies, in the JVM alone.

    A page written as a string of digits counts as a number; topic may be missing. fault names the first field that is missing or of another kind, and is null for an item that fits.
    """
    each = replies.select(*keys, F.posexplode(items_of(parsed(F.col(reply)))).alias("at", "item"))
    get = lambda f: F.when(_is(F.col("item"), "OBJECT"), F.try_variant_get("item", f"$.{f}", "variant"))
    out = each.select(*keys, "at", *[get(f).alias(f"raw_{f}") for f in FIELDS])
    text = {f: F.when(_is(F.col(f"raw_{f}"), "STRING"), F.col(f"raw_{f}").try_cast("string")) for f in FIELDS if f != "page"}
    page = F.when(_is(F.col("raw_page"), "BIGINT"), F.col("raw_page").try_cast("bigint")).when(_is(F.col("raw_page"), "STRING"), F.trim(F.col("raw_page").try_cast("string")).try_cast("bigint"))
    found = {**text, "page": page}
    fault = F.coalesce(*[F.when(found[f].isNull() & (F.lit(f != "topic") | F.col("raw_topic").isNotNull()), F.lit(f)) for f in FIELDS])
    return out.select(*keys, "at", *[found[f].alias(f) for f in FIELDS], fault.alias("fault"))


# -- when nothing came --

HELP = {
    TimeoutError: "The model was too slow. On a machine of one's own that is mostly a lack of memory: free some, choose a smaller model, or send fewer passages.",
    ConnectionError: "There is no server at {url}.",
    ValueError: "The model did not keep to the format; a larger one may.",
}


def chain(error: BaseException | None) -> Iterator[BaseException]:
    """An error and those behind it; HTTP libraries wrap the one that tells."""
    while isinstance(error, BaseException):
        yield TimeoutError(str(error)) if "timed out" in str(error) else error
        error = getattr(error, "reason", None) or error.__cause__


def help_for(errors: list[Exception], url: str) -> str:
    """The advice for the first class in HELP that any of the errors goes back to, or the last one."""
    seen = [e for error in errors for e in chain(error)]
    kind = next((k for k in HELP if any(isinstance(e, k) for e in seen)), ValueError)
    return HELP[kind].format(url=url.removesuffix("/v1") or "the given address")
