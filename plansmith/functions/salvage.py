"""JSON objects out of free text.

One scanner cuts a text into tokens. A reader walks them with a stack of open containers and tells of every object that
closes, and of those still open where the text ends behind a whole value. Where no object will do, the same tokens are
read as loose key-value pairs, whose keys may be misspelt.
"""

from __future__ import annotations

import difflib
import json
import re
from collections.abc import Iterator
from typing import Any, NamedTuple

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from plansmith.functions.registry import PROTEIN
from plansmith.plans.model import compact, flat_keys
from plansmith.session import ship

# Misspellings of keys, other words for a key's parts, and keys that mean the limit.
MISSPELT = {"engimber_": "engineered", "enginered": "engineered", "higheral_class": "oral_class", "statper_class": "scaffold_type"}
OTHER_WORDS = {"by": ("by", "field", "rank"), "engi": ("engi", "imber")}
LIMIT_KEYS = {"top", "k", "length"}
CLOSE = 0.84


class Token(NamedTuple):
    """kind: one of {}[]:, or s (string), u (string without an end), n (number), w (word), ? (anything else)."""

    kind: str
    at: int
    text: str


_TOKEN = re.compile(r'\s*(?:([{}\[\]:,])|("(?:[^"\\]|\\.)*")|("(?:[^"\\]|\\.)*\\?\Z)|(-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)|([^\W\d]+)|(\S))', re.S)


def tokens(text: str, at: int = 0) -> Iterator[Token]:
    while m := _TOKEN.match(text, at):
        at, n = m.end(), m.lastindex
        yield Token(m[n] if n == 1 else " sunw?"[n - 1], m.start(n), m[n])


_WORDS = {"true": True, "false": False, "null": None}


def _value(t: Token) -> Any:
    """A scalar token's value by JSON's rules; ValueError for what is none."""
    if t.kind == "w":
        if t.text not in _WORDS:
            raise ValueError
        return _WORDS[t.text]
    return json.loads(t.text)


class _Open:
    """A container that isn't closed yet. wants: what may come next, of key, colon, value, comma and end."""

    def __init__(self, at: int, is_object: bool) -> None:
        self.at, self.is_object, self.key = at, is_object, None
        self.got: Any = {} if is_object else []
        self.wants = {"key" if is_object else "value", "end"}

    def take(self, x: Any) -> None:
        if self.is_object:
            self.got[self.key] = x
        else:
            self.got.append(x)
        self.wants = {"comma", "end"}


def _walk(text: str, start: int) -> tuple[list[tuple[int, dict]], list[int], int]:
    """From a brace on: objects found with their places, braces seen inside strings, and where to go on."""
    stack: list[_Open] = []
    found, hidden = [], []
    for t in tokens(text, start):
        top = stack[-1] if stack else None
        wants = top.wants if top else {"value"}
        if t.kind == "s":
            hidden += [t.at + i for i, c in enumerate(t.text) if c == "{"]
        try:
            if t.kind in "{[" and "value" in wants:
                stack.append(_Open(t.at, t.kind == "{"))
            elif t.kind in "}]" and "end" in wants and top.is_object == (t.kind == "}"):
                stack.pop()
                if top.is_object:
                    found.append((top.at, top.got))
                if not stack:
                    return found, [], t.at + 1
                stack[-1].take(top.got)
            elif t.kind == "," and "comma" in wants:
                top.wants = {"key" if top.is_object else "value"}
            elif t.kind == ":" and "colon" in wants:
                top.wants = {"value"}
            elif t.kind == "s" and "key" in wants:
                top.key, top.wants = json.loads(t.text), {"colon"}
            elif t.kind in "snw" and "value" in wants:
                top.take(_value(t))
            else:
                return found, hidden, max(t.at, start + 1)
        except ValueError:
            return found, hidden, max(t.at, start + 1)
    if stack and "end" in stack[-1].wants:
        for inner, outer in zip(stack[:0:-1], stack[-2::-1], strict=True):
            outer.take(inner.got)
        return found + [(x.at, x.got) for x in stack if x.is_object], [], len(text)
    return found, hidden, len(text)


def objects(text: str) -> list[dict[str, Any]]:
    """Objects in the order in which they begin; one that the text's end cuts off counts if it only lacks closing marks."""
    out: dict[int, dict] = {}
    at = text.find("{")
    while at >= 0:
        found, hidden, on = _walk(text, at)
        for brace in hidden:
            found += _walk(text, brace)[0]
        out |= {i: x for i, x in found if i not in out}
        at = text.find("{", on)
    return [out[i] for i in sorted(out)]


# ---- loose pairs ----


def loose(t: Token) -> Any:
    """A scalar that may be cut off: tru and fal, a string without its end, the whole part of a number."""
    low = t.text.lower()
    if t.kind == "w":
        return True if low.startswith("tru") else False if low.startswith("fal") else None
    if t.kind == "n":
        return int(re.match(r"-?\d+", t.text)[0])
    try:
        return json.loads(t.text)
    except ValueError:
        return t.text[1:].rstrip('"')


def _is_scalar(t: Token) -> bool:
    return t.kind in "sun" or t.kind == "w" and t.text.lower().startswith(("tru", "fal", "null"))


def _parts() -> dict[str, list[tuple[str, ...]]]:
    """For each slot the beginnings of its name's parts, each with the other words for it."""
    names = {s: [p[:4] for p in s.split("_") if p != "has"] for s in flat_keys()}
    return {s: [OTHER_WORDS.get(p, (p,)) for p in parts] for s, parts in names.items()}


def slot_of(raw_key: str, value: Any) -> str | None:
    """The slot that a key means: by name, by a known misspelling, by the parts in it, by what its value can only be, or by likeness."""
    key = re.sub("[- ]", "_", raw_key.strip().lower())
    if key in flat_keys() or key in MISSPELT:
        return MISSPELT.get(key, key)
    if key in LIMIT_KEYS:
        return "limit"
    held = {s: [any(w in key for w in words) for words in parts] for s, parts in _parts().items()}
    # Of a slot's two name parts both must be there, of the two words about affinity one.
    whole = [s for s, hits in held.items() if (any(hits) if s.startswith("has_") else all(hits))]
    if whole:
        return max(whole, key=lambda s: sum(held[s]))
    for slot in ("scaffold_type", "oral_class"):
        if isinstance(value, str) and value in PROTEIN.by_name[slot].values:
            return slot
    return next(iter(difflib.get_close_matches(key, flat_keys(), 1, CLOSE)), None)


def pairs(text: str) -> dict[str, Any] | None:
    """Slots that loose pairs name, the first of a slot counting; None where they name none but the limit."""
    found: dict[str, Any] = {}
    before: list[Token] = []
    for t in tokens(text):
        if len(before) == 2 and before[0].kind == "s" and len(before[0].text) > 2 and before[1].kind == ":" and _is_scalar(t):
            value = loose(t)
            slot = slot_of(before[0].text[1:-1], value)
            if slot == "limit" and not (type(value) is int and value > 0):
                slot = None
            if slot is not None:
                found.setdefault(slot, value)
        before = [*before[-1:], t]
    return {"limit": PROTEIN.limit} | found if found.keys() - {"limit"} else None


# ---- answers ----


def _fenced(text: str) -> Iterator[str]:
    """What stands between pairs of three backticks, without a language's name."""
    parts = text.split("```")
    for inside in parts[1 : len(parts) - 1 : 2]:
        yield inside[4:] if inside[:4].lower() == "json" else inside


def first_object(text: str | None, required: frozenset[str] | set[str] = frozenset()) -> dict[str, Any] | None:
    """The first object with the required keys, in a fenced block before the rest; loose pairs where there is none."""
    for part in (*_fenced(text or ""), text or ""):
        for x in (*objects(part), pairs(part)):
            if x is not None and required <= x.keys():
                return x
    return None


@F.pandas_udf(StringType())
def _salvaged(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if (x := first_object(t, {"limit"})) is None else compact(x))


def draft_json(answer: Column) -> Column:
    """The draft in a model's answer as JSON text; answers that are one whole object with a limit never leave the JVM."""
    if session := SparkSession.getActiveSession():
        ship(session)
    whole = F.try_parse_json(answer)
    plain = F.trim(answer).startswith("{") & F.try_variant_get(whole, "$.limit", "string").isNotNull()
    return F.when(F.coalesce(plain, F.lit(False)), F.to_json(whole)).otherwise(_salvaged(F.when(~F.coalesce(plain, F.lit(False)), answer)))
