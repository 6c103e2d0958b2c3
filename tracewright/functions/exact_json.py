"""JSON texts read so that they can be written back as they were: repeated names, the spelling of numbers and order stay."""

from __future__ import annotations

import json


class Pairs(list):
    """An object's members in order, repeated names included."""


class Number:
    """A number as it is spelt."""

    __slots__ = ("text",)

    def __init__(self, text: str):
        self.text = text


def _no_json(text: str):
    raise ValueError(text)


def loads(text: str):
    """Objects as Pairs, numbers as Number; NaN and Infinity are no JSON."""
    return json.loads(text, object_pairs_hook=Pairs, parse_float=Number, parse_int=Number, parse_constant=_no_json)


def dumps(v) -> str:
    """The text of a value of loads, without white space between tokens."""
    if isinstance(v, Pairs):
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{dumps(x)}" for k, x in v) + "}"
    if isinstance(v, list):
        return "[" + ",".join(map(dumps, v)) + "]"
    return v.text if isinstance(v, Number) else json.dumps(v, ensure_ascii=False)
