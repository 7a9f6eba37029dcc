"""Strict JSON: no key twice, no lone surrogates, no text behind the value, numbers as the grammar has them, bounded depth."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

DEPTH = 128
STRING = re.compile(r'"(?:[^"\\]|\\.)*"', re.S)
ZEROS = re.compile(r"(?<![0-9.eE+])-?0[0-9]")
# half a pair: a high escape without a low one behind, or a low one without a high one before
HALF = re.compile(r"\\u[dD][89abAB][0-9a-fA-F]{2}(?!\\u[dD][c-fC-F][0-9a-fA-F]{2})|(?<!\\u[dD][89abAB][0-9a-fA-F]{2})\\u[dD][c-fC-F][0-9a-fA-F]{2}")


class Twice(ValueError):
    pass


def _members(pairs: list[tuple[str, object]]) -> dict:
    out = dict(pairs)
    if len(out) != len(pairs):
        raise Twice
    return out


def _constant(name: str) -> None:
    raise json.JSONDecodeError("no constant", name, 0)


DECODER = json.JSONDecoder(object_pairs_hook=_members, parse_constant=_constant)


def check(text: str) -> tuple[str | None, int]:
    """What is wrong with a text and at which byte: ``depth``, ``surrogate``, ``number``, ``duplicate``, ``end``, ``trailing`` or ``syntax``; (None, -1) if nothing is."""
    at = lambda i: len(text[:i].encode("utf-8", "surrogatepass"))
    bare = STRING.sub(lambda m: '"' + "x" * (len(m[0]) - 2) + '"', text)
    depth = 0
    for i, ch in enumerate(bare):
        depth += (ch in "[{") - (ch in "]}")
        if depth > DEPTH:
            return "depth", at(i)
    for m in STRING.finditer(text):
        plain = re.sub(r"\\\\", "xx", m[0])
        half = HALF.search(plain)
        if half:
            return "surrogate", at(m.start() + half.start())
    zero = ZEROS.search(bare)
    if zero:
        return "number", at(zero.start())
    start = len(text) - len(text.lstrip(" \t\r\n"))
    try:
        _, end = DECODER.raw_decode(text, start)
    except Twice:
        return "duplicate", at(start)
    except json.JSONDecodeError as e:
        return ("end" if e.pos >= len(text.rstrip()) else "syntax"), at(e.pos)
    rest = text[end:].strip(" \t\r\n")
    return ("trailing", at(end)) if rest else (None, -1)


@F.pandas_udf(StringType())
def _fault(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else check(t)[0])


def fault(text: Column) -> Column:
    """The kind of fault of a JSON text, null if it has none; see ``check``."""
    return _fault(text)
