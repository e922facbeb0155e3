"""A tolerant JSON reader for configuration: comments, unquoted keys, single quotes, trailing commas, NaN, line breaks in strings."""

from __future__ import annotations

import json
import re
from typing import Any

from pyspark.sql import DataFrame, SparkSession

TOKEN = re.compile(
    r"""(?P<skip>\s+|//[^\n]*|/\*.*?\*/)|(?P<str>"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')|(?P<num>[-+]?(?:Infinity|NaN|0[xX][0-9a-fA-F]+|[0-9]*\.?[0-9]+(?:[eE][-+]?[0-9]+)?|[0-9]+\.))(?![\w$])|(?P<word>[A-Za-z_$][\w$-]*)|(?P<op>[{}\[\]:,])""",
    re.X | re.S,
)
WORDS = {"true": True, "false": False, "null": None}
ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f", "\n": "", "0": "\0"}


def loads(text: str) -> Any:
    toks, at = [], 0
    while at < len(text):
        m = TOKEN.match(text, at)
        if not m:
            raise ValueError(f"not JSON at {at}: {text[at : at + 20]!r}")
        if m.lastgroup != "skip":
            toks.append((m.lastgroup, m[0]))
        at = m.end()
    value, end = _value(toks, 0)
    if end != len(toks):
        raise ValueError(f"{toks[end][1]!r} after the value")
    return value


def _string(raw: str) -> str:
    return re.sub(r"\\(u[0-9A-Fa-f]{4}|x[0-9A-Fa-f]{2}|.)", lambda m: chr(int(m[1][1:], 16)) if len(m[1]) > 1 else ESCAPES.get(m[1], m[1]), raw[1:-1], flags=re.S)


def _number(raw: str) -> int | float:
    sign, body = (-1, raw[1:]) if raw[0] == "-" else (1, raw.lstrip("+"))
    if body == "NaN":
        return float("nan")
    if body == "Infinity":
        return sign * float("inf")
    if body[:2].lower() == "0x":
        return sign * int(body, 16)
    return sign * (int(body) if body.isdigit() else float(body))


def _value(toks: list, i: int) -> tuple[Any, int]:
    if i >= len(toks):
        raise ValueError("the text ends within a value")
    kind, raw = toks[i]
    if kind == "str":
        return _string(raw), i + 1
    if kind == "num":
        return _number(raw), i + 1
    if kind == "word":
        if raw not in WORDS:
            raise ValueError(f"{raw!r} is no value")
        return WORDS[raw], i + 1
    if raw == "[":
        out: list = []
        i += 1
        while toks[i][1] != "]":
            x, i = _value(toks, i)
            out.append(x)
            if toks[i][1] == ",":
                i += 1
            elif toks[i][1] != "]":
                raise ValueError(f"{toks[i][1]!r} in an array")
        return out, i + 1
    if raw == "{":
        found: dict = {}
        i += 1
        while toks[i][1] != "}":
            kind, key = toks[i]
            key = _string(key) if kind == "str" else key
            if toks[i + 1][1] != ":":
                raise ValueError(f"no colon after {key!r}")
            found[key], i = _value(toks, i + 2)
            if toks[i][1] == ",":
                i += 1
            elif toks[i][1] != "}":
                raise ValueError(f"{toks[i][1]!r} in an object")
        return found, i + 1
    raise ValueError(f"{raw!r} is no value")


def dumps(value: Any) -> str:
    return json.dumps(value, ensure_ascii=False, indent=2)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Tolerant JSON lines as a DataFrame, by Spark's own reader."""
    return spark.read.options(allowComments=True, allowUnquotedFieldNames=True, allowSingleQuotes=True, allowNonNumericNumbers=True).json(path)
