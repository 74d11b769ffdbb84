"""Canonical JSON of nested values, content hashes and time-ordered identifiers."""

from __future__ import annotations

import hashlib
import json
import math
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _number(x: float) -> str:
    """The shortest text of a number, as in ECMAScript."""
    if not math.isfinite(x):
        raise ValueError("not a number of JSON")
    if x == int(x) and abs(x) < 1e21:
        return str(int(x))
    digits, _, exponent = repr(abs(x)).partition("e")
    whole, _, part = digits.partition(".")
    power = int(exponent or 0) + len(whole)
    figures = (whole + part).lstrip("0")
    power -= len(whole + part) - len((whole + part).lstrip("0"))
    figures = figures.rstrip("0")
    sign = "-" if x < 0 else ""
    if -6 < power <= 0:
        return f"{sign}0.{'0' * -power}{figures}"
    if 0 < power <= 21:
        return f"{sign}{figures[:power]}.{figures[power:]}"
    e = power - 1
    return f"{sign}{figures[0]}{'.' + figures[1:] if len(figures) > 1 else ''}e{'+' if e > 0 else ''}{e}"


def canonical(value: Any) -> str:
    """JSON with keys in order of their UTF-16 units, no spaces, and minus zero as zero."""
    if value is None or isinstance(value, (bool, str)):
        return json.dumps(value, ensure_ascii=False)
    if isinstance(value, (int, float)):
        return _number(value)
    if isinstance(value, list):
        return "[" + ",".join(map(canonical, value)) + "]"
    if isinstance(value, dict):
        return "{" + ",".join(f"{canonical(k)}:{canonical(value[k])}" for k in sorted(value, key=lambda k: k.encode("utf-16-be"))) + "}"
    raise TypeError(f"{type(value).__name__} isn't JSON")


def canonical_json(text: Column | str) -> Column:
    """The canonical form of a JSON text; null for null and for what isn't JSON."""

    @F.pandas_udf("string")
    def form(texts: pd.Series) -> pd.Series:
        def one(text: str | None) -> str | None:
            try:
                return None if text is None else canonical(json.loads(text))
            except ValueError:
                return None

        return texts.map(one, na_action=None)

    return form(text)


def content_hash(text: Column | str) -> Column:
    return F.sha2(canonical_json(text), 256)


def uuid7(at_ms: Column | str, counter: Column | str, *seed: Column | str) -> Column:
    """A version-7 identifier of a time, a counter of 12 bits and 62 bits that are drawn from ``seed``.

    Nothing is random: the same row gets the same identifier in every run.
    """
    hexed = lambda x, n: F.lpad(F.lower(F.hex(x)), n, "0")
    counter_ = F.col(counter) if isinstance(counter, str) else counter
    time_ = F.col(at_ms) if isinstance(at_ms, str) else at_ms
    draw = F.xxhash64(*seed).bitwiseAND(F.lit((1 << 62) - 1)).bitwiseOR(F.lit(-(1 << 63)))
    bare = F.concat(hexed(time_, 12), F.lit("7"), hexed(counter_ % 4096, 3), hexed(draw, 16))
    return F.concat_ws("-", F.substring(bare, 1, 8), F.substring(bare, 9, 4), F.substring(bare, 13, 4), F.substring(bare, 17, 4), F.substring(bare, 21, 12))


def sha256_text(value: Any) -> str:
    return hashlib.sha256(canonical(value).encode()).hexdigest()
