"""Functions that no Spark built-in expresses: matching blocks of two strings, and repair of cut-off JSON."""

from __future__ import annotations

import difflib
import json

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp ratio; null if either is."""
    return pd.Series([None if x is None or y is None else 1.0 if x == y else difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def longest_block_share(quote: pd.Series, source: pd.Series) -> pd.Series:
    """Length of the longest common block as a share of the quotation."""

    def share(q: str | None, s: str | None) -> float | None:
        if not q or s is None:
            return None
        return difflib.SequenceMatcher(None, q, s, autojunk=False).find_longest_match(0, len(q), 0, len(s)).size / len(q)

    return pd.Series([share(q, s) for q, s in zip(quote, source)], dtype="float64")


def repair(text: str | None) -> str | None:
    """JSON that was cut off: the longest prefix that closes to a valid value, or null."""
    if not text or (start := min((i for i in (text.find("{"), text.find("[")) if i >= 0), default=-1)) < 0:
        return None
    text = text[start:]
    stack, inside, escaped, ends = [], False, False, []
    for i, c in enumerate(text):
        if inside:
            escaped, inside = (c == "\\" and not escaped), not (c == '"' and not escaped)
            continue
        if c == '"':
            inside = True
        elif c in "{[":
            stack.append("}" if c == "{" else "]")
        elif c in "}]":
            if not stack or stack.pop() != c:
                break
            ends.append((i + 1, "".join(reversed(stack))))
            if not stack:
                break
        elif c == ",":
            ends.append((i, "".join(reversed(stack))))
    tail = "".join(reversed(stack))
    ends.append((len(text), ('"' if inside and not escaped else "") + tail))
    for end, close in reversed(ends):
        try:
            return json.dumps(json.loads(text[:end] + close), ensure_ascii=False)
        except ValueError:
            continue
    return None


@F.pandas_udf(T.StringType())
def repair_json(text: pd.Series) -> pd.Series:
    return text.map(repair)
