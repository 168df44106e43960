"""Type signatures as texts: words of them, a form without redundant blanks, and one that names type variables in order."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

PIECE = re.compile(r"\s+|->|=>|::|\(#|#\)|[()\[\],!]|[A-Za-z_][\w'.]*|[^\s\w()\[\],]+|\d+")
VARIABLE = re.compile(r"[a-z_][\w']*$")
TOLD_BY = re.compile(r"->|=>|^\s*\(.*,.*\)\s*$|^\s*\[.*\]\s*$", re.S)


def pieces(text: str) -> list[str]:
    return [p for p in PIECE.findall(text) if not p.isspace()]


def stripped(text: str) -> str:
    """One blank between names, none elsewhere but around arrows."""
    out: list[str] = []
    for p in pieces(text):
        if p in ("->", "=>", "::"):
            out.append(f" {p} ")
        elif out and re.match(r"\w", p) and re.search(r"[\w')\]]$", out[-1]) or out and p in ("(", "[") and re.search(r"[\w')\]]$", out[-1]):
            out.append(f" {p}")
        else:
            out.append(p)
    return re.sub(r" +", " ", "".join(out)).strip()


def normal(text: str) -> str:
    """Type variables renamed to a, b, c, ... in order of their first use, then stripped."""
    names: dict[str, str] = {}
    out = []
    for p in pieces(text):
        if VARIABLE.match(p):
            n = len(names)
            p = names.setdefault(p, chr(97 + n % 26) + (str(n // 26) if n >= 26 else ""))
        out.append(p)
    return stripped(" ".join(out))


def is_signature(text: Column) -> Column:
    return text.rlike(r"(?s)->|=>|^\s*\(.*,.*\)\s*$|^\s*\[.*\]\s*$")


@F.pandas_udf(StringType())
def stripped_udf(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else stripped(t))


@F.pandas_udf(StringType())
def normal_udf(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else normal(t))
