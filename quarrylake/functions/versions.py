"""Version and Unicode functions that Spark has no built-in for: Arrow-batched UDFs."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import functions as F, types as T

_NUMBER = r"(0|[1-9]\d*)"
_PARTS = r"[0-9A-Za-z-]+(?:\.[0-9A-Za-z-]+)*"
_SEMVER = re.compile(rf"^v?{_NUMBER}\.{_NUMBER}\.{_NUMBER}(?:-({_PARTS}))?(?:\+{_PARTS})?$")
_PARTIAL = re.compile(r"^v?(?:[xX*]|\d+)(?:\.(?:[xX*]|\d+)){0,2}$")


def parse(version: str | None) -> tuple | None:
    """A sortable key; a release is above its prereleases, numbers are below words. Numbers have no leading zeros."""
    m = _SEMVER.match((version or "").strip())
    if not m:
        return None
    parts = m[4].split(".") if m[4] else []
    if any(p.isdigit() and len(p) > 1 and p[0] == "0" for p in parts):
        return None
    pre = tuple((0, int(p), "") if p.isdigit() else (1, 0, p) for p in parts)
    return int(m[1]), int(m[2]), int(m[3]), 0 if pre else 1, pre


def compare(left: str | None, right: str | None) -> int | None:
    a, b = parse(left), parse(right)
    return None if a is None or b is None else (a > b) - (a < b)


def release(major: int, minor: int = 0, patch: int = 0) -> tuple:
    return major, minor, patch, 1, ()


def _known(text: str) -> list[int] | None:
    """The numbers of a partial version before its wildcard, or None if it is not one; none may follow a wildcard."""
    if not _PARTIAL.match(text):
        return None
    digits = text.lstrip("v").split(".")
    wild = next((i for i, x in enumerate(digits) if not x.isdigit()), len(digits))
    if any(x.isdigit() for x in digits[wild:]) or any(len(x) > 1 and x[0] == "0" for x in digits[:wild]):
        return None
    return [int(x) for x in digits[:wild]]


def _allows(token: str, v: tuple) -> bool:
    """Whether a release satisfies one comparator."""
    if token in ("*", "x", "X"):
        return True
    mark = re.match(r"[<>]=?|[~^=]?", token)[0]
    known, exact = _known(token[len(mark) :]), parse(token[len(mark) :])
    if known == [] or known is None and (exact is None or mark == "~"):
        return False
    low = exact or release(*known)
    if mark in ("<", "<=", ">", ">="):
        return {"<": v < low, "<=": v <= low, ">": v > low, ">=": v >= low}[mark]
    if mark == "^":
        # the first number that is not 0 may not change; a wildcard among zeros leaves the last known free
        n = 3 if known is None else len(known)
        at = next((i for i in range(3) if low[i]), min(n, 3) - 1)
        return low <= v < release(*low[:at], low[at] + 1)
    if mark == "~":
        at = 0 if len(known) == 1 else 1
        return low <= v < release(*low[:at], low[at] + 1)
    return known is not None and list(v[: len(known)]) == known


def _clause(text: str, v: tuple) -> bool:
    """An exact version matches itself; a prerelease satisfies nothing else."""
    text = re.sub(r"([<>]=?|[~^])\s+", r"\1", text).replace(",", " ").strip()
    exact = parse(text.removeprefix("="))
    if exact is not None:
        return v == exact
    if v[4]:
        return False
    if m := re.match(r"^(\S+)\s+-\s+(\S+)$", text):
        low, high = parse(m[1]), parse(m[2])
        return low is not None and high is not None and low <= v <= high
    return bool(text) and all(_allows(t, v) for t in text.split())


def satisfies(constraint: str | None, version: str | None) -> bool:
    """Absent versions are compatible; what is not understood is not, and a constraint with an empty clause allows nothing."""
    if constraint is None or version is None:
        return True
    v = parse(version)
    clauses = [c.strip() for c in constraint.split("||")]
    return v is not None and all(clauses) and any(_clause(c, v) for c in clauses)


@F.pandas_udf(T.IntegerType())
def semver_compare(left: pd.Series, right: pd.Series) -> pd.Series:
    return pd.Series([compare(a, b) for a, b in zip(left, right)], dtype="Int32")


@F.pandas_udf(T.BooleanType())
def npm_compatible(constraint: pd.Series, version: pd.Series) -> pd.Series:
    return pd.Series([satisfies(a, b) for a, b in zip(constraint, version)])


@F.pandas_udf(T.StringType())
def nfc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


@F.pandas_udf(T.StringType())
def nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))
