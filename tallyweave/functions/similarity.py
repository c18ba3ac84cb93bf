"""String similarity that Spark lacks: Jaro-Winkler and Metaphone, as Arrow functions."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def jaro_winkler_of(a: str, b: str) -> float:
    """Jaro similarity, raised by a common prefix of up to four characters where it is above 0.7."""
    if a == b:
        return 1.0 if a else 0.0
    if not a or not b:
        return 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    taken, mine = [False] * len(b), []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == c:
                taken[j] = True
                mine.append(c)
                break
    if not mine:
        return 0.0
    m = len(mine)
    moved = sum(x != y for x, y in zip(mine, (c for c, t in zip(b, taken, strict=True) if t), strict=True)) // 2
    jaro = (m / len(a) + m / len(b) + (m - moved) / m) / 3
    if jaro <= 0.7:
        return jaro
    prefix = 0
    for x, y in zip(a[:4], b[:4], strict=False):
        if x != y:
            break
        prefix += 1
    return jaro + prefix * 0.1 * (1 - jaro)


#: Names of more characters are compared one by one; those of others stand in the bits of a whole number.
WIDE = 64


def encoded(names: list[str]) -> list[tuple[int, np.ndarray, dict[str, np.ndarray] | None]]:
    """Names by length: the length, their rows, and for each character the places where each name has it, as bits."""
    by_length: dict[int, list[int]] = {}
    for row, name in enumerate(names):
        by_length.setdefault(len(name), []).append(row)
    out = []
    for n, rows in by_length.items():
        if n > WIDE:
            out.append((n, np.array(rows), None))
            continue
        kind, masks = (np.uint32 if n <= 32 else np.uint64), {}
        codes = np.array([names[r] for r in rows], dtype=f"U{max(n, 1)}").view(np.uint32).reshape(len(rows), -1)
        for j in range(n):
            for c in np.unique(codes[:, j]):
                masks.setdefault(chr(c), np.zeros(len(rows), kind))[codes[:, j] == c] |= kind(1 << j)
        out.append((n, np.array(rows), masks))
    return out


def jaro_winkler_to_all(a: str, names: list[str], groups: list[tuple[int, np.ndarray, dict[str, np.ndarray] | None]]) -> np.ndarray:
    """jaro_winkler_of(a, b) for each b of names, whose encoded form is groups: all names of one length step through a at once."""
    out = np.zeros(len(names))
    for n, rows, masks in groups:
        if masks is None:
            out[rows] = [jaro_winkler_of(a, names[r]) for r in rows]
            continue
        if not a or not n:
            continue
        kind = np.uint32 if n <= 32 else np.uint64
        reach, full = max(max(len(a), n) // 2 - 1, 0), (1 << n) - 1
        taken, hits = np.zeros(len(rows), kind), []
        for i, c in enumerate(a):
            near = (((1 << (i + reach + 1)) - 1) & ~((1 << max(0, i - reach)) - 1)) & full
            if c not in masks or not near:
                continue
            free = masks[c] & kind(near)
            free &= ~taken
            free &= -free  # the first place that is left
            taken |= free
            hits.append((masks[c], free != 0))
        m, moved, rest = np.zeros(len(rows), np.int16), np.zeros(len(rows), np.int16), taken
        for mask, hit in hits:
            first = rest & -rest
            first *= hit
            m += hit
            rest = rest ^ first
            first &= mask
            moved += hit & (first == 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            jaro = np.where(m > 0, (m / len(a) + m / n + (m - moved // 2) / m) / 3, 0.0)
        prefix, same = np.zeros(len(rows)), np.ones(len(rows), bool)
        for j, c in enumerate(a[: min(4, n)]):
            same &= (masks[c] & kind(1 << j) != 0) if c in masks else False
            prefix += same
        out[rows] = np.where(jaro > 0.7, jaro + prefix * 0.1 * (1 - jaro), jaro)
    return out


#: The classic rules in the order of the text: at a place, the first pattern that holds gives the code.
_START = [(r"^(KN|GN|PN|AE|WR)", lambda m: m[0][1]), (r"^X", lambda m: "S"), (r"^WH", lambda m: "W")]
_RULES = [
    (r"MB$", "M"), (r"CIA", "X"), (r"SCH", "SK"), (r"CH", "X"), (r"SC(?=[EIY])", "S"), (r"C(?=[EIY])", "S"), (r"C", "K"), (r"DG(?=[EIY])", "J"), (r"D", "T"), (r"GH(?![AEIOU]|$)", ""), (r"GN(ED)?$", "N"), (r"(?<!G)G(?=[EIY])", "J"), (r"GG?", "K"),
    (r"(?<=[AEIOU])H(?![AEIOU])", ""), (r"(?<=[CSPTG])H", ""), (r"CK", "K"), (r"PH", "F"), (r"Q", "K"), (r"S(?=H|IO|IA)", "X"), (r"T(?=IA|IO)", "X"), (r"TH", "0"), (r"TCH", "X"), (r"V", "F"), (r"[WY](?![AEIOU])", ""), (r"X", "KS"), (r"Z", "S"), (r"[BFHJKLMNPRSTWY]", None),
]
_RULES = [(re.compile(p), c) for p, c in _RULES]


def metaphone_of(name: str) -> str:
    w = re.sub(r"[^A-Z]", "", name.upper())
    w = re.sub(r"([ABD-Z])\1+", r"\1", w)
    for p, c in _START:
        w = re.sub(p, c, w, count=1)
    out, i = [], 0
    while i < len(w):
        if w[i] in "AEIOU":
            out.append(w[i] if i == 0 else "")
            i += 1
            continue
        for p, c in _RULES:
            if m := p.match(w, i):
                out.append(m[0] if c is None else c)
                i = m.end()
                break
        else:
            i += 1
    return "".join(out)


def closest_of(least: float):
    """Of two lists of names (the second with how often each occurs): the greatest likeness of each first name to the second ones, and how many reach least to six places."""

    @F.pandas_udf("array<struct<best:double,close:long>>")
    def closest(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        held, groups = None, []
        for names, others, times in parts:
            out = []
            for mine, theirs, n in zip(names, others, times, strict=True):
                theirs = list(theirs)
                if theirs != held:
                    held, groups = theirs, encoded(theirs)
                likes = (jaro_winkler_to_all(a, theirs, groups) for a in mine)
                out.append([{"best": float(x.max()), "close": int(n[np.round(x, 6) >= least].sum())} for x in likes])
            yield pd.Series(out)

    return closest


@F.pandas_udf(T.DoubleType())
def jaro_winkler(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else jaro_winkler_of(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


@F.pandas_udf(T.StringType())
def metaphone(name: pd.Series) -> pd.Series:
    return name.map(lambda n: None if n is None else metaphone_of(n))
