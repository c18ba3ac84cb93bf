"""Personal data in text: counts and redaction as columns; offset-exact masking and its inverse."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Categories, their patterns and the prefix of their tokens, the most specific first.
PATTERNS = {
    "SSN": r"\b\d{3}-\d{2}-\d{4}\b",
    "CREDIT_CARD": r"\b(?:\d{4}[-\s]?){3}\d{4}\b",
    "MRN": r"(?i)\bMRN[-:]?\s?\d{5,10}\b",
    "EMAIL": r"\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b",
    "PHONE": r"(?:\(\d{3}\)\s?|\b\d{3}[-.])\d{3}[-.]?\d{4}\b",
    "DOB": r"\b(?:0[1-9]|1[0-2])/(?:0[1-9]|[12]\d|3[01])/(?:19|20)\d{2}\b",
    "IP_ADDRESS": r"\b(?:(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\.){3}(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\b",
    "DRIVERS_LICENSE": r"\b[A-Z]\d{7,14}\b",
}
PREFIXES = {"SSN": "SSN", "CREDIT_CARD": "CC", "MRN": "MRN", "EMAIL": "EMAIL", "PHONE": "PHONE", "DOB": "DOB", "IP_ADDRESS": "IP", "DRIVERS_LICENSE": "DL"}
SEVERITY = {"SSN": "critical", "CREDIT_CARD": "critical", "MRN": "critical", "DOB": "high", "DRIVERS_LICENSE": "high", "EMAIL": "medium", "PHONE": "medium", "IP_ADDRESS": "low"}
#: The order in which log lines are scrubbed, and the names there.
LOG_ORDER = [("SSN", "SSN"), ("EMAIL", "EMAIL"), ("PHONE_US", "PHONE"), ("CREDIT_CARD", "CREDIT_CARD"), ("IP_ADDRESS", "IP_ADDRESS"), ("DOB", "DOB"), ("DRIVERS_LICENSE", "DRIVERS_LICENSE")]


def counts(text: Column) -> dict[str, Column]:
    """For each category how often it occurs."""
    return {k: F.coalesce(F.regexp_count(text, F.lit(p)), F.lit(0)).cast("long") for k, p in PATTERNS.items()}


def scrub_log(text: Column) -> Column:
    for name, category in LOG_ORDER:
        text = F.regexp_replace(text, PATTERNS[category], f"[{name}_REDACTED]")
    return text


def severity(category: Column) -> Column:
    return F.create_map(*(F.lit(x) for kv in SEVERITY.items() for x in kv))[category]


_FOUND = [(k, re.compile(p)) for k, p in PATTERNS.items()]


def find(text: str) -> list[tuple[int, int, str]]:
    """Start, end and category of what is masked: of overlapping finds the one that starts first, of those the longest."""
    spans = sorted(((m.start(), m.end(), k) for k, p in _FOUND for m in p.finditer(text)), key=lambda s: (s[0], s[0] - s[1]))
    kept: list[tuple[int, int, str]] = []
    for s in spans:
        if not kept or s[0] >= kept[-1][1]:
            kept.append(s)
    return kept


def found_spans(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, category, value, start and end of every find in a text column, overlapping ones too; start counts characters from 0."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(k, c, m[0], m.start(), m.end()) for k, t in zip(b[key], b[text], strict=True) if t for c, p in _FOUND for m in p.finditer(t)]
            yield pd.DataFrame(rows, columns=[key, "category", "value", "start", "end"])

    return df.select(key, text).mapInPandas(run, f"`{key}` {df.schema[key].dataType.simpleString()}, category string, value string, start long, end long")


#: Keys of logged objects whose values are never shown, and what stands for them.
RESTRICTED = ("password", "secret", "token", "api_key", "private_key", "phi", "medical_record", "diagnosis", "treatment", "health_info", "patient_data", "mrn")
HIDDEN = "[RESTRICTED_REDACTED]"


def scrub_fields(fields: Column) -> Column:
    """A logged object (a map of text) with every value scrubbed, those of restricted keys as a whole."""
    return F.transform_values(fields, lambda k, v: F.when(F.lower(k).isin(*RESTRICTED), HIDDEN).otherwise(scrub_log(v)))


def scrub_value(c: Column, kind: T.DataType) -> Column:
    """A logged value of any type with all texts in it scrubbed, however deep, in objects within lists too; members of restricted names give way as a whole.

    A restricted member becomes the text that says so where it is one, else null, since a column keeps its type. kind is the
    column's type.
    """
    if isinstance(kind, T.StringType):
        return scrub_log(c)
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda v: scrub_value(v, kind.elementType))
    gone = lambda member: F.lit(HIDDEN if isinstance(member, T.StringType) else None).cast(member)
    if isinstance(kind, T.StructType):
        parts = [(gone(f.dataType) if f.name.lower() in RESTRICTED else scrub_value(c.getField(f.name), f.dataType)).alias(f.name) for f in kind.fields]
        return F.when(c.isNotNull(), F.struct(*parts))
    if isinstance(kind, T.MapType) and isinstance(kind.keyType, T.StringType):
        return F.transform_values(c, lambda k, v: F.when(F.lower(k).isin(*RESTRICTED), gone(kind.valueType)).otherwise(scrub_value(v, kind.valueType)))
    return c


def mask_text(text: str) -> tuple[str, list[tuple[str, str]]]:
    """The text with a token for each find, and the tokens' values. Numbers run from the text's end; equal values share a token."""
    tokens: dict[tuple[str, str], str] = {}
    n: Counter[str] = Counter()
    parts, upto = [], len(text)
    for start, end, kind in reversed(find(text)):
        key = kind, text[start:end]
        if key not in tokens:
            n[kind] += 1
            tokens[key] = f"[{PREFIXES[kind]}_{n[kind]}]"
        parts += [text[end:upto], tokens[key]]
        upto = start
    return text[:upto] + "".join(reversed(parts)), [(t, v) for (_, v), t in tokens.items()]


def mask(df: DataFrame, text: str = "text") -> DataFrame:
    """df with masked and tokens (array of token, value) for a text column."""
    pair = T.StructType().add("token", "string").add("value", "string")
    schema = T.StructType(list(df.schema.fields)).add("masked", "string").add("tokens", T.ArrayType(pair))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            done = [(None, None) if t is None else mask_text(t) for t in b[text]]
            yield b.assign(masked=[d[0] for d in done], tokens=[d[1] and [{"token": t, "value": v} for t, v in d[1]] for d in done])

    return df.mapInPandas(run, schema)


def unmask(masked: Column, tokens: Column) -> Column:
    """The text before masking."""
    return F.aggregate(F.coalesce(tokens, F.array().cast("array<struct<token:string,value:string>>")), masked, lambda text, t: F.replace(text, t["token"], t["value"]))
