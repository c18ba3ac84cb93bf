"""Routing of uploaded tables: what a table holds, and the mode it is resolved in."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import words as W
from ..functions.names import one_of

#: Header words that speak for persons and for companies, and the bounds of the decision.
PERSON_HEADERS = {"first name", "last name", "name", "nombre", "primer apellido", "segundo apellido", "apellido", "full name", "middle name", "gender", "sexo", "dob", "date of birth", "birthdate", "age", "edad", "surname", "given name", "employee id"}
COMPANY_HEADERS = {"company", "company name", "vendor", "vendor name", "supplier", "supplier name", "organization", "organisation", "business name", "entity name", "legal name", "revenue", "industry"}
TOKEN_RATIO, NUMERIC_SHARE, SAMPLE = 0.30, 0.8, 100


@dataclass(frozen=True)
class Route:
    effective_mode: str
    dataset_type: str
    decision: str
    company_ratio: float


def header_words(columns: list[str]) -> set[str]:
    return {re.sub(r"[\s_\-]+", " ", c.strip().lower()) for c in columns}


def inspect(df: DataFrame) -> Route:
    """Decide by header words, then by how many cells hold a company's word; a table of numbers is refused."""
    words = header_words(df.columns)
    head = df.limit(SAMPLE)
    n = F.count(F.lit(1))
    text = lambda c: F.col(f"`{c}`").cast("string")
    row = head.agg(
        n.alias("n"), *(F.count_if(text(c).rlike(r"^-?[\d.,\s]+$")).alias(f"d{i}") for i, c in enumerate(df.columns)), *(F.count_if(F.upper(text(c)).rlike(rf"\b({one_of(W.CORPORATE + W.INDICATORS)})\b")).alias(f"o{i}") for i, c in enumerate(df.columns)),
    ).first()
    if not row["n"]:
        return Route("reject", "INVALID", "empty_dataset", 0.0)
    k = range(len(df.columns))
    texts = [i for i in k if row[f"d{i}"] / row["n"] < NUMERIC_SHARE]
    if not texts:
        return Route("reject", "INVALID", "invalid_dataset", 0.0)
    ratio = max(row[f"o{i}"] / row["n"] for i in texts)
    if len(words & PERSON_HEADERS) >= 2:
        return Route("mixed", "PERSON", "person_dataset", ratio)
    if words & COMPANY_HEADERS or ratio >= TOKEN_RATIO:
        return Route("company", "COMPANY", "company_dataset", ratio)
    return Route("mixed", "MIXED", "mixed_dataset", ratio)
