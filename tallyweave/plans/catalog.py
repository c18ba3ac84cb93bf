"""All registered queries by name, and the DuckDB SQL that each must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import access, canonicals, classifier, companies, control, documents, evidence, extras, manifests, names, persons, publish, rollups, streams, uploads

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
for _part in (access, canonicals, classifier, companies, control, documents, manifests, names, persons, publish, rollups, evidence, streams, uploads, extras):
    QUERIES |= _part.QUERIES
    ORACLE |= _part.ORACLE
