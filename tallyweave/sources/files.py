"""Uploaded files as tables: type and encoding, delimiter, header row, and readers for text, JSON, ZIP and XLSX.

Any number of files is read at once: each is one binaryFile row of MAX_BYTES at most, parsed by one task into a row for
each of its rows. A file that can't be read becomes a row that says why; nothing raises but read_table() on such a file.
"""

from __future__ import annotations

import csv
import io
import json
import re
import zipfile
from collections import Counter
from collections.abc import Iterator
from pathlib import PurePosixPath
from typing import Any
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import written

#: What files begin with, and the bounds of uploads.
MAGIC = {"89504E47": "png", "FFD8FF": "jpeg", "25504446": "pdf", "47494638": "gif", "424D": "bmp", "7F454C46": "elf", "1F8B": "gzip", "504B0304": "zip", "D0CF11E0": "xls"}
REFUSED = ("png", "jpeg", "pdf", "gif", "bmp", "elf", "gzip")
EXTENSIONS = {".csv": "csv", ".tsv": "tsv", ".txt": "txt", ".json": "json", ".xlsx": "xlsx", ".xls": "xls", ".zip": "zip", ".xml": "xml"}
MAX_BYTES, MAX_ROWS, ZIP_BYTES, PROBE = 100 << 20, 500_000, 200 << 20, 4096
DELIMITERS = [",", ";", "\t", "|"]
TARGETS = ["company", "company_name", "name", "entity", "entity_name", "organization", "vendor", "supplier", "customer"]
LIST_KEYS = ["results", "data", "companies", "items", "records", "rows"]


def detected_type(content: Column, path: Column) -> Column:
    """A file's type by its first bytes, then its extension, then whether it is text."""
    head = F.hex(F.substring(content, 1, 8))
    magic = F.coalesce(*(F.when(head.startswith(k), v) for k, v in MAGIC.items()))
    ext = F.lower(F.regexp_extract(path, r"(\.[A-Za-z0-9]+)$", 1))
    known = F.coalesce(*(F.when(ext == k, v) for k, v in EXTENSIONS.items()))
    probe = F.is_valid_utf8(F.decode(F.substring(content, 1, PROBE), "UTF-8"))
    return F.when(magic.isin(*REFUSED), magic).when((magic == "zip") & (known == "xlsx"), "xlsx").when(magic.isNotNull(), magic).otherwise(F.coalesce(known, F.when(probe, "txt"), F.lit("unknown")))


def detected_encoding(head: bytes) -> str:
    """By mark, then UTF-8, then the Windows code page, then Latin-1."""
    for mark, name in ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16")):
        if head.startswith(mark):
            return name
    for name in ("utf-8", "cp1252"):
        try:
            head.decode(name)
            return name
        except UnicodeDecodeError as e:
            if name == "utf-8" and len(head) >= PROBE and e.reason == "unexpected end of data":  # the head ends inside a character
                return name
    return "latin-1"


def detected_delimiter(lines: list[str]) -> str:
    """The delimiter whose count agrees on most lines, weighed by how often it comes."""

    def score(d: str) -> float:
        counts = [x.count(d) for x in lines if x.strip()]
        if not counts or not any(counts):
            return 0.0
        mode, n = Counter(counts).most_common(1)[0]
        return n / len(counts) * (sum(counts) / len(counts)) if mode else 0.0

    return max(DELIMITERS, key=score) if any(map(score, DELIMITERS)) else ","


def header_score(cells: list[str | None]) -> float:
    """How much a row looks like a header: cells with letters, different cells, cells that are no numbers; blank cells count for nothing."""
    cells = [(c or "").strip() for c in cells]
    if not any(cells):
        return 0.0
    full = [c for c in cells if c]
    number = re.compile(r"-?[\d.\-]+$")
    letters = sum(any(ch.isalpha() for ch in c) for c in full)
    return (letters + len({c.lower() for c in full}) + sum(not number.match(c) for c in full)) / len(cells)


def header_row(rows: list[list[str | None]]) -> int:
    """The row of the header: the first if it scores 2, else the best of 15 if it scores half a point more."""
    scores = [header_score(r) for r in rows[:15]]
    if not scores or scores[0] >= 2.0:
        return 0
    best = max(range(len(scores)), key=lambda i: scores[i])
    return best if scores[best] > scores[0] + 0.5 else 0


def column_names(cells: list[str | None]) -> list[str]:
    """Header cells as names that differ."""
    out: list[str] = []
    for i, c in enumerate(cells):
        name = (str(c).strip() if c is not None else "") or f"column_{i + 1}"
        while name.lower() in (x.lower() for x in out):
            name += "_"
        out.append(name)
    return out


def read_json_table(spark: SparkSession, path: str) -> DataFrame:
    """A JSON file as rows: a list, the list under a well-known key or else the first one, or one object."""
    df = spark.read.option("multiLine", True).json(path)
    for key in [*LIST_KEYS, *df.columns]:
        if key in df.columns and df.schema[key].dataType.typeName() == "array":
            inner = df.select(F.explode(key).alias("r"))
            return inner.select("r.*") if inner.schema["r"].dataType.typeName() == "struct" else inner.toDF("value")
    return df


def read_list(spark: SparkSession, path: str, header: str = "name") -> DataFrame:
    """A text file as one column; blank lines and a header word go."""
    value = F.trim("value")
    return spark.read.text(path).where((value != "") & (F.lower(value) != header)).select(value.alias("value"))


def best_column(df: DataFrame) -> tuple[str, str]:
    """The column to resolve, and how it was chosen: a well-known name, else the one most like names, else the first."""
    by_name = {c.strip().lower().replace(" ", "_"): c for c in df.columns}
    for t in TARGETS:
        if t in by_name:
            return by_name[t], "name"
    n = F.count(F.lit(1))
    likeness = lambda c: F.coalesce(F.count_if(F.col(f"`{c}`").rlike(r"^[^\d]*\p{L}{2,}[^\d]*$")) / n, F.lit(0.0)) * F.coalesce(F.count_distinct(F.col(f"`{c}`")) / n, F.lit(0.0))
    row = df.agg(*(likeness(c).alias(f"s{i}") for i, c in enumerate(df.columns))).first()
    best = max(range(len(df.columns)), key=lambda i: row[i])
    return (df.columns[best], "content") if row[best] > 0.05 else (df.columns[0], "fallback")


def names_of(df: DataFrame) -> DataFrame:
    """original: the chosen column's values that can be names."""
    c = F.trim(F.col(f"`{best_column(df)[0]}`"))
    return df.select(c.alias("original")).where((F.length("original") >= 2) & ~F.lower("original").isin(TARGETS))


_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def workbook(content: bytes) -> dict[str, list[list[str | None]]]:
    """The sheets of an XLSX file as rows of text."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = set(z.namelist())
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in si.iter(f"{{{_NS['m']}}}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).findall("m:si", _NS)]
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        out = {}
        for s in ElementTree.fromstring(z.read("xl/workbook.xml")).find("m:sheets", _NS):
            part = targets[s.get(_REL)].lstrip("/")
            root = ElementTree.fromstring(z.read(part if part.startswith("xl/") else f"xl/{part}"))
            rows = []
            for r in root.iter(f"{{{_NS['m']}}}row"):
                cells: dict[int, str | None] = {}
                for k, c in enumerate(r.findall("m:c", _NS)):
                    at = 0
                    for ch in re.match("[A-Z]*", c.get("r", ""))[0]:
                        at = at * 26 + ord(ch) - 64
                    v, inline = c.find("m:v", _NS), c.find("m:is", _NS)
                    text = "".join(t.text or "" for t in inline.iter(f"{{{_NS['m']}}}t")) if inline is not None else None if v is None else shared[int(v.text)] if c.get("t") == "s" else v.text
                    cells[(at or k + 1) - 1] = text
                rows.append([cells.get(i) for i in range(max(cells, default=-1) + 1)])
            out[s.get("name")] = rows
        return out


def text_density(rows: list[list[str | None]]) -> float:
    """How much text a sheet holds."""
    cells = [c for r in rows for c in r if c]
    text = sum(not re.fullmatch(r"-?[\d.,]+", c) for c in cells)
    return text / len(cells) * (len(cells) + 1).bit_length() if cells else 0.0


def alike_sheets(sheets: dict[str, list[list[str | None]]]) -> list[str]:
    """The densest sheet, and those of nearly its density that share half of its columns."""
    dense = {k: text_density(v) for k, v in sheets.items()}
    best = max(dense, key=lambda k: dense[k])
    head = {c for c in (sheets[best][header_row(sheets[best])] if sheets[best] else []) if c}
    share = lambda k: len(head & {c for c in (sheets[k][header_row(sheets[k])] if sheets[k] else []) if c}) / max(1, len(head))
    return [best, *(k for k in sheets if k != best and dense[k] >= 0.8 * dense[best] and share(k) >= 0.5)]


def kind_of(content: bytes, name: str) -> str:
    """detected_type of one file, for members of archives."""
    head, ext = content[:8].hex().upper(), PurePosixPath(name).suffix.lower()
    magic = next((v for k, v in MAGIC.items() if head.startswith(k)), None)
    if magic == "zip" and ext == ".xlsx":
        return "xlsx"
    if magic:
        return magic
    try:
        text = bool(content[:PROBE].decode()) or True
    except UnicodeDecodeError as e:
        text = len(content) >= PROBE and e.reason == "unexpected end of data"
    return EXTENSIONS.get(ext, "txt" if text else "unknown")


class Unreadable(ValueError):
    """A file that is no table."""


def delimiter_of(text: str) -> str:
    """By the csv module's sniffer, else by how evenly the delimiters come."""
    try:
        return csv.Sniffer().sniff(text[:16_384], delimiters="".join(DELIMITERS)).delimiter
    except csv.Error:
        return detected_delimiter(text[:16_384].splitlines()[:20])


def _records(text: str, sep: str) -> list[list[str]]:
    return [r for r in csv.reader(io.StringIO(text, newline=""), delimiter=sep) if any(c.strip() for c in r)]


def text_rows(content: bytes) -> tuple[dict[str, Any], list[list[str | None]]]:
    """A text file's rows, header first, and how they were found.

    A file of one column is read again from the first of 15 lines with two delimiters; without such a line it is a list,
    whose first line is a header only if it is one's name.
    """
    encoding = detected_encoding(content[:PROBE])
    text = content.decode(encoding, "replace").lstrip("\ufeff")
    sep, how = delimiter_of(text), "delimited"
    rows = _records(text, sep)
    if rows and max(map(len, rows[:50])) == 1:
        lines, how = text.splitlines(), "list"
        for i, line in enumerate(lines[:15]):
            found = next((d for d in DELIMITERS if line.count(d) >= 2), None)
            if found:
                sep, how = found, "header_scan"
                rows = _records("\n".join(lines[i:]), sep)
                break
    if not rows:
        raise Unreadable("empty file")
    width = max(map(len, rows[:15]))
    at = 0 if how == "list" else header_row([[*r, *[None] * (width - len(r))] for r in rows[:15]])
    if how == "list":
        named = rows[0][0].strip().lower().replace(" ", "_") in TARGETS
        rows = [[rows[0][0] if named else "name"], *rows[named:]]
    return {"encoding": encoding, "delimiter": sep, "method": how, "header_at": at}, rows[at:]


def json_rows(content: bytes) -> tuple[dict[str, Any], list[list[str | None]]]:
    """A JSON file's rows as text, header first: a list, the first list under a known or any key, or one object."""
    data = json.loads(content.decode(detected_encoding(content[:PROBE])))
    if isinstance(data, dict):
        key = next((k for k in [*LIST_KEYS, *data] if isinstance(data.get(k), list)), None)
        data = data[key] if key else [data]
    if not isinstance(data, list) or not data:
        raise Unreadable("no rows")
    rows = [r if isinstance(r, dict) else {"value": r} for r in data]
    names = list(dict.fromkeys(k for r in rows for k in r))
    text = lambda v: v if v is None or isinstance(v, str) else json.dumps(v)
    return {"encoding": "utf-8", "delimiter": None, "method": "json", "header_at": 0}, [names, *([text(r.get(n)) for n in names] for r in rows)]


def sheet_rows(content: bytes) -> tuple[dict[str, Any], list[list[str | None]]]:
    """The rows of a workbook's alike sheets under the union of their columns, header first."""
    sheets = workbook(content)
    if not any(sheets.values()):
        raise Unreadable("empty workbook")
    names, parts = [], []
    for k in alike_sheets(sheets):
        at = header_row(sheets[k])
        own = column_names(sheets[k][at])
        names += [n for n in own if n not in names]
        parts.append((own, sheets[k][at + 1 :]))
    rows = [[dict(zip(own, r, strict=False)).get(n) for n in names] for own, part in parts for r in part]
    return {"encoding": None, "delimiter": None, "method": "workbook", "header_at": 0}, [names, *rows]


def rows_of(content: bytes, name: str) -> tuple[dict[str, Any], list[list[str | None]]]:
    """The rows of any file that is a table, header first."""
    kind = kind_of(content, name)
    if kind == "zip":
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            if sum(i.file_size for i in z.infolist()) > ZIP_BYTES:
                raise Unreadable(f"unpacks to more than {ZIP_BYTES} bytes")
            member = next((n for n in z.namelist() if PurePosixPath(n).suffix.lower() in EXTENSIONS and not n.startswith("__MACOSX")), None)
            if member is None:
                raise Unreadable("no supported file in the archive")
            return rows_of(z.read(member), member)
    if kind == "xls":
        raise Unreadable("legacy XLS needs a reader that is not at hand; save it as XLSX or CSV")
    if kind in REFUSED or kind == "unknown":
        raise Unreadable(f"not a table: {kind}")
    if not content.strip():
        raise Unreadable("empty file")
    how, rows = {"json": json_rows, "xlsx": sheet_rows}.get(kind, text_rows)(content)
    return how | {"kind": kind}, rows


INGESTED = "path string, kind string, encoding string, delimiter string, method string, header_at long, error string, head string, left_out long, names array<string>, at long, cells array<string>"
#: Rows that leave a task together.
_TOGETHER = 10_000


def _ingest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = [c.split()[0] for c in INGESTED.split(", ")]
    for b in batches:
        for path, length, content in zip(b["path"], b["length"], b["content"], strict=True):
            base = dict.fromkeys(columns) | {"path": path, "head": content[:256].hex()}
            try:
                if length > MAX_BYTES:
                    raise Unreadable("max_file_size")
                how, rows = rows_of(content, path)
            except Exception as e:  # a file may fail in any way; it says so in its row
                yield pd.DataFrame([base | {"kind": kind_of(content, path), "error": f"{e}"[:200]}])
                continue
            width = max(map(len, rows[: MAX_ROWS + 1]))
            names = column_names([*rows[0], *[None] * (width - len(rows[0]))])
            data = [[*r, *[None] * (width - len(r))] for r in rows[1 : MAX_ROWS + 1]]
            left_out = max(0, len(rows) - 1 - MAX_ROWS)
            for k in range(0, max(1, len(data)), _TOGETHER):
                part = data[k : k + _TOGETHER]
                yield pd.DataFrame([base | how | {"left_out": left_out, "names": names, "at": k + i if part else None, "cells": r} for i, r in enumerate(part or [None])])


def ingested(spark: SparkSession, path: str) -> DataFrame:
    """A row for each row of every file under path (INGESTED); a file without rows, or with an error, has one without cells.

    Files are read up to MAX_ROWS rows; left_out says how many more a file has.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    content = F.when(F.col("length") <= MAX_BYTES, F.col("content")).otherwise(F.substring("content", 1, PROBE))
    # Spark passes over files without bytes; its own list of the files still has them.
    same = F.regexp_replace("path", "^([a-z0-9]+):/+", "$1:/")
    listed = spark.createDataFrame([(f,) for f in files.inputFiles()], "path string").withColumn("same", same).join(files.select(same.alias("same")), "same", "left_anti")
    empty = listed.select("path", F.lit(0).cast("long").alias("length"), F.lit(b"").alias("content"))
    return files.select("path", "length", content.alias("content")).unionByName(empty).mapInPandas(_ingest, INGESTED)


def log_failures(table: DataFrame, path: str) -> None:
    """Append what could not be read, as a whole or beyond MAX_ROWS rows, to a log of JSON lines: path, kind, error and the first 256 bytes in hex."""
    cut = F.when((F.col("left_out") > 0) & F.col("at").eqNullSafe(0), F.concat(F.lit("rows left out: "), F.col("left_out").cast("string")))
    table.withColumn("error", F.coalesce("error", cut)).where("error IS NOT NULL").select("path", "kind", "error", "head").write.mode("append").json(path)


def read_table(spark: SparkSession, path: str, cut: bool = False) -> DataFrame:
    """One file as a table of text under the names of its header; a JSON file with the types of its values.

    A file of more than MAX_ROWS rows raises, unless cut says that the rest may be left out.
    """
    table = written(ingested(spark, path), "upload")
    first = table.orderBy(F.col("at").asc_nulls_first()).select("kind", "error", "names", "left_out").first()
    if first is None:
        raise FileNotFoundError(path)
    if first["error"]:
        raise ValueError(f"{first['kind']}: {first['error']}")
    if first["left_out"] and not cut:
        raise ValueError(f"{first['left_out']} rows beyond the first {MAX_ROWS}")
    if first["kind"] == "json":
        return read_json_table(spark, path)
    return table.where("cells IS NOT NULL").select(*(F.col("cells")[i].alias(n) for i, n in enumerate(first["names"])))
