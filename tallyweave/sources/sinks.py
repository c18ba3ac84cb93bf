"""Exports: fixed-column CSV, JSON and text reports, first-write-wins output, and packs with a manifest of hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import canonical as J

CSV_COLUMNS = {
    "person": ["row_index", "original", "resolved", "match_type", "match_id", "confidence", "layer", "decision_path"],
    "company": ["row_index", "original", "resolved", "layer", "confidence", "entity_type", "decision_path", "source_timestamp"],
    "results": ["row_index", "original", "resolved", "match_type", "match_id", "layer", "decision_path", "entity_type", "confidence"],
}


def with_columns(df: DataFrame, kind: str) -> DataFrame:
    """The export's columns in their order; those that df lacks are empty."""
    return df.select(*(F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in CSV_COLUMNS[kind]))


#: Rows of a written file at most, so that it can be hashed, and read back, as a whole.
PACK_ROWS = 100_000


def write_csv(df: DataFrame, kind: str, path: str, rows: int = PACK_ROWS) -> None:
    """The export as CSV; a task of many rows writes several files, each with the header."""
    with_columns(df, kind).write.option("header", True).option("escape", '"').option("maxRecordsPerFile", rows).csv(path)


def as_json(df: DataFrame) -> DataFrame:
    """Each row as a JSON object, nulls included."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value"))


def node_rows(chains: DataFrame) -> DataFrame:
    """A row for each node of each chain (key, nodes); a chain without nodes has one row."""
    return chains.select("key", F.explode_outer("nodes").alias("n")).select("key", "n.*")


def as_report(chains: DataFrame) -> DataFrame:
    """A text report for each chain."""
    line = F.transform("nodes", lambda n: F.concat(F.lit("  "), n["sequence"].cast("string"), F.lit(". "), n["node_type"], F.lit(" "), n["node_hash"]))
    return chains.select("key", F.concat_ws("\n", F.concat(F.lit("Evidence for "), F.col("key").cast("string")), F.array_join(line, "\n")).alias("value"))


def exported(chains: DataFrame, form: str) -> DataFrame:
    """Evidence chains as value rows of a form: json, text (for a page) or csv."""
    forms = {"json": lambda: as_json(chains), "text": lambda: as_report(chains).select("value"), "csv": lambda: node_rows(chains).select(F.concat_ws(",", *(csv_cell(F.col(c).cast("string")) for c in ("key", "node_type", "sequence", "node_hash"))).alias("value"))}
    if form not in forms:
        raise ValueError(f"unknown form: {form}")
    return forms[form]()


def csv_cell(c: Column) -> Column:
    """A cell as CSV has it: quoted where it holds a comma, a quote or a line break."""
    return F.when(c.rlike('[,"\n\r]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(F.coalesce(c, F.lit("")))


def escape_html(c: Column) -> Column:
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        c = F.replace(c, F.lit(char), F.lit(entity))
    return c


def strip_html(c: Column) -> Column:
    return F.regexp_replace(c, "<[^>]*>", "")


def append_audit(df: DataFrame, path: str) -> None:
    """Append audit rows; what is written stays."""
    df.write.mode("append").parquet(path)


def write_once(df: DataFrame, path: str) -> str:
    """Write df unless equal rows are there already; other rows there raise. Returns written or skipped."""
    spark = df.sparkSession
    digest = lambda d: d.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*sorted(d.columns)).cast("decimal(38,0)"))).first()
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        df.write.mode("errorifexists").parquet(path)
        return "written"
    if digest(spark.read.parquet(path)) == digest(df):
        return "skipped"
    raise ValueError(f"{path} holds other rows")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """path, name (below the folder), size and sha256 of the files under a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    # Readers may spell the scheme of a path in another way than it was given.
    below = F.substring_index("path", f"{path.rstrip('/').rpartition('/')[2]}/", -1)
    return files.select("path", below.alias("name"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def verify(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """name and status (ok, changed, missing, unexpected) of a manifest against the files."""
    e, a = expected.select("name", F.col("sha256").alias("want")), actual.select("name", F.col("sha256").alias("got"))
    status = F.when(F.col("got").isNull(), "missing").when(F.col("want").isNull(), "unexpected").when(F.col("want") == F.col("got"), "ok").otherwise("changed")
    return e.join(a, "name", "full_outer").select("name", status.alias("status"))


#: The form of a pack's manifest.
PACK_VERSION = "1.0"


def write_packs(results: DataFrame, audits: DataFrame, summaries: DataFrame, path: str, made_at: str, rows: int = PACK_ROWS) -> None:
    """Evidence packs of all batches (trace_id): results as CSV, audit events and a summary as JSON lines, and a manifest for each.

    Files go to kind/trace_id=.../, a batch of many rows to several; the manifests (their files by name with size and hash,
    and the hash of that list) are written last, so that a pack without one is not whole.
    """
    results.write.partitionBy("trace_id").option("header", True).option("escape", '"').option("maxRecordsPerFile", rows).csv(f"{path}/files/results")
    audits.write.partitionBy("trace_id").option("maxRecordsPerFile", rows).json(f"{path}/files/audit")
    summaries.write.partitionBy("trace_id").json(f"{path}/files/summary")
    _manifests(members(results.sparkSession, path), made_at).write.json(f"{path}/manifests")


def members(spark: SparkSession, path: str) -> DataFrame:
    """trace_id, name, size and sha256 of the packs' files."""
    files = manifest(spark, f"{path}/files").where(~F.col("name").rlike(r"(^|/)[._][^/]*$"))
    return files.select(F.regexp_extract("name", "/trace_id=([^/]*)/", 1).alias("trace_id"), "name", "size", "sha256")


def _listed(files: Column) -> Column:
    one = lambda f: J.record({"name": J.text(f["name"]), "sha256": J.text(f["sha256"]), "size_bytes": J.whole(f["size"])})
    return J.items(F.transform(F.array_sort(files), one))


def _manifests(files: DataFrame, made_at: str) -> DataFrame:
    rows = files.groupBy("trace_id").agg(F.array_sort(F.collect_list(F.struct("name", "size", "sha256"))).alias("files"), F.sum("size").alias("bytes"))
    rows = rows.withColumns({"version": F.lit(PACK_VERSION), "generated_at": F.lit(made_at)})
    return rows.withColumn("manifest_hash", _manifest_hash())


def _manifest_hash() -> Column:
    return F.sha2(J.record({"version": J.text(F.col("version")), "batch_id": J.text(F.col("trace_id")), "generated_at": J.text(F.col("generated_at")), "bytes": J.whole(F.col("bytes")), "files": _listed(F.col("files"))}), 256)


def verify_packs(spark: SparkSession, path: str) -> DataFrame:
    """trace_id, manifest_ok, files, wrong (names with their status, in order) and valid of every pack; files of no manifest make an invalid pack."""
    kinds = "trace_id string, files array<struct<name:string,size:long,sha256:string>>, bytes long, version string, generated_at string, manifest_hash string"
    kept = spark.read.schema(kinds).json(f"{path}/manifests").withColumn("manifest_ok", _manifest_hash().eqNullSafe(F.col("manifest_hash")))
    status = verify(kept.select(F.inline("files")), members(spark, path)).withColumn("trace_id", F.regexp_extract("name", "/trace_id=([^/]*)/", 1))
    bad = F.array_sort(F.collect_list(F.when(F.col("status") != "ok", F.concat_ws(":", "name", "status"))))
    found = status.groupBy("trace_id").agg(F.count(F.lit(1)).alias("files"), bad.alias("wrong"))
    out = found.join(kept.select("trace_id", "manifest_ok"), "trace_id", "full_outer").withColumns({"manifest_ok": F.coalesce("manifest_ok", F.lit(False)), "files": F.coalesce("files", F.lit(0)), "wrong": F.coalesce("wrong", F.array().cast("array<string>"))})
    return out.select("trace_id", "manifest_ok", "files", "wrong", (F.col("manifest_ok") & (F.size("wrong") == 0)).alias("valid"))
