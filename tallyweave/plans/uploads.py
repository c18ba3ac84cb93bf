"""Queries on uploaded files: made from the tables, written to the shared folder, and read back by the readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import routing
from ..shared import shared_path, written
from ..sources import files, sinks
from . import documents as docs_plan
from .inputs import RESULTS, results, table


def csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results exported as CSV, one file for each task, and ingested again."""
    path = shared_path(spark, "export")
    sinks.write_csv(results(spark, sf_dir).withColumn("source_timestamp", F.col("source_timestamp").cast("string")), "company", path)
    back = files.ingested(spark, path).where("cells IS NOT NULL")
    cell = lambda n: F.nullif(F.get("cells", (F.array_position("names", n) - 1).cast("int")), F.lit(""))
    return back.select(cell("row_index").cast("long").alias("row_index"), cell("original").alias("original"), cell("resolved").alias("resolved"), cell("layer").alias("layer"), cell("confidence").cast("double").alias("confidence"))


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """name and content of a set of uploads made from the nations: each in another form."""
    rows = table(spark, sf_dir, "nation").agg(F.sort_array(F.collect_list(F.struct("n_nationkey", "n_name", "n_regionkey"))).alias("r"))
    line = lambda sep: F.array_join(F.transform("r", lambda x: F.concat_ws(sep, x["n_nationkey"].cast("string"), x["n_name"], x["n_regionkey"].cast("string"))), "\n")
    head, quoted = F.lit("id,name,region\n"), F.array_join(F.transform("r", lambda x: F.concat(x["n_nationkey"].cast("string"), F.lit(',"'), x["n_name"], F.lit(', of\nold",'), x["n_regionkey"].cast("string"))), "\r\n")
    names = F.array_join(F.transform("r", lambda x: x["n_name"]), "\n")
    items = F.to_json(F.transform("r", lambda x: F.struct(x["n_nationkey"].alias("id"), x["n_name"].alias("name"), x["n_regionkey"].alias("region"))))
    forms = {
        "plain.csv": F.concat(head, line(",")).cast("binary"), "blank.csv": F.concat(F.lit("\n\nExport of nations\n\n"), head, line(",")).cast("binary"), "semicolon.txt": F.concat(F.lit("id;name;region\n"), line(";")).cast("binary"), "tab.tsv": F.concat(F.lit("id\tname\tregion\n"), line("\t")).cast("binary"),
        "wide.csv": F.encode(F.concat(head, line(",")), "UTF-16"), "mark.csv": F.concat(F.unhex(F.lit("EFBBBF")), F.concat(head, line(",")).cast("binary")), "quoted.csv": F.concat(head, quoted).cast("binary"), "list.txt": names.cast("binary"), "known.json": F.concat(F.lit('{"ok":true,"rows":'), items, F.lit("}")).cast("binary"),
        "other.json": F.concat(F.lit('{"ok":true,"people":'), items, F.lit("}")).cast("binary"), "picture.png": F.unhex(F.lit("89504E470D0A1A0A00")), "script.pdf": F.lit("%PDF-1.4").cast("binary"),
    }
    return rows.select(F.explode(F.array(*(F.struct(F.lit(k).alias("name"), v.alias("content")) for k, v in forms.items()))).alias("f")).select("f.*")


def _put(spark: SparkSession, sf_dir: str) -> str:
    """The set of uploads as files in the shared folder."""
    path = shared_path(spark, "uploads")
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for row in _files(spark, sf_dir).collect():  # a dozen small files
        at = jvm.org.apache.hadoop.fs.Path(f"{path}/{row['name']}")
        out = at.getFileSystem(conf).create(at)
        out.write(row["content"])
        out.close()
    return path


def uploads_ingested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of a set of uploads in many forms, by the header's names; pictures are refused."""
    got = files.ingested(spark, _put(spark, sf_dir))
    cell = lambda n: F.when(F.array_contains("names", n), F.get("cells", (F.array_position("names", n) - 1).cast("int")))
    return got.select(F.regexp_extract("path", "([^/]+)$", 1).alias("file"), "kind", "method", "error", cell("id").alias("id"), F.replace(cell("name"), F.lit("\n"), F.lit(" ")).alias("name"), cell("region").alias("region"))


def upload_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log of what could not be read."""
    log = shared_path(spark, "failures")
    files.log_failures(files.ingested(spark, _put(spark, sf_dir)), log)
    return spark.read.schema("path string, kind string, error string, head string").json(log).select(F.regexp_extract("path", "([^/]+)$", 1).alias("file"), "kind", "error", "head")


def json_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.as_json(table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", F.nullif("s_nationkey", F.lit(15)).alias("nation"))).select(F.col("value").alias("json"))


def evidence_rows_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.node_rows(docs_plan.chains(spark, sf_dir)).select(F.col("key").alias("doc_id"), "node_type", F.col("sequence").cast("long").alias("sequence"))


def pack_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pack's stored manifest against its files, of which one is changed, one lost, and one new."""
    path, kept = shared_path(spark, "pack"), shared_path(spark, "manifest")
    for region in range(5):
        table(spark, sf_dir, "nation").where(F.col("n_regionkey") == region).select("n_name").coalesce(1).write.text(f"{path}/region={region}")
    sinks.manifest(spark, path).write.parquet(kept)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = lambda name: jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
    fs = at("").getFileSystem(conf)
    fs.delete(at("region=1"), True)
    for name in ("region=3", "region=9"):
        table(spark, sf_dir, "nation").select("n_name").coalesce(1).write.mode("overwrite").text(f"{path}/{name}")
    # Part files have names of their own; a pack's members go by their folders here.
    found = sinks.verify(*(m.withColumn("name", F.regexp_extract("path", "(region=[0-9]+)", 1)) for m in (spark.read.parquet(kept), sinks.manifest(spark, path))))
    return found.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.sort_array(F.collect_list("name")), ",").alias("names"))


def _routed(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Tables that are routed in every way."""
    s, c = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "customer")
    firm = F.concat("s_name", F.when(F.col("s_suppkey") % 2 == 0, " LLC").otherwise(" north"))
    return {
        "supplier": s, "customer": c, "firms": s.select(firm.alias("who"), "s_acctbal"), "vendors": s.select(F.col("s_name").alias("Vendor Name")), "people": c.select(F.col("c_name").alias("First Name"), F.col("c_mktsegment").alias("last_name")),
        "numbers": table(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity"), "nothing": s.limit(0),
    }


def dataset_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The route of each table as an upload."""
    rows = []
    for name, df in _routed(spark, sf_dir).items():
        r = routing.inspect(df)
        rows.append((name, r.effective_mode, r.dataset_type, r.decision))
    return spark.createDataFrame(rows, "name string, mode string, dataset_type string, decision string")


def file_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The types of files as their bytes tell them."""
    path = shared_path(spark, "types")
    table(spark, sf_dir, "region").coalesce(1).write.option("header", True).csv(f"{path}/csv")
    table(spark, sf_dir, "region").coalesce(1).write.json(f"{path}/json")
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "part-*").load(path)
    return found.groupBy(files.detected_type(F.col("content"), F.col("path")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def evidence_packs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packs of all batches, with what is read back from their files; a file of one batch is changed after, one of another lost."""
    path, rows = shared_path(spark, "packs"), results(spark, sf_dir).withColumn("source_timestamp", F.col("source_timestamp").cast("string"))
    audits = rows.where("layer LIKE 'L4%'").select("trace_id", "row_index", F.lit("routed_to_review").alias("event_type"))
    summaries = rows.groupBy("trace_id").agg(F.count(F.lit(1)).alias("total"), F.count("resolved").alias("resolved"))
    sinks.write_packs(rows, audits, summaries, path, "2024-06-01T00:00:00Z")
    read = spark.read.option("header", True).option("escape", '"').csv(f"{path}/files/results").groupBy("trace_id").agg(F.count(F.lit(1)).alias("n"), F.count("resolved").alias("n_resolved"))
    read = read.join(spark.read.json(f"{path}/files/audit").groupBy("trace_id").agg(F.count(F.lit(1)).alias("n_audit")), "trace_id", "left")
    read = written(read.join(spark.read.json(f"{path}/files/summary").select("trace_id", "total"), "trace_id"), "read-back")
    table(spark, sf_dir, "region").select("r_name").coalesce(1).write.mode("overwrite").text(f"{path}/files/audit/trace_id=B2")
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/files/summary/trace_id=B4")
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    checked = sinks.verify_packs(spark, path).select("trace_id", "manifest_ok", "valid")
    return read.join(checked, "trace_id")


QUERIES = {f.__name__: f for f in (csv_roundtrip, uploads_ingested, upload_failures, json_export, evidence_rows_export, pack_verify, evidence_packs, dataset_routing, file_types)}


ORACLE = {
    "csv_roundtrip": f"WITH {RESULTS} SELECT row_index, original, resolved, layer, confidence FROM results",
    "json_export": """SELECT '{"s_suppkey":' || s_suppkey || ',"s_name":"' || s_name || '","nation":' || CASE WHEN s_nationkey = 15 THEN 'null' ELSE s_nationkey::VARCHAR END || '}' AS json FROM supplier""",
    "evidence_rows_export": f"""WITH {docs_plan.CHAIN_SQL} SELECT doc_id, 'source_artifact' AS node_type, 1::BIGINT AS sequence FROM chained UNION ALL SELECT doc_id, CASE layer_used WHEN 1 THEN 'transformation' ELSE 'retrieval_result' END, 2 FROM chained WHERE layer_used IS NOT NULL UNION ALL SELECT doc_id, 'transformation', n_nodes FROM chained""",
    "evidence_packs": f"WITH {RESULTS} SELECT trace_id, count(*) AS n, count(resolved) AS n_resolved, nullif(count_if(layer LIKE 'L4%'), 0)::BIGINT AS n_audit, count(*) AS total, true AS manifest_ok, trace_id NOT IN ('B2', 'B4') AS valid FROM results GROUP BY 1",
    "pack_verify": """WITH old AS (SELECT 'region=' || r_regionkey AS name, (SELECT string_agg(n_name, chr(10) ORDER BY n_nationkey) FROM nation WHERE n_regionkey = r_regionkey) AS body FROM region),
new AS (SELECT CASE WHEN r_regionkey = 1 THEN 'region=9' ELSE name END AS name, CASE WHEN r_regionkey IN (1, 3) THEN (SELECT string_agg(n_name, chr(10) ORDER BY n_nationkey) FROM nation) ELSE body END AS body FROM old JOIN region ON name = 'region=' || r_regionkey)
SELECT CASE WHEN n.name IS NULL THEN 'missing' WHEN o.name IS NULL THEN 'unexpected' WHEN md5(o.body) = md5(n.body) THEN 'ok' ELSE 'changed' END AS status, count(*)::BIGINT AS n, string_agg(coalesce(o.name, n.name), ',' ORDER BY coalesce(o.name, n.name)) AS names
FROM old o FULL JOIN new n ON o.name = n.name GROUP BY 1""",
    "dataset_routing": """WITH ratio AS (SELECT avg((s_suppkey % 2 = 0)::INT) AS r FROM (SELECT s_suppkey FROM supplier ORDER BY s_suppkey LIMIT 100))
SELECT 'supplier' AS name, 'mixed' AS mode, 'MIXED' AS dataset_type, 'mixed_dataset' AS decision UNION ALL SELECT 'customer', 'mixed', 'MIXED', 'mixed_dataset'
UNION ALL SELECT 'firms', CASE WHEN r >= 0.3 THEN 'company' ELSE 'mixed' END, CASE WHEN r >= 0.3 THEN 'COMPANY' ELSE 'MIXED' END, CASE WHEN r >= 0.3 THEN 'company_dataset' ELSE 'mixed_dataset' END FROM ratio
UNION ALL VALUES ('vendors', 'company', 'COMPANY', 'company_dataset'), ('people', 'mixed', 'PERSON', 'person_dataset'), ('numbers', 'reject', 'INVALID', 'invalid_dataset'), ('nothing', 'reject', 'INVALID', 'empty_dataset')""",
    "uploads_ingested": """WITH forms AS (SELECT * FROM (VALUES ('plain.csv', 'csv', 'delimited'), ('blank.csv', 'csv', 'delimited'), ('semicolon.txt', 'txt', 'delimited'), ('tab.tsv', 'tsv', 'delimited'), ('wide.csv', 'csv', 'delimited'), ('mark.csv', 'csv', 'delimited'), ('quoted.csv', 'csv', 'delimited'), ('list.txt', 'txt', 'list'), ('known.json', 'json', 'json'), ('other.json', 'json', 'json')) v(file, kind, method))
SELECT file, kind, method, NULL::VARCHAR AS error, CASE WHEN method <> 'list' THEN n_nationkey::VARCHAR END AS id, n_name || CASE WHEN file = 'quoted.csv' THEN ', of old' ELSE '' END AS name, CASE WHEN method <> 'list' THEN n_regionkey::VARCHAR END AS region FROM forms, nation
UNION ALL VALUES ('picture.png', 'png', NULL, 'not a table: png', NULL, NULL, NULL), ('script.pdf', 'pdf', NULL, 'not a table: pdf', NULL, NULL, NULL)""",
    "upload_failures": "SELECT * FROM (VALUES ('picture.png', 'png', 'not a table: png', '89504e470d0a1a0a00'), ('script.pdf', 'pdf', 'not a table: pdf', '255044462d312e34')) v(file, kind, error, head)",
    "file_types": "SELECT * FROM (VALUES ('csv', 1::BIGINT), ('json', 1::BIGINT)) v(kind, n)",
}
