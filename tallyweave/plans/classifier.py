"""Queries on the classifier of tables: fitted on half of the tables of names, and asked about the others."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import classifier as C
from .inputs import table
from .persons import FIRST, LAST

TRADES, FORMS = ["Acme", "Northern", "Global", "Delta", "Pacific", "Union", "Harbor", "Summit"], ["Holdings LLC", "Freight Inc", "Trading Co", "Insurance Ltd", "Bank Corp", "Logistics GmbH"]


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables of names by nation: customers as persons, suppliers as organizations, parts as numbers and blanks; some mix two kinds or have no cell at all."""
    one = lambda values, k: F.element_at(F.array(*map(F.lit, values)), (k % len(values) + 1).cast("int"))
    heads = lambda *names: F.array(*map(F.lit, names))
    c, s, p = F.col("c_custkey"), F.col("s_suppkey"), F.col("p_partkey")
    person = F.concat_ws(" ", one(FIRST, c * 7), one(LAST, c * 5))
    org = F.concat_ws(" ", one(TRADES, s), one(["River", "Metal", "Grain"], F.floor(s / 8)), one(FORMS, s * 5 + F.floor(s / 3)))
    junk = F.when(p % 4 == 0, "n/a").when(p % 4 == 1, F.format_string("%06d", p * 7919)).when(p % 4 == 2, F.concat(F.lit("INV-"), (p * 31).cast("string"))).otherwise(F.substring(F.md5(p.cast("string")), 1, 8))
    kinds = (
        ("person", table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("n"), c.alias("at"), F.when(c % 23 == 0, None).when(F.col("c_nationkey") % 9 == 8, org_of(c, one)).otherwise(person).alias("text")), F.when(F.col("n") % 3 == 0, heads("First name", "Surname")).otherwise(heads("value"))),
        ("org", table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("n"), s.alias("at"), org.alias("text")), F.when(F.col("n") % 3 == 1, heads("Vendor")).otherwise(heads("value"))),
        ("garbage", table(spark, sf_dir, "part").select((p % 25).alias("n"), p.alias("at"), F.when(p % 25 == 24, "nan").otherwise(junk).alias("text")), heads("value")),
    )
    out = [rows.select(F.concat_ws("-", F.lit(kind), "n").alias("table"), F.lit(kind).alias("kind"), F.col("n").cast("long").alias("n"), F.col("at").cast("long").alias("at"), "text", head.alias("headers")) for kind, rows, head in kinds]
    return out[0].unionByName(out[1]).unionByName(out[2])


def org_of(k, one):
    """Every other customer of some nations is an organization."""
    return F.when(k % 2 == 0, F.concat_ws(" ", one(TRADES, k), one(FORMS, k * 5))).otherwise(F.concat_ws(" ", one(FIRST, k * 7), one(LAST, k * 5)))


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables that were not learned from, with their label, confidence and kind."""
    rows = cells(spark, sf_dir)
    model = C.fitted(rows.where("n % 2 = 0").withColumnRenamed("kind", "label"))
    asked = rows.where("n % 2 = 1 OR n >= 24")
    return C.classified(asked.select("table", "at", "text", "headers"), model).join(asked.select("table", "kind").distinct(), "table")


def dataset_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The route of every table that was not learned from; the heuristic calls each third one mixed."""
    guess = F.when(F.crc32(F.col("table").cast("binary")) % 3 == 0, "mixed").otherwise(F.create_map(*(F.lit(x) for kv in C.AS_HEURISTIC.items() for x in kv))[F.col("kind")])
    out = answers(spark, sf_dir).withColumn("heuristic", guess)
    out = out.withColumn("route", C.decided(F.col("label"), F.col("confidence"), F.col("heuristic")))
    return out.select("table", "kind", "label", "confidence", "heuristic", "route.decision", F.col("route.label").alias("routed"))


def header_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The header tokens of the tables of names."""
    return cells(spark, sf_dir).select("table", "headers").distinct().select("table", F.array_join(C.header_tokens(F.col("headers")), " ").alias("tokens"))


QUERIES = {f.__name__: f for f in (dataset_classes, header_features)}
ORACLE = {
    "header_features": """SELECT DISTINCT 'person-' || c_nationkey AS "table", CASE WHEN c_nationkey % 3 = 0 THEN 'header:first header:surname' ELSE '' END AS tokens FROM customer
UNION ALL SELECT DISTINCT 'org-' || s_nationkey, CASE WHEN s_nationkey % 3 = 1 THEN 'header:vendor' ELSE '' END FROM supplier UNION ALL SELECT DISTINCT 'garbage-' || (p_partkey % 25), '' FROM part""",
}
