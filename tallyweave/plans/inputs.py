"""The driver's tables in the roles of the engine's own: as DataFrames, and as SQL for the twins of the queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


LAYERS = [(5, "L0_GARBAGE"), (60, "L1_EXACT"), (75, "L1_NORM"), (82, "L1_PERSON_EXACT"), (87, "L2_VECTOR"), (91, "L3_LLM"), (93, "L3_CACHED")]


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions, one for each order: a batch for each priority, the layer by the order's number."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey") % 100
    layer = F.lit("L4_HUMAN")
    for top, name in reversed(LAYERS):
        layer = F.when(k < top, name).otherwise(layer)
    kind = F.when(F.col("o_orderstatus") == "O", "ORGANIZATION").when(F.col("o_orderstatus") == "F", "PERSON").otherwise("VESSEL")
    rows = o.select(
        F.concat(F.lit("B"), F.substring("o_orderpriority", 1, 1)).alias("trace_id"), F.col("o_orderkey").alias("row_index"), F.concat(F.lit("Customer#"), F.lpad(F.col("o_custkey").cast("string"), 9, "0")).alias("original"), layer.alias("layer"),
        F.when((k >= 5) & (k < 93), F.concat(F.lit("C"), F.col("o_custkey").cast("string"))).alias("resolved"), ((F.col("o_custkey") % 101).cast("double") / F.lit(100.0)).alias("confidence"), kind.alias("entity_type"), F.col("o_orderdate").alias("source_timestamp"),
    )
    return rows.withColumn("decision_path", F.lower("layer"))


_LAYER = " ".join(f"WHEN o_orderkey % 100 < {top} THEN '{name}'" for top, name in LAYERS)
RESULTS = f"""results AS (
  SELECT *, lower(layer) AS decision_path FROM (
    SELECT 'B' || substr(o_orderpriority, 1, 1) AS trace_id, o_orderkey AS row_index, 'Customer#' || lpad(o_custkey::VARCHAR, 9, '0') AS original,
      CASE {_LAYER} ELSE 'L4_HUMAN' END AS layer,
      CASE WHEN o_orderkey % 100 >= 5 AND o_orderkey % 100 < 93 THEN 'C' || o_custkey::VARCHAR END AS resolved,
      (o_custkey % 101)::DOUBLE / 100.0::DOUBLE AS confidence,
      CASE o_orderstatus WHEN 'O' THEN 'ORGANIZATION' WHEN 'F' THEN 'PERSON' ELSE 'VESSEL' END AS entity_type, o_orderdate AS source_timestamp
    FROM orders))"""
