"""Shared helpers: tables in the cluster's shared folder, hashing of rows to buckets, graph components."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Words are runs of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a session in one process gets one of its own where that is unset."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tallyweave-"))
        at = spark.sparkContext.getCheckpointDir()
    return at.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, compact: bool = False) -> DataFrame:
    """Write df as a table in the shared folder and read it back: cuts lineage and survives lost executors.

    compact: its rows are few bytes each, so they are dealt anew into files of a good size.
    """
    path = new_path(df.sparkSession, name)
    (df.hint("rebalance") if compact else df).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Delete the table behind a DataFrame that stored() returned."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores as tell it from the columns of df."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def placed(df: DataFrame, keys: list[str], order: list[str], name: str, width: str | None = None) -> DataFrame:
    """df with the column name: how many places the rows before it take (from 0) among the rows of its keys (without nulls), by order, nulls first. A row takes one place, or as many as its column width says.

    Rows are dealt into ranges of equal size by keys and order, whatever the keys' sizes; ranges are added up first, then
    places are counted inside each range. The ranges are written, so that both steps see the same. Order must tell rows
    apart, so that no run of equal rows makes a range large.
    """
    part, inside, base = unused(df, "part", "inside", "base")
    rows = stored(df.repartitionByRange(*keys, *order).withColumn(part, F.spark_partition_id()), name)
    takes = F.lit(1) if width is None else F.col(width)
    sums = rows.groupBy(*keys, part).agg(F.sum(takes).alias(base))
    sums = sums.select(*keys, part, (F.sum(base).over(Window.partitionBy(*keys).orderBy(part)) - F.col(base)).alias(base))
    before = Window.partitionBy(*keys, part).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn(inside, F.sum(takes).over(before) - takes).join(sums, [*keys, part])
    return rows.select(*df.columns, (F.col(base) + F.col(inside)).alias(name))


def connected_components(edges: DataFrame) -> DataFrame:
    """Components of an undirected graph by alternating large-star and small-star rounds.

    edges: columns a, b (long). Returns one row per node that has an edge to another node: node, root
    (the smallest node of its component). A round joins each edge with the minimum of its end's neighbours,
    so nothing gathers a node's whole neighbour list, and both sides of the join are tables, so that Spark can split
    a node of many edges. Rounds go on until one changes nothing; their number grows with the logarithm of the nodes.
    """
    cur = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc-edges", compact=True)
    seen = None
    while True:
        both = cur.select("a", "b").unionByName(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = stored(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")), "cc-least", compact=True)
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        down = stored(large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b"), "cc-large", compact=True)
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionByName(least.select("a", F.col("m").alias("b"))).distinct()
        new = stored(small, "cc-edges", compact=True)
        sums = new.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        for spent in (cur, low, down):
            forget(spent)
        cur = new
        if sums == seen:
            return cur.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(cur.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        seen = sums
