"""A batch's end as one flow: wait for all shards, order, chain, replay, receipt, log entry, and one commit.

What is committed depends on the batch's rows alone, and the store is only ever added to: two callers may commit the same
batch, and a caller may die at any step and be run again. Rows of a job are seen all at once when it ends; committed() gives
one row for each batch, and raises where two say different things. What comes after its batch's commit changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import written
from ..streaming.state import leaf
from . import evidence as E

COMMITTED = "trace_id string, rows long, root string, replayed boolean, receipt_id string, leaf string"


def committed(spark: SparkSession, store: str) -> DataFrame:
    """One row for each batch of the store (COMMITTED); none where nothing was committed yet."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(store)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], COMMITTED)
    names = [c.split()[0] for c in COMMITTED.split(", ")]
    rows = spark.read.schema(COMMITTED).parquet(store).groupBy("trace_id").agg(F.collect_set(F.struct(*names[1:])).alias("all"))
    odd = F.raise_error(F.concat(F.lit("two ends of one batch: "), F.col("trace_id")))
    one = F.when(F.size("all") == 1, F.col("all")[0]).otherwise(odd.cast(rows.schema["all"].dataType.elementType))
    return rows.select("trace_id", one.alias("one")).select("trace_id", "one.*")


def arrivals(decisions: DataFrame, done: DataFrame, shards: int) -> DataFrame:
    """trace_id, arrived and state of each batch: waiting, ready or committed."""
    seen = decisions.groupBy("trace_id").agg(F.countDistinct("shard").alias("arrived"))
    out = seen.join(done.select("trace_id", F.lit(True).alias("done")), "trace_id", "left")
    return out.select("trace_id", "arrived", F.when(F.col("done"), "committed").when(F.col("arrived") < shards, "waiting").otherwise("ready").alias("state"))


def ready(decisions: DataFrame, done: DataFrame, shards: int) -> DataFrame:
    """trace_id of the batches all of whose shards are there and that are not committed."""
    return arrivals(decisions, done, shards).where("state = 'ready'").select("trace_id")


def finalized(decisions: DataFrame, batches: DataFrame, replays: int = 2) -> DataFrame:
    """What is to be committed for batches (COMMITTED), worked out whole: written, but not yet committed.

    A batch is ordered, chained and chained again from rows dealt in another way; one whose roots differ is not replayed
    and gets neither receipt nor log entry.
    """
    own = written(decisions.join(batches, "trace_id"), "finalizing")
    runs = []
    for k in range(1 + replays):
        runs.append(E.chain_roots(own if not k else own.repartition(F.xxhash64(F.lit(k), "row_index"))).withColumnRenamed("n", "rows"))
    checked = E.replayed([r.select("trace_id", "root") for r in runs]).select("trace_id", F.col("passed").alias("replayed"))
    out = runs[0].join(checked, "trace_id")
    receipt = F.when(F.col("replayed"), E.receipt_id(F.col("trace_id"), F.col("root")))
    entry = leaf(F.lit("receipt"), F.col("receipt_id"), F.col("root"), F.lit(""), F.substring("root", 1, 32))
    out = out.withColumn("receipt_id", receipt).withColumn("leaf", F.when(F.col("replayed"), entry))
    return written(out.select(*(c.split()[0] for c in COMMITTED.split(", "))), "finalized")


def commit(ends: DataFrame, store: str) -> None:
    """Add ends to the store; a job that dies adds nothing."""
    ends.write.mode("append").parquet(store)
