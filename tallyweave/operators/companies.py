"""Company names: garbage, equal and normalized names, known parents, and the nearest names by weighted character runs.

A tenant's vectors live in a space of their own: its list, its weights, its candidates. Candidates are found without
comparing all pairs: a name whose likeness reaches the least shares one of its heaviest runs with the other, so only those
are joined (no loss), and the likeness is worked out for the pairs that meet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Thresholds
from ..functions.names import let
from ..shared import written
from .rollups import match_type

RUN = 3
#: Legal endings that a name is compared without.
ENDINGS = "inc|incorporated|corp|corporation|co|company|llc|ltd|limited|plc|ag|gmbh|sa|nv|lp|llp"


def normal_name(name: Column) -> Column:
    """Lower case, letters and digits only, without legal endings."""
    words = F.trim(F.regexp_replace(F.lower(name), r"[^\p{L}\p{N}]+", " "))
    return F.trim(F.regexp_replace(words, rf"(\s+({ENDINGS}))+$", ""))


def is_garbage(name: Column) -> Column:
    """No name: missing, shorter than two characters, or without a letter."""
    return F.coalesce((F.length(F.trim(name)) < 2) | ~name.rlike(r"\p{L}"), F.lit(True))


def namespace(tenant: Column) -> Column:
    """The space of a tenant's vectors; a tenant that is not known raises."""
    bad = F.coalesce(F.trim(tenant).isin("", "unknown"), F.lit(True))
    return F.when(bad, F.raise_error(F.lit("vectors need a tenant")).cast("string")).otherwise(F.substring(F.sha2(tenant, 256), 1, 16))


def runs(name: Column) -> Column:
    """The runs of RUN characters of a normal name with a space on each side."""
    return _runs(normal_name(name))


def _runs(normal: Column) -> Column:
    padded = F.concat(F.lit(" "), normal, F.lit(" "))
    return let(padded, lambda p: F.when(F.length(p) >= RUN, F.transform(F.sequence(F.lit(1), F.length(p) - RUN + 1), lambda i: F.substring(p, i, F.lit(RUN)))).otherwise(F.array().cast("array<string>")))


def _weighted(counted: DataFrame, weights: DataFrame, key: str) -> DataFrame:
    """space, key, run, w: unit vectors of run counts times weights; runs that no listed name has count for nothing."""
    rows = counted.join(weights, ["space", "run"]).withColumn("w", F.col("n") * F.col("idf"))
    length = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("space", key)))
    return rows.withColumn("w", F.col("w") / length).select("space", key, "run", "w")


def nearest(names: DataFrame, listed: DataFrame, least: float, top: int) -> DataFrame:
    """tenant, key, listed_id, likeness and rank of the listed names (tenant, listed_id, listed_name) that are most like each name (tenant, key, name) of their tenant.

    Each different normal name of a tenant is compared once.
    """
    own = names.select(namespace(F.col("tenant")).alias("space"), "tenant", "key", normal_name(F.col("name")).alias("normal"))
    once = own.select("tenant", F.col("normal").alias("key")).distinct()
    count = lambda df, key, normal: df.select(namespace(F.col("tenant")).alias("space"), key, F.explode(_runs(normal)).alias("run")).groupBy("space", key, "run").agg(F.count(F.lit(1)).alias("n"))
    theirs = count(listed, "listed_id", normal_name(F.col("listed_name")))
    size = listed.groupBy(namespace(F.col("tenant")).alias("space")).agg(F.count(F.lit(1)).alias("size"))
    weights = theirs.groupBy("space", "run").agg(F.count(F.lit(1)).alias("df")).join(size, "space").select("space", "run", (F.log((F.col("size") + 1) / (F.col("df") + 1)) + 1).alias("idf"))
    b = _weighted(theirs, weights, "listed_id").withColumnRenamed("w", "v")
    a = _weighted(count(once, "key", F.col("key")), weights, "key")
    # What is left of a vector from a run on, by falling weight: below the least no likeness can come from it.
    left = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("space", "key").orderBy("w", F.desc("run")).rowsBetween(Window.unboundedPreceding, 0)))
    heavy = a.withColumn("left", left).where(F.col("left") >= least - 1e-9)
    pairs = heavy.join(b, ["space", "run"]).select("space", "key", "listed_id").distinct()
    likeness = pairs.join(a, ["space", "key"]).join(b, ["space", "listed_id", "run"]).groupBy("space", "key", "listed_id").agg(F.sum(F.col("w") * F.col("v")).alias("likeness"))
    order = Window.partitionBy("space", "key").orderBy(F.desc(F.round("likeness", 9)), "listed_id")
    best = likeness.where(F.round("likeness", 9) >= least).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    best = written(best.withColumnRenamed("key", "normal"), "nearest")  # so that its size is known to the join
    return own.join(best, ["space", "normal"]).select("tenant", "key", "listed_id", "likeness", "rank")


def resolve(names: DataFrame, listed: DataFrame, parents: DataFrame, t: Thresholds = DEFAULT) -> DataFrame:
    """names (tenant, key, name) with resolved, layer, confidence and match_type: garbage, equal, normalized, known parent (alias, parent), nearest, else to a human.

    Each step gets only the names that those before left open. Of listed names that are equal the first id stands for all.
    """
    own = listed.groupBy("tenant", "listed_name").agg(F.min("listed_id").alias("exact_id"))
    like = listed.groupBy("tenant", normal_name(F.col("listed_name")).alias("normal")).agg(F.min("listed_id").alias("norm_id"))
    rows = names.withColumns({"garbage": is_garbage(F.col("name")), "normal": normal_name(F.col("name"))})
    rows = rows.join(own, (rows["tenant"] == own["tenant"]) & (rows["name"] == own["listed_name"]), "left").select(rows["*"], "exact_id")
    rows = rows.join(like, ["tenant", "normal"], "left").join(parents.select(F.col("alias").alias("normal"), "parent"), "normal", "left")
    open_ = rows.where("NOT garbage AND exact_id IS NULL AND norm_id IS NULL AND parent IS NULL")
    near = nearest(open_.select("tenant", "key", "name"), listed, t.vector_resolve, 1).select("tenant", "key", F.col("listed_id").alias("near_id"), "likeness")
    rows = rows.join(near, ["tenant", "key"], "left")
    c = F.col
    layer = F.when(c("garbage"), "L0_GARBAGE").when(c("exact_id").isNotNull(), "L1_EXACT").when(c("norm_id").isNotNull(), "L1_NORM").when(c("parent").isNotNull(), "L1_KNOWN_PARENT").when(c("near_id").isNotNull(), "L2_VECTOR").otherwise("L4_HUMAN")
    rows = rows.withColumn("layer", layer).withColumn("id", F.when(c("layer") == "L1_EXACT", c("exact_id")).when(c("layer") == "L1_NORM", c("norm_id")).when(c("layer") == "L2_VECTOR", c("near_id")))
    by_id = listed.select("tenant", F.col("listed_id").alias("id"), F.col("listed_name"))
    rows = rows.join(by_id, ["tenant", "id"], "left")
    confidence = F.when(c("layer").startswith("L1"), 1.0).when(c("layer") == "L2_VECTOR", F.round("likeness", 9)).otherwise(0.0)
    out = rows.withColumns({"resolved": F.when(c("layer") == "L1_KNOWN_PARENT", c("parent")).otherwise(c("listed_name")), "confidence": confidence})
    return out.select("tenant", "key", "name", "resolved", "layer", "confidence", F.when(c("layer") == "L1_NORM", "EXACT_MATCH").otherwise(match_type(c("layer"), c("confidence"))).alias("match_type"))
