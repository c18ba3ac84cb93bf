"""Documents into shards of near equal bytes: longest-processing-time scheduling of groups that stay together.

A group is the rows of equal text; its size is that of all its rows. Groups in order of size, largest first, each go to the
shard that is least loaded by then (of equal ones the first), which a heap gives. The order is dealt into ranges: how
the shards are loaded where a range begins comes from the counts of groups by size alone, since n groups of one size can be
poured at once; each range then runs the heap in a task of its own. The counts are read in one task, a row for each size:
sizes that differ add up, so there are at most the square root of twice all bytes (14 million for 100 TB).

Only ids, sizes and hashes are moved until a row's shard and slot are known; texts are moved once, to be written. A
group is never divided, so one that holds a third of all bytes makes its shard that large, and the others are equal.

Defined cases: a null text has no bytes, and null texts are a group; an empty text is a group of its own; groups of equal
size go by their least doc_id (null first) and their text's hash; rows of a shard have their slots by doc_id (null first),
size and hash; rows equal in these take successive slots in any order; a very long text is a group like any other; an
empty table gives an empty result; other columns stay, but ones named shard or slot give way.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import new_path, placed, stored, table, unused

SHARDS = 16


def poured(loads: list[int], size: int, n: int) -> list[int]:
    """The loads after n groups of one size went to the least loaded shard one by one."""
    if not n:
        return loads
    low, high = min(loads), max(loads) + n * size + 1
    given = lambda level: [max(0, -((load - level) // size)) for load in loads]  # noqa: E731  each fills up to the level
    while high - low > 1:
        level = (low + high) // 2
        low, high = (level, high) if sum(given(level)) <= n else (low, level)
    counts = given(low)
    rest = n - sum(counts)
    out = [load + c * size for load, c in zip(loads, counts, strict=True)]
    for i in [i for i, load in enumerate(out) if load == low][:rest]:
        out[i] += size
    return out


def scheduled(groups: DataFrame, shards: int = SHARDS) -> DataFrame:
    """From size, hash, first_id, weight (one row a group): size, hash, shard."""
    order = [F.desc("weight"), F.asc_nulls_first("first_id"), F.asc("size"), F.asc("hash")]
    rows = stored(groups.select("size", "hash", "first_id", "weight").repartitionByRange(*order).withColumn("range", F.spark_partition_id()), "shard-groups")
    runs = rows.groupBy("weight", "range").agg(F.count(F.lit(1)).alias("n"))
    runs = stored(runs.withColumn("before", F.sum("n").over(Window.partitionBy("weight").orderBy("range")) - F.col("n")), "shard-runs", compact=True)
    begins = runs.groupBy("range").agg(F.max(F.struct("weight", "before")).alias("at")).select("at.weight", F.lit(0).cast("long").alias("n"), "range", "at.before")
    counts = runs.groupBy("weight").agg(F.sum("n").alias("n")).select("weight", "n", F.lit(-1).alias("range"), F.lit(0).cast("long").alias("before"))

    def pour(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        loads = [0] * shards
        for b in batches:
            out = []
            for weight, n, at, before in zip(*(b[c].tolist() for c in ("weight", "n", "range", "before")), strict=True):
                if at < 0:
                    loads = poured(loads, weight, n)
                else:
                    out.append((at, poured(loads, weight, before)))
            yield pd.DataFrame(out, columns=["range", "loads"])

    starts = begins.unionByName(counts).repartition(1).sortWithinPartitions(F.desc("weight"), F.desc("range")).mapInPandas(pour, "range int, loads array<long>")

    def schedule(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        heap: list[tuple[int, int]] = []
        for b in batches:
            out = []
            for size, key, weight, loads in zip(*(b[c].tolist() for c in ("size", "hash", "weight", "loads")), strict=True):
                if loads is not None:
                    heap = [(int(load), i) for i, load in enumerate(loads)]
                    heapq.heapify(heap)
                    continue
                load, shard = heap[0]
                heapq.heapreplace(heap, (load + weight, shard))
                out.append((size, key, shard))
            yield pd.DataFrame(out, columns=["size", "hash", "shard"])

    none = F.lit(None)
    heads = stored(starts, "shard-loads").select(F.lit(0).cast("long").alias("size"), F.lit(0).cast("long").alias("hash"), none.cast("long").alias("first_id"), F.lit((1 << 63) - 1).alias("weight"), "range", "loads")
    each = rows.withColumn("loads", none.cast("array<long>")).unionByName(heads).repartition("range").sortWithinPartitions("range", *order)
    return each.mapInPandas(schedule, "size long, hash long, shard int")


def sharded(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """docs (doc_id, text) with shard (from 0) and slot, the row's place in its shard (from 0, without gaps)."""
    docs = docs.drop("shard", "slot")
    keys = dict(zip(("id", "no_id", "size", "hash"), unused(docs, "shard_id", "shard_no_id", "shard_size", "shard_hash"), strict=True))
    n, first = unused(docs, "shard_rows", "shard_first")
    # Keys without nulls, so that grouping and join share one exchange of the texts.
    values = [F.coalesce(F.col("doc_id").cast("long"), F.lit(0).cast("long")), F.col("doc_id").isNull(), (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long"), F.xxhash64("text")]
    keyed = docs.withColumns(dict(zip(keys.values(), values, strict=True)))
    rows = stored(keyed.groupBy(*(F.col(c).alias(k) for k, c in keys.items())).agg(F.count(F.lit(1)).alias("n")), "shard-rows", compact=True)
    own = F.when(~F.col("no_id"), F.col("id"))
    # least, not min: a group with a row of null id has null first.
    least = F.when(~F.max("no_id"), F.min(own))
    groups = rows.groupBy("size", "hash").agg(least.alias("first_id"), (F.sum("n") * F.col("size")).alias("weight"))
    homes = stored(scheduled(groups, shards), "shard-homes", compact=True)
    rows = rows.join(homes, ["size", "hash"]).withColumn("has_id", ~F.col("no_id"))
    slots = placed(rows, ["shard"], ["has_id", "id", "size", "hash"], "slot", "n")
    slots = slots.select(*(F.col(k).alias(c) for k, c in keys.items()), F.col("n").alias(n), "shard", F.col("slot").alias(first))
    out = keyed.join(slots.hint("merge"), [*keys.values()])
    nth = F.row_number().over(Window.partitionBy(*keys.values()).orderBy(F.lit(0))) - 1
    return out.select(*docs.columns, "shard", (F.col(first) + F.when(F.col(n) == 1, 0).otherwise(nth)).alias("slot"))


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS) -> None:
    """Write docs as a table with a folder for each shard; the rows of a file are in the order of their slots."""
    sharded(docs, shards).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    path = new_path(spark, "shards")
    write_shards(docs, path)
    kinds = "doc_id long, text string, slot long, shard int"
    size = (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long")
    crc = F.crc32(F.coalesce("text", F.lit("")).cast("binary"))
    return spark.read.schema(kinds).parquet(path).select("doc_id", size.alias("size"), crc.alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


_STEP = "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
#: CRC-32 of a list of byte values, by a table made from its polynomial.
_CRC = "xor(list_reduce({bytes}, lambda c, x: xor(c >> 8, crc_table[xor(c & 255, x) + 1]), 4294967295), 4294967295)"
_TABLE = f"""crc AS (
  SELECT list(c ORDER BY i) AS crc_table FROM (
    WITH RECURSIVE t AS (SELECT i, 0 AS k, i AS c FROM range(256) r(i) UNION ALL SELECT i, k + 1, {_STEP} FROM t WHERE k < 8)
    SELECT i, c FROM t WHERE k = 8))"""
_BYTES = "list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::BIGINT)"
#: The schedule group by group, with the shards' loads as a list.
ORACLE = f"""
WITH RECURSIVE {_TABLE},
sized AS (SELECT doc_id, text, coalesce(strlen(text), 0) + 1 AS size, {_CRC.format(bytes=_BYTES)} AS text_crc32 FROM documents, crc),
groups AS (SELECT text, sum(size)::BIGINT AS weight, row_number() OVER (ORDER BY sum(size) DESC, min(doc_id)) AS g FROM sized GROUP BY text),
plan AS (
  SELECT 0::BIGINT AS g, list_transform(range({SHARDS}), lambda i: 0::BIGINT) AS loads, -1 AS shard
  UNION ALL
  SELECT g, list_transform(loads, lambda l, i: CASE WHEN i = home THEN l + weight ELSE l END), home - 1
  FROM (SELECT s.g, s.weight, p.loads, list_position(p.loads, list_min(p.loads)) AS home FROM plan p JOIN groups s ON s.g = p.g + 1))
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, size) - 1 AS slot, NULL::INT AS grown_shard
FROM sized s JOIN groups g ON s.text IS NOT DISTINCT FROM g.text JOIN plan p ON g.g = p.g
"""
