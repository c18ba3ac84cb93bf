"""Mixing sources to target weights.

The words of a source, documents in order of doc_id, form a stream cut into blocks of BLOCK words. The mix is a
number of slots in output shards of SHARD_SLOTS slots; each shard draws its slots' sources from a multinomial by the
targets. A source's slots are numbered over the shards; pass e over its blocks takes them in the order of a
pseudorandom permutation of their indexes, and slots are joined to blocks by index. Draws beyond a source's need are
handed to sources that were drawn too seldom, and a source's last slot takes as many words as its target leaves, so
that every source meets its target and no block is taken more than twice.

Only DataFrame functions are used. Prefix sums run over ranges of equal size first and inside each range then, so that no
source gathers in one task, whether its doc_ids are dense, sparse, repeated or null; sums over sources run on one row per
source.

Defined cases: a null or empty text has size 0 and is never taken; a null source is a source and comes last; null
doc_ids come first in their source; rows of equal doc_id are ordered by size and the text's hash; repeated rows each take
part; a very long text is many blocks; an empty table gives an empty result; other columns may have any names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, stored, table, unused

BLOCK, SHARD_SLOTS, ROUNDS = 1024, 1024, 20
#: Shards that are summed up together, and slots that are permuted in one task at least, and tasks at most.
SHARDS, TASK_SLOTS, TASKS = 4096, 4096, 20_000
SHARE, CAP, WEIGHTS = 1.5, 2, (5, 2, 1)
SEED = "mix"


def rolled(*parts: Column | str) -> Column:
    """A pseudorandom whole number below 2^32 from the parts' text."""
    text = F.concat_ws("|", F.lit(SEED), *(p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def round_keys(source: Column, turn: Column) -> Column:
    """The keys of a pass's rounds."""
    return F.transform(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), lambda r: rolled("key", source, turn, r))


def permuted(i: Column, n: Column, source: Column, turn: Column, keys: Column | None = None, inverse: bool = False) -> Column:
    """The image of i under a permutation of 0..n-1 for a source's pass: rounds of swap-or-not, each its own inverse. keys: the pass's round_keys."""
    rounds = F.sequence(F.lit(ROUNDS - 1), F.lit(0), F.lit(-1)) if inverse else F.sequence(F.lit(0), F.lit(ROUNDS - 1))

    def swap(x: Column, r: Column) -> Column:
        key = rolled("key", source, turn, r) if keys is None else F.get(keys, r)
        other = F.pmod(key % n - x, n)
        return F.when(rolled("bit", source, turn, r, F.greatest(x, other)) % 2 == 1, other).otherwise(x)

    return F.aggregate(rounds, i.cast("long"), swap)


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, size and a hash of the text for each row of docs."""
    return docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), F.xxhash64("text").alias("text_hash"))


def targets(sized: DataFrame) -> DataFrame:
    """One row per source: sid (its rank), source, source_size, target.

    The largest scale is sought at which the sources' weights, each stopped at CAP times its size, add up to the
    mix: sources in order of the scale that stops them, with the room that those before leave.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), ((F.col("sid") - 1) % len(WEIGHTS) + 1).cast("int"))
    per = per.withColumn("sid", F.row_number().over(by_name)).withColumn("weight", weight).withColumn("stop", F.col("source_size") * float(CAP) / F.col("weight"))
    order = Window.orderBy("stop", "sid")
    every = Window.orderBy("stop", "sid").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    room = F.sum("source_size").over(every) * SHARE - (F.sum("source_size").over(order) - F.col("source_size")) * float(CAP)
    scale = room / (F.sum("weight").over(every) - F.sum("weight").over(order) + F.col("weight"))
    per = per.withColumn("scale", scale)
    per = per.withColumn("scale", F.min(F.when(F.col("scale") <= F.col("stop"), F.struct("stop", "sid", "scale"))).over(every)["scale"])
    return per.select("sid", "source", "source_size", F.least(F.col("source_size") * float(CAP), F.col("weight") * F.col("scale")).alias("target"))


def needs(plan: DataFrame, block: int) -> DataFrame:
    """For each source the blocks of its stream, its whole passes, and the words and slots of the last pass.

    short_at: the slot of the last pass that gets the stream's last, short block.
    """
    size = F.col("source_size")
    plan = plan.where("source_size > 0").withColumn("blocks", F.ceil(size / block)).withColumn("short", size - (F.col("blocks") - 1) * block)
    plan = plan.withColumn("words", F.least(F.floor("target"), size * CAP)).withColumn("passes", F.floor(F.col("words") / size)).withColumn("rest", F.col("words") - F.col("passes") * size)
    plan = plan.withColumn("short_at", permuted(F.col("blocks") - 1, F.col("blocks"), F.col("sid"), F.col("passes"), inverse=True))
    plan = plan.withColumn("keys", F.transform(F.sequence(F.lit(0), F.lit(CAP)), lambda turn: round_keys(F.col("sid"), turn)))
    least = F.ceil(F.col("rest") / block)
    held = least * block - F.when(F.col("short_at") < least, block - F.col("short")).otherwise(0)
    return plan.withColumn("slots", F.col("passes") * F.col("blocks") + least + F.when(held < F.col("rest"), 1).otherwise(0))


@dataclass
class Mix:
    sized: DataFrame
    plan: DataFrame
    slots: DataFrame
    takes: DataFrame
    block: int


def drawn(plan: DataFrame, shard_slots: int) -> DataFrame:
    """shard, slot, sid, seq: a source for every slot of the mix, and its number among the source's slots."""
    spark = plan.sparkSession
    total = plan.agg(F.coalesce(F.sum("slots"), F.lit(0))).first()[0]
    if not total:
        return spark.range(0).select(F.col("id").alias("shard"), F.col("id").alias("slot"), F.col("id").cast("int").alias("sid"), F.col("id").alias("seq"))
    cells = 1 << 12
    span = F.lit(float(1 << 32)) / F.lit(float(total))
    to = F.sum("slots").over(Window.orderBy("sid"))
    cuts = plan.select("sid", "slots", (F.round((to - F.col("slots")) * span)).cast("long").alias("lo"), F.round(to * span).cast("long").alias("hi")).where("lo < hi")
    cuts = cuts.withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") * cells / (1 << 32)), F.floor((F.col("hi") - 1) * cells / (1 << 32)))))
    slots = spark.range(total).select(F.floor(F.col("id") / shard_slots).alias("shard"), F.col("id").alias("slot")).withColumn("roll", rolled("slot", F.col("slot")))
    slots = slots.withColumn("cell", F.floor(F.col("roll") * cells / (1 << 32)))
    picked = slots.join(cuts, "cell").where("roll >= lo AND roll < hi").select("shard", "slot", "sid")
    counts = picked.groupBy("sid", "shard").agg(F.count(F.lit(1)).alias("n")).withColumn("part", F.floor(F.col("shard") / SHARDS))
    parts = counts.groupBy("sid", "part").agg(F.sum("n").alias("all"))
    parts = parts.select("sid", "part", (F.sum("all").over(Window.partitionBy("sid").orderBy("part")) - F.col("all")).alias("before"))
    inside = F.sum("n").over(Window.partitionBy("sid", "part").orderBy("shard")) - F.col("n")
    base = counts.withColumn("inside", inside).join(parts, ["sid", "part"]).select("sid", "shard", (F.col("before") + F.col("inside")).alias("base"))
    seq = picked.withColumn("nth", F.row_number().over(Window.partitionBy("shard", "sid").orderBy("slot")) - 1)
    seq = stored(seq.join(base, ["sid", "shard"]).join(plan.select("sid", "slots"), "sid").select("shard", "slot", "sid", (F.col("base") + F.col("nth")).alias("seq"), "slots"), "drawn-slots", compact=True)
    # Few draws miss: about the root of a source's slots.
    over = seq.where("seq >= slots").select("shard", "slot", F.row_number().over(Window.orderBy("slot")).alias("j"))
    had = counts.groupBy("sid").agg(F.sum("n").alias("n"))
    lack = plan.join(had, "sid", "left").select("sid", "slots", F.coalesce("n", F.lit(0)).alias("n")).where("n < slots").select("sid", F.explode(F.sequence(F.col("n"), F.col("slots") - 1)).alias("seq"))
    lack = lack.withColumn("j", F.row_number().over(Window.orderBy("sid", "seq")))
    out = seq.where("seq < slots").select("shard", "slot", "sid", "seq").unionByName(over.join(lack, "j").select("shard", "slot", "sid", "seq"))
    return out.repartition(max(1, min(total // TASK_SLOTS, TASKS)))  # few bytes, but much to reckon: permuting them is for many tasks


def mix(docs: DataFrame, block: int = BLOCK, shard_slots: int = SHARD_SLOTS) -> Mix:
    """The mix of docs: sized rows with their place in their source's stream, the plan, the slots with the block and the words that each takes, and the takes of each row.

    takes: sid, start (of the row in its stream), turn (the pass), lo, hi: the words that a block gives, counted in the row.
    """
    sized = stored(sizes(docs), "mix-sizes", compact=True)
    plan = stored(targets(sized), "mix-targets")
    ranked = sized.withColumnRenamed("source", "of").join(plan.select("sid", "source", "source_size", "target"), F.col("of").eqNullSafe(F.col("source"))).drop("of")
    same = ["sid", "doc_id", "size", "text_hash"]
    ranked = ranked.groupBy(*same).agg(F.count(F.lit(1)).alias("n"), *(F.first(c).alias(c) for c in ("source", "source_size", "target")))
    ranked = ranked.repartitionByRange(*same).withColumn("range", F.spark_partition_id())
    ranked = stored(ranked.withColumn("words", F.col("n") * F.col("size")), "mix-ranges")
    sums = ranked.groupBy("sid", "range").agg(F.sum("words").alias("words"))
    base = sums.select("sid", "range", (F.sum("words").over(Window.partitionBy("sid").orderBy("range")) - F.col("words")).alias("base"))
    inside = Window.partitionBy("sid", "range").orderBy(F.col("doc_id").asc_nulls_first(), "size", "text_hash").rowsBetween(Window.unboundedPreceding, 0)
    placed = ranked.withColumn("inside", F.sum("words").over(inside) - F.col("words")).join(base, ["sid", "range"])
    placed = placed.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    placed = placed.select("doc_id", "source", "size", "text_hash", "sid", "source_size", "target", (F.col("base") + F.col("inside") + F.col("copy") * F.col("size")).alias("start"))
    placed = stored(placed, "mix-placed", compact=True)
    need = stored(needs(plan, block), "mix-needs")
    slots = drawn(need, shard_slots).join(need.select("sid", "blocks", "short", "passes", "rest", "short_at", "keys"), "sid")
    slots = slots.withColumn("turn", F.floor(F.col("seq") / F.col("blocks"))).withColumn("nth", F.col("seq") % F.col("blocks"))
    slots = slots.withColumn("index", permuted(F.col("nth"), F.col("blocks"), F.col("sid"), F.col("turn"), F.get("keys", F.col("turn").cast("int"))))
    full = F.when(F.col("index") == F.col("blocks") - 1, F.col("short")).otherwise(F.lit(block))
    before = F.col("nth") * block - F.when(F.col("short_at") < F.col("nth"), block - F.col("short")).otherwise(0)
    words = F.when(F.col("turn") < F.col("passes"), full).otherwise(F.least(full, F.col("rest") - before))
    slots = slots.select("shard", "slot", "sid", "turn", "index", words.alias("words"))
    pieces = placed.where("size > 0").select("sid", "start", "size", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block))).alias("index"))
    at = F.col("index") * block
    # Spark takes the pieces for as small as the rows that they are made from, of which a long text's are many.
    takes = pieces.hint("merge").join(slots, ["sid", "index"]).select("sid", "start", "turn", F.greatest(at - F.col("start"), F.lit(0)).alias("lo"), F.least(at + F.col("words") - F.col("start"), F.col("size")).alias("hi")).where("lo < hi")
    return Mix(placed, need, slots, takes, block)


def taken(m: Mix) -> DataFrame:
    """doc_id, size, source_size, target, taken for each row."""
    sums = m.takes.groupBy("sid", "start").agg(F.sum(F.col("hi") - F.col("lo")).alias("taken"))
    rows = m.sized.where("size > 0").join(sums, ["sid", "start"], "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"))
    return rows.unionByName(m.sized.where("size = 0").select("doc_id", "size", "source_size", "target", F.lit(0).cast("long").alias("taken")))


def mixed(docs: DataFrame) -> DataFrame:
    """The mix as documents: for each pass that takes words of a document one row, with the words taken in order.

    A pass that takes all of a document keeps its text as it is; one that takes parts joins their words by one space.
    Columns as they came; n_chars, where there is one, is the new text's. Of equal rows, columns other than these come from any one.
    """
    m = mix(docs)
    part = F.sort_array(F.collect_list(F.struct("lo", "hi")))
    passes = m.takes.groupBy("sid", "start", "turn").agg(part.alias("parts"), F.sum(F.col("hi") - F.col("lo")).alias("n_taken"))
    passes = passes.join(m.sized.select("sid", "start", "doc_id", "source", "text_hash", "size").where("size > 0").hint("merge"), ["sid", "start"])
    # Keys without nulls, so that grouping and join share one exchange of the texts.
    *key, parts = unused(docs, "mix_id", "mix_no_id", "mix_of", "mix_no_source", "mix_hash", "mix_parts")
    values = [F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), F.col("doc_id").isNull(), F.coalesce(F.col("source").cast("string"), F.lit("")), F.col("source").isNull()]
    passes = passes.select(*(v.alias(k) for k, v in zip(key, values, strict=False)), F.col("text_hash").alias(key[4]), F.when(F.col("n_taken") < F.col("size"), F.col("parts")).alias(parts))
    keyed = docs.withColumns(dict(zip(key, [*values, F.xxhash64("text")], strict=True)))
    rows = keyed.groupBy(*key).agg(*(F.first(c).alias(c) for c in docs.columns))
    out = rows.join(passes.hint("merge"), key)
    words = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    cut = F.array_join(F.flatten(F.transform(parts, lambda p: F.slice(words, (p["lo"] + 1).cast("int"), (p["hi"] - p["lo"]).cast("int")))), " ")
    out = out.withColumn("text", F.when(F.col(parts).isNull(), F.col("text")).otherwise(cut))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taken(mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source")))


_SWAP = """list_reduce({rounds}, lambda x, r: CASE WHEN ('0x' || substr(md5('mix|bit|' || sid || '|' || passes || '|' || r || '|' || greatest(x, {other})), 1, 8))::BIGINT % 2 = 1 THEN {other} ELSE x END, {start})"""
_OTHER = "(((('0x' || substr(md5('mix|key|' || sid || '|' || passes || '|' || r), 1, 8))::BIGINT % blocks - x) % blocks + blocks) % blocks)"
_PLACE = _SWAP.format(rounds=f"range({ROUNDS - 1}, -1, -1)", other=_OTHER, start="{start}")
#: The same targets, streams and permutations; which shard a slot lies in makes no difference to what is taken.
ORACLE = rf"""
WITH sized AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::BIGINT AS size FROM documents),
per AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source IS NULL, source COLLATE "C") AS sid FROM sized GROUP BY source),
weighed AS (SELECT *, [5, 2, 1][((sid - 1) % 3 + 1)::INT] AS weight FROM per),
stops AS (SELECT *, source_size * {float(CAP)}::DOUBLE / weight AS stop FROM weighed),
scales AS (SELECT *, (sum(source_size) OVER () * {SHARE}::DOUBLE - (sum(source_size) OVER o - source_size) * {float(CAP)}::DOUBLE) / (sum(weight) OVER () - sum(weight) OVER o + weight) AS scale FROM stops WINDOW o AS (ORDER BY stop, sid)),
chosen AS (SELECT arg_min(scale, (stop, sid)) FILTER (scale <= stop) AS scale FROM scales),
plan AS (SELECT sid, source, source_size, least(source_size * {float(CAP)}::DOUBLE, weight * chosen.scale) AS target FROM scales, chosen),
need AS (
  SELECT *, words // source_size AS passes, words % source_size AS rest, source_size - (blocks - 1) * {BLOCK} AS short
  FROM (SELECT *, least(floor(target)::BIGINT, source_size * {CAP}) AS words, (source_size + {BLOCK - 1}) // {BLOCK} AS blocks FROM plan WHERE source_size > 0)),
ends AS (SELECT *, {_PLACE.format(start="blocks - 1")} AS short_at FROM need),
slots AS (SELECT *, {_PLACE.format(start="k")} AS nth FROM (SELECT *, unnest(range(blocks)) AS k FROM ends)),
cut AS (SELECT sid, k, least(CASE WHEN k = blocks - 1 THEN short ELSE {BLOCK} END, rest - (nth * {BLOCK} - CASE WHEN short_at < nth THEN {BLOCK} - short ELSE 0 END)) AS take FROM slots),
placed AS (
  SELECT s.*, p.sid, p.source_size, p.target, sum(size) OVER (PARTITION BY p.sid ORDER BY doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING)::BIGINT - size AS start
  FROM sized s JOIN plan p ON s.source IS NOT DISTINCT FROM p.source),
pieces AS (SELECT *, unnest(range(start // {BLOCK}, (start + size - 1) // {BLOCK} + 1)) AS k FROM placed WHERE size > 0),
part AS (SELECT p.sid, start, sum(greatest(0, least(p.k * {BLOCK} + take, start + size) - greatest(p.k * {BLOCK}, start)))::BIGINT AS n FROM pieces p JOIN cut c ON p.sid = c.sid AND p.k = c.k AND take > 0 GROUP BY 1, 2)
SELECT doc_id, size, p.source_size, p.target, (CASE WHEN size = 0 THEN 0 ELSE n.passes * size + coalesce(part.n, 0) END)::BIGINT AS taken
FROM placed p LEFT JOIN need n ON p.sid = n.sid LEFT JOIN part ON p.sid = part.sid AND p.start = part.start AND size > 0
"""
