"""Preference pairs as training rows: a shared prompt and two masked completions.

The two conversations of a pair are compared turn by turn; their longest common prefix is rendered once as the prompt,
and what follows it in each as its completion. A mask lists the characters of a completion that count for training:
the texts of assistant turns. Long conversations come in chunks of CHUNK turns, so that no row and no task gathers a
conversation without bound; turns are numbered over ranges of turn numbers first and inside each range then, and written
once for the steps that read them.

Defined cases: a null text is empty and a null role is `user`; turns of equal number are ordered by role and text, and
repeated rows are turns of their own; a side that is missing has an empty completion; a pair whose sides are equal has
two empty completions; null pair_ids are one pair; a very long text is a row of its own size, a very long conversation
many chunks; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored, table

CHUNK, RANGE = 256, 4096
#: Stands for a null pair_id while rows are joined.
NONE = -(1 << 63)
HEAD, TAIL = ("<|", "|>\n"), "\n<|end|>\n"


def numbered(turns: DataFrame, keys: list[str]) -> DataFrame:
    """Each row's place (from 0) among the rows of its keys, by turn, role and text."""
    rows = turns.withColumn("range", F.coalesce(F.floor(F.col("turn") / RANGE), F.lit(NONE)))
    counts = rows.groupBy(*keys, "range").agg(F.count(F.lit(1)).alias("n"))
    base = counts.select(*keys, "range", (F.sum("n").over(Window.partitionBy(*keys).orderBy("range")) - F.col("n")).alias("base"))
    inside = F.row_number().over(Window.partitionBy(*keys, "range").orderBy("turn", "role", "text"))
    return rows.withColumn("inside", inside).join(base, [*keys, "range"]).withColumn("pos", F.col("base") + F.col("inside") - 1).drop("range", "inside", "base")


def _joined(part: str, what: str) -> Column:
    """The parts of one kind of a chunk, in order."""
    own = F.filter("turns", lambda t: (t["part"] == part) & t[what].isNotNull())
    return F.array_join(F.transform(F.array_sort(own), lambda t: t[what]), "" if what == "rendered" else ",")


def preferences(turns: DataFrame) -> DataFrame:
    """From pair_id, side (chosen or rejected), turn, role, text: for each pair and chunk the prompt and both completions with their masks (start-end in characters of the row's completion)."""
    rows = turns.select(F.coalesce(F.col("pair_id").cast("long"), F.lit(NONE)).alias("pair_id"), "side", F.col("turn").cast("long"), F.coalesce("role", F.lit("user")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = stored(numbered(stored(rows, "turns"), ["pair_id", "side"]), "numbered-turns")  # each is read more than once
    chosen, rejected = (rows.where(F.col("side") == s) for s in ("chosen", "rejected"))
    other = rejected.select("pair_id", "pos", F.col("role").alias("role2"), F.col("text").alias("text2"))
    same = (F.col("role") == F.col("role2")) & (F.col("text") == F.col("text2"))
    met = chosen.join(other, ["pair_id", "pos"], "left")
    shared = met.groupBy("pair_id").agg(F.coalesce(F.min(F.when(~F.coalesce(same, F.lit(False)), F.col("pos"))), F.count(F.lit(1))).alias("shared"))
    rows = rows.join(shared, "pair_id", "left").withColumn("shared", F.coalesce("shared", F.lit(0)))
    rows = rows.where((F.col("side") == "chosen") | (F.col("pos") >= F.col("shared")))
    rows = rows.withColumn("part", F.when(F.col("pos") < F.col("shared"), "prompt").otherwise(F.col("side")))
    rows = rows.withColumn("nth", F.when(F.col("part") == "prompt", F.col("pos")).otherwise(F.col("pos") - F.col("shared"))).withColumn("chunk", F.floor(F.col("nth") / CHUNK))
    head = F.concat(F.lit(HEAD[0]), "role", F.lit(HEAD[1]))
    rows = rows.withColumn("rendered", F.concat(head, "text", F.lit(TAIL)))
    before = F.sum(F.length("rendered")).over(Window.partitionBy("pair_id", "part", "chunk").orderBy("nth")) - F.length("rendered") + F.length(head)
    span = F.when((F.col("part") != "prompt") & (F.col("role") == "assistant"), F.concat_ws("-", before, before + F.length("text")))
    rows = rows.withColumn("span", span)
    out = rows.groupBy("pair_id", "chunk").agg(F.max("shared").alias("shared_turns"), F.collect_list(F.struct("part", "nth", "rendered", "span")).alias("turns"))
    cols = {"prompt": ("prompt", "rendered"), "chosen": ("chosen", "rendered"), "chosen_mask": ("chosen", "span"), "rejected": ("rejected", "rendered"), "rejected_mask": ("rejected", "span")}
    return out.select(F.nullif("pair_id", F.lit(NONE)).alias("pair_id"), "chunk", "shared_turns", *(_joined(*v).alias(k) for k, v in cols.items()))


def demo_pairs(conversations: DataFrame) -> DataFrame:
    """A pair for each conversation: it is chosen; in the rejected one its last assistant turn, and what follows, gives way to the last reply of the neighbour (conv_id with its lowest bit turned).

    A conversation without assistant turn is paired with itself; a missing neighbour replies nothing.
    """
    rows = conversations.select(F.coalesce(F.col("conv_id").cast("long"), F.lit(NONE)).alias("pair_id"), F.col("turn").cast("long"), "role", "text")
    last = rows.where("role = 'assistant'").groupBy("pair_id").agg(F.max(F.struct("turn", "text")).alias("last"))
    reply = last.select(F.col("pair_id").bitwiseXOR(F.lit(1).cast("long")).alias("pair_id"), F.col("last.text").alias("reply"))
    ends = last.select("pair_id", F.col("last.turn").alias("end")).join(reply, "pair_id", "left")
    cut = rows.join(ends.select("pair_id", "end"), "pair_id", "left").where("end IS NULL OR turn < end").select("pair_id", F.lit("rejected").alias("side"), "turn", "role", "text")
    tail = ends.select("pair_id", F.lit("rejected").alias("side"), F.col("end").alias("turn"), F.lit("assistant").alias("role"), F.coalesce("reply", F.lit("")).alias("text"))
    out = rows.select("pair_id", F.lit("chosen").alias("side"), "turn", "role", "text").unionByName(cut).unionByName(tail)
    return out.withColumn("pair_id", F.nullif("pair_id", F.lit(NONE)))


def op9_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preferences(demo_pairs(table(spark, sf_dir, "conversations")))


ORACLE = r"""
WITH last AS (SELECT conv_id, max(turn) AS e FROM conversations WHERE role = 'assistant' GROUP BY 1),
reply AS (SELECT xor(c.conv_id, 1) AS conv_id, max(c.text) AS text FROM conversations c JOIN last l ON c.conv_id = l.conv_id AND c.turn = l.e WHERE c.role = 'assistant' GROUP BY 1),
sides AS (
  SELECT conv_id AS pair_id, 'chosen' AS side, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT c.conv_id, 'rejected', c.turn, c.role, coalesce(c.text, '') FROM conversations c LEFT JOIN last l ON c.conv_id = l.conv_id WHERE l.e IS NULL OR c.turn < l.e
  UNION ALL SELECT l.conv_id, 'rejected', l.e, 'assistant', coalesce(r.text, '') FROM last l LEFT JOIN reply r ON l.conv_id = r.conv_id),
placed AS (SELECT *, row_number() OVER (PARTITION BY pair_id, side ORDER BY turn, role, text) - 1 AS pos FROM sides),
shared AS (
  SELECT c.pair_id, coalesce(min(CASE WHEN r.pos IS NULL OR r.role <> c.role OR r.text <> c.text THEN c.pos END), count(*)) AS shared
  FROM placed c LEFT JOIN placed r ON r.side = 'rejected' AND r.pair_id = c.pair_id AND r.pos = c.pos WHERE c.side = 'chosen' GROUP BY 1),
parts AS (
  SELECT p.*, s.shared, CASE WHEN pos < s.shared THEN 'prompt' ELSE side END AS part, '<|' || role || '|>' || chr(10) AS head
  FROM placed p JOIN shared s ON p.pair_id = s.pair_id WHERE side = 'chosen' OR pos >= s.shared),
shown AS (SELECT *, CASE WHEN part = 'prompt' THEN pos ELSE pos - shared END AS nth, head || text || chr(10) || '<|end|>' || chr(10) AS rendered FROM parts),
marked AS (
  SELECT *, sum(length(rendered)) OVER (PARTITION BY pair_id, part, nth // 256 ORDER BY nth) - length(rendered) + length(head) AS begins FROM shown)
SELECT pair_id, (nth // 256)::BIGINT AS chunk, max(shared)::BIGINT AS shared_turns,
  coalesce(string_agg(rendered, '' ORDER BY nth) FILTER (part = 'prompt'), '') AS prompt,
  coalesce(string_agg(rendered, '' ORDER BY nth) FILTER (part = 'chosen'), '') AS chosen,
  coalesce(string_agg(begins::BIGINT || '-' || (begins + length(text))::BIGINT, ',' ORDER BY nth) FILTER (part = 'chosen' AND role = 'assistant'), '') AS chosen_mask,
  coalesce(string_agg(rendered, '' ORDER BY nth) FILTER (part = 'rejected'), '') AS rejected,
  coalesce(string_agg(begins::BIGINT || '-' || (begins + length(text))::BIGINT, ',' ORDER BY nth) FILTER (part = 'rejected' AND role = 'assistant'), '') AS rejected_mask
FROM marked GROUP BY 1, 2
"""
