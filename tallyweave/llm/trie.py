"""The trie of conversations' prefixes, from the sorted conversations and the lengths of their common prefixes.

Conversations are sorted by their turns; a node of the trie is an interval of them. Blocks are the ranges of the sort. Each
row's longest common prefix (LCP) with the row before it is known once the blocks' edges are met. Within a block a stack
gives all nearest smaller values: it holds the nodes of the Cartesian tree over the LCPs on the way to the current row,
nodes of equal LCP being one, and a row whose LCP is smaller closes those above. Depths between a node and its parent have
the same interval and are written out. Only nodes on the first and the last row's way can reach beyond a block; there are as
many as the LCP at its edge, which is the least there. Their pieces meet by depth in block order, a window over pieces.

What a node adds up over its subtree comes from its interval alone: with W(c) the words of conversation c and N(i) the words
of the turns that row i doesn't share with the row before, saved = sum W(c) - sum N(i) - the words that both sums hold above.

Long conversations are cut into segments of SEGMENT turns. Those with equal turns before them form a trie of their own, whose
root is the node where the segments before end; it is linked to its parent by a hash of the turns before. So no row holds
more than SEGMENT turns; a conversation's segments are added up in one window. Turns are compared by 128-bit hashes of role and
text. The list of a node's own conversations is hashed as a stream of chunks, which is serial by definition.

Defined cases: a null role or text is empty; turns go by number, null first, and turns of equal number by their hash, so that
repeated rows are turns of their own; rows of null conv_id belong to no conversation and are left out; a very long text is one
hash and a count; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, placed, stored, table
from .sharding import _CRC, _TABLE

SEGMENT, CHUNK, BATCH = 1024, 4096, 20_000
#: Bytes of a turn's hash in a sort key.
WIDTH = 16
#: Stands behind the last row of a block.
END = 1 << 40

PIECES = "part int, lb long, d int, plb long, seg long, pid string, follows string, n long, conv long, parent_conv long, total long, fresh long, base long, above long, leaves long, kids long, ids string, chunk int, open_left boolean, open_right boolean, single boolean"


def placed_turns(turns: DataFrame) -> DataFrame:
    """conv_id, pos (from 0), digest (of role and text), words; from conv_id, turn, role, text."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    rows = turns.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), digest.alias("digest"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"))
    return placed(rows.withColumn("nth", F.monotonically_increasing_id()), ["conv_id"], ["turn", "digest", "nth"], "pos").select("conv_id", "pos", "digest", "words")


def segments(turns: DataFrame, conversations: DataFrame, length: int) -> DataFrame:
    """One row a segment: conv_id, seg, pid (hash of the turns before), key, len, last, total, path, follows (pid of the next one).

    path holds the words up to each depth, from the turn before the segment on. A conversation whose turns fill its segments
    has an empty one at the end.
    """
    parts = turns.groupBy("conv_id", F.floor(F.col("pos") / length).alias("seg")).agg(F.sort_array(F.collect_list(F.struct("pos", "digest", "words"))).alias("turns"))
    parts = parts.select("conv_id", "seg", F.unhex(F.array_join("turns.digest", "")).alias("key"), F.col("turns.words").alias("words"))
    sizes = parts.groupBy("conv_id").agg(F.sum(F.size("words")).alias("n"))
    ends = conversations.select("conv_id").join(sizes, "conv_id", "left").withColumn("n", F.coalesce("n", F.lit(0))).where(F.col("n") % length == 0)
    empty = ends.select("conv_id", F.floor(F.col("n") / length).alias("seg"), F.lit(b"").alias("key"), F.array().cast("array<long>").alias("words"))
    rows = parts.unionByName(empty).withColumn("len", F.size("words")).withColumn("sum", F.aggregate("words", F.lit(0).cast("long"), lambda a, w: a + w))
    full = F.col("len") == length
    mark = F.when(full, F.md5(F.concat(F.col("seg").cast("string").cast("binary"), "key")))
    for i in range(4):
        rows = rows.withColumn(f"lane{i}", F.coalesce(F.conv(F.substring(mark, 8 * i + 1, 8), 16, 10).cast("long"), F.lit(0)))
    whole = Window.partitionBy("conv_id").orderBy("seg")
    upto = lambda c: F.sum(c).over(whole.rowsBetween(Window.unboundedPreceding, 0))
    lanes, own = [upto(f"lane{i}") for i in range(4)], [F.col(f"lane{i}") for i in range(4)]
    before = upto("sum") - F.col("sum")
    last_words = F.coalesce(F.lag(F.element_at(F.when(full, F.col("words")), -1)).over(whole), F.lit(0))
    rows = rows.select(
        "conv_id", "seg", F.when(F.col("seg") > 0, F.concat_ws(".", *(a - b for a, b in zip(lanes, own, strict=True)))).otherwise("").alias("pid"), "key", "len", (~full).alias("last"), F.sum("sum").over(Window.partitionBy("conv_id")).alias("total"),
        F.when(full, F.concat_ws(".", *lanes)).alias("follows"), before.alias("before"), last_words.alias("last_words"), "words",
    )
    path = F.aggregate("words", F.array(F.col("before") - F.col("last_words"), F.col("before")), lambda a, w: F.concat(a, F.array(F.element_at(a, -1) + w)))
    return rows.withColumn("path", path).drop("before", "last_words", "words")


def common_prefixes(rows: DataFrame) -> DataFrame:
    """The sorted segments with part, pos, lcp (with the row before; -1 where another trie begins) and nxt (that of the row after)."""
    order = ["seg", "pid", "key", "conv_id"]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()).withColumn("pos", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    rows = stored(rows, "trie-sorted")
    what = F.struct("seg", "pid", "key")
    blocks = rows.groupBy("part").agg(F.min_by(what, "pos").alias("first"), F.max_by(what, "pos").alias("final"))
    turn = Window.orderBy("part")  # one row a block
    blocks = stored(blocks.select("part", F.lag("final").over(turn).alias("left"), F.lead("first").over(turn).alias("right")), "trie-edges", compact=True)
    edge = lambda c, at: blocks.where(f"{c} IS NOT NULL").select("part", F.lit(at).cast("long").alias("pos"), f"{c}.*")
    both = rows.unionByName(edge("left", -1).unionByName(edge("right", END)), allowMissingColumns=True)
    both = both.repartition("part").sortWithinPartitions("part", "pos")
    carried = ["part", "pos", "seg", "pid", "conv_id", "len", "last", "total", "path", "follows"]
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}

    def shared(a: tuple | None, b: tuple) -> int:
        if a is None or a[:2] != b[:2]:
            return -1
        return len(os.path.commonprefix([a[2], b[2]])) // WIDTH

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before, held, schema = None, None, None, None
        for batch in batches:
            schema = schema or pa.schema([*(batch.schema.field(c) for c in carried), pa.field("lcp", pa.int32()), pa.field("nxt", pa.int32())])
            out = []
            for row in batch.to_pylist():
                now = (row["seg"], row["pid"], row["key"])
                if row["part"] != part:
                    if held:
                        out.append(held | {"nxt": -1})
                    part, before, held = row["part"], None, None
                lcp = shared(before, now)
                if held:
                    out.append(held | {"nxt": lcp})
                before, held = now, None if row["conv_id"] is None else {c: row[c] for c in carried} | {"lcp": lcp}
            yield pa.RecordBatch.from_pylist(out, schema)
        if held:
            yield pa.RecordBatch.from_pylist([held | {"nxt": -1}], schema)

    return both.mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in carried) + ", lcp int, nxt int")


@dataclass
class Open:
    """A node of the Cartesian tree that the current row is in, with all depths below its parent's."""

    depth: int
    lb: int
    path: list[int]
    base: int
    follows: str | None
    n: int = 0
    conv: int = 1 << 62
    total: int = 0
    fresh: int = 0
    leaves: int = 0
    kids: int = 0
    ends: list[int] = field(default_factory=list)
    chunks: int = 0

    def add(self, n: int, conv: int, total: int, fresh: int, leaves: int) -> None:
        self.n, self.conv, self.total, self.fresh, self.leaves = self.n + n, min(self.conv, conv), self.total + total, self.fresh + fresh, self.leaves + leaves


class Block:
    """One block: rows go in in order, pieces of nodes come out."""

    def __init__(self, part: int, length: int, chunk: int) -> None:
        self.part, self.length, self.chunk = part, length, chunk
        self.stack, self.out = [Open(-1, -1, [], 0, None)], []
        self.seg, self.pid, self.rows = 0, "", 0

    def piece(self, e: Open, d: int, plb: int, open_right: bool, parent: int | None, part_of_list: bool = False) -> None:
        left, top = e.lb < 0, d == e.depth
        single = not (left or open_right or part_of_list or top and e.chunks)
        counts = (0, None, None, 0, 0, 0, 0, 0, 0) if part_of_list else (e.n, e.conv, parent, e.total, e.fresh, 0 if left else e.base, e.path[d], e.leaves, e.kids if top else int(not left))
        ids, chunk = (",".join(map(str, e.ends)), e.chunks) if top else ("", 0)
        self.out.append((self.part, e.lb, d, plb, self.seg, self.pid if d == 0 else None, e.follows if top else None, *counts, ids, chunk, left, open_right, single))

    def close(self, upto: int, open_right: bool = False) -> None:
        """Close what is deeper than upto."""
        while self.stack[-1].depth > upto:
            e, below = self.stack.pop(), self.stack[-1]
            cut = max(upto, below.depth)
            for d in range(e.depth, cut, -1):
                whole = not open_right and e.lb >= 0 and not (d == e.depth and e.chunks)
                self.piece(e, d, e.lb if d - 1 > below.depth else below.lb, open_right, e.conv if whole and d - 1 > cut else None)
            if cut > below.depth:
                self.stack.append(Open(cut, e.lb, e.path, e.base, None, e.n, e.conv, e.total, e.fresh, e.leaves, int(e.lb >= 0)))
            else:
                below.add(e.n, e.conv, e.total, e.fresh, e.leaves)

    def put(self, row: dict) -> None:
        lcp, size, path = row["lcp"], row["len"], row["path"]
        if not self.rows and lcp >= 0:
            self.stack.append(Open(lcp, -1, path, 0, row["follows"] if lcp == self.length else None))
        self.close(lcp)
        self.seg, self.pid, self.rows = row["seg"], row["pid"], self.rows + 1
        if size > lcp:
            self.stack[-1].kids += 1
            self.stack.append(Open(size, row["pos"], path, path[max(lcp, 0) + 1], row["follows"]))
        e = self.stack[-1]
        e.add(1, row["conv_id"], row["total"], path[-1] - path[max(lcp, 0) + 1] + row["later_fresh"], row["leaf"])
        if row["last"]:
            if len(e.ends) == self.chunk:
                self.piece(e, e.depth, -2, False, None, part_of_list=True)
                e.ends, e.chunks = [], e.chunks + 1
            e.ends.append(row["conv_id"])

    def end(self, nxt: int) -> None:
        self.close(nxt)
        self.close(-1, open_right=True)


def pieces(rows: DataFrame, length: int, chunk: int) -> DataFrame:
    """The nodes' pieces, block by block."""
    rows = rows.repartition("part").sortWithinPartitions("part", "pos")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [("part", pa.int32()), ("lb", pa.int64()), ("d", pa.int32()), ("plb", pa.int64()), ("seg", pa.int64()), ("pid", pa.string()), ("follows", pa.string()), *((c, pa.int64()) for c in ("n", "conv", "parent_conv", "total", "fresh", "base", "above", "leaves", "kids")), ("ids", pa.string()), ("chunk", pa.int32()), *((c, pa.bool_()) for c in ("open_left", "open_right", "single"))]

        def flush(out: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(zip(*out, strict=True), kinds, strict=True)], [n for n, _ in kinds])

        block, nxt = None, -1
        for batch in batches:
            for row in batch.to_pylist():
                if block is None or row["part"] != block.part:
                    if block:
                        block.end(nxt)
                        yield flush(block.out)
                    block = Block(row["part"], length, chunk)
                block.put(row)
                nxt = row["nxt"]
                if len(block.out) >= BATCH:
                    yield flush(block.out)
                    block.out = []
        if block:
            block.end(nxt)
            yield flush(block.out)

    return rows.mapInArrow(run, PIECES)


def hashed_lists(parts: DataFrame, key: list[str]) -> DataFrame:
    """key and ends_sha256: the hash of the joined lists of a key's pieces, in order. A key's lists go through one task as a stream."""
    rows = parts.where("ids <> ''").select(*key, "part", "chunk", "ids").repartition(*key).sortWithinPartitions(*key, "part", "chunk")
    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in key)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, h = None, None
        for b in batches:
            done = []
            for *k, ids in zip(*(b[c].tolist() for c in [*key, "ids"]), strict=True):
                if k != current:
                    if h:
                        done.append((*current, h.hexdigest()))
                    current, h = k, hashlib.sha256()
                else:
                    h.update(b",")
                h.update(ids.encode())
            yield pd.DataFrame(done, columns=[*key, "ends_sha256"])
        if h:
            yield pd.DataFrame([(*current, h.hexdigest())], columns=[*key, "ends_sha256"])

    return rows.mapInPandas(run, f"{kinds}, ends_sha256 string")


def nodes(turns: DataFrame, conversations: DataFrame, length: int = SEGMENT, chunk: int = CHUNK) -> DataFrame:
    """The trie's nodes, from placed turns (conv_id, pos, digest, words) and all conversations (conv_id, one row each)."""
    rows = stored(common_prefixes(segments(turns, conversations, length)), "trie-rows")
    rows = rows.withColumn("leaf", (F.col("last") & (F.col("nxt") < F.col("len"))).cast("int"))
    fresh = F.element_at("path", -1) - F.get("path", F.greatest("lcp", F.lit(0)) + 1)
    later = Window.partitionBy("conv_id").orderBy(F.desc("seg")).rowsBetween(Window.unboundedPreceding, -1)
    many = ~F.col("last") | (F.col("seg") > 0)
    one = rows.where(~many).withColumn("later_fresh", F.lit(0).cast("long"))
    more = rows.where(many).withColumn("later_fresh", F.coalesce(F.sum(fresh).over(later), F.lit(0))).withColumn("leaf", F.max("leaf").over(Window.partitionBy("conv_id")))
    found = stored(pieces(one.unionByName(more), length, chunk), "trie-pieces")

    key = ["part", "lb", "d"]
    inside = found.where(f"d < {length}")
    alone = inside.where("single").withColumn("ends_sha256", F.sha2(F.col("ids").cast("binary"), 256))
    # Pieces of a node in several blocks, or with a long list: each goes with the last one at its depth that begins.
    begun = F.last(F.when(~F.col("open_left"), F.struct("part", "lb")), ignorenulls=True).over(Window.partitionBy("d").orderBy("part", "lb", "chunk").rowsBetween(Window.unboundedPreceding, 0))
    split = stored(inside.where("NOT single").withColumn("home", begun).select("*", F.col("home.part").alias("hpart"), F.col("home.lb").alias("hlb")).drop("home"), "trie-split", compact=True)
    home = ["hpart", "hlb", "d"]
    sums = [F.sum(c).alias(c) for c in ("n", "total", "fresh", "base", "leaves", "kids")]
    begins = F.when(~F.col("open_left"), F.col("plb"))
    joined = split.groupBy(*home).agg(*sums, F.min("conv").alias("conv"), F.max("above").alias("above"), F.max("seg").alias("seg"), F.max("pid").alias("pid"), F.max(begins).alias("plb"))
    lists = hashed_lists(split, home)
    joined = stored(joined.join(lists, home, "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest()))), "trie-joined", compact=True)

    cols = ["seg", "pid", "plb", "n", "conv", "total", "fresh", "base", "above", "leaves", "kids", "ends_sha256"]
    every = alone.select(*key, *cols, "parent_conv").unionByName(joined.select(F.col("hpart").alias("part"), F.col("hlb").alias("lb"), "d", *cols, F.lit(None).cast("long").alias("parent_conv")))
    # The parents: by block, first row and depth; a later trie's root by the hash of the turns before it.
    convs = alone.select(*key, "conv").unionByName(split.select(*key, *home[:2]).distinct().join(joined.select(*home, "conv"), home).select(*key, "conv"))
    convs = convs.select(F.col("part").alias("up_part"), F.col("lb").alias("up_lb"), F.col("d").alias("up_d"), F.col("conv").alias("up_conv"))
    links = found.where(f"d = {length} AND NOT open_left").select(F.col("follows").alias("pid"), (F.col("seg") + 1).alias("seg"), F.col("part").alias("up_part"), F.col("plb").alias("up_lb"), F.lit(length - 1).alias("up_d"))
    known = every.where("parent_conv IS NOT NULL OR d = 0 AND seg = 0")
    below = every.where("parent_conv IS NULL AND d > 0").select("*", F.col("part").alias("up_part"), F.col("plb").alias("up_lb"), (F.col("d") - 1).alias("up_d"))
    roots = every.where("d = 0 AND seg > 0").join(links, ["seg", "pid"])
    sought = below.unionByName(roots.select(below.columns)).join(convs, ["up_part", "up_lb", "up_d"], "left").withColumn("parent_conv", F.col("up_conv"))
    out = known.unionByName(sought.select(known.columns))
    saved = F.col("total") - F.col("fresh") - F.col("base") - (F.col("n") - 1) * F.col("above")
    return out.select(
        F.col("conv").alias("conv_id"), (F.col("seg") * length + F.col("d")).alias("depth"), F.col("parent_conv").alias("parent_conv_id"), F.col("n").alias("n_convs"), F.col("kids").alias("n_children"), F.col("leaves").alias("n_leaves"),
        saved.alias("saved_tokens"), "ends_sha256",
    )


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """The trie of conversations given as conv_id, turn, role, text: one row a node."""
    return nodes(placed_turns(conversations), conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long")).distinct())


GROUP, HEADS = 20, 4


def rebuilt(turns: DataFrame, conversations: DataFrame) -> DataFrame:
    """Placed turns of conversations that begin with the first turns of their group's first conversation, so that prefixes are shared."""
    takes = F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS
    ids = conversations.select("conv_id", takes.alias("h"), (F.col("conv_id") - F.col("conv_id") % GROUP).alias("first"))
    heads = turns.where((F.col("conv_id") % GROUP == 0) & (F.col("pos") < HEADS - 1)).select(F.col("conv_id").alias("first"), "pos", "digest", "words")
    given = ids.join(heads, "first").where("pos < h").select("conv_id", "pos", "digest", "words")
    given = stored(given, "trie-heads", compact=True)
    lack = ids.join(given.groupBy("conv_id").agg(F.count(F.lit(1)).alias("got")), "conv_id", "left").select("conv_id", (F.col("h") - F.coalesce("got", F.lit(0))).alias("lack")).where("lack > 0")
    own = turns.where(F.col("pos") >= takes).join(stored(lack, "trie-lack", compact=True), "conv_id", "left")
    return own.select("conv_id", (F.col("pos") - F.coalesce("lack", F.lit(0))).alias("pos"), "digest", "words").unionByName(given)


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = stored(placed_turns(table(spark, sf_dir, "conversations")), "trie-turns", compact=True)
    ids = turns.select("conv_id").distinct()
    return nodes(rebuilt(turns, ids), ids)


_DIGITS = "list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)"
ORACLE = rf"""
WITH {_TABLE},
placed AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) - 1 AS pos FROM conversations WHERE conv_id IS NOT NULL),
turns AS (SELECT conv_id, pos, md5(length(role) || ':' || role || text) AS k, len(regexp_extract_all(text, '{WORD}')) AS w FROM placed),
ids AS (SELECT conv_id, conv_id - conv_id % {GROUP} AS first, {_CRC.format(bytes=_DIGITS)} % {HEADS} AS h FROM (SELECT DISTINCT conv_id FROM turns), crc),
built AS (
  SELECT i.conv_id, 0 AS own, t.pos, t.k, t.w FROM ids i JOIN turns t ON t.conv_id = i.first AND t.pos < i.h
  UNION ALL SELECT i.conv_id, 1, t.pos, t.k, t.w FROM ids i JOIN turns t ON t.conv_id = i.conv_id AND t.pos >= i.h),
lists AS (SELECT conv_id, list(k ORDER BY own, pos) AS ks, list(w ORDER BY own, pos) AS ws FROM built GROUP BY 1),
whole AS (SELECT i.conv_id, coalesce(ks, []) AS ks, coalesce(ws, []) AS ws FROM ids i LEFT JOIN lists l ON i.conv_id = l.conv_id),
paths AS MATERIALIZED (SELECT conv_id, len(ks) AS n, d, md5(array_to_string(ks[:d], '')) AS node, CASE WHEN d > 0 THEN md5(array_to_string(ks[:d - 1], '')) END AS up, coalesce(ws[d], 0) AS w FROM (SELECT *, unnest(range(len(ks) + 1)) AS d FROM whole)),
nodes AS MATERIALIZED (
  SELECT d, node, any_value(up) AS up, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(w) AS saved, bool_and(n = d) AS leaf, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (n = d), '')) AS ends_sha256
  FROM paths GROUP BY 1, 2),
below AS (SELECT p.d, p.node, sum(n.saved)::BIGINT AS saved_tokens, count(*) FILTER (n.leaf) AS n_leaves FROM nodes n JOIN paths p ON p.conv_id = n.conv_id AND p.d <= n.d GROUP BY 1, 2),
kids AS (SELECT d - 1 AS d, up AS node, count(*) AS n FROM nodes WHERE d > 0 GROUP BY 1, 2)
SELECT n.conv_id, n.d::BIGINT AS depth, u.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n, 0) AS n_children, b.n_leaves, b.saved_tokens, n.ends_sha256
FROM nodes n JOIN below b ON n.d = b.d AND n.node = b.node LEFT JOIN kids k ON n.d = k.d AND n.node = k.node LEFT JOIN nodes u ON u.d = n.d - 1 AND u.node = n.up
"""
