"""The prefix trie against a dictionary of prefixes, over several blocks, short segments and short lists."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tallyweave.llm import trie

TURNS = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


@pytest.fixture
def blocks(spark):
    """Every exchange keeps its partitions, so that a few rows fill several blocks."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "6")
    yield
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def plain(convs):
    """The nodes of {conv_id: [(role, text)]}."""
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    kids, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for node in members:
        if node:
            kids[node[:-1]] += 1
    for node, own in members.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        for d in range(len(node) + 1):
            saved[node[:d]] += (len(own) - 1) * words
            leaves[node[:d]] += not kids[node]
    ends = lambda node: hashlib.sha256(",".join(str(c) for c in sorted(members[node]) if len(convs[c]) == len(node)).encode()).hexdigest()
    return sorted((min(own), len(n), min(members[n[:-1]]) if n else -1, len(own), kids[n], leaves[n], saved[n], ends(n)) for n, own in members.items())


def found(df):
    return sorted(tuple(-1 if v is None else v for v in r) for r in df.select(*COLUMNS).collect())


def rows_of(convs):
    return [(c, i, *t) for c, turns in convs.items() for i, t in enumerate(turns)]


def some(seed, n, longest):
    rng = random.Random(seed)
    out = {}
    for c in rng.sample(range(1000), n):
        out[c] = [(rng.choice("ua"), " ".join(["w"] * rng.choice([0, 1, 1, 3]))) for _ in range(rng.randint(0, longest))]
        if rng.random() < 0.5 and len(out) > 1:  # some go on where others are, or repeat them
            old = out[rng.choice(list(out))]
            out[c] = old[: rng.randint(0, len(old))] + (out[c][:2] if rng.random() < 0.6 else [])
        if rng.random() < 0.25:
            out[c] = [("u", "hot"), ("a", "hot hot"), ("u", "end")]
    return out


@pytest.mark.parametrize(("seed", "n", "longest", "length", "chunk"), [(1, 90, 6, 1024, 4096), (2, 120, 9, 2, 3), (3, 60, 12, 3, 1), (4, 150, 4, 1, 5)])
def test_trie_is_that_of_all_prefixes(spark, blocks, seed, n, longest, length, chunk):
    convs = some(seed, n, longest)
    turns = trie.placed_turns(spark.createDataFrame(rows_of(convs), TURNS).repartition(5))
    ids = spark.createDataFrame([(c,) for c in convs], "conv_id long")
    assert found(trie.nodes(turns, ids, length, chunk)) == plain(convs)


def test_one_conversation_holds_most_turns(spark, blocks):
    convs = {1: [("u", f"t{i} x") for i in range(700)], 2: [("u", f"t{i} x") for i in range(650)] + [("a", "other")], 3: [("u", "t0 x")], 4: []}
    turns = trie.placed_turns(spark.createDataFrame(rows_of(convs), TURNS))
    ids = spark.createDataFrame([(c,) for c in convs], "conv_id long")
    assert found(trie.nodes(turns, ids, 64)) == plain(convs)


def test_defined_cases(spark):
    """Nulls, repeated turns, null first, null conversations, clashing columns."""
    rows = [(1, 0, None, None), (1, 0, None, None), (1, 5, "u", "long " * 5000), (2, None, "", ""), (2, 1, "", ""), (None, 0, "u", "lost"), (3, 2, "u", "b"), (3, None, "u", "a")]
    df = spark.createDataFrame(rows, TURNS).withColumn("part", F.lit("x")).withColumn("pos", F.lit(1)).withColumn("key", F.lit(None).cast("string"))
    long = ("u", "long " * 5000)
    assert found(trie.prefix_trie(df)) == plain({1: [("", ""), ("", ""), long], 2: [("", ""), ("", "")], 3: [("u", "a"), ("u", "b")]})
    assert trie.prefix_trie(df.limit(0)).count() == 0


def test_rebuilt_conversations(spark, sf):
    """Conversations begin with turns of their group's first one; the query is that rule's trie."""
    table = spark.read.parquet(f"{sf}/conversations.parquet").toPandas().sort_values(["conv_id", "turn"])
    own = {c: list(zip(g["role"], g["text"], strict=True)) for c, g in table.groupby("conv_id")}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = own.get(c - c % 20, [])[:h] + turns[h:]
    assert found(trie.op12_prefix_trie(spark, sf)) == plain(built)


def test_absent_first_conversations_and_turnless_ones(spark):
    own = {21: [("u", "a")], 22: [("u", "a"), ("a", "b"), ("u", "c"), ("a", "d")], 40: [("u", "x")], 41: [("u", "p"), ("a", "q"), ("u", "r"), ("u", "s")], 43: [], 44: [("u", "p")]}
    turns = trie.placed_turns(spark.createDataFrame(rows_of(own), TURNS))
    ids = spark.createDataFrame([(c,) for c in own], "conv_id long")
    built = {c: own.get(c - c % 20, [])[: (h := zlib.crc32(str(c).encode()) % 4)] + t[h:] for c, t in own.items()}
    assert found(trie.nodes(trie.rebuilt(turns, ids), ids)) == plain(built)
