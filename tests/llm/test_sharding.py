"""Shards by longest processing time against a heap over all groups."""

import heapq
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tallyweave.llm import sharding

DOCS = "doc_id long, text string"


@pytest.mark.parametrize("seed", range(20))
def test_equal_groups_are_poured_as_by_a_heap(seed):
    rng = random.Random(seed)
    loads, size, n = [rng.randint(0, 50) * rng.randint(0, 3) for _ in range(rng.randint(1, 9))], rng.randint(1, 30), rng.randint(0, 60)
    heap = [(load, i) for i, load in enumerate(loads)]
    heapq.heapify(heap)
    for _ in range(n):
        load, i = heap[0]
        heapq.heapreplace(heap, (load + size, i))
    assert sharding.poured(loads, size, n) == [load for load, _ in sorted(heap, key=lambda x: x[1])]


def plain(rows, shards):
    """(doc_id, text) -> sorted (doc_id, text, shard, slot)."""
    groups = defaultdict(list)
    for i, text in rows:
        groups[text].append(i)
    size = lambda t: len((t or "").encode()) + 1
    order = sorted(groups, key=lambda t: (-size(t) * len(groups[t]), min((i is not None, i or 0) for i in groups[t])))
    heap, home = [(0, s) for s in range(shards)], {}
    for t in order:
        load, home[t] = heap[0]
        heapq.heapreplace(heap, (load + size(t) * len(groups[t]), home[t]))
    out, next_slot = [], defaultdict(int)
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, size(r[1]))):
        out.append((i, t, home[t], next_slot[home[t]]))
        next_slot[home[t]] += 1
    return sorted(out, key=str)


@pytest.fixture
def ranges(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


@pytest.mark.parametrize(("seed", "shards"), [(1, 16), (2, 3)])
def test_shards_are_those_of_a_heap(spark, ranges, seed, shards):
    """Many groups of equal size, one that holds a third of all rows, a very long text."""
    rng = random.Random(seed)
    rows = [(i, rng.choice(["hot text", *[f"t{rng.randint(0, 400):03d}"] * 2, "ü" * rng.randint(1, 40)])) for i in range(900)] + [(5000, "long " * 4000)]
    got = sharding.sharded(spark.createDataFrame(rows, DOCS), shards).collect()
    assert sorted(((r["doc_id"], r["text"], r["shard"], r["slot"]) for r in got), key=str) == plain(rows, shards)


def test_defined_cases(spark):
    """Nulls, empty texts, repeated rows, columns of the same names, an empty table."""
    rows = [(1, None), (2, None), (3, ""), (4, ""), (7, "b"), (7, "b"), (7, "b"), (None, "c c"), (8, "x" * 50_000)]
    df = spark.createDataFrame(rows, DOCS).withColumn("shard", F.lit("own")).withColumn("slot", F.lit(None).cast("int")).withColumn("shard_id", F.lit(9)).withColumn("shard_rows", F.lit(9))
    got = sharding.sharded(df, 4)
    assert got.columns == ["doc_id", "text", "shard_id", "shard_rows", "shard", "slot"]
    assert sorted(((r["doc_id"], r["text"], r["shard"], r["slot"]) for r in got.collect()), key=str) == plain(rows, 4)
    assert sharding.sharded(df.limit(0), 4).count() == 0


def test_files_hold_what_the_query_returns(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    sharding.write_shards(docs, str(tmp_path / "out"))
    assert {p.name for p in (tmp_path / "out").glob("shard=*")} == {f"shard={i}" for i in range(16)}
    rows = sorted((r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect())
    want = [(i, len(t.encode()) + 1, zlib.crc32(t.encode()), "bytes", s, slot, None) for i, t, s, slot in plain(rows, 16)]
    assert sorted(tuple(r) for r in sharding.op11_sharding(spark, sf).collect()) == sorted(want)
    read = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted((r["doc_id"], r["shard"], r["slot"], r["lang"]) for r in read) == sorted((w[0], w[4], w[5], d) for w, d in zip(sorted(want), [r["lang"] for r in docs.orderBy("doc_id").collect()], strict=True))
    loads = defaultdict(int)
    for w in want:
        loads[w[4]] += w[1]
    assert max(loads.values()) - min(loads.values()) <= max(w[1] for w in want)
