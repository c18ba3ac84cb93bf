"""Codes of vectors against a search through all entries in plain whole numbers."""

import hashlib
import math
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyweave.llm import vectorcodes

VECTORS = "vec_id long, embedding array<float>, label int"


@pytest.mark.parametrize("seed", range(6))
@pytest.mark.parametrize("spread", [2, 30, 5000])
def test_search_finds_the_nearest_entry_and_of_equal_ones_the_first(seed, spread):
    """A small spread makes many ties and repeated entries."""
    rng = np.random.default_rng(seed)
    book, points = rng.integers(-spread, spread, (int(rng.integers(1, 90)), 4)), rng.integers(-spread * 2, spread * 2, (300, 4))
    away = ((points[:, None, :] - book) ** 2).sum(2)
    index, best = vectorcodes.nearest(vectorcodes.kd_tree(book, leaf=int(rng.integers(1, 9))), book, points)
    assert (index == away.argmin(1)).all() and (best == away.min(1)).all()


def plain(rows, parts, entries, rounds):
    """(vec_id, vector, label) -> {vec_id: (codes, error, label error)} and the codebooks."""
    kept = [(i, [math.floor(256 * x) for x in v], label) for i, v, label in rows]
    width = len(kept[0][1]) // parts
    cut = lambda v, p: v[p * width : (p + 1) * width]
    books = [[cut(v, p) for _, v, _ in sorted(kept)[:entries]] for p in range(parts)]
    near = lambda p, x: min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(books[p]))
    for _ in range(rounds):
        moved = []
        for p in range(parts):
            own = defaultdict(list)
            for _, v, _ in kept:
                own[near(p, cut(v, p))[1]].append(cut(v, p))
            moved.append([[sum(c) // len(own[k]) for c in zip(*own[k], strict=True)] if k in own else e for k, e in enumerate(books[p])])
        books = moved
    out, errors = {}, defaultdict(int)
    for i, v, label in kept:
        found = [near(p, cut(v, p)) for p in range(parts)]
        out[i] = [[k for _, k in found], sum(d for d, _ in found), label]
        errors[label] += out[i][1]
    return {i: (k, e, errors[label]) for i, (k, e, label) in out.items()}, books


def test_query_is_the_rule(spark, sf):
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    want, books = plain(rows, 16, 64, 2)
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    got = vectorcodes.op13_vector_codes(spark, sf).collect()
    assert len(got) == len(rows)
    for r in got:
        codes, error, label_error = want[r["vec_id"]]
        assert (r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) == ("".join(f"{k:02x}" for k in codes), error, label_error, digest)


def test_ties_repeats_and_unused_entries(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.integers(-2, 3, 8)], None if i % 3 else 1) for i in range(80)] + [(i, [0.0] * 8, 2) for i in range(100, 140)]
    want, books = plain(rows, 4, 16, 3)
    coded, got = vectorcodes.quantized(spark.createDataFrame(rows, VECTORS).repartition(5), 4, 16, 3)
    assert got.tolist() == books
    assert {r["vec_id"]: (r["codes"], r["error"]) for r in coded.collect()} == {i: w[:2] for i, w in want.items()}


def test_defined_cases(spark):
    """Null, empty, odd and unbounded vectors, null and repeated ids, few rows, columns of the same names, an empty table."""
    good = [float(i) / 7 for i in range(32)]
    rows = [(1, good, 1), (1, good, 1), (None, good[::-1], None), (2, None, 1), (3, [None, *good[1:]], 1), (4, [math.nan, *good[1:]], 1), (5, [math.inf, *good[1:]], 1), (6, [], 1), (7, good[:16], 1), (8, good[:5], 1), (9, [3e38, *good[1:]], 1)]
    df = spark.createDataFrame(rows, VECTORS).withColumn("ints", F.lit("x")).withColumn("slot", F.lit(1)).withColumn("error", F.lit("e"))
    coded, books = vectorcodes.quantized(df)
    assert books.shape == (16, 3, 2)
    got = sorted(((r["vec_id"], r["codes"], r["error"]) for r in coded.collect()), key=str)
    assert got == sorted([(1, [0] * 16, 0), (1, [0] * 16, 0), (None, [2] * 16, 0), *((i, None, None) for i in (6, 7, 8, 9))], key=str)
    for part in (df.limit(0), df.where("vec_id IN (6, 8)")):
        coded, books = vectorcodes.quantized(part)
        assert books.size == 0 and coded.where("codes IS NOT NULL").count() == 0 and coded.count() == part.count()
