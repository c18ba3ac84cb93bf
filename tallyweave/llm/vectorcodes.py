"""Vector code compression: vectors as one small code for each of their parts (product quantization).

Components become whole numbers, vectors are cut into equal parts, and each part position has a codebook. A round
broadcasts a kd-tree for each codebook (parts x entries x components, whatever the number of rows); tasks look for every
part's nearest entry by branch and bound and add up whole numbers for each entry, one row an entry and task; their sums
move the entries. A node is visited where its bound equals the best distance too, so that of equally near entries the one
of lower index stays. All sums are of whole numbers, so that results don't depend on how rows are dealt or on lost tasks.

Defined cases: rows whose vector is null or holds a null, NaN or infinite component are dropped. Of the others, those that
don't have the commonest length that the parts divide (of equally common ones the least; so empty vectors), or that have a
component beyond RANGE, cannot be coded: they stay, with null code and error. Null vec_ids come last where entries are
chosen; rows of equal vec_id go by their vector; repeated rows each take part; fewer rows than entries give as many
entries; an error sum beyond 64 bits is null; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table

PARTS, ENTRIES, ROUNDS, SCALE, LEAF = 16, 64, 2, 256, 8
#: Components from here on would make squares beyond 64 bits.
RANGE = 1 << 26


@dataclass
class Node:
    """A node of a kd-tree: the box around its entries, and either two children or the entries' indexes, ascending."""

    low: np.ndarray
    high: np.ndarray
    axis: int = 0
    cut: int = 0
    left: Node | None = None
    right: Node | None = None
    entries: np.ndarray | None = None


def kd_tree(book: np.ndarray, leaf: int = LEAF, of: np.ndarray | None = None) -> Node:
    """The kd-tree of a codebook (entries x components): halves at the median of the widest axis down to leaves."""
    of = np.arange(len(book)) if of is None else of
    low, high = book[of].min(0), book[of].max(0)
    if len(of) <= leaf:
        return Node(low, high, entries=np.sort(of))
    axis = int((high - low).argmax())
    order = of[np.argsort(book[of, axis], kind="stable")]
    half = len(order) // 2
    return Node(low, high, axis, int(book[order[half], axis]), kd_tree(book, leaf, order[:half]), kd_tree(book, leaf, order[half:]))


def nearest(tree: Node, book: np.ndarray, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index and squared distance of each point's nearest entry, the lowest index of equally near ones."""
    best, index = np.full(len(points), np.iinfo(np.int64).max), np.full(len(points), len(book))

    def visit(node: Node, rows: np.ndarray) -> None:
        at = points[rows]
        gap = np.maximum(np.maximum(node.low - at, at - node.high), 0)
        open_ = (gap * gap).sum(1) <= best[rows]  # an equal bound may hide an entry of lower index
        rows, at = rows[open_], at[open_]
        if not len(rows):
            return
        if node.entries is not None:
            away = at[:, None, :] - book[node.entries]
            away = (away * away).sum(2)
            first = away.argmin(1)
            dist, entry = away[np.arange(len(rows)), first], node.entries[first]
            won = (dist < best[rows]) | ((dist == best[rows]) & (entry < index[rows]))
            best[rows[won]], index[rows[won]] = dist[won], entry[won]
            return
        before = at[:, node.axis] < node.cut
        for near, far, some in ((node.left, node.right, rows[before]), (node.right, node.left, rows[~before])):
            visit(near, some)
            visit(far, some)

    visit(tree, np.arange(len(points)))
    return index, best


def whole_numbers(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, label and ints (floor of scale times each component; null beyond RANGE) of the rows whose vector is finite."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("embedding")).where(F.col("embedding").isNotNull() & finite)
    small = F.forall("embedding", lambda x: F.abs(x) < RANGE / scale)
    ints = F.transform("embedding", lambda x: F.floor(x * scale).cast("int"))
    return rows.select("vec_id", "label", F.when(small, ints).alias("ints"))


def _points(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("ints").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1).astype(np.int64)


def _codes(books: np.ndarray, trees: list[Node], points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indexes and squared distances, rows x parts."""
    width = books.shape[2]
    found = [nearest(t, b, points[:, p * width : (p + 1) * width]) for p, (t, b) in enumerate(zip(trees, books, strict=True))]
    return np.stack([i for i, _ in found], 1), np.stack([d for _, d in found], 1)


def moved(coded: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after a round: each entry at the floor of the mean of its parts; unused ones stay."""
    parts, entries, width = books.shape
    sent = coded.sparkSession.sparkContext.broadcast((books, [kd_tree(b) for b in books]))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, trees = sent.value
        total, n = np.zeros((parts * entries, width), np.int64), np.zeros(parts * entries, np.int64)
        for batch in batches:
            if batch.num_rows:
                points = _points(batch)
                slot = (_codes(held, trees, points)[0] + np.arange(parts) * entries).ravel()
                np.add.at(total, slot, points.reshape(-1, width))
                n += np.bincount(slot, minlength=len(n))
        used = np.flatnonzero(n)
        yield pa.RecordBatch.from_pydict({"slot": pa.array(used, pa.int32()), "n": pa.array(n[used]), "sums": pa.array(list(total[used]), pa.list_(pa.int64()))})

    partial = coded.select("ints").mapInArrow(sums, "slot int, n long, sums array<long>")
    whole = lambda c: F.sum(c.cast("decimal(38,0)"))
    rows = partial.groupBy("slot").agg(whole(F.col("n")).alias("n"), *(whole(F.get("sums", F.lit(i))).alias(f"s{i}") for i in range(width))).collect()
    sent.destroy()
    flat = books.reshape(-1, width).copy()
    for r in rows:  # at most parts x entries
        flat[r["slot"]] = [int(r[f"s{i}"]) // int(r["n"]) for i in range(width)]
    return flat.reshape(books.shape)


def quantized(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, np.ndarray]:
    """From vec_id, embedding, label: vec_id, label, codes (array of parts indexes), error; and the codebooks (parts x entries x components)."""
    spark = vectors.sparkSession
    ints = stored(whole_numbers(vectors, scale), "vector-ints")
    fits = (F.size("ints") > 0) & (F.size("ints") % parts == 0)
    common = ints.where(fits).groupBy(F.size("ints").alias("n")).count().orderBy(F.desc("count"), "n").first()
    dim = common["n"] if common else -1
    can = F.coalesce(F.size("ints") == dim, F.lit(False))
    rest = ints.where(~can).select("vec_id", "label", F.lit(None).cast("array<int>").alias("codes"), F.lit(None).cast("long").alias("error"))
    if common is None:
        return rest, np.zeros((parts, 0, 0), np.int64)
    coded = ints.where(can)
    seeds = coded.orderBy(F.col("vec_id").asc_nulls_last(), "ints").limit(entries).select("ints").collect()
    books = np.array([r["ints"] for r in seeds], np.int64).reshape(len(seeds), parts, dim // parts).transpose(1, 0, 2)
    for _ in range(rounds):
        books = moved(coded, books)
    sent = spark.sparkContext.broadcast((books, [kd_tree(b) for b in books]))

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, trees = sent.value
        for batch in batches:
            if batch.num_rows:
                index, away = _codes(held, trees, _points(batch))
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(list(index.astype(np.int32)), pa.list_(pa.int32())), pa.array(away.sum(1))], ["vec_id", "label", "codes", "error"])

    kinds = {f.name: f.dataType.simpleString() for f in ints.schema.fields}
    out = coded.mapInArrow(codes, f"vec_id {kinds['vec_id']}, label {kinds['label']}, codes array<int>, error long")
    out = stored(out, "vector-codes")
    sent.destroy()
    return out.unionByName(rest), books


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = quantized(table(spark, sf_dir, "embeddings"))
    # One row a label: written, so that Spark knows its size when it plans the join.
    sums = stored(coded.groupBy("label").agg(F.try_sum("error").alias("label_error")).withColumnRenamed("label", "of"), "label-errors", compact=True)
    text = F.array_join(F.transform("codes", lambda c: F.lower(F.lpad(F.hex(c.cast("long")), 2, "0"))), "")
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    out = coded.join(sums, F.col("label").eqNullSafe(F.col("of")), "left")
    return out.select("vec_id", text.alias("code"), "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


_NEAR = "SELECT k.vec_id, k.p, min(((k.a - b.a) ** 2 + (k.b - b.b) ** 2 + (k.c - b.c) ** 2 + (k.d - b.d) ** 2)::BIGINT * 64 + b.e) AS m FROM parts k JOIN {book} b ON k.p = b.p GROUP BY 1, 2"
_MOVE = "SELECT b.p, b.e, {cols} FROM {book} b LEFT JOIN (SELECT k.p, n.m % 64 AS e, avg(k.a) AS a, avg(k.b) AS b, avg(k.c) AS c, avg(k.d) AS d FROM {near} n JOIN parts k ON n.vec_id = k.vec_id AND n.p = k.p GROUP BY 1, 2) s ON b.p = s.p AND b.e = s.e"
_COLS = ", ".join(f"coalesce(floor(s.{c})::BIGINT, b.{c}) AS {c}" for c in "abcd")
#: For 64 components: 16 parts of four, a to d. A distance and its entry are one number, so that the least has the lowest index.
ORACLE = f"""
WITH kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(x::DOUBLE * 256)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
parts AS MATERIALIZED (SELECT vec_id, p, v[p * 4 + 1] AS a, v[p * 4 + 2] AS b, v[p * 4 + 3] AS c, v[p * 4 + 4] AS d FROM kept, range(16) t(p)),
first AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM kept QUALIFY e < 64),
book0 AS MATERIALIZED (SELECT p, e, a, b, c, d FROM parts JOIN first USING (vec_id)),
near0 AS ({_NEAR.format(book="book0")}), book1 AS MATERIALIZED ({_MOVE.format(cols=_COLS, book="book0", near="near0")}),
near1 AS ({_NEAR.format(book="book1")}), book2 AS MATERIALIZED ({_MOVE.format(cols=_COLS, book="book1", near="near1")}),
near2 AS MATERIALIZED ({_NEAR.format(book="book2")}),
coded AS (SELECT vec_id, string_agg(printf('%02x', m % 64), '' ORDER BY p) AS code, sum(m // 64)::BIGINT AS error FROM near2 GROUP BY 1),
books AS (SELECT sha256(string_agg(concat_ws(',', a, b, c, d), ',' ORDER BY p, e)) AS codebooks_sha256 FROM book2)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM coded JOIN kept USING (vec_id), books
"""
