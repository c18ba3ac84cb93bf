"""Folds over ordered rows: what a row gets depends on the rows of its key before it.

Rows are dealt by key and sorted inside partitions; each partition is read once from front to back, and only a key's
state is kept. So a key may have any number of rows, and no group is gathered. A key is a batch, tenant or breaker; its
rows depend on each other in turn, which no plan can split.
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shared import unused, written

#: From a row (by column name) to what is added to it.
Step = Callable[[dict[str, Any]], tuple]
#: Types that a step may add.
ARROW = {"string": pa.string(), "long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}


def same_key(a: Any, b: Any) -> bool:
    """Whether two values are one key: nulls are, and so are NaNs."""
    return a == b or (a is None and b is None) or (a != a and b != b)


def fold(df: DataFrame, key: str, order: list[str], start: Callable[[], Step], added: str) -> DataFrame:
    """df with the columns `added`, which start()'s step gives for each row in turn; a new step begins with each key. Null is a key of its own."""
    rows = df.repartition(key).sortWithinPartitions(key, *order)
    fields = [c.split() for c in added.split(", ")]
    kinds = [ARROW[kind] for _, kind in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, step = None, None
        for b in batches:
            out = []
            for row in b.to_pylist():
                if step is None or not same_key(row[key], current):
                    current, step = row[key], start()
                out.append(step(row))
            new = [pa.array([o[i] for o in out], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*b.columns, *new], [*b.schema.names, *(name for name, _ in fields)])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return rows.mapInArrow(run, f"{schema}, {added}")


GENESIS = "0" * 64


def hash_chain(df: DataFrame, key: str, order: list[str], canonical: str) -> DataFrame:
    """prev_hash and event_hash: each event's hash covers the hash before it and its canonical text."""

    def start() -> Step:
        prev = GENESIS

        def step(row: dict[str, Any]) -> tuple[str, str]:
            nonlocal prev
            before, prev = prev, hashlib.sha256(f"{prev}:{row[canonical]}".encode()).hexdigest()
            return before, prev

        return step

    return fold(df, key, order, start, "prev_hash string, event_hash string")


def chain_roots(df: DataFrame, key: str, order: list[str], canonical: str) -> DataFrame:
    """key (null is one too), root and n: the last event hash and the length of each key's hash_chain. One row for each key leaves a task, and the rows are moved once."""
    rows = df.select(key, *order, canonical).repartition(key).sortWithinPartitions(key, *order).select(key, canonical)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, prev, n, kinds = None, GENESIS, 0, None
        for b in batches:
            kinds, done = pa.schema([b.schema.field(key), pa.field("root", pa.string()), pa.field("n", pa.int64())]), []
            for k, text in zip(b.column(key).to_pylist(), b.column(canonical).to_pylist(), strict=True):
                if n and not same_key(k, current):
                    done.append({key: current, "root": prev, "n": n})
                    prev, n = GENESIS, 0
                current, prev, n = k, hashlib.sha256(f"{prev}:{text}".encode()).hexdigest(), n + 1
            yield pa.RecordBatch.from_pylist(done, kinds)
        if n:
            yield pa.RecordBatch.from_pylist([{key: current, "root": prev, "n": n}], kinds)

    return rows.mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, root string, n long")


def digests(df: DataFrame, key: str, order: list[str], text: str, between: str = "\n", head: str = "", tail: str = "") -> DataFrame:
    """key (null is one too) and digest: SHA-256 of head, all texts of a key in order with `between` in between, and tail. One row for each key leaves a task."""
    rows = df.select(key, *order, text).repartition(key).sortWithinPartitions(key, *order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, h, kinds = None, None, None
        for b in batches:
            kinds, done = pa.schema([b.schema.field(key), pa.field("digest", pa.string())]), []
            for k, value in zip(b.column(key).to_pylist(), b.column(text).to_pylist(), strict=True):
                if h is None or not same_key(k, current):
                    if h is not None:
                        h.update(tail.encode())
                        done.append({key: current, "digest": h.hexdigest()})
                    current, h = k, hashlib.sha256(head.encode())
                else:
                    h.update(between.encode())
                h.update(str(value).encode())
            yield pa.RecordBatch.from_pylist(done, kinds)
        if h is not None:
            h.update(tail.encode())
            yield pa.RecordBatch.from_pylist([{key: current, "digest": h.hexdigest()}], kinds)

    return rows.mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, digest string")


def placed(df: DataFrame, key: str, order: list[str], name: str) -> DataFrame:
    """df with the column name: each row's place (from 1) in its key by order.

    Rows are dealt into ranges of equal size by key and order, whatever the keys' sizes, sorted there and written with their
    number in the range. Ranges are counted then, and what lies before each is added. The rows are moved once.
    """
    at, of, n, own, base = unused(df, "at", "range", "n", "own", "base")
    rows = written(df.repartitionByRange(key, *order).sortWithinPartitions(key, *order).withColumn(at, F.monotonically_increasing_id()), "ranges")
    rows = rows.withColumn(of, F.shiftright(at, 33))  # a range's numbers begin at its own multiple of 2^33
    counts = written(rows.groupBy(key, of).agg(F.count(F.lit(1)).alias(n), F.min(at).alias(base)), "counts")  # so that its size is known to the join
    before = F.sum(n).over(Window.partitionBy(key).orderBy(of)) - F.col(n)
    base_of = counts.select(F.col(key).alias(own), F.col(of).alias(f"{of}_"), (before + 1 - F.col(base)).alias(base))
    out = rows.join(base_of, F.col(key).eqNullSafe(F.col(own)) & (F.col(of) == F.col(f"{of}_")))
    return out.withColumn(name, F.col(base) + F.col(at)).select(*df.columns, name)


def sliding_limiter(df: DataFrame, key: str, order: list[str], seconds: str, limit: int, window: float) -> DataFrame:
    """allowed, remaining: at most limit requests are let through in any window; refused ones don't count."""

    def start() -> Step:
        let_in: deque[float] = deque()

        def step(row: dict[str, Any]) -> tuple[bool, int]:
            now = row[seconds]
            while let_in and let_in[0] <= now - window:
                let_in.popleft()
            if len(let_in) >= limit:
                return False, 0
            let_in.append(now)
            return True, limit - len(let_in)

        return step

    return fold(df, key, order, start, "allowed boolean, remaining long")


def token_bucket(df: DataFrame, key: str, order: list[str], seconds: str, per_minute: float, burst: float) -> DataFrame:
    """allowed, retry_after: a request takes a token; tokens come back at a rate, up to burst."""
    rate = per_minute / 60.0

    def start() -> Step:
        tokens, last = burst, None

        def step(row: dict[str, Any]) -> tuple[bool, int]:
            nonlocal tokens, last
            now = row[seconds]
            tokens = min(burst, tokens + max(0.0, now - last) * rate) if last is not None else tokens
            last = now
            if tokens >= 1.0:
                tokens -= 1.0
                return True, 0
            return False, int((1.0 - tokens) / rate) + 1

        return step

    return fold(df, key, order, start, "allowed boolean, retry_after long")


def circuit_breaker(df: DataFrame, key: str, order: list[str], seconds: str, failed: str, failures: int, open_for: float, successes: int) -> DataFrame:
    """state before the call, and whether it was let through: closed, open after failures in a row, half open after a while."""

    def start() -> Step:
        state, bad, good, opened = "closed", 0, 0, 0.0

        def step(row: dict[str, Any]) -> tuple[str, bool]:
            nonlocal state, bad, good, opened
            if state == "open" and row[seconds] - opened >= open_for:
                state, good = "half_open", 0
            seen = state
            if state == "open":
                return seen, False
            if row[failed]:
                bad += state == "closed"
                if state == "half_open" or bad >= failures:
                    state, opened, good = "open", row[seconds], 0
            elif state == "half_open":
                good += 1
                if good >= successes:
                    state, bad, good = "closed", 0, 0
            else:
                bad = 0
            return seen, True

        return step

    return fold(df, key, order, start, "state string, let_through boolean")


def ledger(df: DataFrame, key: str, order: list[str], amount: str, credits: int) -> DataFrame:
    """status, remaining: an amount (in whole units) is reserved only if the key's credits still cover it."""

    def start() -> Step:
        left = credits

        def step(row: dict[str, Any]) -> tuple[str, int]:
            nonlocal left
            if row[amount] <= 0:
                return "applied", left
            if left < row[amount]:
                return "rejected", left
            left -= row[amount]
            return "applied", left

        return step

    return fold(df, key, order, start, "status string, remaining long")


def numbered(df: DataFrame, key: str) -> DataFrame:
    """df with n, each row's place (from 0) by a key that tells rows apart: ranges of equal size are counted first, so that no task gets all rows, however far apart the keys lie."""
    of, c, base = unused(df, "range", "c", "base")
    rows = written(df.repartitionByRange(key).withColumn(of, F.spark_partition_id()), "ranges")
    counts = rows.groupBy(of).agg(F.count(F.lit(1)).alias(c))
    bases = counts.select(of, (F.sum(c).over(Window.orderBy(of)) - F.col(c)).alias(base))  # one row a range
    inside = F.row_number().over(Window.partitionBy(of).orderBy(key))
    return rows.withColumn("n", inside).join(bases, of).withColumn("n", F.col(base) + F.col("n") - 1).select(*df.columns, "n")
