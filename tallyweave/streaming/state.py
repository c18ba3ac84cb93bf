"""State by key with timers: caches whose entries expire, stage streams that end, deliveries that are tried again, and an append-only log.

Each takes a stream with a watermark on ts. Time is that of the events, and timers fire as the watermark passes them, so a
run gives the same rows however it is cut into batches or begun anew, as long as no event comes later than the watermark
allows. A key's rows of one batch are sorted in memory; batches are kept small by the source's limits (maxFilesPerTrigger).
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions import canonical as J

#: The only store that keeps timers and several states.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def with_state(stream: DataFrame, key: str, processor: StatefulProcessor, schema: str) -> DataFrame:
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    return stream.groupBy(key).transformWithStateInPandas(processor, schema, "append", "eventTime")


def seconds(ts: Column) -> Column:
    return F.unix_micros(ts) / 1e6


def _ordered(rows: Iterator[pd.DataFrame]) -> list[dict[str, Any]]:
    return pd.concat(list(rows)).sort_values(["seconds", "id"]).to_dict("records")


class _Timed(StatefulProcessor):
    """One value by key, and a timer for when it is due."""

    state = ""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.held = handle, handle.getValueState("held", self.state)

    def read(self) -> tuple | None:
        return tuple(self.held.get()) if self.held.exists() else None

    def write(self, value: tuple | None, due: float | None = None) -> None:
        if value is None:
            self.held.clear()
            return
        self.held.update(value)
        if due is not None:
            self.handle.registerTimer(math.ceil(due * 1000))

    def close(self) -> None:
        pass


class _Cache(_Timed):
    state = "kept double"

    def __init__(self, ttl: float) -> None:
        self.ttl = ttl

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        (kept,) = self.read() or (None,)
        out = []
        for r in _ordered(rows):
            hit = kept is not None and r["seconds"] < kept + self.ttl
            kept = kept if hit else r["seconds"]
            out.append((key[0], r["id"], hit))
        self.write((kept,), kept + self.ttl)
        yield pd.DataFrame(out, columns=["key", "id", "hit"])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        held = self.read()
        if held and (held[0] + self.ttl) * 1000 <= expiredTimerInfo.getExpiryTimeInMs():
            self.write(None)
        yield from ()


def cached(lookups: DataFrame, ttl: float) -> DataFrame:
    """key, id, hit of lookups (key, id, ts): whether the answer is still held; a miss puts it in for ttl seconds. Entries go when their time is over."""
    rows = lookups.select("key", "id", "ts", seconds(F.col("ts")).alias("seconds"))
    return with_state(rows, "key", _Cache(ttl), f"key {rows.schema['key'].dataType.simpleString()}, id long, hit boolean")


class _Stages(_Timed):
    state = "began double, last double, place long"

    def __init__(self, last_stage: str, idle: float) -> None:
        self.last_stage, self.idle = last_stage, idle

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        run, out = self.read(), []
        for r in _ordered(rows):
            if run and r["seconds"] >= run[1] + self.idle:
                out.append((key[0], run[0], run[2] + 1, None, None, "timeout"))
                run = None
            began, _, place = run or (r["seconds"], 0.0, 0)
            done = r["stage"] == self.last_stage
            out.append((key[0], began, place + 1, r["id"], r["stage"], "done" if done else None))
            run = None if done else (began, r["seconds"], place + 1)
        self.write(run, run and run[1] + self.idle)
        yield self.frame(out)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        run = self.read()
        if run and (run[1] + self.idle) * 1000 <= expiredTimerInfo.getExpiryTimeInMs():
            self.write(None)
            yield self.frame([(key[0], run[0], run[2] + 1, None, None, "timeout")])

    @staticmethod
    def frame(out: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(out, columns=["key", "began", "place", "id", "stage", "ended"]).astype({"id": "Int64"})


def stage_stream(stages: DataFrame, last_stage: str, idle: float) -> DataFrame:
    """key, began, place, id, stage, ended: the stages (key, id, ts, stage) of each command in order, as long as it runs.

    A run ends with its last stage (done), or idle seconds after the stage before (timeout, a row of its own). What comes
    after that begins a new run.
    """
    rows = stages.select("key", "id", "ts", "stage", seconds(F.col("ts")).alias("seconds"))
    return with_state(rows, "key", _Stages(last_stage, idle), f"key {rows.schema['key'].dataType.simpleString()}, began double, place long, id long, stage string, ended string")


#: Groups of keys that share one state. A group's entries that wait are read and written as a whole, so there should be some thousands of them at most.
GROUPS = 2048


class _Deliveries(StatefulProcessor):
    """A list of the entries that wait, by group of keys, and a timer for the first of them that is due."""

    def __init__(self, deliver: Callable[[str, int], bool], most: int, longest: float, kind: str) -> None:
        self.deliver, self.most, self.longest, self.kind = deliver, most, longest, kind

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.held = handle, handle.getListState("waiting", f"key {self.kind}, attempts long, due double, payload string")

    def tried(self, waiting: dict[Any, tuple], fresh: dict[Any, float], now: float) -> pd.DataFrame:
        """Attempts that are due, of entries that wait (attempts, due and payload by key): by the watermark, new ones by their own time too."""
        out, rest = [], []
        for key, (attempts, due, payload) in waiting.items():
            upto, over = max(now, fresh.get(key, now)), False
            while not over and due <= upto:
                attempts += 1
                good = self.deliver(payload, attempts)
                over = good or attempts == self.most
                out.append((key, attempts, due, "done" if good else "dead" if over else "failed"))
                due += min(2.0**attempts, self.longest)
            if not over:
                rest.append((key, attempts, due, payload))
        if rest:
            self.held.put(rest)
            self.handle.registerTimer(math.ceil(min(r[2] for r in rest) * 1000))
        else:
            self.held.clear()
        return pd.DataFrame(out, columns=["key", "attempt", "at", "outcome"])

    def waiting(self) -> dict[Any, tuple]:
        return {key: tuple(rest) for key, *rest in self.held.get()} if self.held.exists() else {}

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        waiting, first = self.waiting(), {}
        for part in rows:
            for k, i, s, payload in zip(*(part[c].tolist() for c in ("key", "id", "seconds", "payload")), strict=True):
                if k not in waiting and (k not in first or (s, i) < first[k][:2]):  # an entry that waits is not put in again
                    first[k] = (s, i, payload)
        waiting |= {k: (0, s, payload) for k, (s, _, payload) in first.items()}
        yield self.tried(waiting, {k: v[0] for k, v in first.items()}, timerValues.getCurrentWatermarkInMs() / 1000)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        yield self.tried(self.waiting(), {}, timerValues.getCurrentWatermarkInMs() / 1000)

    def close(self) -> None:
        pass


def deliveries(entries: DataFrame, deliver: Callable[[str, int], bool], most: int = 3, longest: float = 10.0, groups: int = GROUPS) -> DataFrame:
    """key, attempt, at, outcome of entries (key, id, ts, payload): each is delivered at once, else again after 2, 4, ... seconds (longest at most).

    deliver takes the payload and the number of the attempt, and tells whether it went well; an entry that has failed most
    times is dead. outcome: done, failed (to be tried again) or dead. Keys share their state by groups, since most have a
    single entry; groups must stay the same over restarts.
    """
    group = F.pmod(F.xxhash64("key"), F.lit(groups)).alias("group")
    rows = entries.select(group, "key", "id", "ts", F.col("payload").cast("string").alias("payload"), seconds(F.col("ts")).alias("seconds"))
    kind = rows.schema["key"].dataType.simpleString()
    return with_state(rows, "group", _Deliveries(deliver, most, longest, kind), f"key {kind}, attempt long, at double, outcome string")


#: What the transparency log may hold, the form of its leaves, and when a root is published.
ENTRY_TYPES = ["receipt", "assertion", "tombstone"]
LEAF_VERSION = "1.0"
PUBLISH_EVERY, PUBLISH_AFTER = 1024, 300.0


def leaf(entry_type: Column, entry_id: Column, root_hash: Column, timestamp: Column, nonce: Column) -> Column:
    """The hash of an entry's canonical leaf. Another type, or an id or root that is empty, raises."""
    bad = lambda c: F.coalesce(F.trim(c) == "", F.lit(True))
    fault = F.when(~F.coalesce(entry_type.isin(ENTRY_TYPES), F.lit(False)), F.concat(F.lit("not an entry type: "), F.coalesce(entry_type, F.lit("null")))).when(bad(entry_id), "an entry needs an id").when(bad(root_hash), "an entry needs a root")
    fields = {"version": F.lit(LEAF_VERSION), "entry_type": entry_type, "entry_id": entry_id, "root_hash": root_hash, "timestamp": timestamp, "nonce": nonce}
    return F.when(fault.isNotNull(), F.raise_error(fault).cast("string")).otherwise(F.sha2(J.record({k: J.text(v) for k, v in fields.items()}), 256))


class _Log(_Timed):
    state = "size long, frontier string, published long, published_at double"

    def __init__(self, every: int, after: float) -> None:
        self.every, self.after = every, after

    @staticmethod
    def compact(rows: Iterator[pd.DataFrame]) -> tuple[np.ndarray, np.ndarray]:
        """seconds and leaf (32 bytes) of a log's rows in order: 48 bytes a row are held, and as much again while they are put in order."""
        parts = [(r["seconds"].to_numpy(), r["id"].to_numpy(), np.frombuffer(bytes.fromhex("".join(r["leaf"])), "V32")) for r in rows]
        times, ids, leaves = (np.concatenate(c) for c in zip(*parts, strict=True))
        order = np.lexsort((ids, times))
        return times[order], leaves[order]

    @staticmethod
    def node(left: bytes, right: bytes) -> bytes:
        return hashlib.sha256(b"\x01" + left + right).digest()

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        size, text, published, at = self.read() or (0, "", 0, -math.inf)
        peaks = [bytes.fromhex(p) for p in text.split()]  # roots of the full trees, one for each bit of size that is set
        out = []
        times, leaves = self.compact(rows)
        for now, own in zip(times, leaves, strict=True):
            new, bits = hashlib.sha256(b"\x00" + own.tobytes()).digest(), size
            while bits & 1:
                new, bits = self.node(peaks.pop(), new), bits >> 1
            peaks.append(new)
            size += 1
            if size - published >= self.every or now - at >= self.after:
                root = peaks[-1]
                for p in peaks[-2::-1]:
                    root = self.node(p, root)
                published, at = size, float(now)
                out.append((key[0], size, root.hex(), at))
        self.write((size, " ".join(p.hex() for p in peaks), published, at))
        yield pd.DataFrame(out, columns=["key", "tree_size", "root_hash", "at"])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        yield from ()


def published_roots(entries: DataFrame, every: int = PUBLISH_EVERY, after: float = PUBLISH_AFTER) -> DataFrame:
    """key, tree_size, root_hash, at: the roots that a log (key) publishes as its entries (key, id, ts, leaf) are appended.

    A root is due with the first entry, every so many entries, or so many seconds after the one before, whichever is first.
    The state is the roots of the full trees only, as many as the size has bits. A log is serial; logs run side by side.
    """
    rows = entries.select("key", "id", "ts", "leaf", seconds(F.col("ts")).alias("seconds"))
    return with_state(rows, "key", _Log(every, after), f"key {rows.schema['key'].dataType.simpleString()}, tree_size long, root_hash string, at double")
