"""Streams with state and timers: the same rows in one run, and over several runs with a restart between them."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tallyweave.streaming import state as T

ROWS = "key long, id long, ts timestamp, stage string, payload string, leaf string"


def in_runs(spark, folder, parts, build):
    """All rows of a stream whose input comes in parts, each drained by a query of its own from the same checkpoint."""
    for k, part in enumerate(parts):
        df = spark.createDataFrame(part, "key long, id long, s double, stage string, payload string, leaf string").withColumn("ts", F.timestamp_micros((F.col("s") * 1e6).cast("long"))).drop("s")
        df.coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(df.schema).parquet(f"{folder}/in").withWatermark("ts", "0 seconds")
        build(stream).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/out").collect()


def rows(times, key=lambda i: 0, stage=lambda i: "x", payload=lambda i: "0"):
    return [(key(i), i, 1000.0 + t, stage(i), payload(i), hashlib.sha256(b"%d" % i).hexdigest()) for i, t in enumerate(times)]


def cut(all_rows, at):
    return [all_rows[a:b] for a, b in zip([0, *at], [*at, len(all_rows)], strict=True)]


def test_cache_entries_expire_over_restarts(spark, tmp_path):
    rng = random.Random(1)
    times = sorted(rng.uniform(0, 500) for _ in range(120))
    own = rows(times, key=lambda i: i % 3)
    kept, want = {}, {}
    for key, i, s, *_ in own:
        want[i] = key in kept and s < kept[key] + 20
        if not want[i]:
            kept[key] = s
    got = in_runs(spark, tmp_path, cut(own, [40, 41, 90]), lambda d: T.cached(d, 20.0))
    assert {r["id"]: r["hit"] for r in got} == want and len(got) == len(own)


def test_stage_streams_end_by_their_last_stage_or_when_idle(spark, tmp_path):
    """The clock is the watermark: a far event lets the timers of all commands fire, each once."""
    own = rows([0, 1, 2, 40, 41, 42, 43, 200, 500], key=lambda i: i % 2, stage=lambda i: "completed" if i == 4 else "s")
    got = in_runs(spark, tmp_path, cut(own, [3, 5, 8]), lambda d: T.stage_stream(d, "completed", 30.0))
    got = sorted((r["key"], r["began"] - 1000, r["place"], r["id"], r["ended"]) for r in got)
    assert got == sorted([(0, 0.0, 1, 0, None), (0, 0.0, 2, 2, None), (0, 0.0, 3, None, "timeout"), (0, 41.0, 1, 4, "done"), (0, 43.0, 1, 6, None), (0, 43.0, 2, None, "timeout"), (0, 500.0, 1, 8, None), (1, 1.0, 1, 1, None), (1, 1.0, 2, None, "timeout"), (1, 40.0, 1, 3, None), (1, 40.0, 2, 5, None), (1, 40.0, 3, None, "timeout"), (1, 200.0, 1, 7, None), (1, 200.0, 2, None, "timeout")], key=lambda r: (r[0], r[1], r[2]))


def test_deliveries_are_tried_again_and_die_after_the_third_failure(spark, tmp_path):
    own = rows([0, 1, 2, 3, 5, 100], key=lambda i: i, payload=lambda i: str(i % 4))
    got = in_runs(spark, tmp_path, cut(own, [4, 5]), lambda d: T.deliveries(d, lambda payload, attempt: attempt > int(payload)))
    got = sorted((r["key"], r["attempt"], r["at"] - 1000, r["outcome"]) for r in got)
    want = [(0, 1, 0.0, "done"), (1, 1, 1.0, "failed"), (1, 2, 3.0, "done"), (2, 1, 2.0, "failed"), (2, 2, 4.0, "failed"), (2, 3, 8.0, "done"), (3, 1, 3.0, "failed"), (3, 2, 5.0, "failed"), (3, 3, 9.0, "dead"), (4, 1, 5.0, "done"), (5, 1, 100.0, "failed")]
    assert got == want


def test_deliveries_of_many_keys_share_few_states(spark, tmp_path):
    """Keys of one group each go their own way; an entry that waits is not put in again, one that is over is."""
    own = rows([0.01 * i for i in range(120)], key=lambda i: i % 50, payload=lambda i: str(i % 50 % 4)) + [(i, 900 + i, 1100.0, "x", "0", "") for i in range(50)]
    got = in_runs(spark, tmp_path, cut(own, [60, 120]), lambda d: T.deliveries(d, lambda payload, attempt: attempt > int(payload), groups=3))
    want = []
    for k in range(50):
        fails = k % 4
        want += [(k, n + 1, round(0.01 * k + w, 6), "done" if n == fails else "dead" if n == 2 else "failed") for n, w in enumerate((0, 2, 6)) if n <= fails]
        if not fails:  # the first of a batch, where none waits
            want += [(k, 1, round(0.01 * min(i for i in range(60, 120) if i % 50 == k), 6), "done"), (k, 1, 100.0, "done")]
    assert sorted((r["key"], r["attempt"], round(r["at"] - 1000, 6), r["outcome"]) for r in got) == sorted(want)


def tree(hashes):
    while len(hashes) > 1:
        hashes = [hashlib.sha256(b"\x01" + hashes[i] + hashes[i + 1]).digest() if i + 1 < len(hashes) else hashes[i] for i in range(0, len(hashes), 2)]
    return hashes[0].hex()


@pytest.mark.parametrize("at", [[], [1, 7, 40]])
def test_published_roots_are_those_of_the_whole_tree(spark, tmp_path, at):
    own = rows([*range(50), 400, 401], key=lambda i: 7)
    got = in_runs(spark, tmp_path, cut(own, at), lambda d: T.published_roots(d, 16, 300.0))
    leaves = [hashlib.sha256(b"\x00" + bytes.fromhex(r[5])).digest() for r in own]
    assert sorted((r["tree_size"], r["root_hash"]) for r in got) == [(n, tree(leaves[:n])) for n in (1, 17, 33, 49, 51)]


def test_leaves_of_other_forms_raise(spark):
    of = lambda kind, i, root: spark.range(1).select(T.leaf(F.lit(kind).cast("string"), F.lit(i), F.lit(root), F.lit("t"), F.lit("n"))).collect()[0][0]
    want = '{"entry_id":"r","entry_type":"receipt","nonce":"n","root_hash":"h","timestamp":"t","version":"1.0"}'
    assert of("receipt", "r", "h") == hashlib.sha256(want.encode()).hexdigest()
    for bad in (("other", "r", "h"), (None, "r", "h"), ("receipt", " ", "h"), ("tombstone", "r", "")):
        with pytest.raises(Exception, match="entry"):
            of(*bad)


def test_finalize_leaves_one_end_for_each_batch(spark, tmp_path):
    """Late shards, two callers at once, a caller that dies before its commit, shards after the commit, and a store that disagrees."""
    from tallyweave.operators import finalize as Z

    cols = "trace_id string, shard long, row_index long, original string, layer string, resolved string, confidence double, decision_path string, entity_type string, source_timestamp timestamp"
    one = lambda b, shard, i: (b, shard, i, f"n{i}", "L1_EXACT", None, 0.5, "p", "PERSON", None)
    whole = [one(b, i % 3, i) for b in ("a", "b") for i in range(12)]
    store, of = str(tmp_path / "store"), lambda data: spark.createDataFrame(data, cols)
    early = of([r for r in whole if not (r[0] == "b" and r[1] == 2)])
    none = Z.committed(spark, store)
    assert {r["trace_id"]: r["state"] for r in Z.arrivals(early, none, 3).collect()} == {"a": "ready", "b": "waiting"}
    Z.finalized(early, Z.ready(early, none, 3))  # dies before its commit
    assert Z.committed(spark, store).count() == 0
    Z.commit(Z.finalized(early, Z.ready(early, none, 3)), store)
    ends = [Z.finalized(of(whole), Z.ready(of(whole), Z.committed(spark, store), 3)) for _ in range(2)]
    for e in ends:
        Z.commit(e, store)
    first = {r["trace_id"]: r for r in Z.committed(spark, store).collect()}
    assert set(first) == {"a", "b"} and all(r["rows"] == 12 and r["replayed"] and r["receipt_id"] and r["leaf"] for r in first.values())
    late = of([*whole, one("a", 2, 99)])
    assert {r["state"] for r in Z.arrivals(late, Z.committed(spark, store), 3).collect()} == {"committed"}
    Z.commit(Z.finalized(late, Z.ready(late, Z.committed(spark, store), 3)), store)
    assert {r["trace_id"]: r for r in Z.committed(spark, store).collect()} == first
    Z.commit(Z.finalized(late, late.select("trace_id").distinct()), store)  # not asked whether it was ready
    with pytest.raises(Exception, match="two ends of one batch"):
        Z.committed(spark, store).collect()


def test_cases_go_to_the_next_reviewer_with_room(spark):
    from tallyweave.operators import review as V

    steps = [(True, None)] * 5 + [(False, "b"), (True, None), (False, "x"), (False, "a"), (False, "a"), (False, "a"), (True, None)]
    rows = spark.createDataFrame([("t", i, o, r) for i, (o, r) in enumerate(steps)], "team string, i long, opens boolean, reviewer string")
    got = V.with_capacity(rows, "team", ["i"], "opens", "reviewer", ["a", "b"], 2).orderBy("i").collect()
    assert [(r["assigned_to"], r["active"]) for r in got] == [("a", 1), ("b", 1), ("a", 2), ("b", 2), (None, None), (None, 1), ("b", 2), (None, None), (None, 1), (None, 0), (None, 0), ("a", 1)]
    assert V.with_capacity(rows, "team", ["i"], "opens", "reviewer", [], 2).where("assigned_to IS NOT NULL").count() == 0


def test_alerts_fire_only_after_holding_long_enough(spark):
    """Stretches just below and just as long as the limit, a gap without events, a window at the limit, two rules at once."""
    from tallyweave.streaming import events as S

    share = {0: 0.5, 1: 0.5, 3: 0.5, 4: 0.5, 5: 0.5, 6: 0.1, 7: 0.5, 8: 0.5, 9: 0.2, 10: 0.5}
    slow = {7: 9.0, 8: 9.0, 9: 9.0, 10: 9.0}
    windows = spark.createDataFrame([(k * 60, v, slow.get(k, 1.0)) for k, v in share.items()], "s long, share double, p95 double").withColumn("start", F.timestamp_seconds("s"))
    got = S.held_alerts(windows, {"errors": ("share", 0.2), "latency": ("p95", 5.0)}, 60.0, 180.0).select("rule", *(F.unix_timestamp(c).alias(c) for c in ("began", "fired", "ended")), "windows").collect()
    assert sorted(tuple(r) for r in got) == [("errors", 180, 360, 360, 3), ("latency", 420, 600, 660, 4)]
    assert S.held_alerts(windows, {"errors": ("share", 0.2)}, 60.0, 240.0).count() == 0


def test_p95_of_a_window_is_exact(spark):
    from tallyweave.streaming import events as S

    rows = spark.range(1, 1001).selectExpr("id AS event_id", "timestamp_seconds(id % 50) AS ts", "'error' AS event_type", "CAST(id AS double) AS value")
    assert [(r["n"], r["error_share"], r["p95"]) for r in S.measured(rows, "1 minute").collect()] == [(1000, 1.0, 950.0)]


def test_pages_go_on_where_the_last_one_ended(spark):
    from tallyweave.operators import access as A

    rows = spark.createDataFrame([(i % 7 / 10.0, i) for i in range(40)], "c double, i long").repartition(3)
    want, got, after = sorted(((c, i) for c, i in [tuple(r) for r in rows.collect()]), key=lambda r: (-r[0], r[1])), [], None
    while page := [tuple(r) for r in A.page_after(rows, {"c": True, "i": False}, 9, 100, after).collect()]:
        got, after = got + page, {"c": page[-1][0], "i": page[-1][1]}
    assert got == want


def test_a_log_holds_its_rows_compactly():
    """200,000 rows of one log and batch, in parts, in any order: 150 bytes a row at most, where dicts took several hundred."""
    import tracemalloc

    import pandas as pd

    frames = (pd.DataFrame({"seconds": [float((k * 1000 + i) * 7919 % 200_000) for i in range(1000)], "id": range(k * 1000, k * 1000 + 1000), "leaf": [f"{(k * 1000 + i) * 7919 % 200_000:064x}" for i in range(1000)]}) for k in range(200))
    tracemalloc.start()
    times, leaves = T._Log.compact(frames)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 150 * 200_000 and times.tolist() == [*range(200_000)] and [int.from_bytes(x.tobytes(), "big") for x in leaves[[0, 7, 199_999]]] == [0, 7, 199_999]
