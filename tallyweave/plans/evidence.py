"""Queries on hashes, chains, trees, ledgers, limiters and review cases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import canonical as J
from ..operators import evidence as E
from ..operators import finalize as Z
from ..operators import ordered as O
from ..operators import review as V
from ..shared import shared_path, written
from .inputs import RESULTS, results, table

AS_OF = "2001-06-01 00:00:00"
CHUNK_TIME, CHUNK_VERSIONS = "2024-06-01T00:00:00Z", {"config_version": "sha256:c", "sanitization_version": "1", "watchlist_version_hash": "sha256:w"}
REVIEWERS = ["ana", "bo", "chi"]


def hashed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.stable_order(results(spark, sf_dir)).withColumn("canonical", E.canonical_decision()).withColumn("record_hash", F.sha2(E.canonical_decision(False), 256))


def record_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results(spark, sf_dir).select("trace_id", "row_index", F.sha2(E.canonical_decision(False), 256).alias("record_hash"))


def stable_order_v2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.stable_order(results(spark, sf_dir)).select("trace_id", "row_index", F.col("pos").cast("long").alias("pos"))


def row_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event's place in its batch's hash chain."""
    rows = hashed(spark, sf_dir).select("trace_id", "pos", "row_index", "canonical")
    return O.hash_chain(rows, "trace_id", ["pos"], "canonical").select("trace_id", "row_index", "prev_hash", "event_hash")


def row_chain_root(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.chain_roots(results(spark, sf_dir))


def chain_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored chains against their events; all batches but the first are spoiled: a hash, a link, a lost entry, a root."""
    events = written(hashed(spark, sf_dir).select("trace_id", "pos", "canonical"), "events")
    entries = written(O.hash_chain(events, "trace_id", ["pos"], "canonical").select("trace_id", "pos", "prev_hash", "event_hash"), "entries")
    roots = entries.groupBy("trace_id").agg(F.max_by("event_hash", "pos").alias("root"), F.max("pos").alias("last"))
    bad = lambda batch, at: (F.col("trace_id") == batch) & (F.col("pos") == at)
    entries = entries.join(roots.select("trace_id", "last"), "trace_id").where(~bad("B4", F.col("last"))).drop("last")
    entries = entries.withColumn("event_hash", F.when(bad("B2", 5), "f" * 64).otherwise(F.col("event_hash"))).withColumn("prev_hash", F.when(bad("B3", 3), "e" * 64).otherwise(F.col("prev_hash")))
    roots = roots.select("trace_id", F.when(F.col("trace_id") == "B5", "d" * 64).otherwise(F.col("root")).alias("root"))
    return E.checked_chain(events, entries, roots).drop("computed_root")


def replay_determinism(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roots of three runs over rows in other orders and partitions."""
    own = results(spark, sf_dir)
    runs = []
    for parts in (3, 7, 11):
        runs.append(E.chain_roots(own.repartition(parts, F.xxhash64(F.lit(parts), "row_index"))))
    return E.replayed(runs)


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = E.stable_order(results(spark, sf_dir)).withColumn("match_type", F.when(F.col("layer") == "L1_EXACT", "EXACT_MATCH").otherwise("NO_MATCH"))
    return E.chunk_digests(rows.select("trace_id", "pos", E.chunk_record().alias("record")), 500, CHUNK_TIME, CHUNK_VERSIONS)


def chunk_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks(spark, sf_dir)


def chunk_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches whose chunks have digests; those of odd chunks of one batch are lost."""
    lost = (F.col("trace_id") == "B3") & (F.col("chunk") % 2 == 1)
    return E.chunk_coverage(chunks(spark, sf_dir).withColumn("digest", F.when(~lost, F.col("digest"))))


def chunk_chain_root(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.hash_chain(chunks(spark, sf_dir), "trace_id", ["chunk"], "digest").groupBy("trace_id").agg(F.max_by("event_hash", "chunk").alias("root"), F.count(F.lit(1)).alias("chunks"))


def dataset_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = E.stable_order(results(spark, sf_dir)).select("trace_id", "pos", "original")
    return O.digests(rows, "trace_id", ["pos"], "original").withColumnRenamed("digest", "dataset_hash")


def dataset_hash_v1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digest of the originals as one canonical JSON list."""
    rows = E.stable_order(results(spark, sf_dir)).select("trace_id", "pos", J.text(F.col("original")).alias("item"))
    return O.digests(rows, "trace_id", ["pos"], "item", ",", "[", "]").withColumnRenamed("digest", "dataset_hash")


def tenant_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.substring(E.hmac_sha256(b"scope", F.col("s_name")), 1, 16).alias("scope"), F.substring(F.sha2("s_name", 256), 1, 16).alias("tenant_hash"))


def receipt_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A receipt for each batch and the root of its chain."""
    return row_chain_root(spark, sf_dir).select("trace_id", E.receipt_id(F.col("trace_id"), F.col("root")).alias("receipt_id"))


def ledger_event_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results(spark, sf_dir).select("row_index", E.event_id(F.col("trace_id"), F.col("row_index") % 4, F.col("original")).alias("event_id"))


def rfc3339_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    text = F.concat(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"), F.when(k % 3 == 0, F.concat(F.lit("."), (k % 90 + 10).cast("string"))).otherwise(""), F.when(k % 2 == 0, "Z").otherwise("+00:00"))
    return table(spark, sf_dir, "orders").select("o_orderkey", E.rfc3339(text).alias("t"))


def leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", E.leaf_hash(F.unhex(F.sha2("p_name", 256))).alias("hash"))
    return O.numbered(p, "p_partkey").select(F.col("n").alias("idx"), "hash")


def merkle_level1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.merkle_levels(leaves(spark, sf_dir), 1)[1]


def merkle_root(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.merkle_root(leaves(spark, sf_dir))


def merkle_proofs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A proof for every leaf, each checked against the root."""
    own = leaves(spark, sf_dir)
    proofs = E.inclusion_proofs(own)
    root = E.merkle_root(own)
    checked = proofs.select("idx", F.size("proof").cast("long").alias("steps"), E.proven_root(F.col("hash"), F.col("proof")).alias("root"))
    return checked.join(root.withColumn("proven", F.lit(True)), "root", "left").select("idx", "steps", F.coalesce("proven", F.lit(False)).alias("proven"))


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("seconds", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).withColumn("cents", F.round(F.col("value") * 100).cast("long"))


def rate_limiter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.sliding_limiter(ticks(spark, sf_dir).select("user_id", "event_id", "seconds"), "user_id", ["seconds", "event_id"], "seconds", 3, 36_000.0).select("user_id", "event_id", "allowed", "remaining")


def rate_limit_window_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests of a user in the hour up to each."""
    w = Window.partitionBy("user_id").orderBy(F.unix_micros(F.col("ts").cast("timestamp"))).rangeBetween(-3_600_000_000, 0)
    return table(spark, sf_dir, "events").select("event_id", F.count(F.lit(1)).over(w).alias("n"))


def token_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ticks(spark, sf_dir).select("user_id", "event_id", "seconds")
    return O.token_bucket(rows, "user_id", ["seconds", "event_id"], "seconds", 0.01, 3.0).select("user_id", "event_id", "allowed", "retry_after")


def circuit_breaker(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ticks(spark, sf_dir).select("user_id", "event_id", "seconds", (F.col("event_type") == "error").alias("failed"))
    return O.circuit_breaker(rows, "user_id", ["seconds", "event_id"], "seconds", "failed", 2, 86_400.0, 1).select("user_id", "event_id", "state", "let_through")


def ledger_conditional(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ticks(spark, sf_dir).select("user_id", "event_id", "ts", "cents")
    return O.ledger(rows, "user_id", ["ts", "event_id"], "cents", 20_000).select("user_id", "event_id", "status", "remaining")


def ledger_running_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return ticks(spark, sf_dir).select("user_id", "event_id", (F.lit(100_000) - F.sum("cents").over(w)).alias("remaining"))


def concurrency_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases and clicks as taken and freed slots: how many are taken after each event."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    change = F.when(F.col("event_type") == "click", 1).when(F.col("event_type") == "purchase", -1).otherwise(0)
    return table(spark, sf_dir, "events").select("user_id", "event_id", F.sum(change).over(w).alias("taken"))


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, k = F.col("o_orderpriority"), F.col("o_orderkey")
    status = F.when(k % 5 == 0, "decided").when(k % 5 == 1, "assigned").when(k % 5 == 2, "escalated").otherwise("pending")
    rows = table(spark, sf_dir, "orders").select(
        k.alias("case_id"), F.when(p.startswith("1"), "urgent").when(p.startswith("2"), "high").otherwise("standard").alias("priority"), status.alias("status"), F.col("o_orderdate").alias("created_at"), F.when(k % 5 == 1, F.element_at(F.array(*map(F.lit, REVIEWERS)), (k % 3 + 1).cast("int"))).alias("reviewer"), (k % 4).alias("moves"),
    )
    return rows.withColumn("due", V.deadline(F.col("priority"), F.col("created_at")))


CASES = f"""cases AS (SELECT *, created_at + to_hours(CASE priority WHEN 'urgent' THEN 1 WHEN 'high' THEN 4 ELSE 24 END) AS due FROM (
  SELECT o_orderkey AS case_id, CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'urgent' WHEN '2' THEN 'high' ELSE 'standard' END AS priority, CASE o_orderkey % 5 WHEN 0 THEN 'decided' WHEN 1 THEN 'assigned' WHEN 2 THEN 'escalated' ELSE 'pending' END AS status,
    o_orderdate AS created_at, CASE WHEN o_orderkey % 5 = 1 THEN ['ana', 'bo', 'chi'][(o_orderkey % 3 + 1)::INT] END AS reviewer, o_orderkey % 4 AS moves FROM orders))"""
LATE = f"status IN ('pending', 'assigned') AND due < TIMESTAMP '{AS_OF}'"


def sla_deadlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cases(spark, sf_dir).select("case_id", "priority", "due", V.breached(F.col("status"), F.col("due"), F.lit(AS_OF).cast("timestamp")).alias("breached"))


def sla_breaches(spark: SparkSession, sf_dir: str) -> DataFrame:
    late = V.breached(F.col("status"), F.col("due"), F.lit(AS_OF).cast("timestamp"))
    return cases(spark, sf_dir).where(late).groupBy("priority", "status").agg(F.count(F.lit(1)).alias("n"), F.min("due").alias("oldest"))


def queue_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cases(spark, sf_dir).groupBy("priority").agg(*(F.count_if(F.col("status") == s).alias(s) for s in ("pending", "assigned", "decided", "escalated")))


def stale_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    late = cases(spark, sf_dir).where(V.breached(F.col("status"), F.col("due"), F.lit(AS_OF).cast("timestamp")))
    return late.select("case_id", V.stale_action(F.col("reviewer"), F.col("moves"), REVIEWERS).alias("a")).select("case_id", "a.action", "a.new_reviewer")


def round_robin_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.round_robin(cases(spark, sf_dir).where("status = 'pending'").select("case_id"), "case_id", REVIEWERS)


def capacity_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a user as changes of a team's cases: purchases close one of a reviewer's, all others open one; two at most for each."""
    who = F.element_at(F.array(*map(F.lit, REVIEWERS)), (F.col("event_id") % 3 + 1).cast("int"))
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", (F.col("event_type") != "purchase").alias("opens"), who.alias("reviewer"))
    return V.with_capacity(rows, "user_id", ["ts", "event_id"], "opens", "reviewer", REVIEWERS, 2).select("event_id", "assigned_to", "active")


def finalized_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of eight shards, finalized in three calls: one before all shards of a batch are in, then two at once on the same state."""
    rows = written(results(spark, sf_dir).withColumn("shard", F.col("row_index") % 8), "decisions")
    store = shared_path(spark, "finalized")
    early = rows.where("NOT (trace_id = 'B3' AND shard = 5)")
    Z.commit(Z.finalized(early, Z.ready(early, Z.committed(spark, store), 8)), store)
    both = [Z.finalized(rows, Z.ready(rows, Z.committed(spark, store), 8)) for _ in range(2)]
    for each in both:  # planned before either has committed
        Z.commit(each, store)
    return Z.committed(spark, store).select("trace_id", "rows", "root", "receipt_id", "replayed")


def review_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = [*V.AFTER, "shrug"]
    decision = F.element_at(F.array(*map(F.lit, kinds)), (F.col("case_id") % len(kinds) + 1).cast("int"))
    return cases(spark, sf_dir).select("case_id", decision.alias("decision"), V.decided(F.col("status"), decision).alias("new_status"))


LIST = (
    record_hashes, stable_order_v2, row_chain, row_chain_root, chain_verify, replay_determinism, chunk_digest, chunk_evidence, chunk_chain_root, dataset_hash, dataset_hash_v1, tenant_scope, receipt_ids, ledger_event_ids, rfc3339_times, merkle_level1, merkle_root, merkle_proofs, rate_limiter, rate_limit_window_counts, token_bucket, circuit_breaker,
    ledger_conditional, ledger_running_balance, concurrency_slots, sla_deadlines, sla_breaches, queue_stats, stale_actions, round_robin_assignment, capacity_assignment, finalized_batches, review_decisions,
)
QUERIES = {f.__name__: f for f in LIST}

_NUMBER = "CASE WHEN confidence = 0 THEN '0' ELSE rtrim(rtrim(round(confidence, 6)::DECIMAL(30,6)::VARCHAR, '0'), '.') END"
_JSON = "'{{\"confidence\":' || " + _NUMBER + " || ',\"decision_path\":\"' || decision_path || '\",\"entity_type\":\"' || entity_type || '\",\"layer\":\"' || {layer} || '\",\"original\":\"' || original || '\",\"resolved\":' || coalesce('\"' || resolved || '\"', 'null') || '}}'"
HASHED = f"""{RESULTS}, hashed AS (SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY strftime(source_timestamp, '%Y-%m-%dT%H:%M:%S.%fZ'), sha256(original), row_index) AS pos,
  {_JSON.format(layer="CASE WHEN layer = 'L3_CACHED' THEN 'L3_LLM' ELSE layer END")} AS canonical, sha256({_JSON.format(layer="layer")}) AS record_hash FROM results)"""
_RECORD = """'{"decision_path":"' || decision_path || '","entity_type":"' || entity_type || '","latency_ms":0.0,"layer":"' || layer || '","llm_used":' || starts_with(layer, 'L3')::VARCHAR || ',"match_id":null,"match_type":"' || CASE layer WHEN 'L1_EXACT' THEN 'EXACT_MATCH' ELSE 'NO_MATCH' END || '","original_input":"' || original || '","output_confidence":' || confidence::VARCHAR || ',"pii_detected":[],"resolved_output":' || coalesce('"' || resolved || '"', 'null') || ',"row_index":' || row_index || ',"sanitized_input":"' || original || '","sustainability":null}'"""
_CHUNKS = f"""pieces AS (SELECT trace_id, (pos - 1) // 500 AS chunk, count(*)::BIGINT AS rows, string_agg({_RECORD}, ',' ORDER BY pos) AS records FROM hashed GROUP BY 1, 2),
parts AS (SELECT *, count(*) OVER (PARTITION BY trace_id) AS chunks FROM pieces),
chunks AS (SELECT trace_id, chunk, rows, sha256('{{"batch_id":"' || trace_id || '","chunk_count":' || chunks || ',"chunk_index":' || chunk || ',"config_version":"sha256:c","created_at_utc":"{CHUNK_TIME}","records":[' || records || '],"row_end":' || (chunk * 500 + rows) || ',"row_start":' || chunk * 500 || ',"rows_in_chunk":' || rows || ',"sanitization_version":"1","schema_version":"chunk_v1","watchlist_version_hash":"sha256:w"}}') AS digest FROM parts)"""
_FOLD = "list_reduce({}, lambda a, b: sha256(a || ':' || b), repeat('0', 64))"
_TICKS = "ticks AS MATERIALIZED (SELECT user_id, event_id, epoch_us(ts) / 1e6::DOUBLE AS s, event_type = 'error' AS failed, round(value * 100)::BIGINT AS cents, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events)"
_LEAVES = "leaves AS (SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS idx, sha256('\\x00'::BLOB || unhex(sha256(p_name))) AS hash FROM part)"
_UP = "SELECT idx // 2 AS idx, CASE WHEN count(*) = 2 THEN sha256('\\x01'::BLOB || unhex(arg_min(hash, idx)) || unhex(arg_max(hash, idx))) ELSE min(hash) END AS hash FROM {} GROUP BY 1"
ORACLE = {
    "record_hashes": f"WITH {HASHED} SELECT trace_id, row_index, record_hash FROM hashed",
    "stable_order_v2": f"WITH {HASHED} SELECT trace_id, row_index, pos::BIGINT AS pos FROM hashed",
    "row_chain_root": f"WITH {HASHED} SELECT trace_id, {_FOLD.format('list(canonical ORDER BY pos)')} AS root, count(*)::BIGINT AS n FROM hashed GROUP BY 1",
    "chain_verify": f"""WITH {RESULTS}, n AS (SELECT trace_id, count(*)::BIGINT AS events FROM results GROUP BY 1)
SELECT trace_id, trace_id = 'B1' AS valid, CASE trace_id WHEN 'B2' THEN 'event_hash_mismatch' WHEN 'B3' THEN 'prev_hash_link_broken' WHEN 'B4' THEN 'chain_length_mismatch' WHEN 'B5' THEN 'root_hash_mismatch' END AS error,
  CASE trace_id WHEN 'B2' THEN 4::BIGINT WHEN 'B3' THEN 2::BIGINT END AS broken_at, events, events - (trace_id = 'B4')::BIGINT AS entries FROM n""",
    "replay_determinism": f"WITH {HASHED} SELECT trace_id, 3::BIGINT AS runs, 0::BIGINT AS variance, {_FOLD.format('list(canonical ORDER BY pos)')} AS root, true AS passed FROM hashed GROUP BY 1",
    "chunk_digest": f"WITH {HASHED}, {_CHUNKS} SELECT * FROM chunks",
    "chunk_evidence": f"WITH {HASHED}, {_CHUNKS}, d AS (SELECT *, trace_id = 'B3' AND chunk % 2 = 1 AS lost FROM chunks) SELECT trace_id, count(*)::BIGINT AS chunk_count, sum(rows)::BIGINT AS total_records, count_if(NOT lost)::BIGINT AS chunks_with_digest, count_if(lost) = 0 AS valid FROM d GROUP BY 1",
    "chunk_chain_root": f"WITH {HASHED}, {_CHUNKS} SELECT trace_id, {_FOLD.format('list(digest ORDER BY chunk)')} AS root, count(*)::BIGINT AS chunks FROM chunks GROUP BY 1",
    "dataset_hash": f"WITH {HASHED} SELECT trace_id, sha256(string_agg(original, chr(10) ORDER BY pos)) AS dataset_hash FROM hashed GROUP BY 1",
    "dataset_hash_v1": f"WITH {HASHED} SELECT trace_id, sha256('[' || string_agg('\"' || original || '\"', ',' ORDER BY pos) || ']') AS dataset_hash FROM hashed GROUP BY 1",
    "receipt_ids": f"WITH {HASHED}, r AS (SELECT trace_id, sha256(trace_id || ':' || {_FOLD.format('list(canonical ORDER BY pos)')}) AS h FROM hashed GROUP BY 1) SELECT trace_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12) AS receipt_id FROM r",
    "ledger_event_ids": f"WITH {RESULTS} SELECT row_index, sha256(trace_id || ':' || (row_index % 4)::VARCHAR || ':' || original) AS event_id FROM results",
    "rfc3339_times": "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') || '.' || CASE WHEN o_orderkey % 3 = 0 THEN (o_orderkey % 90 + 10)::VARCHAR || '0000' ELSE '000000' END || 'Z' AS t FROM orders",
    "tenant_scope": f"""SELECT s_suppkey, substr(sha256(unhex('{bytes(b ^ 0x5C for b in b'scope'.ljust(64, bytes(1))).hex()}') || unhex(sha256(unhex('{bytes(b ^ 0x36 for b in b'scope'.ljust(64, bytes(1))).hex()}') || encode(s_name)))), 1, 16) AS scope, substr(sha256(s_name), 1, 16) AS tenant_hash FROM supplier""",
    "merkle_proofs": """WITH RECURSIVE n AS (SELECT count(*) AS n FROM part), up AS (
  SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS idx, row_number() OVER (ORDER BY p_partkey) - 1 AS spot, n, 0 AS steps FROM part, n
  UNION ALL SELECT idx, spot // 2, (n + 1) // 2, steps + CASE WHEN spot % 2 = 0 AND spot + 1 = n THEN 0 ELSE 1 END FROM up WHERE n > 1)
SELECT idx, max(steps)::BIGINT AS steps, true AS proven FROM up GROUP BY 1""",
    "row_chain": f"""WITH RECURSIVE {HASHED}, walk AS (
  SELECT trace_id, row_index, pos, repeat('0', 64) AS prev_hash, sha256(repeat('0', 64) || ':' || canonical) AS event_hash FROM hashed WHERE pos = 1
  UNION ALL SELECT h.trace_id, h.row_index, h.pos, w.event_hash, sha256(w.event_hash || ':' || h.canonical) FROM walk w JOIN hashed h ON h.trace_id = w.trace_id AND h.pos = w.pos + 1)
SELECT trace_id, row_index, prev_hash, event_hash FROM walk""",
    "rate_limiter": f"""WITH RECURSIVE {_TICKS}, walk AS (
  SELECT user_id, event_id, k, [s] AS past, true AS allowed, 2::BIGINT AS remaining FROM ticks WHERE k = 1
  UNION ALL SELECT user_id, event_id, k, CASE WHEN len(kept) < 3 THEN list_append(kept, s) ELSE kept END, len(kept) < 3, greatest(0, 2 - len(kept))::BIGINT
  FROM (SELECT t.*, list_filter(w.past, lambda x: x > t.s - 36000.0) AS kept FROM walk w JOIN ticks t ON t.user_id = w.user_id AND t.k = w.k + 1))
SELECT user_id, event_id, allowed, remaining FROM walk""",
    "token_bucket": f"""WITH RECURSIVE {_TICKS}, walk AS (
  SELECT user_id, event_id, k, s, 2.0::DOUBLE AS tokens, true AS allowed, 0::BIGINT AS retry_after FROM ticks WHERE k = 1
  UNION ALL SELECT user_id, event_id, k, s, CASE WHEN full_ >= 1 THEN full_ - 1 ELSE full_ END, full_ >= 1, CASE WHEN full_ >= 1 THEN 0 ELSE trunc((1.0::DOUBLE - full_) / (0.01::DOUBLE / 60.0::DOUBLE))::BIGINT + 1 END
  FROM (SELECT t.*, least(3.0::DOUBLE, w.tokens + greatest(0.0::DOUBLE, t.s - w.s) * (0.01::DOUBLE / 60.0::DOUBLE)) AS full_ FROM walk w JOIN ticks t ON t.user_id = w.user_id AND t.k = w.k + 1))
SELECT user_id, event_id, allowed, retry_after FROM walk""",
    "circuit_breaker": f"""WITH RECURSIVE {_TICKS}, walk AS (
  SELECT user_id, event_id, k, 'closed' AS seen, true AS let_through, 'closed' AS state, failed::INT AS bad, 0.0::DOUBLE AS opened FROM ticks WHERE k = 1
  UNION ALL SELECT user_id, event_id, k, now, now <> 'open',
    CASE WHEN now = 'open' THEN 'open' WHEN failed THEN CASE WHEN now = 'half_open' OR bad + 1 >= 2 THEN 'open' ELSE now END ELSE 'closed' END,
    CASE WHEN now = 'open' THEN bad WHEN failed THEN bad + (now = 'closed')::INT ELSE 0 END, CASE WHEN now <> 'open' AND failed AND (now = 'half_open' OR bad + 1 >= 2) THEN s ELSE opened END
  FROM (SELECT t.*, w.bad, w.opened, CASE WHEN w.state = 'open' AND t.s - w.opened >= 86400.0 THEN 'half_open' ELSE w.state END AS now FROM walk w JOIN ticks t ON t.user_id = w.user_id AND t.k = w.k + 1))
SELECT user_id, event_id, seen AS state, let_through FROM walk""",
    "ledger_conditional": f"""WITH RECURSIVE {_TICKS}, walk AS (
  SELECT user_id, event_id, k, CASE WHEN cents > 20000 THEN 'rejected' ELSE 'applied' END AS status, (20000 - CASE WHEN cents BETWEEN 1 AND 20000 THEN cents ELSE 0 END)::BIGINT AS remaining FROM ticks WHERE k = 1
  UNION ALL SELECT t.user_id, t.event_id, t.k, CASE WHEN t.cents > w.remaining AND t.cents > 0 THEN 'rejected' ELSE 'applied' END, w.remaining - CASE WHEN t.cents > 0 AND t.cents <= w.remaining THEN t.cents ELSE 0 END FROM walk w JOIN ticks t ON t.user_id = w.user_id AND t.k = w.k + 1)
SELECT user_id, event_id, status, remaining FROM walk""",
    "merkle_level1": f"WITH {_LEAVES} {_UP.format('leaves')}",
    "merkle_root": f"WITH RECURSIVE {_LEAVES}, t AS (SELECT 0 AS level, idx, hash, count(*) OVER () AS n FROM leaves UNION ALL SELECT * FROM (SELECT level + 1 AS level, idx, hash, count(*) OVER () AS n FROM (SELECT max(level) AS level, idx // 2 AS idx, CASE WHEN count(*) = 2 THEN sha256('\\x01'::BLOB || unhex(arg_min(hash, idx)) || unhex(arg_max(hash, idx))) ELSE min(hash) END AS hash FROM t WHERE n > 1 GROUP BY idx // 2))) SELECT hash AS root FROM t WHERE n = 1",
    "rate_limit_window_counts": "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 3600000000 PRECEDING AND CURRENT ROW)::BIGINT AS n FROM events",
    "ledger_running_balance": "SELECT user_id, event_id, (100000 - sum(round(value * 100)::BIGINT) OVER (PARTITION BY user_id ORDER BY ts, event_id))::BIGINT AS remaining FROM events",
    "concurrency_slots": "SELECT user_id, event_id, (sum(CASE event_type WHEN 'click' THEN 1 WHEN 'purchase' THEN -1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id))::BIGINT AS taken FROM events",
    "sla_deadlines": f"WITH {CASES} SELECT case_id, priority, due, {LATE} AS breached FROM cases",
    "sla_breaches": f"WITH {CASES} SELECT priority, status, count(*)::BIGINT AS n, min(due) AS oldest FROM cases WHERE {LATE} GROUP BY ALL",
    "queue_stats": f"WITH {CASES} SELECT priority, count_if(status = 'pending')::BIGINT AS pending, count_if(status = 'assigned')::BIGINT AS assigned, count_if(status = 'decided')::BIGINT AS decided, count_if(status = 'escalated')::BIGINT AS escalated FROM cases GROUP BY 1",
    "stale_actions": f"WITH {CASES} SELECT case_id, CASE WHEN moves >= 2 THEN 'escalate' ELSE 'reassign' END AS action, CASE WHEN moves < 2 THEN CASE WHEN reviewer = 'ana' THEN 'bo' ELSE 'ana' END END AS new_reviewer FROM cases WHERE {LATE}",
    "round_robin_assignment": f"WITH {CASES} SELECT case_id, ['ana', 'bo', 'chi'][((row_number() OVER (ORDER BY case_id) - 1) % 3 + 1)::INT] AS assigned_to FROM cases WHERE status = 'pending'",
    "capacity_assignment": """WITH RECURSIVE c AS MATERIALIZED (SELECT user_id, event_id, event_type <> 'purchase' AS opens, (event_id % 3 + 1)::INT AS who, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
walk AS (SELECT DISTINCT user_id, 0::BIGINT AS k, NULL::BIGINT AS event_id, 0 AS turn, [0, 0, 0] AS active, NULL::INT AS who, false AS opens FROM c
  UNION ALL SELECT user_id, k, event_id, CASE WHEN opens AND pick IS NOT NULL THEN pick % 3 ELSE turn END, list_transform(active, lambda a, i: CASE WHEN pick IS NULL OR i <> pick THEN a WHEN opens THEN a + 1 ELSE greatest(a - 1, 0) END), pick, opens
  FROM (SELECT c.user_id, c.k, c.event_id, c.opens, w.turn, w.active, CASE WHEN NOT c.opens THEN c.who WHEN w.active[w.turn % 3 + 1] < 2 THEN w.turn % 3 + 1 WHEN w.active[(w.turn + 1) % 3 + 1] < 2 THEN (w.turn + 1) % 3 + 1 WHEN w.active[(w.turn + 2) % 3 + 1] < 2 THEN (w.turn + 2) % 3 + 1 ELSE NULL END AS pick
    FROM walk w JOIN c ON c.user_id = w.user_id AND c.k = w.k + 1))
SELECT event_id, CASE WHEN opens THEN ['ana', 'bo', 'chi'][who] END AS assigned_to, active[who]::BIGINT AS active FROM walk WHERE k > 0""",
    "review_decisions": f"""WITH {CASES}, d AS (SELECT case_id, status, ['approve', 'reject', 'escalate', 'request_more_evidence', 'reopen', 'shrug'][(case_id % 6 + 1)::INT] AS decision FROM cases)
SELECT case_id, decision, CASE WHEN status <> 'decided' THEN CASE WHEN decision IN ('approve', 'reject') THEN 'decided' WHEN decision = 'escalate' THEN 'escalated' WHEN decision IN ('request_more_evidence', 'reopen') THEN 'pending' END END AS new_status FROM d""",
}
ORACLE["finalized_batches"] = f"SELECT a.trace_id, a.n AS rows, a.root, b.receipt_id, true AS replayed FROM ({ORACLE['row_chain_root']}) a JOIN ({ORACLE['receipt_ids']}) b ON a.trace_id = b.trace_id"
