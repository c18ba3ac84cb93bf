"""Canonical records, digests of chunks, and Merkle trees."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import canonical as J
from ..functions.names import let
from ..shared import unused
from . import ordered as O

#: Layers that only say where a cached answer came from, and the layer that they stand for.
SAME_LAYER = {"L3_CACHED": "L3_LLM", "L3_FIRESTORE_CACHED": "L3_LLM", "L3_PERSON_CACHED": "L3_PERSON_LLM"}
FIELDS = ["confidence", "decision_path", "entity_type", "layer", "original", "resolved"]


def json_number(x: Column) -> Column:
    """A number of six decimals at most without trailing zeros; below 0.0001 with an exponent of two digits."""
    micro = F.round(F.abs(x) * 1_000_000).cast("long")
    sign = F.when(x < 0, "-").otherwise("")
    plain = F.regexp_replace(F.regexp_replace(F.round(F.abs(x), 6).cast("decimal(30,6)").cast("string"), "0+$", ""), r"\.$", "")
    tiny = F.when(micro < 10, F.concat(micro.cast("string"), F.lit("e-06"))).otherwise(F.concat(F.regexp_replace(F.format_string("%d.%d", (micro / 10).cast("long"), micro % 10), r"\.0$", ""), F.lit("e-05")))
    return F.when(micro == 0, "0").otherwise(F.concat(sign, F.when(micro < 100, tiny).otherwise(plain)))


def canonical_layer(layer: Column) -> Column:
    return F.coalesce(*(F.when(layer == k, v) for k, v in SAME_LAYER.items()), layer)


def canonical_decision(same_layer: bool = True) -> Column:
    """The canonical JSON of a decision: six fields by name, without what differs between runs."""
    text = lambda c: J.text(F.coalesce(F.col(c), F.lit("")))
    layer = F.coalesce(F.col("layer"), F.lit(""))
    parts = {"confidence": json_number(F.coalesce("confidence", F.lit(0.0))), "decision_path": text("decision_path"), "entity_type": text("entity_type"), "layer": J.text(canonical_layer(layer) if same_layer else layer), "original": text("original"), "resolved": J.text(F.col("resolved"))}
    return J.record(parts)


def utc_text(t: Column) -> Column:
    return F.coalesce(F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"), F.lit("1970-01-01T00:00:00.000000Z"))


def rfc3339(t: Column) -> Column:
    """A UTC time of six decimals from its RFC 3339 text; anything else raises: other zones, other forms."""
    good = t.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d{1,9})?(Z|[+-]00:00)$")
    digits = F.rpad(F.substring(F.regexp_extract(t, r"\.(\d+)", 1), 1, 6), 6, "0")
    return F.when(good, F.concat(F.substring(t, 1, 19), F.lit("."), digits, F.lit("Z"))).when(t.isNotNull(), F.raise_error(F.concat(F.lit("not a UTC time: "), t)).cast("string"))


def _order(results: DataFrame) -> tuple[DataFrame, list[str]]:
    """results with what their order in a batch goes by: time, hash of the input, row index."""
    at, digest = unused(results, "at", "digest")
    rows = results.withColumn(at, utc_text(F.col("source_timestamp"))).withColumn(digest, F.unhex(F.sha2(F.coalesce("original", F.lit("")), 256)))
    return rows, [at, digest, "row_index"]


def stable_order(results: DataFrame) -> DataFrame:
    """results with pos, each row's place in its batch by time, hash of the input and row index.

    A batch may hold a third of all rows: places come from ranges of equal size, counted first.
    """
    rows, order = _order(results)
    return O.placed(rows, "trace_id", order, "pos").drop(*order[:2])


def chain_roots(results: DataFrame) -> DataFrame:
    """trace_id, root and n of the hash chain of each batch's canonical decisions in stable order. Places are not needed, so rows are moved once."""
    rows, order = _order(results)
    canonical = unused(rows, "canonical")[0]
    return O.chain_roots(rows.withColumn(canonical, canonical_decision()), "trace_id", order, canonical)


#: The form of a chunk of decisions.
CHUNK_SCHEMA = "chunk_v1"


def chunk_record() -> Column:
    """The canonical JSON of a decision as evidence of its batch's chunk."""
    c, text = F.col, J.ascii_text
    none = F.lit("null")
    return J.record({
        "row_index": J.whole(c("row_index")), "original_input": text(c("original")), "sanitized_input": text(c("original")), "pii_detected": F.lit("[]"), "entity_type": text(c("entity_type")), "decision_path": text(c("decision_path")), "layer": text(c("layer")), "resolved_output": text(c("resolved")),
        "output_confidence": J.double(c("confidence")), "match_type": text(c("match_type")), "match_id": none, "latency_ms": F.lit("0.0"), "llm_used": J.whole(c("layer").startswith("L3")), "sustainability": none,
    })


def chunk_digests(placed: DataFrame, size: int, made_at: str, versions: dict[str, str]) -> DataFrame:
    """trace_id, chunk, rows and digest of a batch's chunks of a fixed number of rows, in order of pos.

    placed: trace_id, pos and record (chunk_record). The digest is that of the chunk's canonical JSON without it.
    """
    chunk = F.floor((F.col("pos") - 1) / size)
    counts = placed.groupBy("trace_id").agg(F.ceil(F.count(F.lit(1)) / size).alias("chunks"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("pos", "record"))), lambda r: r["record"])
    rows = placed.groupBy("trace_id", chunk.alias("chunk")).agg(ordered.alias("records"), F.count(F.lit(1)).alias("rows")).join(counts, "trace_id")
    start = F.col("chunk") * size
    fields = {"schema_version": F.lit(f'"{CHUNK_SCHEMA}"'), "batch_id": J.ascii_text(F.col("trace_id")), "chunk_index": J.whole(F.col("chunk")), "chunk_count": J.whole(F.col("chunks")), "row_start": J.whole(start), "row_end": J.whole(start + F.col("rows")), "rows_in_chunk": J.whole(F.col("rows")), "created_at_utc": J.text(F.lit(made_at))}
    fields |= {k: J.text(F.lit(v)) for k, v in versions.items()} | {"records": J.items(F.col("records"))}
    return rows.select("trace_id", "chunk", "rows", F.sha2(J.record(fields), 256).alias("digest"))


def chunk_coverage(chunks: DataFrame) -> DataFrame:
    """For each batch its chunks, their rows, those with a digest, and whether all have one."""
    out = chunks.groupBy("trace_id").agg(F.count(F.lit(1)).alias("chunk_count"), F.sum("rows").alias("total_records"), F.count_if(F.coalesce(F.col("digest") != "", F.lit(False))).alias("chunks_with_digest"))
    return out.withColumn("valid", F.col("chunks_with_digest") == F.col("chunk_count"))


def checked_chain(events: DataFrame, entries: DataFrame, roots: DataFrame) -> DataFrame:
    """valid, error, broken_at (from 0), events, entries and computed_root of each batch's chain.

    events: trace_id, pos, canonical; entries: trace_id, pos, prev_hash, event_hash; roots: trace_id, root. The first fault
    of a batch is told: another number of entries, a link to another hash than the one before, a hash that is not its
    event's, another root. Entries meet their events and those before them by batch and place, so no task gets a batch.
    """
    before = entries.select("trace_id", (F.col("pos") + 1).alias("pos"), F.col("event_hash").alias("before"))
    met = events.select("trace_id", "pos", "canonical", F.lit(1).alias("event")).join(entries.withColumn("entry", F.lit(1)), ["trace_id", "pos"], "full_outer").join(before, ["trace_id", "pos"], "left")
    link = ~F.col("prev_hash").eqNullSafe(F.when(F.col("pos") == 1, F.lit(O.GENESIS)).otherwise(F.col("before")))
    hashed = ~F.sha2(F.concat_ws(":", "prev_hash", "canonical"), 256).eqNullSafe(F.col("event_hash"))
    fault = F.when(link, "prev_hash_link_broken").when(hashed, "event_hash_mismatch")
    per = met.groupBy("trace_id").agg(F.count("event").alias("events"), F.count("entry").alias("entries"), F.min(F.when(fault.isNotNull(), F.struct("pos", fault.alias("fault")))).alias("first"), F.max_by("event_hash", "pos").alias("computed_root"))
    per = per.join(roots, "trace_id", "left").withColumn("computed_root", F.coalesce("computed_root", F.lit(O.GENESIS)))
    short, other = F.col("events") != F.col("entries"), ~F.col("computed_root").eqNullSafe(F.col("root"))
    error = F.when(short, "chain_length_mismatch").when(F.col("first").isNotNull(), F.col("first.fault")).when(other, F.when(F.col("events") == 0, "empty_chain_root_mismatch").otherwise("root_hash_mismatch"))
    return per.select("trace_id", error.isNull().alias("valid"), error.alias("error"), F.when(~short, F.col("first.pos") - 1).alias("broken_at"), "events", "entries", "computed_root")


def replayed(runs: list[DataFrame]) -> DataFrame:
    """runs, variance (those whose root is not the first's), passed and root of each batch, from the roots of several runs."""
    every = reduce(DataFrame.unionByName, (r.select("trace_id", "root", F.lit(k).alias("k")) for k, r in enumerate(runs)))
    per = every.groupBy("trace_id").agg(F.sort_array(F.collect_list(F.struct("k", "root"))).alias("all"))
    first = F.col("all")[0]["root"]
    per = per.select("trace_id", F.size("all").cast("long").alias("runs"), F.size(F.filter("all", lambda r: r["root"] != first)).cast("long").alias("variance"), first.alias("root"))
    return per.withColumn("passed", (F.col("variance") == 0) & (F.col("runs") == len(runs)))


def receipt_id(batch: Column, root: Column) -> Column:
    """A batch's receipt by its root, in the form of a UUID."""
    h = F.sha2(F.concat_ws(":", batch, root), 256)
    return F.concat_ws("-", *(F.substring(h, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))


def event_id(batch: Column, shard: Column, fingerprint: Column) -> Column:
    return F.sha2(F.concat_ws(":", batch, shard.cast("string"), fingerprint), 256)


def leaf_hash(data: Column) -> Column:
    return F.sha2(F.concat(F.unhex(F.lit("00")), data), 256)


def node_hash(left: Column, right: Column) -> Column:
    return F.sha2(F.concat(F.unhex(F.lit("01")), F.unhex(left), F.unhex(right)), 256)


def _halved(nodes: Column) -> Column:
    """One level up: pairs are hashed, an odd node goes up as it is."""
    top = ((F.size(nodes) - 1) / 2).cast("int")
    at = lambda i: F.try_element_at(nodes, i)
    return F.transform(F.sequence(F.lit(0), top), lambda i: F.coalesce(node_hash(at(2 * i + 1), at(2 * i + 2)), at(2 * i + 1)))


def merkle_root(leaves: DataFrame, leaf_bits: int = 10, rounds: int = 4) -> DataFrame:
    """root of leaves (idx from 0, hash). A round takes 2^leaf_bits neighbours at a time up leaf_bits levels; rounds bound the leaves to 2^(leaf_bits*rounds)."""
    cur = leaves.select("idx", "hash")
    for _ in range(rounds):
        group = F.floor(F.col("idx") / (1 << leaf_bits))
        nodes = F.transform(F.array_sort(F.collect_list(F.struct("idx", "hash"))), lambda n: n["hash"])
        cur = cur.groupBy(group.alias("idx")).agg(nodes.alias("nodes"))
        up = reduce(lambda nodes, _: let(nodes, _halved), range(leaf_bits), F.col("nodes"))
        cur = cur.select("idx", F.element_at(up, 1).alias("hash"))
    return cur.select(F.col("hash").alias("root"))


def merkle_levels(leaves: DataFrame, height: int) -> list[DataFrame]:
    """The tree's levels (idx, hash) from the leaves up, height of them above."""
    out = [leaves.select("idx", "hash")]
    for _ in range(height):
        both = out[-1].groupBy(F.floor(F.col("idx") / 2).alias("up")).agg(F.min_by("hash", "idx").alias("left"), F.max_by("hash", "idx").alias("right"), F.count(F.lit(1)).alias("n"))
        out.append(both.select(F.col("up").alias("idx"), F.when(F.col("n") == 2, node_hash(F.col("left"), F.col("right"))).otherwise(F.col("left")).alias("hash")))
    return out


def inclusion_proofs(leaves: DataFrame, leaf_bits: int = 10, rounds: int = 4) -> DataFrame:
    """idx, hash, proof (hash and side of each sibling on the way up) of every leaf.

    A round takes blocks of 2^leaf_bits neighbours: steps inside a block come from its own nodes, those above it from the
    proofs of the blocks' roots, of which there are so many fewer.
    """
    nodes = F.transform(F.array_sort(F.collect_list(F.struct("idx", "hash"))), lambda n: n["hash"])
    blocks = leaves.groupBy(F.floor(F.col("idx") / (1 << leaf_bits)).alias("block")).agg(nodes.alias("nodes"))
    levels = [F.col("nodes")]
    table = blocks
    for k in range(leaf_bits):
        table = table.withColumn(f"level{k + 1}", _halved(levels[-1]))
        levels.append(F.col(f"level{k + 1}"))
    table = table.select("block", *(x.alias(f"level{k}") for k, x in enumerate(levels)))
    steps = "array<struct<hash:string,side:string>>"
    if rounds > 1:
        tops = table.select(F.col("block").alias("idx"), F.col(f"level{leaf_bits}")[0].alias("hash"))
        above = inclusion_proofs(tops, leaf_bits, rounds - 1).select(F.col("idx").alias("block"), F.col("proof").alias("above"))
        table = table.join(above, "block")
    else:
        table = table.withColumn("above", F.array().cast(steps))

    def step(i: Column, k: int) -> Column:
        at = F.call_function("shiftright", i, F.lit(k))
        other = F.get(F.col(f"level{k}"), at.bitwiseXOR(F.lit(1)))
        return F.when(other.isNotNull(), F.struct(other.alias("hash"), F.when(at % 2 == 0, "right").otherwise("left").alias("side")))

    each = F.transform("level0", lambda h, i: F.struct((F.col("block") * (1 << leaf_bits) + i).alias("idx"), h.alias("hash"), F.concat(F.array_compact(F.array(*(step(i, k) for k in range(leaf_bits)))), "above").alias("proof")))
    return table.select(F.inline(each))


def proven_root(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its proof lead to."""
    return F.aggregate(proof, leaf, lambda h, p: F.when(p["side"] == "right", node_hash(h, p["hash"])).otherwise(node_hash(p["hash"], h)))


def hmac_sha256(key: bytes, text: Column) -> Column:
    """HMAC from two hashes, in hex."""
    key = key.ljust(64, b"\0")
    pad = lambda x: F.unhex(F.lit(bytes(b ^ x for b in key).hex()))
    return F.sha2(F.concat(pad(0x5C), F.unhex(F.sha2(F.concat(pad(0x36), text.cast("binary")), 256))), 256)
