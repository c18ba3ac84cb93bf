"""Document resolution: ordered rules, precedents by equal or similar text, and routing to review."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import reduce
from typing import Any

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, Thresholds
from ..functions import canonical as J
from ..shared import unused, written


def condition(tree: dict[str, Any], content: Column, kind: Column) -> Column:
    """A predicate tree as a Column; a test that is not known never holds."""
    if "all_of" in tree:
        return reduce(Column.__and__, (condition(c, content, kind) for c in tree["all_of"]), F.lit(True))
    if "any_of" in tree:
        return reduce(Column.__or__, (condition(c, content, kind) for c in tree["any_of"]), F.lit(False))
    if "document_type_equals" in tree:
        return F.coalesce(kind == tree["document_type_equals"], F.lit(False))
    if "content_contains" in tree:
        return F.coalesce(F.contains(F.lower(content), F.lit(tree["content_contains"].lower())), F.lit(False))
    if "content_pattern" in tree:
        return F.coalesce(content.rlike(f"(?i){tree['content_pattern']}"), F.lit(False))
    return F.lit(False)


def first_rule(rules: Sequence[dict[str, Any]], content: Column, kind: Column) -> Column:
    """rule_id and resolution of the first rule that holds, else null."""
    return F.coalesce(*(F.when(condition(r["condition"], content, kind), F.struct(F.lit(r["id"]).alias("rule_id"), F.lit(r["resolution"]).alias("resolution"))) for r in rules))


def normal_text(text: Column) -> Column:
    """Lower case, anything but letters, digits and underscores as one space."""
    return F.trim(F.regexp_replace(F.lower(text), r"(?U)[^\w]+", " "))


def bigrams(text: Column) -> Column:
    """The set of a text's pairs of neighbouring characters; of a text of one character, that character."""
    many = F.array_distinct(F.regexp_extract_all(text, F.lit("(?s)(?=(..))"), F.lit(1)))
    return F.when(F.length(text) == 0, F.array().cast("array<string>")).when(F.length(text) == 1, F.array(text)).otherwise(many)


def dice(a: Column, b: Column) -> Column:
    """2|A∩B| / (|A|+|B|) of two sets; both empty 1, one empty 0."""
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(2.0 * F.size(F.array_intersect(a, b)) / (F.size(a) + F.size(b)))


def exact_precedents(docs: DataFrame, precedents: DataFrame) -> DataFrame:
    """docs (key, text) with precedent, the first (by ordinal) whose normal text is equal, else null."""
    (norm,) = unused(docs, "norm")
    first = precedents.groupBy(normal_text(F.col("content")).alias(norm)).agg(F.min_by("precedent", "ordinal").alias("precedent"))
    return docs.withColumn(norm, normal_text(F.col("text"))).join(first, norm, "left").drop(norm)


#: Grams of all precedents up to which an index of them is sent to the tasks: 64 MB.
MOST_GRAMS = 8_000_000


def similar_precedents(docs: DataFrame, precedents: DataFrame, least: float, most_grams: int = MOST_GRAMS) -> DataFrame:
    """key, precedent, similarity: the most similar precedent of each document with a Dice of least or more; ties to the first.

    Texts of one language share most bigrams: a quarter of all pairs may truly reach 0.6, so no filter leaves few candidates.
    A list of precedents that holds most_grams bigrams or fewer goes to the tasks as an index, by which a document's overlaps
    with all of them are counted at once; a longer one is joined by prefixes. Both give the same rows.
    """
    # Bigrams as 64-bit hashes: there are too few kinds of them to collide, and numbers sort and meet much faster.
    hashed = lambda text: F.transform(bigrams(normal_text(F.col(text))), lambda g: F.xxhash64(g))
    b = precedents.select("precedent", "ordinal", "content", hashed("content").alias("set")).where("size(set) > 0")
    b = written(b.withColumn("m", F.size("set")), "bigrams")
    grams = b.agg(F.coalesce(F.sum("m"), F.lit(0))).first()[0]
    if grams <= most_grams:
        return _by_index(docs.select("key", "text"), b, least)
    return _by_prefix(docs.select("key", hashed("text").alias("set")).where("size(set) > 0"), b, least)


#: What normal_text's pattern takes for no part of a word, spelt out.
_NO_WORD = regex.compile(r"[^\p{Alphabetic}\p{M}\p{Nd}\p{Pc}\u200c\u200d]+")


def _gram_codes(text: str) -> np.ndarray:
    """The bigrams of a text's normal form as numbers, each once: normal_text and bigrams in tasks, at a tenth of the cost.

    They agree but for characters that are too new for Java's version of Unicode.
    """
    points = np.frombuffer(_NO_WORD.sub(" ", text.lower()).strip(" ").encode("utf-32-le"), np.uint32).astype(np.int64)
    return np.unique((points[:-1] << 21) | points[1:]) if len(points) > 1 else points


def _by_index(a: DataFrame, b: DataFrame, least: float) -> DataFrame:
    """Each document's best precedent, by an index from bigrams to precedents in the order of the list."""
    kinds = f"key {a.schema['key'].dataType.simpleString()}, precedent {b.schema['precedent'].dataType.simpleString()}, similarity double"
    held = b.select("precedent", "ordinal", "content").toArrow().sort_by("ordinal")
    sets = [_gram_codes(t) for t in held.column("content").to_pylist()]
    sizes = np.array([len(x) for x in sets], np.int64)
    grams, of = np.unique(np.concatenate([np.zeros(0, np.int64), *sets]), return_inverse=True)
    order = np.argsort(of, kind="stable")
    index = a.sparkSession.sparkContext.broadcast((grams, np.searchsorted(of[order], np.arange(len(grams) + 1)), np.repeat(np.arange(len(sizes)), sizes)[order], sizes, held.column("precedent").combine_chunks()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, starts, having, sizes, names = index.value
        for batch in batches:
            keys, best, scores = [], [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                own = _gram_codes(text or "")
                near = np.searchsorted(grams, own)
                known = near[near < len(grams)]
                known = known[grams[known] == own[near < len(grams)]]
                if len(known):
                    shared = np.bincount(np.concatenate([having[starts[g] : starts[g + 1]] for g in known]), minlength=len(sizes))
                    dice = 2.0 * shared / (sizes + len(own))
                    first = int(dice.argmax())
                    if dice[first] >= least:
                        keys.append(i)
                        best.append(first)
                        scores.append(float(dice[first]))
            yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(keys, pa.int64())), names.take(pa.array(best, pa.int64())), pa.array(scores, pa.float64())], ["key", "precedent", "similarity"])

    return a.mapInArrow(run, kinds)


#: Kinds of bigrams that are counted apart where they are put in order.
GRAM_KINDS = 1 << 14


def _by_prefix(a: DataFrame, b: DataFrame, least: float) -> DataFrame:
    """Candidates share a bigram prefix: with bigrams in one order, two sets that reach the threshold share one of the first |A| - ceil(share |A|) + 1.

    Rare bigrams come first, by how many precedents have them, and only sets whose sizes are in reach of each other meet.
    """
    share = least / (2.0 - least)
    kind = lambda g: F.pmod(g, F.lit(GRAM_KINDS))
    counts = b.select(F.explode("set").alias("g")).groupBy(kind(F.col("g")).alias("id")).agg(F.count(F.lit(1)).alias("n"))
    every = a.sparkSession.range(GRAM_KINDS).join(counts, "id", "left").agg(F.array_sort(F.collect_list(F.struct("id", F.coalesce("n", F.lit(0)).alias("n")))).alias("all"))
    often = F.broadcast(written(every.select(F.transform("all", lambda x: x["n"]).alias("often")), "gram-counts"))  # one row of GRAM_KINDS counts
    in_order = F.transform(F.array_sort(F.transform("set", lambda g: F.struct(F.get("often", kind(g).cast("int")).alias("n"), g.alias("g")))), lambda x: x["g"])
    level = lambda n: F.floor(F.log(n.cast("double")) / F.lit(max(-math.log(share), 1e-6) * 1.000001))

    def prefixes(df: DataFrame, *keep: str) -> DataFrame:
        kept = F.slice(in_order, F.lit(1), (F.size("set") - F.ceil(F.lit(share) * F.size("set") - 1e-9) + 1).cast("int"))
        return df.join(often).select(*keep, F.explode(kept).alias("gram"))

    a = written(a.withColumn("n", F.size("set")), "bigrams")  # read twice
    ours = prefixes(a, "key", "n").withColumn("level", level(F.col("n")))
    near = F.explode(F.array(*(level(F.col("m")) + i for i in (-1, 0, 1))))  # sizes in reach are a level apart at most
    theirs = prefixes(b, "ordinal", "m").withColumn("level", near)
    close = (F.col("n") >= share * F.col("m") - 1e-9) & (F.col("m") >= share * F.col("n") - 1e-9)
    met = ours.join(theirs, ["gram", "level"]).where(close).select("key", "ordinal").distinct()
    pairs = met.join(a, "key").join(b.select("precedent", "ordinal", F.col("set").alias("other")), "ordinal")
    scored = pairs.select("key", "precedent", "ordinal", dice(F.col("set"), F.col("other")).alias("similarity")).where(F.col("similarity") >= least)
    return scored.groupBy("key").agg(F.max_by(F.struct("precedent", "similarity"), F.struct("similarity", -F.col("ordinal"))).alias("best")).select("key", "best.precedent", "best.similarity")


def routing_reason(confidence: Column, forced: Column, llm_available: Column, t: Thresholds = DEFAULT) -> Column:
    """Why a resolution goes to review, or null: forced, then no model at hand, then low confidence."""
    low = confidence < t.review
    return F.when(forced, "force_review").when(~llm_available & low, "llm_unavailable").when(low, "low_confidence")


def resolve_documents(docs: DataFrame, rules: Sequence[dict[str, Any]], precedents: DataFrame, t: Thresholds = DEFAULT) -> DataFrame:
    """docs (key, text, document_type) with rule_id, precedent, match_type, similarity, resolution, confidence, layer_used, reason and status.

    By rules, then equal precedents, then the most similar precedent; layers above t.max_layer are left out. Only documents
    that the layers before leave open go on.
    """
    rule = first_rule(rules, F.col("text"), F.col("document_type")) if t.max_layer >= 1 else F.lit(None).cast("struct<rule_id:string,resolution:string>")
    by, near = unused(docs, "rule", "near")
    rows = docs.withColumn(by, rule)
    if t.max_layer >= 2:
        rows = exact_precedents(rows, precedents)
        rest = rows.where(F.col(by).isNull() & F.col("precedent").isNull()).select("key", "text")
        rows = rows.join(similar_precedents(rest, precedents, t.precedent_match).select("key", F.col("precedent").alias(near), "similarity"), "key", "left")
    else:
        rows = rows.withColumns({"precedent": F.lit(None).cast("long"), near: F.lit(None).cast("long"), "similarity": F.lit(None).cast("double")})
    by_rule = F.col(by).isNotNull()
    match = F.when(~by_rule, F.when(F.col("precedent").isNotNull(), "exact").when(F.col(near).isNotNull(), "fuzzy"))
    found = F.when(~by_rule, F.coalesce("precedent", near))
    similarity = F.when(match == "exact", 1.0).when(match == "fuzzy", F.col("similarity"))
    out = rows.select(
        "key", "document_type", F.length("text").alias("content_length"), F.col(by)["rule_id"].alias("rule_id"), found.alias("precedent"), match.alias("match_type"), similarity.alias("similarity"),
        F.coalesce(F.col(by)["resolution"], F.concat(F.lit("precedent "), found.cast("string"))).alias("resolution"), F.when(by_rule, 1).when(found.isNotNull(), 2).alias("layer_used"),
    )
    out = out.withColumn("confidence", F.when(F.col("layer_used") == 1, 1.0).otherwise(clamped(F.coalesce("similarity", F.lit(0.0)))))
    reason = routing_reason(F.col("confidence"), F.lit(False), F.lit(True), t)
    return out.withColumn("reason", reason).withColumn("status", F.when(reason.isNull(), "resolved").otherwise("routed_to_review"))


def clamped(confidence: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), confidence))


#: The kinds of nodes, each with the fields of its data.
NODE_FIELDS = {
    "source_artifact": ["artifact_ref", "metadata"], "retrieval_result": ["match_score", "query", "results"], "transformation": ["input_hash", "output_hash", "transform_type"], "model_call": ["confidence", "latency_ms", "model", "prompt_version", "provider", "response_summary"],
    "human_decision": ["decision", "evidence_reviewed", "notes", "reviewer_id"], "export_artifact": ["artifact_ref", "format", "hash"], "degradation_event": ["mode", "reason"],
}


def node_hash(kind: Column, sequence: Column, timestamp: Column, data: Column) -> Column:
    """SHA-256 of a node's canonical content. data: its canonical JSON."""
    return F.sha2(J.record({"node_type": J.ascii_text(kind), "sequence": J.whole(sequence), "timestamp": J.ascii_text(timestamp), "data": data}), 256)


def node(kind: str, sequence: Column, timestamp: Column, data: dict[str, Column]) -> Column:
    """A node with its hash. data: JSON by field, all of NODE_FIELDS[kind] or those of a step of the engine."""
    if "step" not in data and kind != "source_artifact" and sorted(data) != NODE_FIELDS[kind]:
        raise ValueError(f"{kind} needs {', '.join(NODE_FIELDS[kind])}")
    json = J.record(data)
    return F.struct(F.lit(kind).alias("node_type"), sequence.cast("int").alias("sequence"), timestamp.alias("timestamp"), json.alias("data"), node_hash(F.lit(kind), sequence, timestamp, json).alias("node_hash"))


def chain_hash(nodes: Column) -> Column:
    """SHA-256 of the nodes' hashes in order of sequence."""
    return F.sha2(F.array_join(F.transform(F.array_sort(F.transform(nodes, lambda n: F.struct(n["sequence"].alias("s"), n["node_hash"].alias("h")))), lambda n: n["h"]), ""), 256)


def appended(chains: DataFrame, new: Column) -> DataFrame:
    """Open chains with one more node each (null adds none) and their new hash; closed ones raise."""
    closed = F.when(F.col("closed"), F.raise_error(F.concat(F.lit("chain is closed: "), F.col("key").cast("string"))))
    more = F.when(new.isNull(), F.col("nodes")).otherwise(F.array_append("nodes", new))
    return chains.withColumn("nodes", F.coalesce(closed.cast(chains.schema["nodes"].dataType), more)).withColumn("chain_hash", chain_hash(F.col("nodes")))


def evidence_chain(resolved: DataFrame, as_of: str, rule_set: str = "1", t: Thresholds = DEFAULT) -> DataFrame:
    """key, nodes, chain_hash, closed of resolve_documents' rows: what came in, what matched, and how it was routed."""
    at, step, c = F.lit(as_of), lambda name: J.text(F.lit(name)), F.col
    kind = J.ascii_text(c("document_type"))
    source = node("source_artifact", F.lit(1), at, {"document_type": kind, "content_length": J.whole(c("content_length")), "has_force_review": F.lit("false")})
    by_rule = node("transformation", F.lit(2), at, {"step": step("l1_rule_match"), "rule_id": J.ascii_text(c("rule_id")), "rule_set_version": J.text(F.lit(rule_set)), "document_type": kind, "matched": F.lit("true")})
    match = {"precedent_id": J.text(c("precedent").cast("string")), "similarity": J.double(c("similarity")), "match_type": J.text(c("match_type"))}
    exact = node("retrieval_result", F.lit(2), at, match | {"step": step("l2_exact_match")})
    fuzzy = node("retrieval_result", F.lit(2), at, match | {"step": step("l2_fuzzy_match"), "threshold": F.lit(repr(t.precedent_match))})
    found = F.when(c("layer_used") == 1, by_rule).when(c("match_type") == "exact", exact).when(c("match_type") == "fuzzy", fuzzy)
    last = F.when(c("layer_used").isNull(), 2).otherwise(3)
    routing = {"step": step("routing_decision"), "route_to_review": J.whole(c("reason").isNotNull()), "reason": J.text(c("reason")), "confidence": J.double(c("confidence")), "review_threshold": F.lit(repr(t.review)), "force_review": F.lit("false"), "llm_available": F.lit("true")}
    nodes = F.array_compact(F.array(source, found, node("transformation", last, at, routing)))
    out = resolved.select("key", nodes.alias("nodes"), (c("status") == "resolved").alias("closed"))
    return out.withColumn("chain_hash", chain_hash(c("nodes")))


def checked_chains(chains: DataFrame) -> DataFrame:
    """key, node_errors (sequences of nodes whose hash is not their content's), gap (whether sequences are not 1, 2, ...), chain_ok and valid."""
    wrong = F.filter("nodes", lambda n: ~node_hash(n["node_type"], n["sequence"], n["timestamp"], n["data"]).eqNullSafe(n["node_hash"]))
    own = F.array_sort(F.transform("nodes", lambda n: n["sequence"]))
    wanted = F.when(F.size("nodes") > 0, F.sequence(F.lit(1), F.size("nodes"))).otherwise(F.array().cast("array<int>"))
    out = chains.select("key", F.transform(wrong, lambda n: n["sequence"]).alias("node_errors"), (own != wanted).alias("gap"), chain_hash(F.col("nodes")).eqNullSafe(F.col("chain_hash")).alias("chain_ok"))
    return out.withColumn("valid", (F.size("node_errors") == 0) & ~F.col("gap") & F.col("chain_ok"))


def integrity_report(checked: DataFrame) -> DataFrame:
    """Chains in all, valid ones, and those with each kind of error."""
    n = lambda c: F.count_if(c)
    return checked.agg(F.count(F.lit(1)).alias("chains"), n(F.col("valid")).alias("valid"), n(F.size("node_errors") > 0).alias("node_errors"), n(F.col("gap")).alias("gaps"), n(~F.col("chain_ok")).alias("chain_errors"))
