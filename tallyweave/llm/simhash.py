"""SimHash near-duplicates by anchor-point covering.

A fingerprint's low 46 bits are two 23-bit blocks. The binary Golay code covers each block perfectly with radius
3: every value has one codeword within 3 bits, its home. The anchors are the 2^24 pairs of codewords. A
fingerprint is at home at one anchor, and visits every anchor that is within covering radius plus threshold of it:
the bits by which its blocks exceed radius 3 add up to the threshold at most. If x and y differ in d <= threshold
bits, y's distance to x's home exceeds the radius by d bits at most, so y visits x's home and no link is lost.
Homes and visitors are joined per anchor and compared by the bits of their difference.

Defined cases: a null, empty or blank text has fingerprint zero and links like any other; repeated rows are kept,
each with its own result row; other columns of the input are ignored, whatever their names; an empty table gives an
empty result; null doc_ids keep their rows, link, and take part in no minimum; very long texts are read in pieces.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations, repeat

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import connected_components, stored, table, unused

SHINGLE = 3
SEED = 42
THRESHOLD = 2
#: Length, covering radius and generator polynomial x^11+x^9+x^7+x^6+x^5+x+1 of the binary Golay code.
BLOCK, RADIUS, GENERATOR = 23, 3, 0b101011100011
#: Anchors with more homes than this are compared through the points one bit away instead: the same links' components, in
#: linear time, where comparing homes with visitors would take the square of a group of near copies.
CROWDED = 4096
PIECE = 1 << 20


def word_pieces(data: bytes, size: int = PIECE) -> Iterator[list[bytes]]:
    """The words of data, in lists from about size bytes each, so that a huge text needs no list of all its words."""
    at = 0
    while at < len(data):
        end = at + size
        while end < len(data) and data[end] not in b" \t\n\v\f\r":
            end += 1
        yield data[at:end].split()
        at = end


def fingerprint(text: str | None) -> int:
    """64-bit majority of the XXH64 hashes of a text's word shingles; zero if it has no word."""
    import xxhash

    if text is None:
        return 0
    votes, total, tail = np.zeros(64, dtype=np.int64), 0, []
    for words in word_pieces(text.encode("utf-8", "surrogatepass").lower()):
        words = tail + words
        if len(words) >= SHINGLE:
            shingles = map(b" ".join, zip(*(words[i:] for i in range(SHINGLE)), strict=False))
            n = len(words) - SHINGLE + 1
            hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), dtype=np.uint64, count=n)
            for i in range(0, n, 1 << 15):
                part = hashes[i : i + (1 << 15)].view(np.uint8).reshape(-1, 8)
                votes += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
            total += n
        tail = words[-(SHINGLE - 1) :]
    if not total:
        return xxhash.xxh64_intdigest(b" ".join(tail), SEED) if tail else 0
    return int(np.packbits(2 * votes > total, bitorder="little").view(np.uint64)[0])


def _fingerprints(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        fps = np.array([fingerprint(t) for t in b["text"]], dtype=np.uint64).view(np.int64)
        yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), "of": b["of"], "fp": fps})


def text_hash(text: Column | str) -> Column:
    """Tells texts under one doc_id apart."""
    return F.coalesce(F.xxhash64(text), F.lit(0))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, of (the text's hash), fp (the 64 bits as a signed long) for each row of docs."""
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long"), text_hash(text).alias("of"), text.alias("text")).mapInPandas(_fingerprints, "doc_id long, of long, fp long")


@cache
def _code() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each syndrome the error patterns of weight radius+threshold at most, by weight: starts, patterns, counts by excess; and the syndromes of all blocks' high parts."""
    unit = []
    for i in range(BLOCK):  # x^i modulo the generator
        v = 1 << i
        for b in range(BLOCK - 1, 10, -1):
            if v >> b & 1:
                v ^= GENERATOR << (b - 11)
        unit.append(v)
    pats, syns, excess = [], [], []
    for weight in range(RADIUS + THRESHOLD + 1):
        for bits in combinations(range(BLOCK), weight):
            p = s = 0
            for b in bits:
                p |= 1 << b
                s ^= unit[b]
            pats.append(p)
            syns.append(s)
            excess.append(max(0, weight - RADIUS))
    pats, syns, excess = np.array(pats), np.array(syns), np.array(excess)
    order = np.lexsort((pats, excess, syns))
    starts = np.searchsorted(syns[order], np.arange(2049))
    counts = np.stack([np.bincount(syns[excess <= e], minlength=2048) for e in range(THRESHOLD + 1)], axis=1)
    return starts, pats[order].astype(np.int64), counts.astype(np.int64), np.array(unit)


def _syndromes(blocks: np.ndarray) -> np.ndarray:
    out = np.zeros(len(blocks), dtype=np.int64)
    for b, s in enumerate(_code()[3]):
        out ^= np.where(blocks >> b & 1, s, 0)
    return out


def _ranges(starts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For ranges of counts numbers from starts: the index of each number's range, and the number."""
    of = np.repeat(np.arange(len(counts)), counts)
    return of, np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(starts, counts)


def homes_of(fps: np.ndarray) -> np.ndarray:
    """The home anchor of each fingerprint."""
    starts, pats, _, _ = _code()
    low, high = fps & (1 << BLOCK) - 1, fps >> BLOCK & (1 << BLOCK) - 1
    return (low ^ pats[starts[_syndromes(low)]]) << BLOCK | (high ^ pats[starts[_syndromes(high)]])


def visits_of(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The index of a fingerprint and an anchor, for every anchor within covering radius plus threshold."""
    starts, pats, counts, _ = _code()
    low, high = fps & (1 << BLOCK) - 1, fps >> BLOCK & (1 << BLOCK) - 1
    syn_low, syn_high = _syndromes(low), _syndromes(high)
    of, at = _ranges(starts[syn_low], counts[syn_low, THRESHOLD])
    excess = (at - starts[syn_low[of]])[:, None] >= counts[syn_low[of]]  # one column for each excess that is passed
    left = THRESHOLD - excess.sum(axis=1)
    one = low[of] ^ pats[at]
    of2, at2 = _ranges(starts[syn_high[of]], counts[syn_high[of], left])
    return of[of2], one[of2] << BLOCK | (high[of[of2]] ^ pats[at2])


def _homes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        fps = b["fp"].to_numpy()
        yield pd.DataFrame({"anchor": homes_of(fps), "home": fps})


def _visits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        fps = b["fp"].to_numpy()
        of, anchor = visits_of(fps)
        yield pd.DataFrame({"anchor": anchor, "visitor": fps[of]})


def links(fps: DataFrame, crowded: int = CROWDED) -> DataFrame:
    """Links a, b between distinct fingerprints (column fp) that differ in THRESHOLD bits at most; where an anchor is crowded, enough of them to connect the same components."""
    homes = fps.mapInPandas(_homes, "anchor long, home long")
    visits = fps.mapInPandas(_visits, "anchor long, visitor long")
    near = (F.col("home") < F.col("visitor")) & (F.bit_count(F.col("home").bitwiseXOR(F.col("visitor"))) <= THRESHOLD)
    # Spark takes visits, some 60 rows a fingerprint, and points, 65, for as small as what they are made from: no broadcast at any size.
    hot = stored(homes.groupBy("anchor").count().where(F.col("count") > crowded).select("anchor"), "crowded-anchors")
    if hot.isEmpty():
        return homes.join(visits.hint("merge"), "anchor").where(near).select(F.col("home").alias("a"), F.col("visitor").alias("b"))
    calm = homes.join(hot, "anchor", "left_anti").join(visits.hint("merge"), "anchor").where(near).select(F.col("home").alias("a"), F.col("visitor").alias("b"))
    # Fingerprints within one bit of the same point differ in two bits at most, and any two that do share a point.
    busy = visits.join(hot, "anchor", "left_semi").select(F.col("visitor").alias("fp")).distinct()
    flips = F.concat(F.array(F.lit(0).cast("long")), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), i)))
    points = busy.select("fp", F.explode(flips).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("point"))
    least = points.groupBy("point").agg(F.min("fp").alias("b"))
    return calm.unionByName(points.join(least.hint("merge"), "point").where("fp <> b").select(F.col("fp").alias("a"), "b"))


def components(prints: DataFrame, crowded: int = CROWDED) -> DataFrame:
    """fp, component_id (the smallest doc_id that links reach) and first (rank, doc_id, of and number of rows of the first document, null doc_ids last) for each fingerprint of prints."""
    rows = prints.groupBy("fp", "doc_id", "of").agg(F.count(F.lit(1)).alias("n"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "of", "n"))
    firsts = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id"), first.alias("first")), "fingerprint-firsts", compact=True)
    parts = connected_components(links(firsts.select("fp"), crowded))
    linked = firsts.join(parts, F.col("fp") == F.col("node")).select("fp", "root", "first_id", "first")
    low = linked.groupBy("root").agg(F.min("first_id").alias("low_id"), F.min("first").alias("low"))
    linked = linked.join(low, "root").select(F.col("fp").alias("of_fp"), "low_id", "low")
    out = firsts.join(linked, F.col("fp") == F.col("of_fp"), "left")
    alone = F.col("of_fp").isNull()
    # A table, so that in the join with the documents Spark can split a fingerprint that many of them have.
    return stored(out.select("fp", F.when(alone, F.col("first_id")).otherwise(F.col("low_id")).alias("component_id"), F.when(alone, F.col("first")).otherwise(F.col("low")).alias("first")), "fingerprint-components", compact=True)


def near_duplicates(docs: DataFrame, crowded: int = CROWDED) -> DataFrame:
    """doc_id, fp, component_id (the smallest doc_id that links reach, its own included) for each row of docs."""
    prints = stored(fingerprints(docs), "fingerprints")
    return prints.join(components(prints, crowded).select("fp", "component_id").hint("merge"), "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each component stays: the one with the smallest doc_id, then text hash; null doc_ids come last. Columns as they came.

    Of rows that repeat the kept doc_id and text any one stays.
    """
    prints = stored(fingerprints(docs), "fingerprints")
    kept = stored(components(prints).select("first.*").distinct(), "kept-documents", compact=True)
    names = unused(docs, "kept_unknown", "kept_id", "kept_of", "kept_rows")
    unknown, kept_id, kept_of, rows = map(F.col, names)
    kept = kept.select(F.col("unknown").alias(names[0]), F.coalesce("doc_id", F.lit(0)).alias(names[1]), F.col("of").alias(names[2]), F.col("n").alias(names[3]))
    own_id = F.col("doc_id").cast("long")
    same = (own_id.isNull() == unknown) & (F.coalesce(own_id, F.lit(0)) == kept_id) & (text_hash(F.col("text").cast("string")) == kept_of)
    stay = docs.join(kept.hint("merge"), same)  # the kept grow with docs: no broadcast at any size
    out = stay.where(rows == 1).select(*docs.columns)
    if not kept.where(rows > 1).isEmpty():
        out = out.unionByName(stay.where(rows > 1).dropDuplicates(names[:3]).select(*docs.columns))
    return out


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
