"""Removal of word runs that repeat in later documents, by fingerprints of running lines.

Line breaks shift when a passage is pasted into other text, so a line here is a running line: LINE words from any word
on. Each run of MIN_WORDS words has one of its lines as fingerprint, the first whose first word's hash is least; two runs
that are equal have an equal one for certain, however they lie. A fingerprint's surroundings are all words of the runs of
MIN_WORDS, one after the other, that it stands for. Where a fingerprint is in several texts, its places with
equal surroundings are compared with the first of them; where their first place has the line in common with other
surroundings, each run of MIN_WORDS there is compared with the first place of that run. So all words of every run of
MIN_WORDS that an earlier document has are found; they are deleted, each with the white space after it.

All is DataFrame functions; least_lines is winnowing proper in numpy, for arrays of bytes, and serves no query.
Equal hashes are not trusted: the words of a run are compared by a second hash, and so are whole texts. Places of frequent
fingerprints are never gathered: they are joined with one first place, a join that Spark can split; first places ask for
their own words once, however many runs they serve.

Defined cases: null texts stay null and empty ones empty; texts of fewer words than MIN_WORDS never change; repeated
rows (equal doc_id and text) count as one document and come out alike; null doc_ids come first; what repeats inside one
document only stays; a very long text needs memory for its list of words; an empty table gives an empty result; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import GAP, WORD, forget, stored, table

MIN_WORDS, LINE = 50, 20
KEY, FIRST = ["known", "id", "of"], ["f_known", "f_id", "f_of"]


def _let(value: Column, then) -> Column:
    """then(value), where value is worked out once."""
    return F.transform(F.array(value), then)[0]


def keyed(docs: DataFrame) -> DataFrame:
    """known, id, of (which order and tell documents apart) and text of each row."""
    return docs.select(F.col("doc_id").isNotNull().alias("known"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"), F.coalesce(F.xxhash64(F.col("text").cast("string")), F.lit(0)).alias("of"), F.col("text").cast("string").alias("text"))


def _mixed(h: np.ndarray) -> np.ndarray:
    """Hashes with their bits spread; arithmetic on 64 bits wraps."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def _sums(values: np.ndarray, base: int, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """For each range lo to hi of values the hash of its values in their order: a polynomial's value at an odd base, from running sums."""
    powers = lambda b: np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(len(values), b, np.uint64)]))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * powers(base)[:-1])])
    return _mixed((total[hi] - total[lo]) * powers(pow(base, -1, 1 << 64))[lo] + (hi - lo).astype(np.uint64))


def _words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of data begin and end."""
    inside = np.concatenate([[False], (data != 32) & ((data < 9) | (data > 13)), [False]])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    return edge[::2], edge[1::2]


def least_lines(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, doc: np.ndarray, line: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first word of the least line in each window of lines inside one document (doc: of each word), about once each.

    Where a line comes again before it leaves the window, the least hash stays; such stretches get a place for each
    window of lines. So does a document's last window.
    """
    n = len(starts) - line - window + 2
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    at = starts[0]
    words = _sums(data[at : ends[-1]].astype(np.uint64) + np.uint64(1), 0x9E3779B97F4A7C15, starts - at, ends - at)
    k = np.arange(len(words) - line + 1)
    lines = _sums(words, 0xC2B2AE3D27D4EB4F, k, k + line)
    low, reach = lines, 1
    while 2 * reach <= window:
        low, reach = np.minimum(low[:-reach], low[reach:]), 2 * reach
    low = np.minimum(low[:n], low[window - reach :][:n])
    whole = doc[:n] == doc[line + window - 2 :]
    i = np.arange(n)
    new = np.ones(n, bool)
    new[1:] = (low[1:] != low[:-1]) | ~whole[:-1]
    new[:-1] |= ~whole[1:]
    new[-1] = True
    step = i[window::window]
    views = np.lib.stride_tricks.sliding_window_view(lines, window)
    new[step] |= (views[step - window] == low[step][:, None]).any(axis=1)
    new = np.flatnonzero(new & whole)
    return low[new], new + (views[new] == low[new][:, None]).argmax(axis=1)


def _split(text: Column) -> Column:
    """The words of a text. To look for rare gaps first and to split at one character costs less than a pattern."""
    plain = text
    for gap in "\t\x0b\f\r":
        plain = F.replace(plain, F.lit(gap), F.lit(" "))
    rare = reduce(Column.__or__, (F.contains(text, F.lit(gap)) for gap in "\t\x0b\f\r"))
    return F.array_remove(F.split(F.replace(F.when(rare, plain).otherwise(text), F.lit("\n"), F.lit(" ")), " "), "")


def _hashes(text: Column) -> Column:
    """The hash of each word of a text."""
    return F.transform(_split(text), lambda w: F.xxhash64(w))


def fingerprints(rows: DataFrame, min_words: int = MIN_WORDS, line: int = LINE) -> DataFrame:
    """known, id, of, mark (hash of the line), around (hash of all windows that it stands for), at, lo, hi (words of these) of every fingerprint of every document.

    Each window of min_words stands under its least line: the first of its lines whose first word's hash is least. A
    line's windows, one after the other, make one fingerprint.
    """
    window = min_words - line + 1
    split = rows.where(F.length("text") >= 2 * min_words - 1).select(*KEY, _hashes(F.col("text")).alias("words"))
    # Of explode() Spark infers a filter, which it moves below the split and so splits a text for each word.
    found = split.select(*KEY, "words", F.explode_outer(F.when(F.size("words") >= min_words, F.sequence(F.lit(0), F.size("words") - min_words))).alias("lo")).where("lo IS NOT NULL")
    # The least line changes where the window before began with it, or where a lesser one comes in.
    before, last = F.get("words", F.col("lo") - 1), F.get("words", F.col("lo") + window - 1)
    if window > 1:
        found = found.withColumn("inner", F.array_min(F.slice("words", F.col("lo") + 1, window - 1))).where((F.col("lo") == 0) | (before <= F.col("inner")) | (last < F.col("inner")))
    # From here on the few words that matter go along.
    found = found.select(*KEY, "lo", F.slice("words", F.col("lo") + 1, min_words + window - 1).alias("words"))
    found = found.withColumn("low", F.array_min(F.slice("words", 1, window)))
    found = found.withColumn("skip", F.array_position("words", F.col("low")).cast("int") - 1).withColumn("most", F.least("skip", F.size("words") - min_words))
    # How many windows more have it as their least: until a lesser one comes in.
    lesser = F.array_position(F.transform(F.slice("words", window + 1, F.col("most")), lambda w: w < F.col("low")), True).cast("int")
    found = found.withColumn("end", F.coalesce(F.nullif(lesser, F.lit(0)) - 1, "most"))
    found = found.withColumn("mark", F.xxhash64(F.slice("words", F.col("skip") + 1, line)))
    # All these words, and where the line is.
    return found.select(*KEY, "mark", F.xxhash64("mark", "skip", F.slice("words", 1, F.col("end") + min_words)).alias("around"), (F.col("lo") + F.col("skip")).alias("at"), "lo", (F.col("lo") + F.col("end") + min_words).alias("hi"))


def repeated_runs(rows: DataFrame, min_words: int = MIN_WORDS, line: int = LINE) -> DataFrame:
    """known, id, of, lo, hi (words) of runs of min_words and more that an earlier document has, with their place there: f_known, f_id, f_of, f_lo. All such words are in one, but for those of copies()."""
    marks = stored(fingerprints(rows, min_words, line), "line-fingerprints")
    own, first = F.struct(*KEY), F.struct(*FIRST)

    def shared(places: DataFrame, same: str, *more: Column) -> DataFrame:
        """What several texts have in common; texts that are copies as a whole are found apart. Stored, since Spark splits no join that an aggregate feeds."""
        return stored(places.groupBy(same).agg(F.min("of").alias("a"), F.max("of").alias("b"), *more).where("a <> b").drop("a", "b"), "line-shared").hint("merge")

    def with_first(places: DataFrame, same: str) -> DataFrame:
        """places with the first of those that are the same: FIRST, f_at."""
        firsts = places.groupBy(same).agg(F.min(F.struct(*KEY, "at")).alias("first"))
        firsts = firsts.select(same, *(F.col(f"first.{k}").alias(f) for k, f in zip([*KEY, "at"], [*FIRST, "f_at"], strict=True)))
        return places.join(stored(firsts, "line-firsts").hint("merge"), same)

    mixed = (F.min("around") != F.max("around")).alias("mixed")
    hits = stored(marks.join(shared(marks, "mark", mixed), "mark").drop("mark"), "line-hits")
    forget(marks)
    claim = [*KEY, "lo", "hi", *FIRST, (F.col("at") - F.col("f_at")).alias("shift")]
    places = stored(with_first(hits.where(F.col("hi") - F.col("lo") >= min_words), "around"), "line-places")
    forget(hits)
    whole = places.where(own != first).select(*claim)
    # Where the surroundings are the first of their kind, but the line has others too, each window is looked up.
    asked = places.where((own == first) & F.col("mixed")).groupBy(*KEY).agg(F.collect_list(F.struct("lo", "hi")).alias("asked"))
    starts = F.array_distinct(F.flatten(F.transform("asked", lambda s: F.sequence(s["lo"], s["hi"] - min_words))))
    texts = rows.join(asked.hint("merge"), KEY).select(*KEY, _hashes(F.col("text")).alias("words"), starts.alias("starts"))
    windows = texts.select(*KEY, "words", F.explode_outer("starts").alias("at")).select(*KEY, "at", F.xxhash64(F.slice("words", F.col("at") + 1, min_words)).alias("window"))
    windows = stored(windows, "line-windows")
    windows = stored(windows.join(shared(windows, "window"), "window"), "line-shared-windows")
    windows = with_first(windows, "window").where(own != first).withColumn("lo", F.col("at")).withColumn("hi", F.col("at") + min_words)
    diagonal = Window.partitionBy(*KEY, *FIRST, "shift").orderBy("lo")
    claims = whole.unionByName(windows.select(*claim))
    claims = claims.withColumn("apart", F.when(F.col("lo") <= F.max("hi").over(diagonal.rowsBetween(Window.unboundedPreceding, -1)), 0).otherwise(1))
    claims = claims.withColumn("run", F.sum("apart").over(diagonal.rowsBetween(Window.unboundedPreceding, 0)))
    runs = claims.groupBy(*KEY, *FIRST, "shift", "run").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    return runs.select(*KEY, "lo", "hi", *FIRST, (F.col("lo") - F.col("shift")).alias("f_lo"))


def copies(rows: DataFrame) -> DataFrame:
    """known, id, of of documents whose whole text an earlier one has, by two hashes."""
    texts = rows.where("text IS NOT NULL").select("known", "id", "of", F.xxhash64(F.lit("copy"), "text").alias("again"))
    firsts = texts.groupBy("of", "again").agg(F.min(F.struct("known", "id")).alias("a"), F.max(F.struct("known", "id")).alias("b")).where("a <> b")
    return texts.join(firsts.hint("merge"), ["of", "again"]).where(F.struct("known", "id") != F.col("a")).select(*KEY).distinct()


def _content(words: Column, lo: Column, n: Column) -> Column:
    return F.xxhash64(F.lit("run"), F.slice(words, lo + 1, n))


def _kept(spans: Column, n: Column) -> Column:
    """The stretches (lo, hi) of 0 to n that no span covers."""
    none = F.expr("CAST(array() AS ARRAY<STRUCT<lo: INT, hi: INT>>)")
    start = F.struct(F.lit(0).alias("reach"), none.alias("kept"))

    def step(acc: Column, s: Column) -> Column:
        free = F.when(s["lo"] > acc["reach"], F.array(F.struct(acc["reach"].alias("lo"), s["lo"].alias("hi")))).otherwise(none)
        return F.struct(F.greatest(acc["reach"], s["hi"]).alias("reach"), F.concat(acc["kept"], free).alias("kept"))

    return F.aggregate(F.concat(F.array_sort(spans), F.array(F.struct(n.alias("lo"), n.alias("hi")))), start, step, lambda acc: acc["kept"])


def without_repeats(docs: DataFrame, min_words: int = MIN_WORDS, line: int = LINE) -> DataFrame:
    """doc_id, text (without the runs that repeat), n_words, n_deleted (words) of each row of docs."""
    rows = keyed(docs)
    runs = stored(repeated_runs(rows, min_words, line), "line-runs")
    # The first places' words: each asked for once.
    asked = runs.select(*(F.col(f).alias(k) for f, k in zip(FIRST, KEY, strict=True)), "f_lo", (F.col("hi") - F.col("lo")).alias("n")).distinct()
    asked = asked.groupBy(*KEY).agg(F.collect_list(F.struct("f_lo", "n")).alias("asked"))
    told = rows.join(asked.hint("merge"), KEY).dropDuplicates(KEY).select(*(F.col(k).alias(f) for f, k in zip(FIRST, KEY, strict=True)), _split(F.col("text")).alias("words"), "asked")
    told = told.select(*FIRST, "words", F.inline("asked")).select(*FIRST, "f_lo", "n", _content(F.col("words"), F.col("f_lo"), F.col("n")).alias("content"))
    met = runs.withColumn("n", F.col("hi") - F.col("lo")).join(told.hint("merge"), [*FIRST, "f_lo", "n"])
    met = met.select(*KEY, "lo", "hi", "content").unionByName(copies(rows), allowMissingColumns=True)
    met = met.groupBy(*KEY).agg(F.collect_list(F.struct("lo", "hi", "content")).alias("runs"), F.bool_or(F.col("content").isNull()).alias("copy"))

    out, compared = rows.join(met.hint("merge"), KEY, "left"), F.coalesce(~F.col("copy"), F.lit(False))
    out = out.withColumn("words", F.when(compared, _split(F.col("text"))))
    out = out.withColumn("n_words", F.when(compared, F.size("words")).when(F.col("text").isNull(), 0).otherwise(F.size(_split(F.col("text")))))
    equal = F.filter("runs", lambda r: (r["hi"] - r["lo"] >= min_words) & (_content(F.col("words"), r["lo"], r["hi"] - r["lo"]) == r["content"]))
    kept = F.when(compared, _kept(F.transform(equal, lambda r: F.struct(r["lo"], r["hi"])), F.col("n_words")))
    kept = F.when(F.col("copy") & (F.col("n_words") >= min_words), F.expr("CAST(array() AS ARRAY<STRUCT<lo: INT, hi: INT>>)")).otherwise(kept)
    out = out.select("known", "id", "text", F.col("n_words").cast("long").alias("n_words"), kept.alias("kept"))
    n_kept = F.aggregate("kept", F.lit(0), lambda n, s: n + s["hi"] - s["lo"]).cast("long")
    out = out.withColumn("n_deleted", F.coalesce(F.col("n_words") - n_kept, F.lit(0)))
    pieces = F.regexp_extract_all("text", F.lit(f"{WORD}(?:{GAP})?"), F.lit(0))
    cut = _let(pieces, lambda p: F.array_join(F.flatten(F.transform("kept", lambda s: F.slice(p, s["lo"] + 1, s["hi"] - s["lo"]))), ""))
    cut = F.concat(F.regexp_extract("text", f"^(?:{GAP})?", 0), F.when(F.col("n_deleted") == F.col("n_words"), "").otherwise(cut))
    cut = F.when(F.col("n_deleted") == 0, F.col("text")).otherwise(cut)
    return out.select(F.when(F.col("known"), F.col("id")).alias("doc_id"), cut.alias("text"), "n_words", "n_deleted")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(table(spark, sf_dir, "documents"))
