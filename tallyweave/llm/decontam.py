"""Benchmark decontamination by edit distance over words.

A document matches an item of m words if some window of m of its words (lower-cased runs of letters, digits and
underscores; a window may pass the text's end) is within floor(MAX_EDIT * m) word edits of it. Candidates come from
CGK embeddings: a walk over the words emits the word at its place and moves on or stays by a random bit of step and
word, which turns few edits into few differing places. Each repetition has a walk of its own and samples BITS places
as a key; windows and items with equal keys are compared by the exact edit distance. The number of repetitions is
sought for each band of item lengths (a band's longest items are a quarter longer than its shortest): the smallest that
reaches RECALL on the band's items edited up to the threshold. A band that MOST_REPEATS don't bring there is compared
exactly. Windows that share too few words or word pairs with all items for that distance (a lossless bound) are neither
hashed nor compared.

The distinct items are taken in blocks of BLOCK_ITEMS rows and BLOCK_CHARS characters about, each block over all documents.

Defined cases: null, empty and wordless texts and items match nothing; items of fewer than 1/MAX_EDIT words match
exact windows only; repeated rows of documents each report their matches, those of items count once; of an item's equally
near windows the first is reported; very long texts are looked at in parts of bounded size, and one text's words at once;
an empty table of either kind gives no match; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

MAX_EDIT, RECALL, BITS, MOST_REPEATS, TRIALS = 0.2, 0.998, 2, 128, 500
BAND = 1.25
BLOCK_ITEMS, BLOCK_CHARS = 5000, 8_000_000
#: Words of documents that are looked at together.
BATCH_WORDS = 1 << 18
_WORDS = re.compile(r"\w+")


def words(text: str | None) -> list[str]:
    return _WORDS.findall(text.lower()) if text else []


def _mixed(x: np.ndarray, salt: int) -> np.ndarray:
    """A pseudorandom 64-bit number for each number of x."""
    h = (x.astype(np.uint64) + np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ h >> np.uint64(32)


def edit_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The edit distance of each row of a to the same row of b."""
    n, m = b.shape
    step = np.arange(m + 1)
    row = np.broadcast_to(step, (n, m + 1))
    for i in range(a.shape[1]):
        new = np.empty((n, m + 1), dtype=np.int64)
        new[:, 0] = i + 1
        np.minimum(row[:, :-1] + (a[:, i : i + 1] != b), row[:, 1:] + 1, out=new[:, 1:])
        row = np.minimum.accumulate(new - step, axis=1) + step
    return row[:, -1]


def _expanded(starts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For ranges of counts numbers from starts: the index of each number's range, and the number."""
    of = np.repeat(np.arange(len(counts)), counts)
    return of, np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(starts, counts)


class Items:
    """A block of items, ready to be looked for."""

    def __init__(self, rows: list[tuple[int, str]], seed: int = 11):
        split = [(i, w) for i, t in rows if (w := words(t))]
        self.ids = [i for i, _ in split]
        self.vocab: dict[str, int] = {}
        for _, w in split:
            for x in w:
                self.vocab.setdefault(x, len(self.vocab) + 1)
        self.items = [np.array([self.vocab[x] for x in w], dtype=np.int64) for _, w in split]
        self.base = len(self.vocab) + 1
        self.grams = {q: np.unique(np.concatenate([self._codes(a, q) for a in self.items] or [np.zeros(0, np.int64)])) for q in (2, 3)}
        self.sized: dict[int, list[int]] = {}
        for k, a in enumerate(self.items):
            self.sized.setdefault(len(a), []).append(k)
        self.longest = max(self.sized, default=0)
        self.seed = seed
        #: For each length its repetitions; 0: every window that passes the bound is compared.
        self.repeats = self._repeats()
        #: For each length and repetition: the keys of its items, sorted, and the items.
        self.keys = {}
        flat = np.concatenate([*self.items, np.full(self.longest, -1, dtype=np.int64)]) if self.items else np.zeros(0, np.int64)
        begins = np.cumsum([0, *map(len, self.items)])
        starts, of = begins[:-1], {m: np.array(k) for m, k in self.sized.items()}
        for r in range(max(self.repeats.values(), default=0)):
            for m, key in self.sampled(flat, starts, {m: k for m, k in of.items() if r < self.repeats[m]}, r):
                order = np.argsort(key, kind="stable")
                self.keys[m, r] = key[order], of[m][order]

    @staticmethod
    def limit(m: int) -> int:
        return int(MAX_EDIT * m + 1e-9)

    def need(self, m: int, q: int) -> int:
        """The runs of q words that a window shares with an item of m words within its limit: an edit breaks q of them at most."""
        return m - q + 1 - q * self.limit(m)

    def _codes(self, a: np.ndarray, q: int) -> np.ndarray:
        """A number for each run of q words."""
        code = a[: max(0, len(a) - q + 1)]
        for k in range(1, q):
            code = code * self.base + a[k : len(a) - q + 1 + k]
        return code

    def _hits(self, flat: np.ndarray, before: np.ndarray, q: int) -> np.ndarray:
        """The places where a run of q words is one of the items', given those of q - 1 words."""
        hit = before[:-1] & before[1:]
        at = np.flatnonzero(hit)
        code = flat[at]
        for k in range(1, q):
            code = code * self.base + flat[at + k]
        grams = self.grams[q]
        hit[at] = grams[np.minimum(np.searchsorted(grams, code), len(grams) - 1)] == code if len(grams) else False
        return hit

    def sampled(self, flat: np.ndarray, starts: np.ndarray, sets: dict[int, np.ndarray], r: int) -> Iterator[tuple[int, np.ndarray]]:
        """For each length m in sets, the keys of repetition r for windows of m words at the starts that the set names.

        A walk doesn't depend on the length, so one walk from each start serves all. Places are drawn from the first m
        steps, in which a walk can't leave its window.
        """
        places = {m: np.random.default_rng((self.seed, m, r)).choice(m, size=min(BITS, m), replace=False).tolist() for m in sets}
        wanted = {p for ps in places.values() for p in ps}
        at, seen = starts.copy(), {}
        for j in range(max(wanted, default=-1) + 1):
            if j % 64 == 0:  # 64 steps' bits for each word; the last is for the gaps between texts
                bits = _mixed(np.arange(self.base + 1), (r << 20) + j + 1)
            word = flat[at]
            if j in wanted:
                seen[j] = word
            at += (bits[word] >> np.uint64(j % 64) & np.uint64(1)).astype(np.int64)
        for m, of in sets.items():
            key = np.zeros(len(of), dtype=np.uint64)
            for p in places[m]:
                key = _mixed(key ^ seen[p][of].astype(np.uint64), p)
            yield m, key

    def _edited(self, a: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        """An item's words with as many edits as the limit allows, or fewer where edits move the window's end."""
        m = len(a)
        while True:
            b = a
            for kind, p in zip(rng.integers(0, 4, self.limit(m)).tolist(), rng.integers(0, m, self.limit(m)).tolist(), strict=True):
                # Half of the edits are put for a word; words put in or left out move the window's end, which costs an edit more.
                b = np.concatenate([b[:p], [0], b[p:]])[:m] if kind == 0 else np.concatenate([b[:p], b[p + 1 :], [0]]) if kind == 1 else np.concatenate([b[:p], [0], b[p + 1 :]])
            if edit_distances(a[None], b[None])[0] <= self.limit(m):
                return b

    def _repeats(self) -> dict[int, int]:
        """For each length the repetitions that reach RECALL on edited items of its band, all of the band's items in turn."""
        rng, out = np.random.default_rng(self.seed), {m: 1 for m in self.sized if not self.limit(m)}
        bands: dict[int, list[int]] = {}
        for m in sorted(set(self.sized) - set(out)):
            bands.setdefault(int(np.log(m) / np.log(BAND)), []).append(m)
        for lengths in bands.values():
            of = [k for m in lengths for k in self.sized[m]]
            tried = [(self.items[k], self._edited(self.items[k], rng)) for k in np.resize(of, max(TRIALS, len(of))).tolist()]
            pairs: dict[int, list[int]] = {}
            for t, (a, _) in enumerate(tried):
                pairs.setdefault(len(a), []).append(t)
            flat = np.concatenate([*(x for pair in tried for x in pair), np.full(self.longest, -1)])
            starts = np.cumsum([0, *(len(a) for a, _ in tried for _ in range(2))])[:-1]
            sets = {m: np.array([2 * t + side for t in ts for side in (0, 1)]) for m, ts in pairs.items()}
            found, used = np.zeros(len(tried), dtype=bool), 0
            while found.mean() < RECALL and used < MOST_REPEATS:
                for m, key in self.sampled(flat, starts, sets, used):
                    found[pairs[m]] |= key[::2] == key[1::2]
                used += 1
            out |= {m: used if found.mean() >= RECALL else 0 for m in lengths}
        return out

    def _near(self, hit: np.ndarray, q: int) -> np.ndarray | None:
        """Where a window may begin: in reach before a stretch with as many hits as any window must have in one of its stretches. None: anywhere."""
        stretch, least = 6, 7
        for m in self.sized:
            stretches, rest = divmod(m - q + 1, stretch)
            if stretches < 1 or self.need(m, q) <= rest:
                return None
            least = min(least, -(-(self.need(m, q) - rest) // stretches))
        sums = np.concatenate([[0], np.cumsum(hit)])
        good = np.flatnonzero(sums[stretch:] - sums[:-stretch] >= least)
        mark = np.zeros(len(hit) + 2, dtype=np.int64)
        np.add.at(mark, np.maximum(good - self.longest, 0), 1)
        np.add.at(mark, good + 1, -1)
        return np.flatnonzero(np.cumsum(mark[:-1]) > 0)

    def find(self, texts: list[str | None]) -> Iterator[tuple[int, int, int, int]]:
        """Row, item, position in words and distance of each item's best window in each text that matches it."""
        held: list[tuple[int, np.ndarray]] = []
        n = 0
        for row, text in enumerate(texts):
            w = words(text)
            if w:
                held.append((row, np.fromiter(map(self.vocab.get, w, repeat(0)), dtype=np.int64, count=len(w))))
                n += len(w)
            if n >= BATCH_WORDS:
                yield from self._find(held)
                held, n = [], 0
        yield from self._find(held)

    def _pairs(self, windows: np.ndarray, m: int, found: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Windows and items of m words to compare, in parts: those with equal keys, or all where keys don't reach the recall."""
        if self.repeats[m]:
            both = np.unique(np.concatenate(found))
            for c in range(0, len(both), 20_000):
                yield both[c : c + 20_000] // len(self.items), both[c : c + 20_000] % len(self.items)
        else:
            for k in self.sized[m]:
                for c in range(0, len(windows), 20_000):
                    part = windows[c : c + 20_000]
                    yield part, np.full(len(part), k)

    def _find(self, held: list[tuple[int, np.ndarray]]) -> Iterator[tuple[int, int, int, int]]:
        if not held or not self.items:
            return
        gap = np.full(self.longest, -1, dtype=np.int64)
        flat = np.concatenate([x for _, a in held for x in (a, gap)])
        begins = np.cumsum([0, *(len(a) + len(gap) for _, a in held)])[:-1]
        hits = {1: flat > 0}
        for q in self.grams:
            hits[q] = self._hits(flat, hits[q - 1], q)
        near = self._near(hits[3], 3)
        near = self._near(hits[2], 2) if near is None else near
        near = np.arange(len(flat)) if near is None else near
        before = {q: np.concatenate([[0], np.cumsum(h)]) for q, h in hits.items()}
        windows = {}
        for m in self.sized:
            s = near[: np.searchsorted(near, len(flat) - m, side="right")]
            for q in reversed(before):
                if self.need(m, q) > 0:
                    s = s[before[q][s + m - q + 1] - before[q][s] >= self.need(m, q)]
            if len(s):
                windows[m] = s
        if not windows:
            return
        starts = np.unique(np.concatenate(list(windows.values())))
        sets = {m: np.searchsorted(starts, s) for m, s in windows.items()}
        pairs: dict[int, list[np.ndarray]] = {m: [] for m in windows}
        for r in range(max(self.repeats[m] for m in windows)):
            for m, key in self.sampled(flat, starts, {m: s for m, s in sets.items() if r < self.repeats[m]}, r):
                keys, of = self.keys[m, r]
                lo, hi = np.searchsorted(keys, key, "left"), np.searchsorted(keys, key, "right")
                i, j = _expanded(lo, hi - lo)
                pairs[m].append(windows[m][i] * len(self.items) + of[j])
        best: dict[tuple[int, int], tuple[int, int]] = {}
        for m, found in pairs.items():
            limit = self.limit(m)
            for start, item in self._pairs(windows[m], m, found):
                dist = edit_distances(np.stack([self.items[k] for k in item.tolist()]), flat[start[:, None] + np.arange(m)])
                ok = dist <= limit
                for p, k, d in zip(start[ok].tolist(), item[ok].tolist(), dist[ok].tolist(), strict=True):
                    at_row = int(np.searchsorted(begins, p, "right")) - 1
                    if (d, p) < best.get((at_row, k), (m + 1, 0)):
                        best[at_row, k] = d, p
        for (at_row, k), (d, p) in sorted(best.items()):
            yield held[at_row][0], k, int(p - begins[at_row]), d


def item_blocks(benchmark: DataFrame) -> Iterator[Items]:
    """The items in blocks of bounded size."""
    known = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where("text IS NOT NULL").distinct()
    n, chars = known.agg(F.count("text"), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    blocks = max(-(-n // BLOCK_ITEMS), -(-chars // BLOCK_CHARS))
    for k in range(blocks):
        rows = known.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).collect()
        yield Items(sorted(((r["item_id"], r["text"]) for r in rows), key=lambda r: (r[0] is None, r[0] or 0, r[1])))


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, position (in words), distance, item_words for each document and item that match."""
    spark = docs.sparkSession
    schema = "doc_id long, item_id long, position long, distance long, item_words long"
    out = spark.createDataFrame([], schema)
    for block in item_blocks(benchmark):
        shared = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            items = shared.value
            for b in batches:
                ids = b["doc_id"].astype("Int64")
                rows = [(ids.iloc[r], items.ids[k], p, d, len(items.items[k])) for r, k, p, d in items.find(b["text"].tolist())]
                yield pd.DataFrame(rows, columns=["doc_id", "item_id", "position", "distance", "item_words"]).astype({"doc_id": "Int64", "item_id": "Int64"})

        out = out.unionByName(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInPandas(run, schema))
    return out


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that match no item; columns as they came."""
    for block in item_blocks(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b in batches:
                bad = {r for r, *_ in shared.value.find(b.column("text").to_pylist())}
                yield b.filter(pa.array([r not in bad for r in range(b.num_rows)], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
