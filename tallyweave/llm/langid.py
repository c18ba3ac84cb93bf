"""Language identification by averaged hashed subword embeddings with a linear softmax.

A text's subwords are the runs of 2 to 4 characters inside its words, the word's edges marked. Each is hashed to a
bucket with an embedding; their mean goes through a linear softmax. Embeddings and weights are trained in numpy by
stochastic gradient descent on a bounded sample of labelled rows. A held part of the sample calibrates the scores by
a temperature, and sets the score below which a text is rejected: no more than REJECT_SHARE of the held rows that are
predicted right may fall below it, and it is 0.5 at most.

The bound of the sample: about SAMPLE_ROWS rows in equal parts for each language, chosen by a hash of doc_id, of
SAMPLE_CHARS characters at most each; of more than SAMPLE_ROWS labels the most frequent ones. Prediction reads whole texts.

Defined cases: null, empty or letterless texts get `und` with score 0; if nothing can be learned every text does;
null langs are never learned; rows with null doc_id count as not held out; repeated rows are predicted alike; of equal
scores the first label in order wins; columns named like the results give way to them; very long texts are hashed in parts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

BUCKET_BITS, DIM, EPOCHS, RATE = 16, 16, 6, 0.4
BUCKETS = 1 << BUCKET_BITS
SAMPLE_ROWS, SAMPLE_CHARS = 4000, 50_000
REJECT_SHARE = 0.001
NGRAMS = (2, 3, 4)
#: Texts are hashed in parts of about so many characters, to bound memory.
PART = 1 << 20
UND = "und"


@cache
def _letters() -> np.ndarray:
    """For each code point its lower-case letter, or 0 if it is no letter."""
    out = np.zeros(0x110000, dtype=np.uint32)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            out[i] = ord(low) if len(low) == 1 else i
    return out


def subwords(text: str) -> np.ndarray:
    """The buckets of a text's subwords."""
    points = _letters()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
    edge = points == 0
    keep = ~edge
    keep[1:] |= edge[1:] & ~edge[:-1]
    a = np.concatenate([np.zeros(1, np.uint32), points[keep], np.zeros(1, np.uint32)])
    word = a != 0
    out, h, inner = [], a, None
    for n in range(2, NGRAMS[-1] + 1):
        if len(a) < n:
            break
        # Each length's hash goes on from the hash of one character less; only edges may be white.
        h = (h[:-1] ^ (a[n - 1 :] << np.uint32(16))) * np.uint32(0x85EBCA6B)
        h ^= h >> np.uint32(15)
        inner = word[1:-1].copy() if n == 3 else inner[:-1] & word[n - 2 : len(a) - 1] if n > 3 else None
        if n in NGRAMS:
            out.append(h[inner if n > 2 else word[:-1] | word[1:]] * np.uint32(0xC2B2AE35) >> np.uint32(32 - BUCKET_BITS))
    return np.concatenate(out) if out else np.zeros(0, dtype=np.uint32)


def parts(text: str) -> Iterator[str]:
    """A text in parts that end between words where they can."""
    at = 0
    while at < len(text):
        end = min(len(text), at + PART)
        while end < len(text) and text[end - 1].isalpha() and end - at < 2 * PART:
            end += 1
        yield text[at:end]
        at = end


@dataclass
class Model:
    langs: list[str]
    #: For each bucket its embedding times the softmax weights, and the bias.
    table: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    reject_below: float = 0.0

    def logits(self, text: str | None) -> np.ndarray | None:
        total, n = np.zeros(len(self.langs)), 0
        for part in parts(text or ""):
            of = subwords(part)
            if len(of):
                # Long texts count their buckets first, then add each bucket's row once.
                if len(of) > BUCKETS:
                    total += np.bincount(of, minlength=BUCKETS) @ self.table
                else:
                    total += np.ones(len(of), np.float32) @ self.table.take(of, axis=0)
                n += len(of)
        return total / n + self.bias if n and self.langs else None

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, calibrated score, rejected."""
        z = self.logits(text)
        if z is None:
            return UND, 0.0, True
        p = _softmax(z / self.temperature)
        k = int(p.argmax())
        return self.langs[k], float(p[k]), bool(p[k] < self.reject_below)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train(rows: list[tuple[str, str]], seed: int = 7) -> Model:
    """A model from (text, lang) rows. Each text is learned whole and by a short run of its words, so that short texts are scored well too."""
    rng = np.random.default_rng(seed)
    langs = sorted({lang for _, lang in rows})
    data: list[tuple[np.ndarray, np.ndarray, int, bool]] = []
    for i, (text, lang) in enumerate(rows):
        words = text.split()
        k = int(rng.integers(0, max(1, len(words))))
        for piece in (text, " ".join(words[k : k + int(rng.integers(2, 30))])):
            of, count = np.unique(subwords(piece), return_counts=True)
            if len(of):
                data.append((of, (count / count.sum()).astype(np.float32), langs.index(lang), i % 5 == 0))
    if not data:
        return Model([], np.zeros((BUCKETS, 0)), np.zeros(0))
    emb = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    out, bias = np.zeros((DIM, len(langs)), np.float32), np.zeros(len(langs), np.float32)
    learn = [d for d in data if not d[3]] or data
    steps = EPOCHS * len(learn)
    step = 0
    for _ in range(EPOCHS):
        for j in rng.permutation(len(learn)):
            of, share, y, _ = learn[j]
            rate = np.float32(RATE * (1 - step / steps))
            step += 1
            mean = share @ emb[of]
            g = _softmax(mean @ out + bias).astype(np.float32)
            g[y] -= 1
            back = out @ g
            out -= rate * np.outer(mean, g)
            bias -= rate * np.float32(0.1) * g
            emb[of] -= rate * np.float32(DIM) * share[:, None] * back
    model = Model(langs, (emb @ out).astype(np.float32), bias.astype(np.float64))
    held = [d for d in data if d[3]] or data
    z = np.array([d[1] @ model.table[d[0]] + model.bias for d in held])
    y = np.array([d[2] for d in held])
    nll = lambda t: -np.log(np.maximum(_softmax(z / t)[np.arange(len(y)), y], 1e-12)).mean()
    model.temperature = float(min(np.geomspace(0.02, 5, 60), key=nll))
    p = _softmax(z / model.temperature)
    right = np.sort(p.max(axis=1)[p.argmax(axis=1) == y])
    model.reject_below = float(min(0.5, right[int(REJECT_SHARE * len(right))])) if len(right) else 0.0
    return model


def is_held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame) -> Model:
    """Train on a bounded sample of the labelled rows of docs that are not held out."""
    known = docs.where(F.col("lang").isNotNull() & ~is_held_out())
    counts = known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(SAMPLE_ROWS).collect()
    if not counts:
        return train([])
    quota = max(1, SAMPLE_ROWS // len(counts))
    below = docs.sparkSession.createDataFrame([(r["lang"], int(1_000_000 * quota / r["count"]) + 1) for r in counts], "lang string, below long")
    roll = F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1_000_000))
    sample = known.select("doc_id", "text", F.col("lang").cast("string").alias("lang")).join(F.broadcast(below), "lang").where(roll < F.col("below"))
    sample = sample.where(F.col("text").isNotNull() & (F.length("text") <= SAMPLE_CHARS))
    rows = sample.select("doc_id", "text", "lang").limit(2 * SAMPLE_ROWS).collect()
    rows.sort(key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["text"]))
    return train([(r["text"], r["lang"]) for r in rows])


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """The columns of docs other than those that are added: lang_pred, score and rejected."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    taken = [c for c in docs.columns if c not in ("lang_pred", "score", "rejected")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [shared.value.predict(t) for t in b.column("text").to_pylist()]
            more = {"lang_pred": pa.array([g[0] for g in got], pa.string()), "score": pa.array([g[1] for g in got], pa.float64()), "rejected": pa.array([g[2] for g in got], pa.bool_())}
            yield pa.RecordBatch.from_arrays([*b.columns, *more.values()], names=[*b.schema.names, *more])

    schema = docs.select(*taken).schema.add("lang_pred", "string").add("score", "double").add("rejected", "boolean")
    return docs.select(*taken).mapInArrow(run, schema)


def identified(docs: DataFrame) -> DataFrame:
    """The documents whose language the model does not reject; columns as they came."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array([not shared.value.predict(t)[2] for t in b.column("text").to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = predict(docs.select("doc_id", "text"), fit(docs))
    return out.select("doc_id", is_held_out().alias("held_out"), "lang_pred", "score", "rejected")
