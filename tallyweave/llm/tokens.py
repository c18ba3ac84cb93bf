"""Token ids in patched frame-of-reference blocks.

Documents are put in ascending doc_id order by a range partitioning; each partition is a shard, written as
segments. A segment is a self-contained file image (all numbers little-endian):

    magic "TWPF" | version u16 | block length u16 | documents u64 | ids u64 | blocks u64
    doc_id i64 for each document | known u8 for each document (0: its doc_id is null) | ids u64 for each document
    start u64 for each block, counted from the first block's first byte
    blocks: minimum u32 | width u8 | exceptions u16 | packed differences | exception positions u8 | exception differences u32

A block holds BLOCK ids less their minimum, packed at the width of their PERCENTILE-th part; larger differences are
exceptions. The last block is filled up with its minimum. The block index lets read_ids() decode any range of ids
alone. Spark writes the images as rows of a table in the shared folder, so that lost tasks are simply run again.

Defined cases: a null or empty text has the end id alone; null doc_ids come first; rows that repeat a doc_id are
written one after the other by the hash of their text; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import new_path, table

BLOCK, PERCENTILE = 256, 90
SEGMENT_IDS = 1 << 20
#: Bytes of frequent words and their ids that a worker may remember, and what Python needs besides for each of them.
KNOWN_BYTES, ENTRY_BYTES = 96 << 20, 200
#: Bytes of text that are split into words together.
SLICE = 1 << 22
END_ID = 1
HEAD = struct.Struct("<4sHHQQQ")
_MARK = "\x7f"
_WORD_END = "</w>"
#: Letters of Latin up to U+023F but the one whose lower case is no letter alone, and the ASCII marks after them.
_RUN = r"^(?P<run>[a-zA-Z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{12F}\x{131}-\x{23F}]+)(?P<tail>[!-/:-@\[-`{-~]*)$"


class WordEncoder:
    """Encodes texts word by word: this tokenizer never joins across white space, so a word's ids depend on the word alone.

    It also splits between letters and the marks after them, so Latin words share the ids of their letters. A letter
    run's last id, and no other, is that of a token that ends a word; this tells the words of a common call apart, and
    any call in which the counts differ is encoded in the general way.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.known, self.runs, self.room = {"": b""}, {}, KNOWN_BYTES
        mark = self._ids(_MARK)
        self.mark = mark[0] if len(mark) == 1 else None
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values(), default=0) + 1, dtype=bool)
        self.ends[[i for token, i in vocab.items() if token.endswith(_WORD_END)]] = True

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids

    @staticmethod
    def _cut(words: list[str], ids: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> dict[str, bytes]:
        data = ids.tobytes()
        return dict(zip(words, map(data.__getitem__, map(slice, (4 * starts).tolist(), (4 * stops).tolist())), strict=True))

    def _any(self, words: list[str]) -> dict[str, bytes]:
        """The ids of any words; many at a time with a mark between them."""
        out, plain = {}, []
        for w in words:
            if self.mark is None or _MARK in w:
                out[w] = np.array(self._ids(w), dtype="<u4").tobytes()
            else:
                plain.append(w)
        for i in range(0, len(plain), 5000):
            part = plain[i : i + 5000]
            ids = np.array(self._ids(f" {_MARK} ".join(part)), dtype="<u4")
            marks = np.flatnonzero(ids == self.mark)
            if len(marks) != len(part) - 1:
                raise ValueError("the tokenizer split the words in another way")
            out |= self._cut(part, ids, np.append(0, marks + 1), np.append(marks, len(ids)))
        return out

    def _letters(self, runs: list[str]) -> dict[str, bytes]:
        """The ids of runs of Latin letters."""
        out = {}
        for i in range(0, len(runs), 5000):
            part = runs[i : i + 5000]
            ids = np.array(self._ids(" ".join(part)), dtype="<u4")
            stops = np.flatnonzero(self.ends[ids]) + 1
            out |= self._cut(part, ids, np.append(0, stops[:-1]), stops) if len(stops) == len(part) and stops[-1] == len(ids) else self._any(part)
        return out

    def _kept(self, keep: dict[str, bytes], words: list[str], times: np.ndarray, encode) -> list[bytes]:
        """The ids of distinct words, from those that are kept or else by encode. Only words that came more than once are kept then."""
        ids = list(map(keep.get, words))
        fresh = encode([w for w, i in zip(words, ids, strict=True) if i is None])
        for k in np.flatnonzero(times > 1).tolist() if fresh else ():
            if self.room <= 0:
                break
            if ids[k] is None:
                w = words[k]
                keep[w] = fresh[w]
                self.room -= 4 * len(w) + len(fresh[w]) + ENTRY_BYTES
        return [fresh[w] if i is None else i for w, i in zip(words, ids, strict=True)] if fresh else ids

    def encode(self, texts: pa.Array) -> Iterator[bytes]:
        """The ids of each text (strings) without an end id, as bytes of u32."""
        texts = pc.fill_null(texts, "")
        ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)) // SLICE
        cuts = [0, *(np.flatnonzero(np.diff(ends)) + 1).tolist(), len(texts)]
        for i, j in pairwise(cuts):
            yield from self._encode(texts.slice(i, j - i))

    def _encode(self, texts: pa.Array) -> list[bytes]:
        """Distinct words first: each is a run of letters with marks after it, or any other word; then the ids of all places."""
        lists = pc.ascii_split_whitespace(texts)
        coded = lists.flatten().dictionary_encode()
        parts = pc.extract_regex(coded.dictionary, _RUN)
        plain = parts.is_valid()
        run, tail = (pc.struct_field(parts, k).filter(plain).dictionary_encode() for k in ("run", "tail"))
        other = coded.dictionary.filter(pc.invert(plain))
        plain = plain.to_numpy(zero_copy_only=False)
        times = np.bincount(coded.indices.to_numpy(), minlength=len(plain))
        count = lambda part: np.bincount(part.indices.to_numpy(), weights=times[plain], minlength=len(part.dictionary))
        pieces = [
            *self._kept(self.runs, run.dictionary.to_pylist(), count(run), self._letters),
            *self._kept(self.known, tail.dictionary.to_pylist(), count(tail), self._any),
            *self._kept(self.known, other.to_pylist(), times[~plain], self._any),
            b"",
        ]
        two = np.full((len(plain), 2), len(pieces) - 1, dtype=np.int32)
        two[plain, 0] = run.indices.to_numpy()
        two[plain, 1] = tail.indices.to_numpy() + len(run.dictionary)
        two[~plain, 0] = np.arange(len(other)) + len(run.dictionary) + len(tail.dictionary)
        # A slice's ids are few enough for numbers of 32 bits, which are moved twice as fast.
        sizes = np.fromiter(map(len, pieces), dtype=np.int32, count=len(pieces)) // 4
        starts = np.cumsum(sizes, dtype=np.int32) - sizes
        at = two[coded.indices.to_numpy()].reshape(-1)
        many = sizes[at]
        before = np.append(0, np.cumsum(many, dtype=np.int64))
        kind = np.int32 if before[-1] < 1 << 31 else np.int64
        places = np.repeat((starts[at] - before[:-1]).astype(kind), many) + np.arange(before[-1], dtype=kind)
        data, ends = np.frombuffer(b"".join(pieces), dtype="<u4").take(places).tobytes(), (4 * before[2 * lists.offsets.to_numpy()]).tolist()
        return [data[i:j] for i, j in pairwise(ends)]


@cache
def encoder(path: str) -> WordEncoder:
    """One encoder for each worker process; it remembers KNOWN_BYTES of words at most from task to task."""
    return WordEncoder(path)


def _scatter(out: np.ndarray, at: np.ndarray, values: np.ndarray) -> None:
    """Put each value's bytes at its place."""
    raw = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.itemsize)
    out[at[:, None] + np.arange(raw.shape[1])] = raw


def pack(ids: np.ndarray, block: int = BLOCK, percentile: int = PERCENTILE) -> tuple[np.ndarray, bytes]:
    """The starts of the blocks of ids, and their bytes."""
    n = -(-len(ids) // block)
    v = np.zeros((n, block), dtype=np.uint32)
    v.reshape(-1)[: len(ids)] = ids
    if n and len(ids) % block:
        v[-1, len(ids) % block :] = v[-1, : len(ids) % block].min()
    low = v.min(axis=1) if n else np.zeros(0, dtype=np.uint32)
    v -= low[:, None]
    k = max(0, -(-block * percentile // 100) - 1)
    width = np.frexp(np.partition(v, k, axis=1)[:, k].astype(np.float64))[1].astype(np.int64)
    over = v >= (np.uint64(1) << width.astype(np.uint64))[:, None]
    row, pos = np.nonzero(over)
    many = over.sum(axis=1)
    bytes_packed = -(-block * width // 8)
    size = 7 + bytes_packed + 5 * many
    starts = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), dtype=np.uint8)
    _scatter(out, starts, low.astype("<u4"))
    out[starts + 4] = width
    _scatter(out, starts + 5, many.astype("<u2"))
    rank = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
    tail = (starts + 7 + bytes_packed)[row]
    out[tail + rank] = pos
    _scatter(out, tail + many[row] + 4 * rank, v[row, pos].astype("<u4"))
    v[over] = 0
    for w in np.unique(width[width > 0]).tolist():
        rows = np.flatnonzero(width == w)
        columns = v[rows].T.astype(np.uint64)
        words = np.zeros((-(-block * w // 64), len(rows)), dtype=np.uint64)
        for j in range(block):
            k, bit = divmod(j * w, 64)
            words[k] |= columns[j] << np.uint64(bit)
            if bit + w > 64:
                words[k + 1] |= columns[j] >> np.uint64(64 - bit)
        packed = np.ascontiguousarray(words.T).astype("<u8").view(np.uint8)[:, : -(-block * w // 8)]
        out[starts[rows][:, None] + 7 + np.arange(packed.shape[1])] = packed
    return starts.astype("<u8"), out.tobytes()


def unpack(data: np.ndarray, starts: np.ndarray, block: int) -> np.ndarray:
    """The ids of the blocks that begin at starts of data."""
    n, starts = len(starts), starts.astype(np.int64)
    data = np.concatenate([data, np.zeros(8, dtype=np.uint8)])
    word = lambda at, k: sum(data[at + i].astype(np.uint64) << np.uint64(8 * i) for i in range(k))
    low, width, many = word(starts, 4), data[starts + 4].astype(np.int64), word(starts + 5, 2).astype(np.int64)
    out = np.zeros((n, block), dtype=np.uint64)
    for w in np.unique(width[width > 0]):
        rows = np.flatnonzero(width == w)
        bit = np.arange(block) * w
        at = starts[rows][:, None] + 7 + (bit >> 3)
        out[rows] = word(at, 5) >> (bit & 7).astype(np.uint64) & np.uint64((1 << int(w)) - 1)
    row = np.repeat(np.arange(n), many)
    rank = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
    tail = (starts + 7 + -(-block * width // 8))[row]
    out[row, data[tail + rank]] = word(tail + many[row] + 4 * rank, 4)
    return (out + low[:, None]).astype("<u4").reshape(-1)


def write_segment(doc_ids: list[int | None], ids: list[bytes]) -> bytes:
    """The file image of some documents' ids."""
    flat = np.frombuffer(b"".join(ids), dtype="<u4")
    starts, blocks = pack(flat)
    known = np.array([d is not None for d in doc_ids], dtype=np.uint8)
    head = HEAD.pack(b"TWPF", 1, BLOCK, len(doc_ids), len(flat), len(starts))
    return b"".join([head, np.array([d or 0 for d in doc_ids], dtype="<i8").tobytes(), known.tobytes(), np.array([len(i) // 4 for i in ids], dtype="<u8").tobytes(), starts.tobytes(), blocks])


def read_index(image: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int, int, np.ndarray]:
    """doc_ids, known flags, ids per document, block starts, block length, ids in all, the blocks' bytes."""
    magic, version, block, docs, total, blocks = HEAD.unpack_from(image)
    if (magic, version) != (b"TWPF", 1):
        raise ValueError("not a segment of token ids")
    at = HEAD.size
    doc_ids = np.frombuffer(image, "<i8", docs, at)
    known = np.frombuffer(image, np.uint8, docs, at := at + 8 * docs)
    sizes = np.frombuffer(image, "<u8", docs, at := at + docs).astype(np.int64)
    starts = np.frombuffer(image, "<u8", blocks, at := at + 8 * docs)
    return doc_ids, known, sizes, starts, block, total, np.frombuffer(image, np.uint8, offset=at + 8 * blocks)


def read_ids(image: bytes, start: int = 0, stop: int | None = None) -> np.ndarray:
    """The ids start to stop of a segment, from their own blocks only."""
    *_, starts, block, total, data = read_index(image)
    stop = total if stop is None else min(stop, total)
    if start >= stop:
        return np.zeros(0, dtype="<u4")
    first = start // block
    return unpack(data, starts[first : -(-stop // block)], block)[start - first * block : stop - first * block]


def _encode(path: str, end_id: int, segment_ids: int):
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, seg, doc_ids, ids, held = TaskContext.get().partitionId(), 0, [], [], 0

        def image() -> pa.RecordBatch:
            return pa.record_batch({"shard": pa.array([shard], pa.int32()), "seg": pa.array([seg], pa.int64()), "n_ids": pa.array([held], pa.int64()), "image": pa.array([write_segment(doc_ids, ids)], pa.binary())})

        words = encoder(path)
        for b in batches:
            for d, i in zip(b.column("doc_id").to_pylist(), words.encode(b.column("text")), strict=True):
                doc_ids.append(d)
                ids.append(i + end)
                held += len(ids[-1]) // 4
                if held >= segment_ids:
                    yield image()
                    seg, doc_ids, ids, held = seg + 1, [], [], 0
        if doc_ids:
            yield image()

    return run


def write_tokens(docs: DataFrame, tokenizer_path: str, end_id: int = END_ID, segment_ids: int = SEGMENT_IDS) -> str:
    """Encode the text of docs in ascending doc_id order and write the ids; returns the folder of the table of images."""
    out = new_path(docs.sparkSession, "token-ids")
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    # A third of the rows may share a doc_id, or have none: ranges go by the text's hash next, and so does the order.
    rows = rows.withColumn("of", F.xxhash64("text")).repartitionByRange("doc_id", "of").sortWithinPartitions("doc_id", "of", "text").drop("of")
    rows.mapInArrow(_encode(tokenizer_path, end_id, segment_ids), "shard int, seg long, n_ids long, image binary").write.option("compression", "none").parquet(out)
    return out


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for shard, seg, image in zip(b.column("shard").to_pylist(), b.column("seg").to_pylist(), b.column("image"), strict=True):
            image = image.as_buffer().to_pybytes()
            doc_ids, known, sizes, *_ = read_index(image)
            ids = memoryview(read_ids(image)).cast("B")
            ends = np.cumsum(sizes)
            yield pa.record_batch({
                "shard": pa.array([shard] * len(sizes), pa.int32()),
                "seg": pa.array([seg] * len(sizes), pa.int64()),
                "doc_id": pa.array(doc_ids, pa.int64(), mask=known == 0),
                "local": pa.array(ends - sizes, pa.int64()),
                "n_tokens": pa.array(sizes, pa.int64()),
                "ids_crc32": pa.array([zlib.crc32(ids[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)], pa.int64()),
            })


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, read back from the images under path."""
    images = spark.read.schema("shard int, seg long, n_ids long, image binary").parquet(path)
    segs = images.select("shard", "seg", "n_ids")
    shards = segs.groupBy("shard").agg(F.sum("n_ids").alias("ids"))
    before = shards.select("shard", (F.sum("ids").over(Window.orderBy("shard")) - F.col("ids")).alias("before"))
    inside = segs.select("shard", "seg", (F.sum("n_ids").over(Window.partitionBy("shard").orderBy("seg")) - F.col("n_ids")).alias("inside"))
    base = inside.join(before, "shard").select("shard", "seg", (F.col("before") + F.col("inside")).alias("base"))
    docs = images.select("shard", "seg", "image").mapInArrow(_decode, "shard int, seg long, doc_id long, local long, n_tokens long, ids_crc32 long")
    return docs.join(base, ["shard", "seg"]).select("doc_id", (F.col("base") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")


def token_table(docs: DataFrame) -> DataFrame:
    """Write docs with the production tokenizer and read the ids back."""
    import public_tokenizers

    return read_tokens(docs.sparkSession, write_tokens(docs, public_tokenizers.path("word_bpe_49k.json")))


def op1_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_table(table(spark, sf_dir, "documents"))
