"""Media columns: payloads as images in archive directories, and a Spark data source over them.

A payload is padded to rows of 64 bytes and stored as an 8-bit grey PNG of width 64. Images are members of ZIP
archives, stored without a second compression; the member's name holds doc_id and the payload's own length. Writing
tasks close an archive at ARCHIVE_BYTES or ARCHIVE_MEMBERS; a finished write adds a manifest that lists the archives of
the tasks that succeeded with the offset of a member about every SPLIT_BYTES, so that archives of failed attempts are
never read; archives without any manifest raise. The reader plans byte ranges from the manifests, PARTITIONS of them at
most for large directories, walks the members of its ranges, gives them on as Arrow batches, and reads a member that fails
again from its own offset.

Paths are opened by their file-system scheme (pyarrow.fs), so archives may lie in any store that it knows.

Defined cases: null and empty texts are 64 zero bytes; null doc_ids come back null; repeated rows are members of their
own; equal payloads give equal images; an empty directory gives no rows; a very long text is a tall image, held whole by
one task; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import json
import struct
import time
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from .common import new_path, table

WIDTH = 64
ARCHIVE_BYTES, ARCHIVE_MEMBERS, SPLIT_BYTES, PARTITIONS = 256 << 20, 60_000, 16 << 20, 20_000
RETRIES, WINDOW = 4, 1 << 20
BATCH_BYTES = 8 << 20
SCHEMA = "doc_id long, n_bytes long, media binary"
_ARROW = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])
#: The layouts of ZIP's local header, directory entry and end record, and the PNG signature.
_LOCAL, _ENTRY, _END = struct.Struct("<4s5H3I2H"), struct.Struct("<4s6H3I5H2I"), struct.Struct("<4s4H2IH")
_PNG = b"\x89PNG\r\n\x1a\n"


def padded(data: bytes) -> bytes:
    return data + bytes((-len(data)) % WIDTH if data else WIDTH)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode_png(payload: bytes) -> bytes:
    """A payload of whole rows as an 8-bit grey image."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    lines = np.concatenate([np.zeros((len(rows), 1), np.uint8), rows], axis=1)
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return _PNG + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 1)) + _chunk(b"IEND", b"")


def decode_png(data: bytes) -> bytes:
    """The payload of an image that encode_png made; every part's checksum is checked."""
    if data[:8] != _PNG:
        raise ValueError("no PNG signature")
    at, parts, height = 8, [], 0
    while at < len(data):
        (size,) = struct.unpack_from(">I", data, at)
        kind, body = data[at + 4 : at + 8], data[at + 8 : at + 8 + size]
        if struct.unpack_from(">I", data, at + 8 + size)[0] != zlib.crc32(kind + body):
            raise ValueError("damaged PNG part")
        if kind == b"IHDR":
            height = struct.unpack_from(">II", body)[1]
        elif kind == b"IDAT":
            parts.append(body)
        at += 12 + size
    return np.frombuffer(zlib.decompress(b"".join(parts)), np.uint8).reshape(height, WIDTH + 1)[:, 1:].tobytes()


def member_name(doc_id: int | None, n_bytes: int) -> bytes:
    return f"{'null' if doc_id is None else doc_id}.{n_bytes}.png".encode()


class Archive:
    """A ZIP archive that is written from front to back."""

    def __init__(self, stream):
        self.stream, self.size, self.entries, self.count, self.splits = stream, 0, [], 0, [0]

    def add(self, name: bytes, data: bytes) -> None:
        if self.size - self.splits[-1] >= SPLIT_BYTES:
            self.splits.append(self.size)
        crc = zlib.crc32(data)
        self.entries.append(_ENTRY.pack(b"PK\x01\x02", 20, 20, 0, 0, 0, 0x21, crc, len(data), len(data), len(name), 0, 0, 0, 0, 0, self.size) + name)
        head = _LOCAL.pack(b"PK\x03\x04", 20, 0, 0, 0, 0x21, crc, len(data), len(data), len(name), 0) + name
        self.stream.write(head)
        self.stream.write(data)
        self.size += len(head) + len(data)
        self.count += 1

    def close(self) -> None:
        directory = b"".join(self.entries)
        self.stream.write(directory + _END.pack(b"PK\x05\x06", 0, 0, self.count, self.count, len(directory), self.size, 0))
        self.stream.close()


def _filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if ":" in path else f"file://{path}")


@dataclass
class Written(WriterCommitMessage):
    archives: list[tuple[str, int, list[int]]]


class ArchiveWriter(DataSourceArrowWriter):
    def __init__(self, path: str):
        self.path = path

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, base = _filesystem(self.path)
        fs.create_dir(base, recursive=True)
        done, open_archive, name = [], None, ""

        def finish() -> None:
            open_archive.close()
            done.append((name, open_archive.size, open_archive.splits))

        for batch in iterator:
            for doc_id, n_bytes, media in zip(*(batch.column(c).to_pylist() for c in _ARROW.names), strict=True):
                if open_archive and (open_archive.size + len(media) > ARCHIVE_BYTES or open_archive.count >= ARCHIVE_MEMBERS):
                    finish()
                    open_archive = None
                if open_archive is None:
                    name = f"media-{uuid.uuid4().hex}.zip"
                    open_archive = Archive(fs.open_output_stream(f"{base}/{name}"))
                open_archive.add(member_name(doc_id, n_bytes), media)
        if open_archive:
            finish()
        return Written(done)

    def commit(self, messages: list[Written | None]) -> None:
        fs, base = _filesystem(self.path)
        fs.create_dir(base, recursive=True)
        archives = [a for m in messages if m for a in m.archives]
        with fs.open_output_stream(f"{base}/manifest-{uuid.uuid4().hex}.json") as f:
            f.write(json.dumps(archives).encode())

    def abort(self, messages: list[Written | None]) -> None:
        fs, base = _filesystem(self.path)
        for name, *_ in (a for m in messages if m for a in m.archives):
            fs.delete_file(f"{base}/{name}")


@dataclass
class ByteRange(InputPartition):
    """Stretches of archives: name, start and end of each."""

    stretches: list[tuple[str, int, int]]


def planned(archives: list[tuple[str, int, list[int]]], most: int = PARTITIONS) -> list[ByteRange]:
    """Byte ranges of archives (name, size, offsets of members): a split each, or as many splits together as keep their number down."""
    target = max(SPLIT_BYTES, -(-sum(size for _, size, _ in archives) // most))
    out, held, n = [], [], 0
    for name, size, splits in archives:
        for start, end in zip(splits, [*splits[1:], size], strict=True):
            if held and held[-1][0] == name and held[-1][2] == start:
                held[-1] = (name, held[-1][1], end)
            else:
                held.append((name, start, end))
            n += end - start
            if n >= target:
                out.append(ByteRange(held))
                held, n = [], 0
    return [*out, ByteRange(held)] if held or not out else out


class MemberReader:
    """Members of one archive by offset; a failed read is tried again from the same offset with a new handle."""

    def __init__(self, fs, path: str, retries: int = RETRIES, wait: float = 0.1):
        self.fs, self.path, self.retries, self.wait, self.file = fs, path, retries, wait, None
        self.at, self.window = 0, b""

    def _bytes(self, offset: int, n: int) -> bytes:
        lo = offset - self.at
        if lo < 0 or lo + n > len(self.window):
            if self.file is None:
                self.file = self.fs.open_input_file(self.path)
            self.file.seek(offset)
            self.at, self.window, lo = offset, self.file.read(max(n, WINDOW)), 0
        got = self.window[lo : lo + n]
        if len(got) < n:
            raise OSError(f"{self.path} ends inside a member at {offset}")
        return got

    def _member(self, offset: int) -> tuple[bytes, bytes, int]:
        magic, *_, crc, size, _, named, extra = _LOCAL.unpack(self._bytes(offset, _LOCAL.size))
        if magic != b"PK\x03\x04":
            raise OSError(f"no member of {self.path} at {offset}")
        at = offset + _LOCAL.size + named + extra
        name, data = self._bytes(offset + _LOCAL.size, named), self._bytes(at, size)
        if zlib.crc32(data) != crc:
            raise OSError(f"damaged member of {self.path} at {offset}")
        return name, data, at + size

    def member(self, offset: int) -> tuple[bytes, bytes, int]:
        """Name, data and the next member's offset."""
        for attempt in range(self.retries + 1):
            try:
                return self._member(offset)
            except (OSError, struct.error):
                self.file, self.window = None, b""
                if attempt == self.retries:
                    raise
                time.sleep(self.wait * 2**attempt)
        raise AssertionError


class ArchiveReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[ByteRange]:
        from pyarrow.fs import FileSelector

        fs, base = _filesystem(self.path)
        files = sorted(fs.get_file_info(FileSelector(base, allow_not_found=True)), key=lambda i: i.base_name)
        manifests, archives = [i for i in files if i.base_name.startswith("manifest-")], []
        if not manifests and any(i.base_name.endswith(".zip") for i in files):
            raise FileNotFoundError(f"{self.path} holds archives but no manifest: its write did not finish")
        for info in manifests:
            with fs.open_input_stream(info.path) as f:
                archives += json.loads(f.read())
        return planned(archives)

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        fs, base = _filesystem(self.path)
        rows, held = [], 0
        for name, at, end in partition.stretches:
            reader = MemberReader(fs, f"{base}/{name}")
            while at < end:
                member, data, at = reader.member(at)
                doc_id, n_bytes, _ = member.decode().split(".")
                rows.append((None if doc_id == "null" else int(doc_id), int(n_bytes), data))
                held += len(data)
                if held >= BATCH_BYTES:
                    yield self._batch(rows)
                    rows, held = [], 0
        if rows:
            yield self._batch(rows)

    @staticmethod
    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)


class ArchiveDataSource(DataSource):
    """Format media_archive: doc_id, n_bytes, media of the members under a path."""

    @classmethod
    def name(cls) -> str:
        return "media_archive"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> ArchiveWriter:
        return ArchiveWriter(self.options["path"])


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = [t or b"" for t in b.column("text").cast(pa.binary()).to_pylist()]
        media = [encode_png(padded(t)) for t in texts]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([len(t) for t in texts], pa.int64()), pa.array(media, pa.binary())], schema=_ARROW)


def write_media(docs: DataFrame, path: str) -> None:
    """Store the text of docs under path."""
    docs.sparkSession.dataSource.register(ArchiveDataSource)
    docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_encode, SCHEMA).write.format("media_archive").mode("append").save(path)


def read_media(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(ArchiveDataSource)
    return spark.read.format("media_archive").load(path)


def feature(payload: bytes) -> str:
    """A coarse picture of an image: for each of its 64 columns whether it is brighter than the median column, in hex."""
    sums = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH).sum(axis=0, dtype=np.int64)
    return np.packbits(sums > np.sort(sums)[WIDTH // 2]).tobytes().hex()


FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        media = b.column("media").to_pylist()
        rows = []
        for m in media:
            p = decode_png(m)
            rows.append((len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), len(m), hashlib.sha256(m).hexdigest(), feature(p)))
        kinds = {"payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64(), "media_bytes": pa.int64(), "media_sha256": pa.string(), "feature": pa.string()}
        cols = [pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds.values())]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_bytes"), *cols], names=["doc_id", "n_bytes", *kinds])


def features(media: DataFrame) -> DataFrame:
    """Lengths, checksums and the feature of each stored image's payload."""
    return media.mapInArrow(_features, FEATURES)


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "media")
    write_media(table(spark, sf_dir, "documents"), path)
    return features(read_media(spark, path))
