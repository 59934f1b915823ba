"""Media columns: payloads in tar shards addressed by content; rows carry digest, shard, offset, length.

Each document's bytes become an 8-bit grey PNG (64 samples a row, zero padded). A task writes the
PNGs of its rows to one tar shard after another in the shared folder, each content once a shard, and
returns pointers only, so payloads never go through a shuffle. Copies in different shards then agree
on one place (the smallest pointer of a digest). Metadata columns come from range reads of the header
alone; features from reading the stored bytes back, each content once.

A retried or speculative task writes shards of its own under new names; pointers lead only to
shards of the attempts that finished. The pointer table is written before it is read, so a lost
executor never makes shards anew.

Edge cases: null and empty texts are one row of zeros; repeated rows share one stored content; null
ids and any extra columns pass through untouched; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import io
import struct
import tarfile
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonguemill.llm.common import file_system, new_path, written

WIDTH = 64
#: A shard is closed when it has passed this size.
SHARD_BYTES = 128 << 20
#: Signature and IHDR chunk: what a header-only read fetches.
HEADER_BYTES = 33
_SIGNATURE = b"\x89PNG\r\n\x1a\n"


def pad(raw: bytes) -> bytes:
    """raw with zeros up to a positive multiple of WIDTH."""
    return raw + bytes((-len(raw)) % WIDTH or (0 if raw else WIDTH))


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def to_png(payload: bytes) -> bytes:
    """payload (a positive multiple of WIDTH) as the samples of a grey image, without filters."""
    rows = np.zeros((len(payload) // WIDTH, WIDTH + 1), np.uint8)  # column 0: filter type none
    rows[:, 1:] = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return _SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), 6)) + _chunk(b"IEND", b"")


def read_header(head: bytes) -> tuple[int, int, int]:
    """Width, height and bit depth from the first HEADER_BYTES."""
    if head[:8] != _SIGNATURE or head[12:16] != b"IHDR":
        raise ValueError("not a PNG header")
    return struct.unpack(">IIB", head[16:25])


def from_png(png: bytes) -> bytes:
    """The samples of an image that to_png made; damaged chunks raise."""
    width, height, _ = read_header(png[:HEADER_BYTES])
    at, data = 8, []
    while at < len(png):
        (n,) = struct.unpack_from(">I", png, at)
        kind, body = png[at + 4 : at + 8], png[at + 8 : at + 8 + n]
        if zlib.crc32(kind + body) != struct.unpack_from(">I", png, at + 8 + n)[0]:
            raise ValueError("damaged chunk")
        data += [body] * (kind == b"IDAT")
        at += 12 + n
    rows = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(height, width + 1)
    if rows[:, 0].any():
        raise ValueError("filtered rows are not written here")
    return rows[:, 1:].tobytes()


def feature(payload: bytes) -> str:
    """Sample statistics as text, from integers only, so equal payloads give equal strings."""
    x = np.frombuffer(payload, np.uint8)
    counts = np.bincount(x, minlength=256)
    total, squares = int((counts * np.arange(256)).sum()), int((counts * np.arange(256) ** 2).sum())
    return f"n={len(x)};sum={total};squares={squares};levels={int((counts > 0).sum())};mode={int(counts.argmax())};edges={int((x[1:] != x[:-1]).sum())}"


class _Shards:
    """Tar shards of one task attempt."""

    def __init__(self, folder: str):
        self.fs, self.folder = file_system(folder)
        self.fs.create_dir(self.folder, recursive=True)
        self.out, self.name, self.at, self.seen = None, "", 0, {}

    def put(self, digest: str, png: bytes) -> tuple[str, int, int]:
        if self.out and self.at > SHARD_BYTES:
            self.close()
        if not self.out:
            self.name, self.at, self.seen = f"{uuid.uuid4().hex}.tar", 0, {}
            self.out = self.fs.open_output_stream(f"{self.folder}/{self.name}")
        if digest not in self.seen:
            info = tarfile.TarInfo(f"{digest}.png")
            info.size = len(png)
            head = info.tobuf(tarfile.USTAR_FORMAT)
            self.out.write(head)
            self.out.write(png + bytes(-len(png) % 512))
            self.seen[digest] = (self.name, self.at + len(head), len(png))
            self.at += len(head) + len(png) + (-len(png) % 512)
        return self.seen[digest]

    def close(self) -> None:
        if self.out:
            self.out.write(bytes(1024))
            self.out.close()
            self.out = None


def store(df: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes every text to shards under folder; id, n_bytes, digest (of the PNG), shard, offset, length."""
    schema = df.select(id_col).schema.simpleString()[7:-1] + ", n_bytes bigint, digest string, shard string, offset bigint, length bigint"

    def run(batches):
        shards = _Shards(folder)
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                raw = (text or "").encode()
                png = to_png(pad(raw))
                digest = hashlib.sha256(png).hexdigest()
                rows.append((len(raw), digest, *shards.put(digest, png)))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, columns, kinds)], [id_col, "n_bytes", "digest", "shard", "offset", "length"])
        shards.close()

    return df.select(id_col, text_col).mapInArrow(run, schema)


def places(pointers: DataFrame) -> DataFrame:
    """One row per content: digest, and the shard, offset and length that every row of it shall use."""
    first = F.min(F.struct("shard", "offset", "length"))
    return pointers.groupBy("digest").agg(first.alias("place")).select("digest", "place.*")


def _ranges(places_df: DataFrame, folder: str, columns: str, read) -> DataFrame:
    """places_df with columns of read(open file, offset, length), for each place; runs of a shard open its file once."""
    names = [*places_df.columns, *(c.split()[0] for c in columns.split(", "))]
    schema = f"{places_df.schema.simpleString()[7:-1]}, {columns}"
    own = [places_df.columns.index(c) for c in ("shard", "offset", "length")]

    def run(batches):
        fs, root = file_system(folder)
        name, f = None, None
        for batch in batches:
            shards, offsets, lengths = (batch.column(i).to_pylist() for i in own)
            rows: list = [None] * len(shards)
            for i in sorted(range(len(shards)), key=lambda i: (shards[i], offsets[i])):
                if shards[i] != name:
                    name, f = shards[i], fs.open_input_file(f"{root}/{shards[i]}")
                rows[i] = read(f, offsets[i], lengths[i])
            table = pa.table([*batch.columns, *([r[k] for r in rows] for k in range(len(names) - len(batch.columns)))], names=names)
            yield from table.to_batches()

    return places_df.mapInArrow(run, schema)


def _head(f, offset: int, length: int) -> tuple:
    f.seek(offset)
    return read_header(f.read(min(HEADER_BYTES, length)))


def _whole(f, offset: int, length: int) -> tuple:
    f.seek(offset)
    png = f.read(length)
    payload = from_png(png)
    return (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-WIDTH:]), len(png), hashlib.sha256(png).hexdigest(), feature(payload))


def headers(places_df: DataFrame, folder: str) -> DataFrame:
    """places_df with width, height, bit_depth by reading HEADER_BYTES of each content."""
    return _ranges(places_df, folder, "width bigint, height bigint, bit_depth bigint", _head)


def features(places_df: DataFrame, folder: str) -> DataFrame:
    """places_df with what the stored bytes say when all are read: payload and media sizes, digests, checksum, feature."""
    return _ranges(places_df, folder, "payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string", _whole)


def media_columns(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stores every text and returns a row per input row: id, n_bytes, pointer (digest, shard, offset, length), metadata, features."""
    folder = new_path(df.sparkSession, "media")
    pointers = written(store(df, folder, id_col, text_col), "media-pointers")
    facts = features(headers(places(pointers), folder), folder)
    return pointers.select(id_col, "n_bytes", "digest").join(facts, "digest")
