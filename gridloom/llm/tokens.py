"""Token ids in sorted-string-table shards: documents keyed by identifier, for binary-search lookup.

A shard holds one range of doc_id in ascending order. Its parts, in this order:

* blocks of about ``BLOCK_BYTES``: entries (shared key bytes u8, other key bytes u8, value bytes u32, key rest, value), the
  whole block compressed with Zstandard. Keys are doc_ids as eight big-endian bytes with the sign bit flipped, so that byte
  order is number order; each key leaves out the bytes it shares with the one before it. Values are ids, little-endian.
* a Bloom filter over the keys,
* a sparse index: for each block its first key, offset, stored bytes, plain bytes, documents and ids,
* a footer: offsets and sizes of filter and index, bytes for each id, the end id's presence and a magic number.

Tasks write shards straight to the shared folder under a name of their own attempt, and a manifest row names each shard that
a successful attempt wrote; only those are read. A lost executor costs the rerun of its tasks.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.llm.scratch import cut, new_path
from gridloom.llm.vocab import encoder, public_path

BLOCK_BYTES = 1 << 17
MAGIC = b"GLSST001"
FOOTER = struct.Struct("<QQQQI8s")
INDEX = struct.Struct("<8sQIIII")
ENTRY = struct.Struct("<BBI")
BLOOM_BITS, BLOOM_HASHES = 10, 7


def key_of(doc_id: int) -> bytes:
    return struct.pack(">Q", doc_id + (1 << 63))


def id_of(key: bytes) -> int:
    return struct.unpack(">Q", key)[0] - (1 << 63)


def _bloom_places(key: bytes, bits: int) -> list[int]:
    a, b = zlib.crc32(key), zlib.crc32(key, 0x9E3779B9) | 1
    return [(a + i * b) % bits for i in range(BLOOM_HASHES)]


class ShardWriter:
    """Writes one shard to an open binary stream; keys must not descend."""

    def __init__(self, stream, width: int):
        self.stream, self.width, self.codec = stream, width, pa.Codec("zstd", compression_level=1)
        self.offset, self.index, self.keys = 0, [], []
        self._fresh()

    def _fresh(self) -> None:
        self.entries, self.size, self.docs, self.ids, self.last, self.first = [], 0, 0, 0, b"", b""

    def add(self, doc_id: int, value: bytes) -> None:
        key = key_of(doc_id)
        shared = next((i for i in range(8) if key[i] != self.last[i]), 8) if self.entries else 0
        self.first = self.first or key
        self.entries += [ENTRY.pack(shared, 8 - shared, len(value)), key[shared:], value]
        self.size += len(value) + ENTRY.size + 8 - shared
        self.docs, self.ids, self.last = self.docs + 1, self.ids + len(value) // self.width, key
        self.keys.append(key)
        if self.size >= BLOCK_BYTES:
            self._flush()

    def _flush(self) -> None:
        if self.entries:
            plain = b"".join(self.entries)
            stored = self.codec.compress(plain, asbytes=True)
            self.stream.write(stored)
            self.index.append((self.first, self.offset, len(stored), len(plain), self.docs, self.ids))
            self.offset += len(stored)
            self._fresh()

    def close(self) -> None:
        self._flush()
        bits = max(64, len(self.keys) * BLOOM_BITS + -len(self.keys) * BLOOM_BITS % 8)
        bloom = bytearray(bits // 8)
        for key in self.keys:
            for at in _bloom_places(key, bits):
                bloom[at >> 3] |= 1 << (at & 7)
        index = b"".join(INDEX.pack(*x) for x in self.index)
        self.stream.write(bytes(bloom) + index)
        self.stream.write(FOOTER.pack(self.offset, len(bloom), self.offset + len(bloom), len(index), self.width, MAGIC))


class ShardReader:
    """Reads one shard from a seekable stream: all documents in order, or one by binary search."""

    def __init__(self, stream):
        self.stream = stream
        stream.seek(0, 2)
        stream.seek(stream.tell() - FOOTER.size)
        self.bloom_at, self.bloom_size, index_at, index_size, self.width, magic = FOOTER.unpack(stream.read(FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a token shard")
        stream.seek(index_at)
        self.index = list(INDEX.iter_unpack(stream.read(index_size)))
        self.codec, self.bloom = pa.Codec("zstd"), None

    def _block(self, nth: int) -> Iterator[tuple[bytes, bytes]]:
        _, offset, stored, plain, _, _ = self.index[nth]
        self.stream.seek(offset)
        data, at, key = self.codec.decompress(self.stream.read(stored), plain, asbytes=True), 0, b""
        while at < plain:
            shared, rest, size = ENTRY.unpack_from(data, at)
            at += ENTRY.size
            key = key[:shared] + data[at : at + rest]
            yield key, data[at + rest : at + rest + size]
            at += rest + size

    def __iter__(self) -> Iterator[tuple[int, bytes]]:
        for nth in range(len(self.index)):
            for key, value in self._block(nth):
                yield id_of(key), value

    def may_hold(self, doc_id: int) -> bool:
        if self.bloom is None:  # read at the first lookup and kept
            self.stream.seek(self.bloom_at)
            self.bloom = self.stream.read(self.bloom_size)
        return all(self.bloom[at >> 3] >> (at & 7) & 1 for at in _bloom_places(key_of(doc_id), self.bloom_size * 8))

    def lookup(self, doc_id: int) -> list[bytes]:
        """The values of a doc_id: none, one, or all of its repeated rows."""
        if not self.may_hold(doc_id):
            return []
        key, low, high = key_of(doc_id), 0, len(self.index)
        while low < high:
            mid = (low + high) // 2
            low, high = (mid + 1, high) if self.index[mid][0] < key else (low, mid)
        found = []
        for nth in range(max(0, low - 1), len(self.index)):
            if self.index[nth][0] > key:
                break
            found += [v for k, v in self._block(nth) if k == key]
        return found


def arrow_uri(path: str) -> str:
    scheme, there, rest = path.partition("://")
    return f"s3://{rest}" if there and scheme in ("s3a", "s3n") else path


def open_file(path: str, write: bool = False):
    """A binary stream on any file system that Arrow knows (local, HDFS, S3, ...). Spark's s3a is Arrow's s3."""
    from pyarrow import fs

    system, at = fs.FileSystem.from_uri(arrow_uri(path))
    if not write:
        return system.open_input_file(at)
    system.create_dir(at.rpartition("/")[0], recursive=True)
    return system.open_output_stream(at)


def write_shards(docs: DataFrame, folder: str, vocabulary: str, end_id: int = 2) -> DataFrame:
    """Write the ids of each whole text, the end id after each, as shards in ascending doc_id order.

    Returns the manifest, a written table: (shard, path, first, docs, ids), one row for each shard; shards ascend with doc_id.
    Null texts count as empty and get the end id alone. Rows without a doc_id have no key and are left out. Repeated rows
    are all written, equal doc_ids in the order of their texts. An empty table gives an empty manifest.
    """

    def run(batches):
        code, end = encoder(vocabulary, spaced=True), np.array([end_id], "<u2").tobytes()
        writer, path, tokens, first, last = None, f"{folder}/{uuid4().hex}.sst", 0, None, None
        for b in batches:
            for doc_id, text in zip(b["doc_id"].to_pylist(), b["text"], strict=True):
                if writer is None:
                    stream = open_file(path, write=True)
                    writer, first = ShardWriter(stream, 2), doc_id
                value = code.encode(text.as_py() or "") + end
                writer.add(doc_id, value)
                tokens, last = tokens + len(value) // 2, doc_id
        if writer:
            writer.close()
            stream.close()
            yield pa.RecordBatch.from_pydict({"path": [path], "first": [first], "last": [last], "docs": [len(writer.keys)], "ids": [tokens]})

    keyed = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ordered = keyed.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return cut(ordered.mapInArrow(run, "path string, first long, last long, docs long, ids long"), "manifest")


def read_shards(manifest: DataFrame) -> DataFrame:
    """Rows (doc_id, start, n_tokens, ids) of all shards; start: ids of all documents before it.

    The running sum is over shards (one manifest row each), not over documents: within a shard the reader counts on.
    """
    names = ["doc_id", "start", "n_tokens", "ids"]

    def rows_of(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), [pa.int64()] * 3 + [pa.binary()], strict=True)], names)

    def run(batches):
        for b in batches:
            for path, start in zip(b["path"].to_pylist(), b["base"].to_pylist(), strict=True):
                with open_file(path) as stream:
                    rows, size = [], 0
                    for doc_id, value in (reader := ShardReader(stream)):
                        n = len(value) // reader.width
                        rows.append((doc_id, start, n, np.frombuffer(value, f"<u{reader.width}").astype("<u4").tobytes()))
                        start, size = start + n, size + len(value)
                        if size > 1 << 21:
                            yield rows_of(rows)
                            rows, size = [], 0
                    if rows:
                        yield rows_of(rows)

    ahead = Window.orderBy("first", "last", "path").rowsBetween(Window.unboundedPreceding, -1)
    placed = manifest.select("path", F.coalesce(F.sum("ids").over(ahead), F.lit(0)).alias("base"))
    # a task for each shard: their rows are few, but each stands for a file
    return placed.repartition(max(1, manifest.count()), "path").mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def token_spans(manifest: DataFrame) -> DataFrame:
    """Rows (doc_id, start, n_tokens, ids_crc32) read back from the shards."""
    return read_shards(manifest).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op3_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    manifest = write_shards(docs, new_path(spark, "shards"), public_path("byte_bpe_50k.json"))
    return token_spans(manifest)


QUERIES = {"op3_token_shards": op3_token_shards}
ORACLE_SQL: dict[str, str] = {}
