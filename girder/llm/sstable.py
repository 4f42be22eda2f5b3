"""Sorted-string-table shards of token ids: a binary file format with binary-search lookup.

A shard is a file of blocks, a block index, a Bloom filter and a footer. Entries are in ascending key order; a
key is the document's identifier as 8 big-endian bytes with the sign bit flipped, or no bytes for null. A block
stores each key without the bytes that it shares with the key before it. The index has, for each block, its
last key, offset and length. The value of a key is its token ids, little-endian, two bytes each where the
vocabulary allows and four otherwise.

    entry   varint shared bytes, varint further bytes, varint value bytes, further key bytes, value
    index   for each block: varint key bytes, key, varint offset, varint length
    bloom   one byte number of probes, then the bits
    footer  8 numbers of 8 bytes: index offset, index length, bloom offset, bloom length, documents, tokens,
            bytes an id, blocks; then the magic number
"""

from __future__ import annotations

import bisect
import hashlib
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, id_and_text, map_batches, new_dir, put, saved
from .tokenizing import encoder, vocabulary

MAGIC = b"GIRDSST1"
FOOTER = struct.Struct("<8Q8s")
BLOCK_BYTES = 64 << 10
SHARD_BYTES = 64 << 20
BITS_PER_KEY, PROBES = 10, 7
MANIFEST = "shard long, path string, n_docs long, n_tokens long"


def key_of(doc_id: int | None) -> bytes:
    return b"" if doc_id is None else ((doc_id + (1 << 63)) % (1 << 64)).to_bytes(8, "big")


def id_of(key: bytes) -> int | None:
    return int.from_bytes(key, "big") - (1 << 63) if key else None


def varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def probes(key: bytes, bits: int) -> list[int]:
    a, b = struct.unpack("<QQ", hashlib.blake2b(key, digest_size=16).digest())
    return [(a + k * (b | 1)) % (1 << 64) % bits for k in range(PROBES)]


class Writer:
    """Builds one shard in memory; keys come in ascending order and may repeat."""

    def __init__(self, width: int):
        self.width, self.out, self.block, self.last = width, bytearray(), bytearray(), b""
        self.index, self.keys, self.tokens = bytearray(), [], 0
        self.blocks = 0

    def add(self, key: bytes, ids: bytes) -> None:
        """``ids``: little-endian unsigned 32-bit integers."""
        value = ids
        if self.width == 2:
            wide = np.frombuffer(ids, "<u4")
            if len(wide) and wide.max() > 0xFFFF:
                raise ValueError(f"id {wide.max()} does not fit into two bytes")
            value = wide.astype("<u2").tobytes()
        if len(self.block) >= BLOCK_BYTES:
            self.end_block()
        shared = 0
        while shared < min(len(key), len(self.last)) and key[shared] == self.last[shared]:
            shared += 1
        self.block += varint(shared) + varint(len(key) - shared) + varint(len(value)) + key[shared:] + value
        self.last = key
        self.keys.append(key)
        self.tokens += len(ids) // 4

    def end_block(self) -> None:
        self.index += varint(len(self.last)) + self.last + varint(len(self.out)) + varint(len(self.block))
        self.out += self.block
        self.block, self.last = bytearray(), b""
        self.blocks += 1

    def size(self) -> int:
        return len(self.out) + len(self.block)

    def finish(self) -> bytes:
        if self.block:
            self.end_block()
        bits = max(64, BITS_PER_KEY * len(self.keys))
        bloom = np.zeros(bits, bool)
        bloom[[p for key in self.keys for p in probes(key, bits)]] = True
        filtered = bytes([PROBES]) + np.packbits(bloom, bitorder="little").tobytes()
        at = len(self.out)
        footer = FOOTER.pack(at, len(self.index), at + len(self.index), len(filtered), len(self.keys), self.tokens, self.width, self.blocks, MAGIC)
        return bytes(self.out) + bytes(self.index) + filtered + footer


class Reader:
    """Reads one shard's bytes."""

    def __init__(self, data: bytes):
        self.data = data
        self.index_at, index_len, bloom_at, bloom_len, self.docs, self.tokens, self.width, _, magic = FOOTER.unpack(data[-FOOTER.size :])
        if magic != MAGIC:
            raise ValueError("not a shard of this format")
        self.bloom = np.frombuffer(data, np.uint8, bloom_len - 1, bloom_at + 1)
        self.blocks, at = [], self.index_at
        while at < self.index_at + index_len:
            n, at = read_varint(data, at)
            key, at = data[at : at + n], at + n
            offset, at = read_varint(data, at)
            length, at = read_varint(data, at)
            self.blocks.append((key, offset, length))

    def entries(self, offset: int, length: int) -> Iterator[tuple[bytes, bytes]]:
        data, at, end, key = self.data, offset, offset + length, b""
        while at < end:
            shared, at = read_varint(data, at)
            more, at = read_varint(data, at)
            size, at = read_varint(data, at)
            key = key[:shared] + data[at : at + more]
            at += more
            yield key, data[at : at + size]
            at += size

    def __iter__(self) -> Iterator[tuple[bytes, bytes]]:
        for _, offset, length in self.blocks:
            yield from self.entries(offset, length)

    def ids(self, value: bytes) -> np.ndarray:
        return np.frombuffer(value, "<u2" if self.width == 2 else "<u4").astype("<u4")

    def may_hold(self, key: bytes) -> bool:
        bits = max(64, BITS_PER_KEY * self.docs)
        return all(self.bloom[p >> 3] >> (p & 7) & 1 for p in probes(key, bits))

    def get(self, doc_id: int | None) -> np.ndarray | None:
        """The ids of a document, or None: Bloom filter, binary search of the index, then one block."""
        key = key_of(doc_id)
        if not self.may_hold(key):
            return None
        k = bisect.bisect_left(self.blocks, key, key=lambda b: b[0])
        if k < len(self.blocks):
            for found, value in self.entries(*self.blocks[k][1:]):
                if found == key:
                    return self.ids(value)
        return None


def write_shards(docs: DataFrame, folder: str, encode: Callable[[], Callable], width: int, end_id: int, together: bool = False) -> DataFrame:
    """Write all documents in ascending id order; (shard, path, n_docs, n_tokens), a row per shard, shards in key order.

    ``docs`` has doc_id and text (see id_and_text). What ``encode`` returns makes a text's ids, or with ``together`` those
    of a list of texts one after the other. Null ids come first, repeated ids stay side by side. Each
    range of ids becomes one shard, or several where it is larger than SHARD_BYTES. ``folder`` is one that
    executors can write to through pyarrow's file systems.
    """
    spark = docs.sparkSession
    fs.FileSystem.from_uri(folder)[0].create_dir(fs.FileSystem.from_uri(folder)[1])
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, end = encode(), end_id.to_bytes(4, "little")
        shard, writer, rows = TaskContext.get().partitionId() << 20, Writer(width), []

        def close() -> None:
            path = f"{folder}/shard-{shard:016d}.sst"
            put(path, writer.finish())
            rows.append((shard, path, len(writer.keys), writer.tokens))

        for batch in batches:
            for doc_id, value in zip(batch.column(0).to_pylist(), ids(batch.column(1).to_pylist()) if together else map(ids, batch.column(1).to_pylist()), strict=True):
                if writer.size() >= SHARD_BYTES:
                    close()
                    shard, writer = shard + 1, Writer(width)
                writer.add(key_of(doc_id), value + end)
        if writer.keys:
            close()
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=["shard", "path", "n_docs", "n_tokens"])

    ordered = docs.repartitionByRange(n, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first())
    return saved(map_batches(ordered, write, MANIFEST), "sst-manifest")


def read_shards(manifest: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, read from the files; start counts the ids of all documents before it."""
    spark = manifest.sparkSession
    schema = "path string, k long, doc_id long, local_start long, n_tokens long, ids_crc32 long"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                shard, rows, start = Reader(content.as_buffer().to_pybytes()), [], 0
                for k, (key, value) in enumerate(shard):
                    ids = shard.ids(value)
                    rows.append((path.rsplit("/", 1)[1], k, id_of(key), start, len(ids), zlib.crc32(ids)))
                    start += len(ids)
                if rows:
                    columns = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(next(columns))] + [pa.array(c, pa.int64()) for c in columns], names=[c.split()[0] for c in schema.split(", ")])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.sst").load(folder).select("path", "content")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row per shard
    starts = manifest.select(
        F.element_at(F.split("path", "/"), -1).alias("path"), F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("shard_start")
    )
    return (
        map_batches(files, read, schema)
        .join(starts, "path")
        .select("doc_id", (F.col("shard_start") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")
    )


def op8_sstable(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = vocabulary("byte_bpe_50k.json")
    folder = new_dir(spark, "sst")
    manifest = write_shards(id_and_text(documents(spark, sf_dir)), folder, lambda: encoder(path).many, 2, 0, together=True)
    return read_shards(manifest, folder)
