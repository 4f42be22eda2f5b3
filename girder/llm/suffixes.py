"""Exact removal of repeated byte strings by bucket-pointer refinement of suffixes.

A suffix's first bucket is its q-gram. Each round refines the buckets of all suffixes at once to about twice the
length: a suffix's new bucket is the pair of its own and of the bucket that the suffix some bytes later had in the
round before, so that every round reuses the last one's updates, up to the length sought. Buckets are named by
what is in them, a 64-bit hash, so rounds need no exchange.

Of the round before the last, at half the length, buckets are dealt out over the cluster. Every string of the
full length has a smallest half-length bucket (by name), which equal strings share, so only the suffixes at those
places are dealt out at first: sorted by their bucket, then by the refined buckets of the first and last string
that have this smallest one. A bucket that this leaves with one document is done; where all its suffixes
agree, all but the smallest document's are repeats. Only the buckets that hold unlike suffixes are refined
further, string by string. What a task finds equal in its own batch it settles alone: one suffix of a kind is
dealt out for each batch, so no bucket grows with the copies of a text.

Strings are equal if 128 bits agree, two names of half the length (which overlap by a byte where it is odd): of n
strings two unlike ones are taken for equal with a chance of n**2 / 2**129.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, map_batches, pieces, release, saved, text_bytes
from .hashing import BASE, U, mix, window_hashes

#: Bytes of text from which one message to each bucket is made.
BATCH_BYTES = 4 << 20
#: Bytes of the first buckets' q-grams, at most.
FIRST = 8
#: Longest strings that can be sought: a record holds the length of a run in 16 bits.
LONGEST = 1 << 16
#: Null ids are larger than all others; a real id of this value counts as equal to them.
LAST_ID = (1 << 63) - 1
MESSAGE = "bucket int, payload binary"
FOUND = "doc_id long, row long, start int, stop int, kind int"
REPEATED, UNLIKE = 1, 2
RECORD = np.dtype([("a", "<u8"), ("b", "<u8"), ("doc", "<i8"), ("row", "<i8"), ("start", "<i4"), ("n", "<u2"), ("settled", "?")])


def smallest(values: np.ndarray, width: int) -> np.ndarray:
    """Index of the leftmost smallest of values[p:p + width], for each p."""
    n = len(values) - width + 1
    at, low, size = np.arange(len(values), dtype=np.int32), values, 1
    steps = []
    while 2 * size <= width:
        steps.append(size)
        size *= 2
    if size < width:
        steps.append(width - size)
    for step in steps:
        take = low[step:] < low[: len(low) - step]
        at = np.where(take, at[step:], at[: len(at) - step])
        low = np.where(take, low[step:], low[: len(low) - step])
    return at[:n]


def buckets_at(raw: np.ndarray, length: int) -> np.ndarray:
    """The bucket of the string of ``length`` at each byte: q-grams, refined round by round by the buckets of later offsets."""
    if length <= FIRST:
        return window_hashes(raw, length)
    half = (length + 1) // 2
    before = buckets_at(raw, half)
    later = length - half
    return mix(before[: max(0, len(before) - later)] * U(BASE) + before[later:])


def suffix_runs(raw: np.ndarray, offsets: np.ndarray, length: int) -> tuple:
    """(first, last, q-gram bucket, refined bucket, text) of each run of strings that share their smallest q-gram."""
    q = (length + 1) // 2
    grams = buckets_at(raw, q)
    n = len(raw) - length + 1
    if n <= 0:
        return (np.zeros(0, np.int64),) * 5
    at = smallest(grams, length - q + 1)[:n]
    inside = np.ones(n + 1, bool)
    for end in offsets[1:]:
        inside[max(0, end - length + 1) : min(end, n)] = False
    inside[n] = False
    new = np.ones(n, bool)
    new[1:] = (at[1:] != at[:-1]) | ~inside[: n - 1]
    first = np.flatnonzero(new & inside[:n])
    stop = np.ones(n, bool)
    stop[:-1] = (at[1:] != at[:-1]) | ~inside[1:n]
    last = np.flatnonzero(stop & inside[:n])
    place = at[first]
    shape = ((last - first) << 16 | (place - first)).astype(U)
    later = length - q
    refined = mix(mix(string_buckets(grams, first, later)[2] * U(BASE) + string_buckets(grams, last, later)[2]) + shape)
    return first, last, grams[place], refined, np.searchsorted(offsets, first, "right") - 1


def string_buckets(grams: np.ndarray, at: np.ndarray, later: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The buckets at the suffix and some bytes later, and the refined bucket made of both."""
    a, b = grams[at], grams[at + later]
    return a, b, mix(a * U(BASE) + b)


def messages(records: np.ndarray, buckets: int, salt: int) -> pa.RecordBatch:
    """One message for each bucket. Of equal suffixes only those of the smallest document go to the bucket of their key."""
    records = records[np.lexsort((records["doc"], records["b"], records["a"]))]
    if len(records):
        new = np.ones(len(records), bool)
        new[1:] = (records["a"][1:] != records["a"][:-1]) | (records["b"][1:] != records["b"][:-1])
        low = records["doc"][new][np.cumsum(new) - 1]
        records["settled"] = records["doc"] > low
    bucket = (records["a"] % U(buckets)).astype(np.int64)
    settled = records["settled"]
    bucket[settled] = (np.arange(settled.sum()) // 64 + salt) % buckets
    order = np.lexsort((records["start"], records["row"], records["doc"], bucket))
    records, bucket = records[order], bucket[order]
    bounds = np.searchsorted(bucket, np.arange(buckets + 1))
    used = np.flatnonzero(np.diff(bounds))
    payload = [b"".join(np.ascontiguousarray(records[name][bounds[i] : bounds[i + 1]]).tobytes() for name in RECORD.names) for i in used]
    return pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(payload, pa.binary())], names=["bucket", "payload"])


def unpacked(payload: bytes) -> np.ndarray:
    n, at = len(payload) // RECORD.itemsize, 0
    out = np.empty(n, RECORD)
    for name in RECORD.names:
        kind = RECORD[name]
        out[name] = np.frombuffer(payload, kind, n, at)
        at += n * kind.itemsize
    return out


def settle(records: np.ndarray, refine: bool) -> list[np.ndarray]:
    """[doc, row, start, n, kind] of what a bucket's sorting shows; ``refine``: unlike suffixes are to be looked at again."""
    done = records[records["settled"]]
    left = records[~records["settled"]]
    left = left[np.lexsort((left["doc"], left["b"], left["a"]))]
    parts = [(done, np.full(len(done), REPEATED))]
    if len(left):
        new_a = np.ones(len(left), bool)
        new_a[1:] = left["a"][1:] != left["a"][:-1]
        new = new_a.copy()
        new[1:] |= left["b"][1:] != left["b"][:-1]
        group = np.cumsum(new) - 1
        repeated = left["doc"] > left["doc"][new][group]
        parts.append((left[repeated], np.full(repeated.sum(), REPEATED)))
        if refine:
            run = np.cumsum(new_a) - 1
            kinds = np.bincount(run[new])
            starts = np.flatnonzero(new_a)
            several = np.minimum.reduceat(left["doc"], starts) != np.maximum.reduceat(left["doc"], starts)
            unlike = ~repeated & ((kinds > 1) & several)[run]
            parts.append((left[unlike], np.full(unlike.sum(), UNLIKE)))
    rows = np.concatenate([r for r, _ in parts])
    return [rows["doc"], rows["row"], rows["start"], rows["n"].astype(np.int32), np.concatenate([k for _, k in parts]).astype(np.int32)]


def by_bucket(sent: DataFrame, buckets: int, handle: Callable[[np.ndarray], list[np.ndarray]], length: int) -> DataFrame:
    """FOUND rows: what ``handle`` makes of the messages of each bucket; runs of strings become runs of bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, bucket = [], None

        def found() -> pa.RecordBatch:
            doc, row, start, n, kind = handle(np.concatenate([unpacked(p) for p in held]))
            stop = start + n - 1 + np.where(kind == REPEATED, length, 1).astype(np.int32)
            return pa.RecordBatch.from_arrays([pa.array(x) for x in (doc, row, start, stop.astype(np.int32), kind)], names=[c.split()[0] for c in FOUND.split(", ")])

        for batch in batches:
            for at, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if at != bucket and held:
                    yield found()
                    held = []
                bucket = at
                held.append(payload)
        if held:
            yield found()

    n = int(sent.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return map_batches(sent.repartition(n, "bucket").sortWithinPartitions("bucket"), run, FOUND)


def text_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(doc ids, rows, bytes, offsets, batch, from, to) in groups of about BATCH_BYTES."""
    for batch in batches:
        raw, offsets = text_bytes(batch.column(2))
        doc, row = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
        for lo, hi in pieces(offsets, BATCH_BYTES):
            yield doc[lo:hi], row[lo:hi], raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], batch, lo, hi


def packed_records(a: np.ndarray, b: np.ndarray, doc: np.ndarray, row: np.ndarray, start: np.ndarray, n: np.ndarray) -> np.ndarray:
    out = np.empty(len(a), RECORD)
    for name, value in zip(RECORD.names, (a, b, doc, row, start, n, False), strict=True):
        out[name] = value
    return out


def repeated_spans(keyed: DataFrame, length: int) -> DataFrame:
    """FOUND rows of kind REPEATED: byte ranges whose every string of ``length`` also starts in a smaller document."""
    spark = keyed.sparkSession
    buckets = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    q = (length + 1) // 2

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, (doc, row, raw, offsets, *_) in enumerate(text_batches(batches)):
            parts = []
            for lo, hi in pieces(offsets):
                base = offsets[lo]
                first, last, a, b, text = suffix_runs(raw[base : offsets[hi]], offsets[lo : hi + 1] - base, length)
                if len(first):
                    start = first + base - offsets[lo + text]
                    parts.append(packed_records(a, b, doc[lo + text], row[lo + text], start, last - first + 1))
            if parts:
                yield messages(np.concatenate(parts), buckets, 7919 * k)

    first = saved(by_bucket(map_batches(keyed, deal, MESSAGE), buckets, lambda r: settle(r, True), length), "suffixes-1")
    release(spark)

    def deal_again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, (doc, row, raw, offsets, batch, lo, hi) in enumerate(text_batches(batches)):
            grams = buckets_at(raw, q)
            parts = []
            for i, ranges in enumerate(batch.column(3).slice(lo, hi - lo).to_pylist()):
                at = np.unique(np.concatenate([np.arange(r["start"], r["stop"]) for r in ranges]))
                a, b, _ = string_buckets(grams, at + offsets[i], length - q)
                parts.append(packed_records(a, b, doc[i], row[i], at, np.ones(len(at))))
            if parts:
                yield messages(np.concatenate(parts), buckets, 7919 * k)

    unlike = first.where(F.col("kind") == UNLIKE).groupBy("doc_id", "row").agg(F.collect_list(F.struct("start", "stop")).alias("ranges"))
    again = keyed.join(unlike, ["doc_id", "row"]).select("doc_id", "row", "text", "ranges")
    second = saved(by_bucket(map_batches(again, deal_again, MESSAGE), buckets, lambda r: settle(r, False), length), "suffixes-2")
    release(spark)
    return first.where(F.col("kind") == REPEATED).unionByName(second)


def remove_repeats(docs: DataFrame, length: int = 50) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept) of each row.

    Each byte goes that is covered by a string of ``length`` bytes (2 to LONGEST) that also starts in a
    document with a smaller id; strings are judged on the input. A null text is empty; null ids are larger than
    all others and not smaller than each other; rows with one id don't remove from each other; other columns
    are ignored; no rows give no rows. ``kept`` has the remaining bytes.
    """
    if not 2 <= length <= LONGEST:
        raise ValueError(f"strings of 2 to {LONGEST} bytes are sought")
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    # Only where ids repeat does a row need more than its id to be told from others.
    unique = docs.groupBy("doc_id").count().where("count > 1").isEmpty()
    row = F.lit(0).cast("long") if unique else F.xxhash64(text)
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias("doc_id"), row.alias("row"), text.alias("text"), F.col("doc_id").cast("long").alias("id"))
    spans = repeated_spans(keyed.drop("id"), length).groupBy("doc_id", "row").agg(F.collect_list(F.struct("start", "stop")).alias("ranges"))
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, raw, ranges in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                kept, removed, spans, at = [], 0, 0, 0
                stop = -1
                for r in sorted((r["start"], r["stop"]) for r in ranges or ()):
                    if r[0] > stop:
                        spans += 1
                        kept.append(raw[at : r[0]])
                        stop = r[0]
                    if r[1] > stop:
                        removed += r[1] - stop
                        stop = at = r[1]
                kept = b"".join([*kept, raw[at:]])
                rows.append((doc_id, len(raw), removed, spans, hashlib.sha256(kept).hexdigest(), kept))
            kinds = [pa.int64()] * 4 + [pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], k) for k in kinds], names=[c.split()[0] for c in schema.split(", ")])

    return map_batches(keyed.join(spans, ["doc_id", "row"], "left").select("id", "row", "text", "ranges"), cut, schema)


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir)).drop("kept")
