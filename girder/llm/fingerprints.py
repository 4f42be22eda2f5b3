"""Document fingerprints from closed syncmers.

A run of K bytes is an anchor when the smallest hash among its runs of S bytes stands at its start or its
end. That depends on nothing outside the run, so an edit changes only the anchors that it touches. Two texts
are as alike as the anchors that both have, in the same order, among all of both together. A fingerprint keeps
the anchors below a fixed hash and their places, a share of them whatever the length, and of a short text all.
"""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import PIECE_BYTES, documents, id_and_text, map_batches
from .hashing import U, window_hashes

K, S = 16, 6
#: A fingerprint keeps the anchors in this part of the hashes, but SHORT of them at least.
PART, SHORT = 8, 96
SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def anchors(raw: np.ndarray, k: int = K, s: int = S) -> np.ndarray:
    """Starts of the closed syncmers in ``raw``."""
    small = window_hashes(raw, s)
    n = len(raw) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    width, size, low = k - s + 1, 1, small
    while 2 * size <= width:
        low = np.minimum(low[: len(low) - size], low[size:])
        size *= 2
    low = np.minimum(low[:n], low[width - size : width - size + n])
    return np.flatnonzero((small[:n] == low) | (small[k - s : k - s + n] == low))


def sketches(texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(hashes in ascending order, places) of all anchors of each text."""
    raw = np.frombuffer(b"".join(texts), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    found = anchors(raw)
    hashes = window_hashes(raw, K)[found] >> U(32) if len(found) else np.zeros(0, U)
    owner = np.searchsorted(offsets, found, "right") - 1
    inside = found + K <= offsets[owner + 1] if len(found) else np.zeros(0, bool)
    found, hashes, owner = found[inside], hashes[inside], owner[inside]
    bounds = np.searchsorted(owner, np.arange(len(texts) + 1))
    out = []
    for i, (lo, hi) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
        h, first = np.unique(hashes[lo:hi], return_index=True)
        out.append((h.astype(np.int64), found[lo:hi][first] - offsets[i]))
    return out


def likeness(a: tuple, b: tuple, same: bool) -> float:
    """0 to 1: anchors of both in the same order, over all anchors of both together."""
    if same:
        return 1.0
    if not len(a[0]) or not len(b[0]):
        return 0.0
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    total = len(a[0]) + len(b[0]) - len(i)
    there = b[1][j[np.argsort(a[1][i], kind="stable")]]
    if (np.diff(there) > 0).all():
        return len(there) / total
    ends: list[int] = []
    for place in there.tolist():
        at = bisect.bisect_left(ends, place)
        ends[at : at + 1] = [place]
    return len(ends) / total


def kept(sketch: tuple, part: int) -> tuple[np.ndarray, np.ndarray]:
    """The anchors of a sketch that its fingerprint keeps."""
    n = max(SHORT, int(np.searchsorted(sketch[0], (1 << 32) // part)))
    return sketch[0][:n], sketch[1][:n]


def fingerprint(sketch: tuple, text: bytes, part: int = PART) -> str:
    """Anchors by place, 8 hexadecimal digits of hash and the place; of a text without anchors, a hash of the whole."""
    if not len(sketch[0]):
        return "=" + hashlib.blake2b(text, digest_size=16).hexdigest()
    hashes, at = kept(sketch, part)
    order = np.argsort(at, kind="stable")
    return ",".join(f"{h:08x}:{p:x}" for h, p in zip(hashes[order].tolist(), at[order].tolist(), strict=True))


def edit(text: str, following: str) -> str:
    cut = len(text) // 3
    return text[: len(text) - cut] + following[:cut]


def with_next(docs: DataFrame) -> DataFrame:
    """(bucket, extra, doc_id, text) such that, sorted by these with doc_id descending, each row that isn't
    extra is followed by the next document in its bucket.

    Identifiers are cut into ranges at quantiles; each range gets one extra row or more: the documents with the
    largest id of the next range (of the first range, for the last), so that only the text of one document a
    range moves twice. The driver sees one id for each range.
    """
    spark = docs.sparkSession
    n = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = docs.where(F.col("doc_id").isNotNull()).stat.approxQuantile("doc_id", [i / n for i in range(1, n)], 1 / (4 * n))
    splits = [float("-inf"), *(sorted(set(cuts)) or [0.0]), float("inf")]
    ranged = Bucketizer(splits=splits, inputCol="__id", outputCol="__range", handleInvalid="keep").transform(docs.withColumn("__id", F.col("doc_id").cast("double")))
    ranged = ranged.select((F.lit(len(splits)) - F.when(F.col("doc_id").isNull(), -1).otherwise(F.col("__range"))).cast("int").alias("bucket"), "doc_id", "text")
    heads = sorted((r.bucket, r.head) for r in ranged.groupBy("bucket").agg(F.max("doc_id").alias("head")).collect())
    into = [(heads[i - 1][0], head) for i, (_, head) in enumerate(heads)]
    extra = spark.createDataFrame(into, "bucket int, head long")  # one row for each range
    again = docs.join(F.broadcast(extra), F.col("doc_id").eqNullSafe(F.col("head"))).select("bucket", F.lit(1).alias("extra"), "doc_id", "text")
    return ranged.select("bucket", F.lit(0).alias("extra"), "doc_id", "text").unionByName(again)


def fingerprint_edits(docs: DataFrame, part: int = PART) -> DataFrame:
    """Fingerprints of each text and of its edited text, and the likeness of the texts by all their anchors (see SCHEMA).

    A text's edited text has its last third replaced by the start of the next document's, in descending id
    order, null ids last, equal ids by text; the last is followed by the first, and a lone document by itself.
    Fingerprints keep one anchor in ``part`` (but SHORT at least); with 1 they keep all.
    Null texts are empty; repeated rows each give a row; other columns are ignored; no rows give no rows.
    """

    def results(held: list, following: str) -> pa.RecordBatch:
        texts = [t for _, t in held] + [following]
        edited = [edit(t, u) for t, u in zip(texts, texts[1:], strict=False)]
        plain, changed = [t.encode() for t in texts], [t.encode() for t in edited]
        a, b = sketches(plain), sketches(changed)
        prints = [fingerprint(x, t, part) for x, t in zip(a, plain, strict=True)]
        others = [fingerprint(x, t, part) for x, t in zip(b, changed, strict=True)]
        n = len(held)
        columns = [
            pa.array([d for d, _ in held], pa.int64()),
            pa.array([len(t) for _, t in held], pa.int64()),
            pa.array([hashlib.sha256(t).hexdigest() for t in changed], pa.string()),
            pa.array(prints[:n], pa.string()),
            pa.array(others, pa.string()),
            pa.array([likeness(a[i], b[i], plain[i] == changed[i]) for i in range(n)], pa.float64()),
            pa.array([likeness(a[i], a[i + 1], plain[i] == plain[i + 1]) for i in range(n)], pa.float64()),
        ]
        return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in SCHEMA.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, bucket, closed = [], 0, None, True
        for batch in batches:
            for at, extra, doc_id, text in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if at != bucket:
                    held, size, bucket, closed = [], 0, at, False
                if closed:
                    continue
                if held and (extra or size >= PIECE_BYTES):
                    yield results(held, text)
                    held, size = [], 0
                closed = bool(extra)
                held.append((doc_id, text))
                size += len(text)

    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = with_next(id_and_text(docs)).repartitionById(n, F.pmod("bucket", F.lit(n))).sortWithinPartitions("bucket", "extra", F.col("doc_id").desc_nulls_last(), "text")
    return map_batches(dealt, run, SCHEMA)


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    # All anchors: the likenesses are those of the fingerprints returned.
    return fingerprint_edits(documents(spark, sf_dir), part=1)
