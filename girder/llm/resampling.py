"""Importance resampling towards a target text, by hashed n-grams counted once for each distinct line.

Texts are cut into lines. Of the lines of a group of documents only the distinct ones are looked at: their n-grams
are counted once and multiplied by how often the line occurs; n-grams that cross from one line to the next are
added separately, from the words at the lines' edges. A line's sum of gains is likewise made once and given to all
documents that hold the line. Groups are what a task has at hand, so that no line is shuffled to find its repeats;
tasks send counts of the buckets, a table of fixed size.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, map_batches, pieces, saved, text_bytes
from .counting import SLICES, hashed_counts
from .hashing import LOWER, U, mix, powers, words
from .lines import line_spans

#: Words are of digits, letters and all beyond ASCII, after A-Z have become lower case.
IS_WORD = np.zeros(256, bool)
IS_WORD[48:58] = IS_WORD[97:123] = IS_WORD[128:] = True
#: Bytes of text whose lines are compared, and of the longest word whose checksum is computed along with others.
GROUP_BYTES, LONG_WORD = 4 << 20, 48
_TABLE = np.array([zlib.crc32(bytes([b ^ 0xFF])) ^ 0xFF000000 for b in range(256)], np.uint32)


def crc_of(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, state: np.ndarray) -> np.ndarray:
    """The states (inverted checksums) after the bytes of each span, begun at ``state``."""
    state, lengths = state.copy(), ends - starts
    capped = np.minimum(lengths, LONG_WORD + 1)
    order = np.argsort(-capped, kind="stable")
    alive = np.searchsorted(-capped[order], -np.arange(1, LONG_WORD + 1), "right")
    long = lengths > LONG_WORD
    n_long = int(long.sum())
    for k in range(LONG_WORD):
        now = order[n_long : alive[k]]
        if not len(now):
            break
        state[now] = (state[now] >> np.uint32(8)) ^ _TABLE[(state[now] ^ raw[starts[now] + k]) & np.uint32(0xFF)]
    for i in np.flatnonzero(long).tolist():
        state[i] = zlib.crc32(raw[starts[i] : ends[i]].tobytes(), int(~state[i])) ^ 0xFFFFFFFF
    return state


class Runs:
    """Words of texts and the buckets of runs of them."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, buckets: int):
        self.raw, self.buckets = LOWER[raw], buckets
        self.text, self.starts, self.ends = words(self.raw, offsets, IS_WORD)

    def of(self, first: np.ndarray, size: int) -> np.ndarray:
        """The buckets of the runs of ``size`` words from each word ``first``."""
        state = np.full(len(first), 0xFFFFFFFF, np.uint32)
        for k in range(size):
            if k:
                state = (state >> np.uint32(8)) ^ _TABLE[(state ^ np.uint32(32)) & np.uint32(0xFF)]
            state = crc_of(self.raw, self.starts[first + k], self.ends[first + k], state)
        return (~state).astype(np.int64) % self.buckets


def distinct_spans(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(an index of each distinct span, which of these each span equals), by two 64-bit hashes."""
    up, down = powers(len(raw) + 1)
    total = np.zeros((2, len(raw) + 1), U)
    for k, values in enumerate((raw.astype(U) + U(1), mix(raw.astype(U) + U(257)))):
        np.cumsum(values * up[:-1], out=total[k, 1:])
    pairs = np.empty(len(starts), [("a", U), ("b", U)])
    for k, name in enumerate("ab"):
        pairs[name] = (total[k][ends] - total[k][starts]) * down[starts] + (ends - starts).astype(U)
    _, first, which = np.unique(pairs, return_index=True, return_inverse=True)
    return first, which.reshape(-1)


class Segments:
    """The runs of up to ``longest`` words of a group of texts, those inside a line once for each distinct line."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, longest: int, buckets: int):
        self.texts = len(offsets) - 1
        self.line_text, starts, ends = line_spans(raw, offsets)
        first, self.which = distinct_spans(raw, starts, ends)
        self.times = np.bincount(self.which, minlength=len(first))
        # The distinct lines, one behind the other.
        sizes = ends[first] - starts[first]
        at = np.concatenate([[0], np.cumsum(sizes)])
        own = raw[np.repeat(starts[first] - at[:-1], sizes) + np.arange(at[-1])]
        self.bags = list(self.inside(Runs(own, at, buckets), longest))
        self.crossing = list(self.between(Runs(raw, offsets, buckets), starts, longest)) if longest > 1 else []

    @staticmethod
    def inside(runs: Runs, longest: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(distinct line, bucket) of the runs of each size inside lines."""
        for size in range(1, longest + 1):
            first = np.arange(max(0, len(runs.text) - size + 1))
            first = first[runs.text[first] == runs.text[first + size - 1]]
            yield runs.text[first], runs.of(first, size)

    @staticmethod
    def between(runs: Runs, line_starts: np.ndarray, longest: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(text, bucket) of the runs of each size that begin in one line and end in another of the text."""
        line = np.searchsorted(line_starts, runs.starts, "right")
        for size in range(2, longest + 1):
            first = np.arange(max(0, len(runs.text) - size + 1))
            last = first + size - 1
            first = first[(runs.text[first] == runs.text[last]) & (line[first] != line[last])]
            yield runs.text[first], runs.of(first, size)

    def counts(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(buckets, how often each) of all runs."""
        for line, bucket in self.bags:
            yield bucket, self.times[line]
        for _, bucket in self.crossing:
            yield bucket, np.ones(len(bucket), np.int64)

    def per_text(self, gains: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(runs, sum of their gains) of each text; the sums of a distinct line are made once."""
        n, total = np.zeros(len(self.times), np.int64), np.zeros(len(self.times), np.int64)
        for line, bucket in self.bags:
            n += np.bincount(line, minlength=len(n))
            np.add.at(total, line, gains[bucket])
        texts, sums = np.zeros(self.texts, np.int64), np.zeros(self.texts, np.int64)
        np.add.at(texts, self.line_text, n[self.which])
        np.add.at(sums, self.line_text, total[self.which])
        for text, bucket in self.crossing:
            texts += np.bincount(text, minlength=self.texts)
            np.add.at(sums, text, gains[bucket])
        return texts, sums


def groups(batch: pa.RecordBatch, column: int, longest: int, buckets: int) -> Iterator[tuple[int, int, Segments]]:
    raw, offsets = text_bytes(batch.column(column))
    for lo, hi in pieces(offsets, GROUP_BYTES):
        yield lo, hi, Segments(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], longest, buckets)


def bucket_counts(texts: DataFrame, longest: int, buckets: int) -> np.ndarray:
    """How often each bucket occurs among the runs of all ``texts``, a table with one column."""
    size = -(-buckets // SLICES) * SLICES

    def features(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for _, _, segments in groups(batch, 0, longest, buckets):
            yield from segments.counts()

    return hashed_counts(texts, features, size)[:buckets]


def gains_of(source: np.ndarray, target: np.ndarray, buckets: int) -> np.ndarray:
    """1000 times the log-ratio of the models of target and source, add-one smoothed and rounded down."""
    s, t = source.astype(float), target.astype(float)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets)))).astype(np.int64)


def whole_text(df: DataFrame) -> DataFrame:
    return df.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def weigh(docs: DataFrame, target: DataFrame, longest: int = 1, buckets: int = 10_000, seed: str = "2024:") -> DataFrame:
    """(doc_id, n_features, weight, score) of each row: the mean gain of its runs, and that with Gumbel noise."""
    gains = gains_of(bucket_counts(whole_text(docs), longest, buckets), bucket_counts(whole_text(target), longest, buckets), buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [segments.per_text(gains) for _, _, segments in groups(batch, 1, longest, buckets)]
            n, total = (np.concatenate([p[k] for p in parts] or [np.zeros(0, np.int64)]) for k in (0, 1))
            weight = np.where(n > 0, total // np.maximum(n, 1), 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(weight)], names=["doc_id", "n_features", "weight"])

    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    hashed = F.sha2(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).cast("binary"), 256)
    uniform = (F.conv(F.substring(hashed, 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    noise = F.floor(-1000 * F.log(-F.log(uniform))).cast("long")
    return map_batches(keyed, run, "doc_id long, n_features long, weight long").withColumn("score", F.col("weight") + noise)


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, least: int = 20, longest: int = 1, buckets: int = 10_000, seed: str = "2024:") -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of each row; rank is null for what isn't drawn.

    Of the N rows with ``least`` features or more, the floor(percent * N / 100) of the highest scores are drawn, ties
    to the smaller id, null ids last; several rows with one id and score are drawn in any order. A null text has
    no features and weighs 0. Null ids share one noise. Other columns are ignored; no rows give no rows.

    Scores are whole numbers in a range that the logarithms bound, so counts by score find the place of each score,
    and only documents of equal score are put in order.
    """
    scored = saved(weigh(docs, target, longest, buckets, seed), "scored")
    enough = F.col("n_features") >= least
    counts = scored.where(enough).groupBy("score").count()
    # One row for each score, some ten thousand.
    above = Window.orderBy(F.col("score").desc()).rowsBetween(Window.unboundedPreceding, -1)
    all_rows = F.sum("count").over(Window.partitionBy())
    places = counts.select("score", F.coalesce(F.sum("count").over(above), F.lit(0)).alias("before"), F.floor(all_rows * percent / 100).alias("drawn"))
    last = places.where("before < drawn").agg(F.min("score").alias("least_score"), F.max("drawn").alias("drawn")).first()
    names = ["doc_id", "n_features", "weight", "score"]
    rank = F.lit(None).cast("long").alias("rank")
    if last.drawn is None:
        return scored.select(*names, rank)
    taken = enough & (F.col("score") >= last.least_score)
    within = F.row_number().over(Window.partitionBy("score").orderBy(F.col("doc_id").asc_nulls_last()))
    ranked = scored.where(taken).withColumn("within", within).join(places.select("score", "before"), "score")
    ranked = ranked.withColumn("rank", (F.col("before") + F.col("within")).cast("long")).withColumn("rank", F.when(F.col("rank") <= last.drawn, F.col("rank")))
    return ranked.select(*names, "rank").unionByName(scored.where(~taken).select(*names, rank))


def drawn(docs: DataFrame, target: DataFrame, **settings) -> DataFrame:
    """The rows of ``docs`` whose id is drawn, with the columns that they had; rows without id aren't drawn."""
    ids = resample(docs, target, **settings).where("rank IS NOT NULL AND doc_id IS NOT NULL").select(F.col("doc_id").alias("__id")).distinct()
    return docs.join(ids, F.col("doc_id").cast("long") == F.col("__id"), "left_semi")


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


SQL = r"""
WITH words AS (
  SELECT src, id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w
  FROM (SELECT 0 AS src, doc_id AS id, text FROM documents UNION ALL SELECT 1, item_id, text FROM benchmark)
),
counted AS (SELECT src, w, count(*) AS n FROM words GROUP BY src, w),
hashed AS (
  SELECT w, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(strlen(w)), lambda i: ('0x' || substr(hex(encode(w)), 2 * i + 1, 2))::BIGINT)),
    lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384::BIGINT * (x & 1)))), 4294967295::BIGINT) % 10000 AS b
  FROM (SELECT DISTINCT w FROM words)
),
buckets AS (SELECT b, sum(n) FILTER (src = 0) AS s, sum(n) FILTER (src = 1) AS t FROM counted JOIN hashed USING (w) GROUP BY b),
totals AS (SELECT coalesce(sum(s), 0)::DOUBLE AS ss, coalesce(sum(t), 0)::DOUBLE AS tt FROM buckets),
gains AS (
  SELECT b, floor(1000 * ln((coalesce(t, 0)::DOUBLE + 1) * (ss + 10000) / ((coalesce(s, 0)::DOUBLE + 1) * (tt + 10000))))::BIGINT AS gain FROM buckets, totals
),
summed AS (SELECT id, count(*) AS n, sum(gain) AS gain FROM words JOIN hashed USING (w) JOIN gains USING (b) WHERE src = 0 GROUP BY id),
weighed AS (
  SELECT doc_id, coalesce(n, 0)::BIGINT AS n_features, coalesce((gain - ((gain % n) + n) % n) // n, 0)::BIGINT AS weight,
    ('0x' || substr(sha256('2024:' || doc_id::VARCHAR), 1, 8))::BIGINT AS h
  FROM documents LEFT JOIN summed ON id = doc_id
),
scored AS (SELECT doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM weighed),
ranked AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r, count(*) OVER () AS n FROM scored WHERE n_features >= 20)
SELECT s.*, CASE WHEN r <= 10 * n // 100 THEN r END AS rank FROM scored s LEFT JOIN ranked USING (doc_id)
"""
