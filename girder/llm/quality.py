"""Quality classifier by importance resampling.

Two generative models of hashed word unigrams and bigrams are counted: the target from labelled good documents,
the raw one from all documents. A document's importance is the log-ratio of both. It is tempered: multiplied by
TEMPER over the root of its number of features, as the ratio of a long text is a sum of many that aren't
independent. Gumbel noise, seeded by the identifier, makes taking the largest perturbed weights a sample without
replacement in proportion to the exponentiated tempered ratios; k is stated by the share of the labelled good
documents that the target was not fitted on which the sample has to keep, and a global threshold takes exactly these.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, map_batches, pieces, saved, text_bytes
from .counting import hashed_counts
from .hashing import BASE, U, mix, word_hashes, words

BUCKETS = 1 << 18
#: Labelled rows that the target model is fitted on, at most.
FIT_ROWS = 20_000
#: Pseudo-count that draws the ratio of rare features to one.
SHRINK = 10.0
#: Log-ratios are multiplied by this over the root of the number of features; the larger, the less the noise decides.
TEMPER = 8.0
#: Share of the labelled good documents that the sample keeps; it sets k.
CLEAN_KEPT = 0.99


def features(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, int, int]]:
    """(bucket of each unigram and bigram, its text, first text, end) in pieces of whole texts."""
    raw, offsets = text_bytes(column)
    for lo, hi in pieces(offsets):
        part, own = raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        text, starts, ends = words(part, own)
        one = word_hashes(part, starts, ends)
        two, same = mix(one[:-1] * U(BASE) + one[1:]), text[1:] == text[:-1]
        x = np.concatenate([one, two[same]]) >> U(64 - 18)
        yield x.astype(np.int64), np.concatenate([text, text[1:][same]]), lo, hi


def uniform(ids: np.ndarray, seed: int) -> np.ndarray:
    return ((mix(mix(ids.astype(np.int64).view(U)) + U(seed)) >> U(11)).astype(np.float64) + 0.5) / 2.0**53


def held_out():
    """Half of the labelled rows, by hash: they set k and don't fit the target."""
    return F.pmod(F.xxhash64(F.lit("fit"), F.col("doc_id").cast("long")), F.lit(2)) == 1


def log_ratios(docs: DataFrame, good: DataFrame) -> np.ndarray:
    """Log-ratio of target to raw model for each bucket; zeros without target rows."""
    sample = good.select("doc_id").where(F.col("doc_id").isNotNull() & ~held_out()).distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(FIT_ROWS)
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    flagged = keyed.join(F.broadcast(sample.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(True).alias("good"))), "doc_id", "left")  # FIT_ROWS ids at most
    chosen = flagged.select("text", F.coalesce("good", F.lit(False)).alias("good"))

    def count(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        good = batch.column(1).to_numpy(zero_copy_only=False)
        for x, text, lo, _ in features(batch.column(0)):
            yield x
            yield x[good[lo + text]] + BUCKETS

    counts = hashed_counts(chosen, count, 2 * BUCKETS).astype(np.float64)
    raw, target = counts[:BUCKETS], counts[BUCKETS:]
    if not target.sum():
        return np.zeros(BUCKETS)
    return np.log((target + SHRINK) / (raw * target.sum() / raw.sum() + SHRINK))


def perturbed(ids: pa.Array, texts: pa.Array, ratios: np.ndarray, seed: int, temper: float = TEMPER) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(log-ratio, weight, weight with Gumbel noise) of a batch."""
    plain, sizes = np.zeros(len(texts)), np.zeros(len(texts))
    for x, text, lo, hi in features(texts):
        sizes[lo:hi] = np.bincount(text, minlength=hi - lo)
        plain[lo:hi] = np.bincount(text, weights=ratios[x], minlength=hi - lo)
    weights = temper * plain / np.sqrt(np.maximum(sizes, 1))
    noise = -np.log(-np.log(uniform(ids.fill_null(-1).to_numpy(zero_copy_only=False), seed)))
    return plain, weights, weights + noise


def quantile(values: DataFrame, column: str, share: float) -> float | None:
    """The least value that is as large as ``share`` of all or more, exactly; None without values.

    An approximate quantile with a stated error brackets it; only values in the bracket are then ranked.
    """
    error = 0.0005
    n = values.where(F.col(column).isNotNull()).count()
    if not n:
        return None
    target = max(1, math.ceil(share * n))
    low, high = values.approxQuantile(column, [max(0.0, share - 2 * error), min(1.0, share + 2 * error)], error)
    below = values.where(F.col(column) < low).count()
    inside = values.where(F.col(column).between(low, high)).orderBy(column).limit(target - below)
    return inside.agg(F.max(column)).first()[0]


class Selection:
    """What resampling settled: the ratios (a table of fixed size) and the least perturbed weight that is kept."""

    def __init__(self, docs: DataFrame, labels: DataFrame, clean_kept: float = CLEAN_KEPT, seed: int = 17, temper: float = TEMPER):
        good = labels.where("quality = 1 AND coalesce(toxic, 0) = 0")
        self.seed, ratios = seed, log_ratios(docs, good).astype(np.float32)
        self.ratios, self.temper = ratios, temper

        def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                columns = map(pa.array, perturbed(batch.column(0), batch.column(1), ratios, seed, temper))
                yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", "log_ratio", "weight", "perturbed"])

        texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
        self.weights = saved(map_batches(texts, weigh, "doc_id long, log_ratio double, weight double, perturbed double"), "weights")
        known = self.weights.join(good.select("doc_id").where(held_out()).distinct(), "doc_id")
        least = quantile(known, "perturbed", 1 - clean_kept)
        self.least = float("-inf") if least is None else least

    def keep(self, docs: DataFrame) -> DataFrame:
        """Rows of ``docs`` that are kept, with all their columns."""
        names, ratios, seed, least, temper = docs.columns, self.ratios, self.seed, self.least, self.temper
        keyed = docs.select("*", F.col("doc_id").cast("long").alias("__id"), F.coalesce(F.col("text"), F.lit("")).alias("__text"))

        def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                *_, p = perturbed(batch.column(len(names)), batch.column(len(names) + 1), ratios, seed, temper)
                yield batch.select(list(range(len(names)))).filter(pa.array(p >= least))

        return map_batches(keyed, kept, docs.schema)


def resample(docs: DataFrame, labels: DataFrame, clean_kept: float = CLEAN_KEPT) -> DataFrame:
    """(doc_id, log_ratio, weight, perturbed) of the documents that the sample takes: the k largest perturbed weights.

    Null and empty texts have weight 0; null ids share one noise; repeated rows are decided alike; ties at the
    last place are all taken; without labelled good rows everything is kept; no rows give no rows.
    """
    chosen = Selection(docs, labels, clean_kept)
    return chosen.weights.where(F.col("perturbed") >= F.lit(chosen.least))


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
