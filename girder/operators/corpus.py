"""Chunks, retrieval and curation of documents."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def word_chunks(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, chunk_index, text) of each run of ``size`` words."""
    listed = docs.select("doc_id", F.filter(F.split("text", r"\s+"), lambda w: w != "").alias("words")).where(F.size("words") > 0)
    starts = F.transform(F.sequence(F.lit(0), F.floor((F.size("words") - 1) / size).cast("int")), lambda i: F.struct(i.alias("i"), F.array_join(F.slice("words", i * size + 1, size), " ").alias("text")))
    return listed.select("doc_id", F.explode(starts).alias("c")).select("doc_id", F.col("c.i").alias("chunk_index"), F.col("c.text").alias("text"))


def sliding_chunks(docs: DataFrame, size: int, overlap: int) -> DataFrame:
    """(doc_id, chunk_index, text) of windows of ``size`` characters that share ``overlap``; the last one reaches the end."""
    step = size - overlap
    n = F.greatest(F.lit(0), F.ceil((F.length("text") - size) / step).cast("int"))
    windows = F.transform(F.sequence(F.lit(0), n), lambda i: F.struct(i.alias("i"), F.substr("text", i * step + 1, F.lit(size)).alias("text")))
    return docs.where(F.length("text") > 0).select("doc_id", F.explode(windows).alias("c")).select("doc_id", F.col("c.i").alias("chunk_index"), F.col("c.text").alias("text"))


#: Vectors of a block, and queries that it meets at a time as a matrix.
BLOCK_ROWS, MET = 16_384, 512
#: Bytes of query vectors that a task holds beside a block.
ROUND_BYTES = 32 << 20


def units(rows: pa.Table, key: str) -> tuple[np.ndarray, np.ndarray]:
    """(ids, matrix) of normalised vectors in order of id; a zero vector stays."""
    rows = rows.sort_by(key).combine_chunks()
    matrix = rows["embedding"].combine_chunks().flatten().to_numpy().astype(np.float64).reshape(rows.num_rows, -1)
    norm = np.sqrt((matrix * matrix).sum(axis=1, keepdims=True))
    return rows[key].to_numpy(), np.divide(matrix, norm, out=matrix.copy(), where=norm > 0)


def best_of_block(held: pa.Table, asked: pa.Table, k: int) -> pa.Table:
    """(query_id, vec_id, score): the ``k`` nearest of a block's vectors for each of the vectors asked."""
    if not held.num_rows or not asked.num_rows:
        return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
    (ids, matrix), (queries, wanted), parts = units(held, "vec_id"), units(asked, "query_id"), []
    for lo in range(0, len(queries), MET):
        score = np.round(wanted[lo : lo + MET] @ matrix.T, 6)
        least = np.partition(score, -k, axis=1)[:, -k:].min(axis=1) if score.shape[1] > k else np.full(len(score), -np.inf)
        query, place = np.nonzero(score >= least[:, None])  # the k best and ties with the last of them
        order = np.lexsort((place, -score[query, place], query))  # ids ascend, so ties go to the smaller one
        query, place = query[order], place[order]
        kept = np.arange(len(query)) - np.searchsorted(query, query) < k
        query, place = query[kept], place[kept]
        parts.append((queries[lo + query], ids[place], score[query, place]))
    return pa.table(dict(zip(("query_id", "vec_id", "score"), map(np.concatenate, zip(*parts, strict=True)), strict=True)))


def cosine_top(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, score, rank) of the ``k`` nearest vectors of each query in a stated query set.

    Vectors are dealt out to blocks of some BLOCK_ROWS, and queries to parts of ROUND_BYTES; each two meet as matrices in
    one task and leave ``k`` rows a query, so that what a task holds is bounded however many there are of both.
    """
    held = vectors.where("embedding IS NOT NULL").select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    asked = queries.where("embedding IS NOT NULL").select(F.col("vec_id").cast("long").alias("query_id"), "embedding")
    size = asked.agg(F.sum(F.size("embedding") * 8)).first()[0] or 0
    blocks, parts = (max(1, -(-total // most)) for total, most in ((held.count(), BLOCK_ROWS), (size, ROUND_BYTES)))
    dealt = lambda rows, key, name, n: rows.withColumn(name, F.pmod(F.xxhash64(key), F.lit(n)).cast("int"))
    spread = lambda rows, name, n: rows.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    left = spread(dealt(held, "vec_id", "block", blocks), "part", parts).groupBy("block", "part")
    right = spread(dealt(asked, "query_id", "part", parts), "block", blocks).groupBy("block", "part")
    run = lambda a, b: best_of_block(a.select(["vec_id", "embedding"]), b.select(["query_id", "embedding"]), k)
    scored = left.cogroup(right).applyInArrow(run, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")).cast("long")
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)


def token_cap(ranked: DataFrame, cap: int) -> DataFrame:
    """In order of rank, each row whose tokens still fit; one that doesn't is skipped, and smaller ones after it are tried."""
    item = F.struct("rank", "vec_id", "tokens")
    listed = ranked.groupBy("query_id").agg(F.array_sort(F.collect_list(item)).alias("items"))  # a ranked list is short
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<bigint>").alias("kept"))
    add = lambda a, x: F.when(a.used + x.tokens <= cap, F.struct((a.used + x.tokens).alias("used"), F.concat(a.kept, F.array(x.vec_id)).alias("kept"))).otherwise(a)
    return listed.select("query_id", F.explode(F.aggregate("items", start, add, lambda a: a.kept)).alias("vec_id"))
