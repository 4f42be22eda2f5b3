"""What Python holds at a time is bounded, whatever comes in one batch."""

import pyarrow as pa
from pyspark.sql import functions as F

from girder.operators import corpus, retrieval


def test_chunks_leave_in_bounded_batches(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "CHUNK_CHARS", 2_000)
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.repeat(F.lit("some words. "), 100).alias("text")).coalesce(1)
    whole = retrieval.markdown_chunks(docs)
    # Batches of chunks, not one with those of all 300 texts, reach the next step.
    sizes = [r.n for r in whole.mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in batches), "n long").collect()]
    assert sum(sizes) == whole.count() == 300 * len({r.chunk_index for r in whole.where("doc_id = 7").collect()})


def test_a_block_meets_queries_in_parts(monkeypatch):
    monkeypatch.setattr(corpus, "MET", 2)
    rows = lambda key, ids: pa.table({key: pa.array(ids, pa.int64()), "embedding": pa.array([[float(i % 3), 1.0] for i in ids], pa.list_(pa.float32()))})
    got = corpus.best_of_block(rows("vec_id", [9, 3, 6, 1]), rows("query_id", [0, 1, 2, 3, 4]), 2)
    assert list(zip(got["query_id"].to_pylist(), got["vec_id"].to_pylist(), strict=True)) == [(0, 3), (0, 6), (1, 1), (1, 3), (2, 1), (2, 3), (3, 3), (3, 6), (4, 1), (4, 3)]
    assert corpus.best_of_block(rows("vec_id", []), rows("query_id", [1]), 2).num_rows == 0
