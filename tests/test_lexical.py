"""BM25 in shards, against scoring all pairs."""

import math
import random
from collections import Counter

from pyspark.sql import functions as F

from girder.operators import lexical
from girder.operators.lexical import bm25_top


def test_shards_give_what_scoring_all_pairs_gives_without_pairs(spark, monkeypatch):
    rng = random.Random(4)
    words = lambda n: " ".join(f"w{int(rng.paretovariate(0.5)) % 300}" for _ in range(n))
    texts = [words(rng.randint(1, 60)) for _ in range(3_000)] + ["the same text of all w1"] * 700 + [None, "", "!"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    asked = [(q, words(rng.randint(1, 12))) for q in range(60)] + [(60, "the"), (61, "nowhere"), (62, None), (63, "the same w1 w2 w3")]
    queries = spark.createDataFrame(asked, "query_id long, text string")
    counts = [Counter((x or "").replace("!", "").split()) for x in texts]
    n = sum(map(bool, counts))
    mean, df = sum(c.total() for c in counts) / n, Counter(w for c in counts for w in c)
    for k, shard, at_once in ((3, 4_000_000, 4_000_000), (50, 9_000, 100)):
        want = []
        for q, text in asked:
            terms = [(w, math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5))) for w in sorted(set((text or "").split())) if w in df]
            scores = [(-round(sum(idf * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * c.total() / mean)) for w, idf in terms), 6), i) for i, c in enumerate(counts) if any(w in c for w, _ in terms)]
            want += [(q, i, r, -s) for r, (s, i) in enumerate(sorted(scores)[:k], 1)]
        monkeypatch.setattr(lexical, "SHARD", shard)
        monkeypatch.setattr(lexical, "ASKED", at_once)
        got = sorted(bm25_top(docs, queries, k).select("query_id", "doc_id", "rank", "score").collect(), key=lambda r: (r[0], r[2]))
        assert [tuple(r)[:3] for r in got] == [w[:3] for w in want] and all(abs(g.score - w[3]) < 2e-6 for g, w in zip(got, want, strict=True))
    assert bm25_top(docs.limit(0), queries, 3).count() == 0 and bm25_top(docs, queries.limit(0), 3).count() == 0


def test_long_batches_are_counted_in_parts(spark, monkeypatch):
    monkeypatch.setattr(lexical, "COUNT_CHARS", 100)
    docs = spark.range(500).select(F.col("id").alias("doc_id"), F.lit("some words of some length").alias("text")).coalesce(1)
    rows = lexical.counted(docs)
    assert rows.where("term IS NULL").agg(F.sum("tf"), F.sum("len")).first()[:] == (500, 2_500) and rows.where("term IS NOT NULL").count() == 2_000
    assert rows.where("term IS NULL").count() > 100


def test_phrases_held_equal_looking_into_each_text(spark, monkeypatch):
    rng = random.Random(8)
    words = lambda n: " ".join(f"w{int(rng.paretovariate(0.5)) % 40}" for _ in range(n))
    texts = [words(rng.randint(1, 20)) for _ in range(600)] + [None, ""]
    asked = [(q, [words(rng.randint(1, 2)) for _ in range(rng.randint(1, 4))]) for q in range(40)] + [(40, ["nowhere w1", "w1"]), (41, ["nowhere"]), (42, []), (43, ["w1", "nowhere w1"])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    queries = spark.createDataFrame(asked, "query_id long, phrases array<string>")
    index = lexical.Index(docs)
    monkeypatch.setattr(lexical, "SHARD", 700)
    for k in (4, None):
        want = []
        for q, phrases in asked:
            shares = [(-sum(set(p.split()) <= set((x or "").split()) for p in set(phrases)) / max(1, len(set(phrases))), i) for i, x in enumerate(texts)]
            want += [(q, i, -s, r) for r, (s, i) in enumerate(sorted(x for x in shares if x[0])[:k], 1)]
        assert sorted(tuple(r) for r in index.holding(queries, k).collect()) == sorted(want)


def test_a_shard_holds_few_copies():
    """Numbers of documents and terms take four bytes a row; numpy's arrays stay below nine times that."""
    import tracemalloc

    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    from girder.operators import lexical

    rng, n = np.random.default_rng(1), 400_000
    pair = rng.choice(4000 * 1000, n, replace=False)
    held = pa.table({"doc_id": pair // 1000 * 7 - 9, "no": (pair % 1000) << 33, "impact": rng.random(n)})
    asked = pa.table({"query_id": np.repeat([3, 5], 4), "no": np.array([1, 2, 3, 999, 4, 5, 6, 5000]) << 33, "idf": np.linspace(1, 2, 8)})
    tracemalloc.start()
    got = lexical.best_of_shard(held, asked, 5).to_pylist()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 36 * n
    for q in (3, 5):
        idf = {r["no"]: r["idf"] for r in asked.to_pylist() if r["query_id"] == q}
        score = {}
        for r in held.filter(pc.is_in(held["no"], pa.array(list(idf)))).to_pylist():
            score[r["doc_id"]] = score.get(r["doc_id"], 0) + idf[r["no"]] * r["impact"]
        want = sorted(((-round(s, 6), d) for d, s in score.items()))[:5]
        assert [(r["doc_id"], round(r["score"], 6)) for r in got if r["query_id"] == q] == [(d, -s) for s, d in want]
    assert lexical.best_of_shard(held.slice(0, 0), asked, 5).num_rows == 0 == lexical.best_of_shard(held, asked.slice(0, 0), 5).num_rows
