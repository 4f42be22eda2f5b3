"""Passages by shared words, against scoring all pairs."""

import random

from pyspark.sql import functions as F

from girder.operators import lexical, overlap, ranking, retrieval


def plain(asked, held, k):
    hits = asked.where("term IS NOT NULL").join(held.distinct(), "term").groupBy("query_id", "doc_id", "chunk_index").agg(F.count("*").alias("score"))
    return retrieval.best_chunks(hits, k)


def test_overlap_equals_scoring_all_pairs(spark):
    rng = random.Random(5)
    words = [f"w{int(rng.paretovariate(0.6)) % 400}" for _ in range(12_000)] + ["the"] * 1_500
    rng.shuffle(words)
    held = spark.createDataFrame([(i // 60, i // 20 % 3, w) for i, w in enumerate(words)] + [(7, 0, None)], "doc_id int, chunk_index int, term string")
    asked = spark.createDataFrame(
        [(q, rng.choice(words)) for q in range(40) for _ in range(rng.randint(1, 12))] + [(50, "the"), (51, "the"), (51, "the"), (51, "w3"), (52, "nowhere"), (53, None)], "query_id int, term string"
    )
    rows = lambda df: sorted(tuple(r) for r in df.select("query_id", "doc_id", "chunk_index", "score", "rank").collect())
    for k in (1, 3):
        want = rows(plain(asked, held, k))
        assert rows(overlap.overlap_top(asked, held, k)) == want and len(want) > 40 * k
    assert overlap.overlap_top(asked, held.limit(0), 3).count() == 0 and overlap.overlap_top(asked.limit(0), held, 3).count() == 0


def test_places_of_hot_groups(spark):
    rng = random.Random(3)
    rows = [(rng.choice([1, 1, 1, 2, None]), rng.choice([None, *range(50)]), i) for i in range(3_000)] + [(9, 1, -1)]
    df = spark.createDataFrame(rows, "g int, v int, i int").repartition(5)
    got = {r.i: (r.g, r["rank"]) for r in ranking.numbered(df, ["g"], [F.desc("v"), F.col("i")]).collect()}
    want = {}
    for g in (1, 2, None, 9):
        of = sorted((r for r in rows if r[0] == g), key=lambda r: (-(r[1] if r[1] is not None else -1), r[2]))
        want |= {r[2]: (g, n) for n, r in enumerate(of, 1)}
    assert got == want and ranking.numbered(df.limit(0), ["g"], [F.col("v")]).count() == 0


def test_overlap_writes_postings_and_no_pairs(spark, monkeypatch):
    """Every question has the words of every chunk in common: only postings and questions are written, whatever their product."""
    written, cut = [], overlap.cut
    monkeypatch.setattr(overlap, "cut", lambda df: written.append(out := cut(df)) or out)
    monkeypatch.setattr(lexical, "SHARD", 100)
    held = spark.range(400).select((F.col("id") / 4).cast("long").alias("doc_id"), (F.col("id") % 4).cast("int").alias("chunk_index"), F.explode(F.array(F.lit("the"), F.lit("and"))).alias("term"))
    held = held.unionByName(held.limit(50)).unionByName(spark.createDataFrame([(70, 2, "rare")], "doc_id long, chunk_index int, term string"))
    asked = spark.range(300).select(F.col("id").alias("query_id"), F.explode(F.array(F.lit("the"), F.lit("and"), F.lit("rare"))).alias("term"))
    got = sorted(tuple(r) for r in overlap.overlap_top(asked, held, 2).collect())
    assert got == sorted(r for q in range(300) for r in ((q, 70, 2, 3, 1), (q, 0, 0, 2, 2)))
    assert max(df.count() for df in written) <= 900
