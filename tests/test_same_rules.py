"""Queries whose rule and SQL once differed: values where both have to decide alike."""

from girder.operators import retrieval


def test_scores_of_contexts_are_rounded_from_their_binary_value(spark):
    hits = spark.createDataFrame([(1, 5, 53.3525, "a b"), (1, 6, 2.0625, "c"), (1, 7, 1.9996, "d")], "query_id long, doc_id long, score double, text string")
    assert retrieval.as_context(hits, 3).first().context == "[5 53.352] a b\n[6 2.062] c\n[7 2.000] d"


def test_means_on_a_limit_do_not_depend_on_order(spark, tmp_path):
    import duckdb

    from girder import registry

    registry.load()
    # The mean is 60 exactly; added up as doubles in this order it is less.
    values = [(i, 1, "click", v) for i, v in enumerate([59.3] * 500 + [60.7] * 500)]
    spark.createDataFrame(values, "event_id long, user_id long, event_type string, value double").coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
    want = con.execute(registry.ORACLES["health_aggregate"]).fetchall()
    assert [tuple(r) for r in registry.QUERIES["health_aggregate"](spark, str(tmp_path)).collect()] == want == [(1, 100.0, "healthy")]


def test_question_words_end_at_letters_of_any_script(spark):
    import duckdb
    from pyspark.sql import functions as F

    from girder.functions import questions
    from girder.plans.retrieval import ASKING, LED

    asked = {"one doesíque two three four": None, "what which long sum of days does": "long sum of days", "List íwhat is what due": "íwhat is due", "how many_days are left now": None}
    df = spark.createDataFrame(list(asked.items()), "q string, bare string")
    assert all(r.bare == r.got for r in df.withColumn("got", questions.unwrapped(F.col("q"))).collect())
    sql = f"SELECT trim(regexp_replace({ASKING(ASKING(LED))}, '\\s+', ' ', 'g')) FROM (SELECT ? AS base)"
    got = [duckdb.execute(sql, [q]).fetchall()[0][0] for q in asked]
    assert got == [bare or q for q, bare in asked.items()]


def test_defects_rank_all_trades(spark):
    from girder import registry

    registry.load()
    rows = registry.QUERIES["defect_ranking"](spark, "/root/testdata/sf0.01").collect()
    assert sorted(r["rank"] for r in rows) == list(range(1, 101)) and [r.trade for r in sorted(rows, key=lambda r: (-r.risk, r.trade))] == [r.trade for r in sorted(rows, key=lambda r: r["rank"])]
