"""Exact quantiles where the values of a group are far from even."""

import random

import numpy as np

from girder.operators import boq


def test_quantiles_of_uneven_groups(spark):
    rng = random.Random(3)
    rows = [("outlier", rng.random()) for _ in range(3000)] + [("outlier", 1e12), ("outlier", -1e12)]
    rows += [("steps", rng.choice([1.0, 1.0, 1.0, 2.0, 7.5])) for _ in range(900)] + [("one", 4.0)] * 50 + [("power", 10 ** rng.uniform(-9, 9)) for _ in range(2500)] + [("few", 1.0), ("few", 2.0), (None, 3.0), (None, None), ("none", None)]
    shares = {"p1": 0.01, "p25": 0.25, "median": 0.5, "p99": 0.99, "low_end": 0.0, "high_end": 1.0}
    got = {r[0]: r for r in boq.exact_quantiles(spark.createDataFrame(rows, "g string, v double").repartition(5), ["g"], "v", shares).collect()}
    for g in {r[0] for r in rows} - {"none"}:
        values = [v for k, v in rows if k == g and v is not None]
        assert got[g].n == len(values) and (got[g].low, got[g].high) == (min(values), max(values))
        for name, share in shares.items():
            assert np.isclose(got[g][name], np.quantile(values, share), rtol=1e-12), (g, name)


def test_places_are_found_inside_brackets(spark):
    """A value at an index, found without a window over a whole group's values."""
    from girder.operators import schedule

    rng = random.Random(4)
    rows = [("many", rng.randrange(10**9)) for _ in range(30_000)] + [("few", 4), ("few", 9), ("few", 9), ("one", 7), (None, 1), (None, 5), ("none", None)]
    table = spark.createDataFrame(rows, "g string, v long").repartition(3)
    for share in (0.0, 0.25, 0.5, 0.8, 1.0):
        found = schedule.index_quantile(table, "g", "v", share)
        assert found.columns == ["g", "n", "at"] and dict(found.dtypes)["at"] == "bigint"
        got = {r.g: (r.n, r["at"]) for r in found.collect()}
        for g in {r[0] for r in rows} - {"none"}:
            values = sorted(v for k, v in rows if k == g and v is not None)
            assert got.pop(g) == (len(values), values[min(int(share * len(values)), len(values) - 1)])
        assert not got
    both = boq.exact_quantiles(table, ["g"], "v", {"median": 0.5}, places={"low": 0.25, "high": 0.75}).where("g = 'many'").drop("n").collect()[0]
    values = sorted(v for g, v in rows if g == "many")
    assert both.median == np.quantile(values, 0.5) and both[2:4] == (values[7500], values[22500])


def test_rows_are_not_sorted_to_be_counted(spark):
    """Rows outside the brackets are added up where they are read: no sort stands before the last scan's sums."""
    table = spark.createDataFrame([(f"g{i % 3}", float(i)) for i in range(200)], "g string, v double")
    plan = boq.exact_quantiles(table, ["g"], "v", {"median": 0.5})._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "HashAggregate" in plan


def test_nearest_vectors_in_rounds(spark, monkeypatch):
    from girder.operators import corpus

    rng = np.random.default_rng(5)
    rows = rng.normal(size=(300, 6))
    table = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(rows)] + [(900, None)], "vec_id long, embedding array<double>").repartition(4)
    unit = rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))
    want = {}
    for q in range(0, 300, 7):
        score = np.round(unit @ unit[q], 6)
        want[q] = np.lexsort((np.arange(300), -score))[:4].tolist()
    for size in (32 << 20, 100):  # all queries at once, and each block alone
        monkeypatch.setattr(corpus, "ROUND_BYTES", size)
        got = {}
        for r in corpus.cosine_top(table, table.where("vec_id % 7 = 0 AND vec_id < 300"), 4).collect():
            got.setdefault(r.query_id, []).append((r.rank, r.vec_id))
        assert {q: [v for _, v in sorted(x)] for q, x in got.items()} == want
