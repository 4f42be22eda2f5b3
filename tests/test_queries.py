"""Every registered query of the core library against its SQL, on the smallest tables."""

import math
import os

import duckdb
import pytest

from girder import registry

registry.load()
DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.9g}")
    return str(value) if not isinstance(value, (int, str, bool, type(None))) else value


def rows(names, table):
    order = sorted(names)
    return sorted(([repr(plain(r[names.index(c)])) for c in order] for r in table))


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_matches_sql(spark, con, name):
    df = registry.QUERIES[name](spark, DATA)
    sql = con.execute(registry.ORACLES[name])
    names = [d[0] for d in sql.description]
    assert sorted(df.columns) == sorted(names)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(names, sql.fetchall())


def test_token_cap_skips_and_goes_on(spark):
    from girder.operators.corpus import token_cap

    ranked = spark.createDataFrame([(1, 10, 1, 60), (1, 11, 2, 50), (1, 12, 3, 40)], "query_id long, vec_id long, rank long, tokens long")
    assert sorted(r.vec_id for r in token_cap(ranked, 100).collect()) == [10, 12]


def test_revision_kinds_do_not_compare(spark):
    from pyspark.sql import functions as F

    from girder.functions.text import revision_rank

    got = spark.createDataFrame([("03",), ("B",), ("AA",), ("x1",)], "t string").select(revision_rank(F.col("t")).alias("r")).collect()
    assert [r.r and tuple(r.r) for r in got] == [(0, 3), (1, 2), (1, 27), None]
