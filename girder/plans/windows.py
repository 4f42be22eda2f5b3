"""Ranks, leaderboards and running totals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import ranking
from ..registry import Tables, query

MONEY = "decimal(38,4)"


@query(
    "tender_rank",
    """WITH b AS (SELECT s_suppkey, s_nationkey, s_acctbal AS price, min(s_acctbal) OVER n AS low, (sum(s_acctbal::DECIMAL(38,4)) OVER n)::DOUBLE / count(*) OVER n AS mean FROM supplier
      WINDOW n AS (PARTITION BY s_nationkey)),
    s AS (SELECT *, CASE WHEN price = low THEN 100 WHEN price <= mean THEN 80 WHEN price <= 1.1 * mean THEN 60 ELSE 40 END AS price_score FROM b)
    SELECT s_nationkey AS tender, s_suppkey AS bidder, price_score::INTEGER AS price_score, row_number() OVER (PARTITION BY s_nationkey ORDER BY price_score DESC, price, s_suppkey) AS rank FROM s""",
)
def tender_rank(t: Tables) -> DataFrame:
    """Bids by score, then price. Bounds are summed before they are moved, and places counted in ranges, as a tender may hold most bids."""
    price = F.col("s_acctbal")
    bounds = t.supplier.groupBy("s_nationkey").agg(F.min(price).alias("low"), (F.sum(price.cast(MONEY)).cast("double") / F.count("*")).alias("mean"))
    score = F.when(price == F.col("low"), 100).when(price <= F.col("mean"), 80).when(price <= 1.1 * F.col("mean"), 60).otherwise(40)
    scored = t.supplier.select("s_nationkey", "s_suppkey", "s_acctbal").join(bounds, "s_nationkey").withColumn("price_score", score)
    placed = ranking.numbered(scored, ["s_nationkey"], [F.desc("price_score"), F.col("s_acctbal"), F.col("s_suppkey")])
    return placed.select(F.col("s_nationkey").alias("tender"), F.col("s_suppkey").alias("bidder"), "price_score", "rank")


@query(
    "supplier_top3",
    """WITH x AS (SELECT l_partkey, l_suppkey, sum(l_quantity::DECIMAL(38,4))::DOUBLE AS quantity FROM lineitem GROUP BY ALL)
    SELECT l_partkey AS part, l_suppkey AS supplier, quantity, row_number() OVER (PARTITION BY l_partkey ORDER BY quantity DESC, l_suppkey) AS rank FROM x QUALIFY rank <= 3""",
)
def supplier_top3(t: Tables) -> DataFrame:
    sums = t.lineitem.groupBy(F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supplier")).agg(F.sum(F.col("l_quantity").cast(MONEY)).cast("double").alias("quantity"))
    return ranking.top(sums, ["part"], [F.desc("quantity"), F.col("supplier")], 3)


@query(
    "provider_leaderboard",
    """WITH p AS (SELECT event_type AS provider, count(*) AS calls, sum(value::DECIMAL(38,4))::DOUBLE / count(value) AS latency, count(*) FILTER (value > 90) * 1.0::DOUBLE / count(*) AS slow FROM events GROUP BY 1)
    SELECT *, 100 * (1 - slow) - latency / 10 AS reliability, row_number() OVER (ORDER BY 100 * (1 - slow) - latency / 10 DESC NULLS LAST, provider) AS rank FROM p""",
)
def provider_leaderboard(t: Tables) -> DataFrame:
    stats = t.events.groupBy(F.col("event_type").alias("provider")).agg(
        F.count("*").alias("calls"), (F.sum(F.col("value").cast(MONEY)).cast("double") / F.count("value")).alias("latency"), (F.count_if(F.col("value") > 90) * F.lit(1.0) / F.count("*")).alias("slow")
    )
    scored = stats.withColumn("reliability", 100 * (1 - F.col("slow")) - F.col("latency") / 10)
    return scored.withColumn("rank", F.row_number().over(Window.orderBy(F.col("reliability").desc_nulls_last(), "provider")).cast("long"))  # one row per provider


@query(
    "rolling_latency",
    """SELECT event_id, (sum(value::DECIMAL(38,4)) OVER w)::DOUBLE / count(value) OVER w AS mean_20, count(*) FILTER (value > 90) OVER w AS n_slow
    FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)""",
)
def rolling_latency(t: Tables) -> DataFrame:
    w = ranking.rolling(["user_id"], ["ts", "event_id"], 20)
    mean = F.sum(F.col("value").cast(MONEY)).over(w).cast("double") / F.count("value").over(w)
    return t.events.select("event_id", mean.alias("mean_20"), F.count(F.when(F.col("value") > 90, 1)).over(w).alias("n_slow"))


@query(
    "trend_spike",
    """SELECT event_id, user_id FROM (SELECT event_id, user_id, sum(value::DECIMAL(38,4)) OVER a AS x, sum(value::DECIMAL(38,4)) OVER b AS y, count(*) OVER b AS n
    FROM events WINDOW a AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), b AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 9 PRECEDING AND 5 PRECEDING))
    WHERE n = 5 AND x::DOUBLE > 1.5 * y::DOUBLE""",
)
def trend_spike(t: Tables) -> DataFrame:
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    value, before = F.col("value").cast(MONEY), order.rowsBetween(-9, -5)
    both = t.events.select("event_id", "user_id", F.sum(value).over(order.rowsBetween(-4, 0)).alias("x"), F.sum(value).over(before).alias("y"), F.count("*").over(before).alias("n"))
    return both.where((F.col("n") == 5) & (F.col("x").cast("double") > 1.5 * F.col("y").cast("double"))).select("event_id", "user_id")


@query("latest_per_scope", "SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, max(ts) AS ts FROM events GROUP BY 1")
def latest_per_scope(t: Tables) -> DataFrame:
    return t.events.groupBy("user_id").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"), F.max("ts").alias("ts"))


@query(
    "last_k_messages",
    "SELECT conv_id, turn, role, (least(n, 3) - k + 1)::BIGINT AS place FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations) WHERE k <= 3",
)
def last_k_messages(t: Tables) -> DataFrame:
    """The last three turns of each conversation, the oldest in place 1."""
    last = ranking.top(t.conversations.select("conv_id", "turn", "role"), ["conv_id"], [F.desc("turn")], 3)
    return last.withColumn("place", F.max("rank").over(Window.partitionBy("conv_id")) - F.col("rank") + 1).drop("rank")


@query(
    "cumulative_variations",
    """WITH v AS (SELECT o_custkey, o_orderkey, (sum(o_totalprice::DECIMAL(38,4)) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))::DOUBLE AS total,
    (max(o_totalprice) OVER (PARTITION BY o_custkey)) * 4 AS contract FROM orders)
    SELECT o_custkey AS contract_id, o_orderkey AS variation, total, total * 100 / contract AS pct, total > 0.2 * contract AS over_cap FROM v""",
)
def cumulative_variations(t: Tables) -> DataFrame:
    own = Window.partitionBy("o_custkey")
    total = F.sum(F.col("o_totalprice").cast(MONEY)).over(own.orderBy("o_orderdate", "o_orderkey").rowsBetween(Window.unboundedPreceding, 0)).cast("double")
    v = t.orders.select("o_custkey", "o_orderkey", total.alias("total"), (F.max("o_totalprice").over(own) * 4).alias("contract"))
    return v.select(
        F.col("o_custkey").alias("contract_id"), F.col("o_orderkey").alias("variation"), "total", (F.col("total") * 100 / F.col("contract")).alias("pct"), (F.col("total") > 0.2 * F.col("contract")).alias("over_cap")
    )


@query(
    "windows_delay",
    """WITH d AS (SELECT o_orderkey, date_trunc('month', o_orderdate) AS month, date_diff('day', o_orderdate::DATE, max(l_shipdate)::DATE) AS days FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey, o_orderdate),
    m AS (SELECT month, count(*) AS n, sum(days)::BIGINT AS days FROM d GROUP BY 1 HAVING count(*) > 0)
    SELECT strftime(month, '%Y-%m') AS month, n, days, (sum(days) OVER (ORDER BY month))::BIGINT AS cumulative FROM m""",
)
def windows_delay(t: Tables) -> DataFrame:
    done = t.lineitem.groupBy("l_orderkey").agg(F.max("l_shipdate").alias("finish"))
    late = t.orders.join(done, F.col("o_orderkey") == F.col("l_orderkey")).select(F.date_format("o_orderdate", "yyyy-MM").alias("month"), F.datediff("finish", "o_orderdate").alias("late"))
    months = late.groupBy("month").agg(F.count("*").alias("n"), F.sum("late").alias("days"))
    return months.withColumn("cumulative", F.sum("days").over(Window.orderBy("month").rowsBetween(Window.unboundedPreceding, 0)))  # one row per month


@query(
    "package_sequence",
    """SELECT l_orderkey AS package, l_linenumber AS item, l_orderkey::VARCHAR || '.' || (row_number() OVER w)::VARCHAR AS activity, lag(l_linenumber) OVER w AS predecessor
    FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate)""",
)
def package_sequence(t: Tables) -> DataFrame:
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate")
    name = F.concat_ws(".", F.col("l_orderkey").cast("string"), F.row_number().over(w).cast("string"))
    return t.lineitem.select(F.col("l_orderkey").alias("package"), F.col("l_linenumber").alias("item"), name.alias("activity"), F.lag("l_linenumber").over(w).alias("predecessor"))


@query(
    "contiguous_runs",
    "SELECT lang, min(doc_id) AS first, max(doc_id) AS last, count(*) AS n FROM (SELECT lang, doc_id, doc_id - row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS k FROM documents) GROUP BY lang, k",
)
def contiguous_runs(t: Tables) -> DataFrame:
    return ranking.islands(t.documents.select("lang", "doc_id"), ["lang"], "doc_id")
