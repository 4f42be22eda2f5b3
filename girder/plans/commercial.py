"""Commercial queries. A customer is a contract, an order a claim or bid, a nation a tender package."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import calculators as calc
from ..operators import commercial, ranking
from ..registry import Tables, query

MONEY = "decimal(38,4)"


@query(
    "earned_value",
    """WITH s AS (SELECT l_orderkey AS order_id, sum(l_extendedprice::DECIMAL(38,4))::DOUBLE AS b, sum((CASE WHEN l_linestatus = 'F' THEN l_extendedprice ELSE 0 END)::DECIMAL(38,4))::DOUBLE AS p,
      sum((CASE WHEN l_returnflag <> 'R' THEN l_extendedprice ELSE 0 END)::DECIMAL(38,4))::DOUBLE AS e, sum((l_extendedprice * (1 - l_discount))::DECIMAL(38,4))::DOUBLE AS a FROM lineitem GROUP BY 1),
    i AS (SELECT *, e / nullif(a, 0) AS cpi, e / nullif(p, 0) AS spi FROM s), x AS (SELECT *, b / nullif(cpi, 0) AS eac FROM i)
    SELECT order_id, cpi, spi, eac, eac - a AS etc, b - eac AS vac, e - a AS cv, e - p AS sv, CASE WHEN least(cpi, spi) IS NULL THEN 'unknown'
      WHEN least(cpi, spi) >= 0.95 THEN 'green' WHEN least(cpi, spi) >= 0.85 THEN 'amber' ELSE 'red' END AS light FROM x""",
)
def earned_value(t: Tables) -> DataFrame:
    price = F.col("l_extendedprice")
    exact = lambda c: F.sum(c.cast(MONEY)).cast("double")
    sums = t.lineitem.groupBy(F.col("l_orderkey").alias("order_id")).agg(
        exact(price).alias("b"),
        exact(F.when(F.col("l_linestatus") == "F", price).otherwise(0.0)).alias("p"),
        exact(F.when(F.col("l_returnflag") != "R", price).otherwise(0.0)).alias("e"),
        exact(price * (1 - F.col("l_discount"))).alias("a"),
    )
    return sums.select("order_id", *commercial.earned_value(*(F.col(c) for c in "bpea")))


@query(
    "interim_payments",
    """WITH c AS (SELECT o_custkey AS contract, o_orderkey AS claim, o_orderdate AS dated, o_totalprice::DECIMAL(20,2) AS gross FROM orders),
    r AS (SELECT *, sum(gross) OVER w AS run FROM c WINDOW w AS (PARTITION BY contract ORDER BY dated, claim ROWS UNBOUNDED PRECEDING)),
    p AS (SELECT *, gross::DOUBLE * 0.1 AS retained, least(run::DOUBLE * 0.2, 50000) - least((run - gross)::DOUBLE * 0.2, 50000) AS recovered FROM r)
    SELECT contract, claim, retained, recovered, gross::DOUBLE - retained - recovered AS net FROM p""",
)
def interim_payments(t: Tables) -> DataFrame:
    claims = t.orders.select(F.col("o_custkey").alias("contract"), F.col("o_orderkey").alias("claim"), F.col("o_orderdate").alias("at"), F.col("o_totalprice").cast("decimal(20,2)").alias("gross"))
    return commercial.payments(claims, "contract", ["at", "claim"], "gross", 0.1, 0.2, F.lit(50000.0)).select("contract", "claim", "retained", "recovered", "net")


@query(
    "tender_statistics",
    """WITH s AS (SELECT c_nationkey AS package, count(o_totalprice) AS n, min(o_totalprice) AS low, sum(o_totalprice::DECIMAL(38,4))::DOUBLE / count(o_totalprice) AS mean,
    max(o_totalprice) AS high FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1) SELECT *, (high - low) * 100 / nullif(low, 0) AS spread_pct FROM s""",
)
def tender_statistics(t: Tables) -> DataFrame:
    bids = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_nationkey").alias("package"), F.col("o_totalprice").alias("price"))
    return commercial.tender_statistics(bids, "package", "price")


@query(
    "price_scores",
    """WITH b AS (SELECT o_orderkey, o_totalprice AS price, min(o_totalprice) OVER w AS low, (sum(o_totalprice::DECIMAL(38,4)) OVER w)::DOUBLE / count(*) OVER w AS mean
      FROM orders JOIN customer ON o_custkey = c_custkey WINDOW w AS (PARTITION BY c_nationkey, year(o_orderdate)))
    SELECT o_orderkey, CASE WHEN price <= low THEN 100 WHEN price <= mean THEN 80 WHEN price <= mean * 1.1 THEN 60 ELSE 40 END AS score FROM b""",
)
def price_scores(t: Tables) -> DataFrame:
    """A package may hold a third of all bids: its figures come from an aggregation with partial sums, not from a window."""
    bids = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_nationkey", F.year("o_orderdate").alias("y"), F.col("o_totalprice").alias("price"))
    mean = F.sum(F.col("price").cast(MONEY)).cast("double") / F.count("*")
    stats = bids.groupBy("c_nationkey", "y").agg(F.min("price").alias("low"), mean.alias("mean"))
    return bids.join(stats, ["c_nationkey", "y"]).select("o_orderkey", calc.price_score(F.col("price"), F.col("low"), F.col("mean")).alias("score"))


@query(
    "risk_bands",
    """WITH r AS (SELECT l_orderkey, l_linenumber, l_suppkey % 5 + 1 AS p, l_partkey % 5 + 1 AS i FROM lineitem)
    SELECT p, i, CASE WHEN p * i <= 4 THEN 'green' WHEN p * i <= 9 THEN 'amber' ELSE 'red' END AS band, count(*) AS n FROM r GROUP BY 1, 2""",
)
def risk_bands(t: Tables) -> DataFrame:
    rated = t.lineitem.select((F.col("l_suppkey") % 5 + 1).alias("p"), (F.col("l_partkey") % 5 + 1).alias("i"))
    return rated.groupBy("p", "i").agg(F.count("*").alias("n")).withColumn("band", calc.risk_band(F.col("p"), F.col("i")))


@query(
    "correction_fit",
    """WITH x AS (SELECT p_brand AS formula, p_retailprice * l_quantity AS c, l_extendedprice AS a FROM lineitem JOIN part ON l_partkey = p_partkey),
    s AS (SELECT formula, coalesce(regr_slope(a, c), 1) AS scale, avg(c) AS mx, avg(a) AS my FROM x GROUP BY 1), l AS (SELECT *, my - scale * mx AS bias FROM s),
    f AS (SELECT formula, scale, bias, my, count(*) AS n, avg(abs(a - c * scale - bias)) AS e FROM x JOIN l USING (formula) GROUP BY 1, 2, 3, 4)
    SELECT formula, n, round(scale, 6) AS scale, round(bias, 2) AS bias, round(e / nullif(abs(my), 0), 6) AS error_share,
      CASE WHEN n >= 50 AND e / nullif(abs(my), 0) <= 0.1 THEN 'trusted' WHEN n >= 10 THEN 'provisional' ELSE 'unproven' END AS tier FROM f""",
)
def correction_fit(t: Tables) -> DataFrame:
    pairs = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select(F.col("p_brand").alias("formula"), (F.col("p_retailprice") * F.col("l_quantity")).alias("c"), F.col("l_extendedprice").alias("a"))
    fit = commercial.correction_fit(pairs, "formula", "c", "a")
    return fit.select("formula", "n", F.round("scale", 6).alias("scale"), F.round("bias", 2).alias("bias"), F.round("error_share", 6).alias("error_share"), "tier")


@query(
    "defect_ranking",
    """WITH x AS (SELECT l_suppkey AS trade, count(*) AS n, sum(CASE l_returnflag WHEN 'R' THEN 5 WHEN 'A' THEN 3 ELSE 1 END)::BIGINT AS weighted,
      count_if(l_linestatus = 'F') * 100.0::DOUBLE / count(*) AS fail_pct FROM lineitem GROUP BY 1 HAVING count(*) >= 3)
    SELECT *, row_number() OVER (ORDER BY risk DESC, trade) AS rank FROM (SELECT *, weighted + fail_pct AS risk FROM x)""",
)
def defect_ranking(t: Tables) -> DataFrame:
    """All trades with their place by risk, the highest first."""
    weight = F.when(F.col("l_returnflag") == "R", 5).when(F.col("l_returnflag") == "A", 3).otherwise(1)
    failed = F.count_if(F.col("l_linestatus") == "F") * 100.0 / F.count("*")
    found = t.lineitem.groupBy(F.col("l_suppkey").alias("trade")).agg(F.count("*").alias("n"), F.sum(weight).alias("weighted"), failed.alias("fail_pct")).where("n >= 3")
    risky = found.withColumn("risk", F.col("weighted") + F.col("fail_pct")).withColumn("all", F.lit(0))
    return ranking.numbered(risky, ["all"], [F.desc("risk"), F.col("trade")]).drop("all")


@query(
    "block_metrics",
    """SELECT event_type AS block, count(*) AS n, sum(value::DECIMAL(38,6))::DOUBLE / count(value) AS mean, count_if(value < 10) AS n_low,
    arg_max(value, (ts, event_id)) AS last_value FROM events GROUP BY 1""",
)
def block_metrics(t: Tables) -> DataFrame:
    mean = F.sum(F.col("value").cast("decimal(38,6)")).cast("double") / F.count("value")
    return t.events.groupBy(F.col("event_type").alias("block")).agg(
        F.count("*").alias("n"), mean.alias("mean"), F.count_if(F.col("value") < 10).alias("n_low"), F.max_by("value", F.struct("ts", "event_id")).alias("last_value")
    )


@query(
    "usage_rollup",
    """SELECT ts::DATE AS day, event_type, count(*) AS n, sum(value::DECIMAL(38,6))::DOUBLE AS cost FROM events GROUP BY ROLLUP (ts::DATE, event_type)""",
)
def usage_rollup(t: Tables) -> DataFrame:
    cost = F.sum(F.col("value").cast("decimal(38,6)")).cast("double")
    return t.events.select(F.col("ts").cast("date").alias("day"), "event_type", "value").rollup("day", "event_type").agg(F.count("*").alias("n"), cost.alias("cost"))


@query(
    "activity_counts",
    """SELECT o_orderpriority AS priority, o_orderstatus AS status, count(*) AS n, count_if(o_orderstatus = 'P') AS blocked FROM orders
    GROUP BY GROUPING SETS ((o_orderpriority), (o_orderstatus), ())""",
)
def activity_counts(t: Tables) -> DataFrame:
    named = t.orders.select(F.col("o_orderpriority").alias("priority"), F.col("o_orderstatus").alias("status"))
    blocked = F.count_if(F.col("status") == "P").alias("blocked")
    return named.groupingSets([[F.col("priority")], [F.col("status")], []], "priority", "status").agg(F.count("*").alias("n"), blocked)


def measures() -> tuple:
    """Quantity, price and line number as loads, spans and sizes."""
    return F.col("l_quantity"), F.col("l_extendedprice"), F.col("l_linenumber").cast("double")


@query(
    "calculators_structural",
    """SELECT l_orderkey, l_linenumber, q * s * s / 8 AS moment, q * s / 2 + p / 2 AS shear, q * s * s / 12 AS fixed_moment, p * s * 0.25 * (s - s * 0.25) / nullif(s, 0) AS point_moment,
    p * 1000 / nullif(300 * q, 0) AS stress, p / nullif(q * s, 0) AS pressure, p * 1000 / nullif(3.141592653589793 * q * q / 4, 0) AS cylinder,
    q * 10 * 420 * (500 - q * 10 * 420 / (0.85 * 30 * 300) / 2) / 1e6 AS rc_moment
    FROM (SELECT *, l_quantity AS q, l_extendedprice AS p, l_linenumber::DOUBLE AS s FROM lineitem)""",
)
def calculators_structural(t: Tables) -> DataFrame:
    lit, (q, p, s) = F.lit, measures()
    return t.lineitem.select(
        "l_orderkey", "l_linenumber",
        calc.beam_moment_udl(q, s).alias("moment"),
        calc.beam_shear(q, s, p).alias("shear"),
        calc.fixed_beam_support_moment(q, s).alias("fixed_moment"),
        calc.beam_moment_point(p, s, s * 0.25).alias("point_moment"),
        calc.shear_stress(p, lit(300.0), q).alias("stress"),
        calc.bearing_pressure(p, q, s).alias("pressure"),
        calc.cylinder_strength(p, q).alias("cylinder"),
        calc.rc_beam_moment(q * 10, lit(420.0), lit(300.0), lit(500.0), lit(30.0)).alias("rc_moment"),
    )


@query(
    "calculators_site",
    """SELECT l_orderkey, l_linenumber, q * s * 2 * 1.25 AS excavated, (p - q) * 1.1 AS backfill, q * 100 / 50 AS compaction, (p - q) / nullif(q, 0) AS roi, p / nullif(q, 0) AS per_area,
    greatest(1, ceil(p / (4 * 8)))::BIGINT AS days, 80 * 9.81 * (1 + s / 2) / 1000 AS arrest, q / (35 + q) * 780 AS shrinkage,
    3.141592653589793 / 4 * (q / 1000) * (q / 1000) * 7850 * 12 * s AS rebar FROM (SELECT *, l_quantity AS q, l_extendedprice AS p, l_linenumber::DOUBLE AS s FROM lineitem)""",
)
def calculators_site(t: Tables) -> DataFrame:
    lit, (q, p, s) = F.lit, measures()
    return t.lineitem.select(
        "l_orderkey", "l_linenumber",
        calc.excavation_volume(q, s, lit(2.0), lit(1.25)).alias("excavated"),
        calc.backfill_volume(p, q, lit(1.1)).alias("backfill"),
        calc.compaction_percent(q, lit(50.0)).alias("compaction"),
        calc.roi(p, q).alias("roi"),
        calc.cost_per_area(p, q).alias("per_area"),
        calc.duration_days(p, lit(4.0), lit(8.0)).alias("days"),
        calc.fall_arrest_force(lit(80.0), s, lit(2.0)).alias("arrest"),
        calc.shrinkage_at(q, lit(780.0), lit(35.0)).alias("shrinkage"),
        calc.rebar_weight(q, lit(12.0), s).alias("rebar"),
    )
