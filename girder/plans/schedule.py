"""Schedule queries. An order is a network, its lines are activities; ship dates and quantities make spans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import networks as net
from ..operators import schedule
from ..operators.boq import exact_quantiles
from ..registry import Tables, query

MONEY = "decimal(38,6)"
NETWORK = """acts AS (SELECT l_orderkey AS network, l_linenumber AS activity, max(l_quantity)::BIGINT % 10 + 1 AS duration, max(l_suppkey) % 3 AS s
    FROM lineitem GROUP BY 1, 2),
  arcs AS (SELECT p.network, p.activity AS pred, q.activity AS succ, CASE q.activity - p.activity WHEN 1 THEN p.duration WHEN 2 THEN p.s
    ELSE p.duration - q.duration - 1 END AS w FROM acts p JOIN acts q ON p.network = q.network AND q.activity - p.activity BETWEEN 1 AND 3),
  paths AS (SELECT network, activity AS a, activity AS b, 0::BIGINT AS len FROM acts
    UNION SELECT p.network, p.a, r.succ, p.len + r.w FROM paths p JOIN arcs r ON p.network = r.network AND p.b = r.pred),
  early AS (SELECT network, b AS activity, max(len) AS es FROM paths GROUP BY 1, 2),
  ends AS (SELECT e.network, max(es + duration) AS finish FROM early e JOIN acts a ON e.network = a.network AND e.activity = a.activity GROUP BY 1),
  late AS (SELECT p.network, p.a AS activity, min(finish - duration - len) AS ls FROM paths p JOIN acts a ON p.network = a.network AND p.b = a.activity
    JOIN ends n ON n.network = p.network GROUP BY 1, 2),
  slack AS (SELECT r.network, r.pred AS activity, greatest(0, min(s.es - p.es - w)) AS free FROM arcs r JOIN early p ON p.network = r.network AND p.activity = r.pred
    JOIN early s ON s.network = r.network AND s.activity = r.succ GROUP BY 1, 2),
  cpm AS (SELECT network, activity, duration, es AS early_start, es + duration AS early_finish, ls AS late_start, ls + duration AS late_finish,
    ls - es AS total_float, coalesce(free, ls - es) AS free_float, ls <= es AS is_critical
    FROM acts JOIN early USING (network, activity) JOIN late USING (network, activity) LEFT JOIN slack USING (network, activity))"""


def networks(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Each line follows the one before; it also starts after the second and ends after the third before it."""
    acts = t.lineitem.groupBy(F.col("l_orderkey").alias("network"), F.col("l_linenumber").alias("activity")).agg(
        (F.max("l_quantity").cast("long") % 10 + 1).alias("duration"), (F.max("l_suppkey") % 3).alias("s")
    )
    step = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.lit(kind).alias("kind")) for k, kind in ((1, "FS"), (2, "SS"), (3, "FF"))))).alias("e")
    lag = F.when(F.col("kind") == "SS", F.col("s")).when(F.col("kind") == "FF", -1).otherwise(0)
    edges = acts.select("network", "activity", "s", step).select("network", F.col("activity").alias("pred"), (F.col("activity") + F.col("e.k")).alias("succ"), "e.kind", "s")
    return acts, edges.withColumn("lag", lag)


@query("cpm_schedule", f"WITH RECURSIVE {NETWORK} SELECT * FROM cpm")
def cpm_schedule(t: Tables) -> DataFrame:
    return net.critical_path(*networks(t))


@query(
    "cpm_summary",
    f"""WITH RECURSIVE {NETWORK} SELECT network, max(early_finish) AS finish, count(*) AS n, count_if(is_critical) AS n_critical,
    count_if(total_float BETWEEN 1 AND 4) AS n_near, count_if(is_critical) * 100.0::DOUBLE / count(*) AS critical_pct FROM cpm GROUP BY 1""",
)
def cpm_summary(t: Tables) -> DataFrame:
    near, critical = F.count_if(F.col("total_float").between(1, 4)), F.count_if("is_critical")
    return net.critical_path(*networks(t)).groupBy("network").agg(
        F.max("early_finish").alias("finish"), F.count("*").alias("n"), critical.alias("n_critical"), near.alias("n_near"), (critical * 100.0 / F.count("*")).alias("critical_pct")
    )


def spans(t: Tables) -> DataFrame:
    start = F.col("l_shipdate").cast("date")
    return t.lineitem.select(F.col("l_returnflag").alias("trade"), F.col("l_quantity").alias("quantity"), start.alias("start"), F.date_add(start, F.col("l_linenumber") * 5).alias("finish"))


SPANS = """spans AS (SELECT l_returnflag AS trade, l_quantity AS quantity, l_shipdate::DATE AS start, l_shipdate::DATE + (l_linenumber * 5)::INT AS finish FROM lineitem),
  each AS (SELECT *, unnest(generate_series(date_trunc('{p}', start)::TIMESTAMP, date_trunc('{p}', finish)::TIMESTAMP, INTERVAL 1 {p}))::DATE AS period_start FROM spans),
  cuts AS (SELECT *, least(finish, (period_start + INTERVAL 1 {p})::DATE - 1) - greatest(start, period_start) + 1 AS days FROM each)"""


@query("histogram_weekly", f"WITH {SPANS.format(p='week')} SELECT trade, period_start, count(*) AS active, sum(days)::BIGINT AS crew_days FROM cuts GROUP BY 1, 2")
def histogram_weekly(t: Tables) -> DataFrame:
    return schedule.by_period(spans(t), "WEEK").groupBy("trade", "period_start").agg(F.count("*").alias("active"), F.sum("days").alias("crew_days"))


@query(
    "resource_spread_monthly",
    f"WITH {SPANS.format(p='month')} SELECT trade, period_start, sum((quantity * days / (finish - start + 1))::DECIMAL(38,6))::DOUBLE AS quantity FROM cuts GROUP BY 1, 2",
)
def resource_spread_monthly(t: Tables) -> DataFrame:
    share = (F.col("quantity") * F.col("days") / (F.datediff("finish", "start") + 1)).cast(MONEY)
    return schedule.by_period(spans(t), "MONTH").groupBy("trade", "period_start").agg(F.sum(share).cast("double").alias("quantity"))


def leads(t: Tables) -> DataFrame:
    """Days from order to shipping of each line, with its part's type and the planned days (a month)."""
    joined = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    return joined.select(F.col("p_type").alias("category"), F.datediff("l_shipdate", "o_orderdate").cast("long").alias("days"))


LEADS = """leads AS (SELECT p_type AS category, date_diff('day', o_orderdate::DATE, l_shipdate::DATE) AS days FROM lineitem
  JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)"""


@query("lead_time_summary", f"WITH {LEADS} SELECT category, count(days) AS samples, median(days)::DOUBLE AS median, max(days) AS longest FROM leads GROUP BY 1")
def lead_time_summary(t: Tables) -> DataFrame:
    found = exact_quantiles(leads(t), ["category"], "days", {"median": 0.5})
    return found.select("category", F.col("n").alias("samples"), F.col("median").cast("double").alias("median"), F.col("high").alias("longest"))


@query("lead_time_p80", f"WITH {LEADS} SELECT category, count(days) AS n, list_sort(list(days))[least(floor(count(days) * 0.8), count(days) - 1)::BIGINT + 1] AS at FROM leads WHERE days IS NOT NULL GROUP BY 1")
def lead_time_p80(t: Tables) -> DataFrame:
    return schedule.index_quantile(leads(t), "category", "days", 0.8)


@query("variance_upper_median", f"WITH {LEADS} SELECT category, count(days) AS n, list_sort(list(days))[count(days) // 2 + 1] AS at FROM leads WHERE days IS NOT NULL GROUP BY 1")
def variance_upper_median(t: Tables) -> DataFrame:
    """The upper of the two middle values, not their mean."""
    return schedule.index_quantile(leads(t), "category", "days", 0.5)


@query(
    "duration_calibration",
    f"""WITH {LEADS}, s AS (SELECT category, count(days) AS n, median(days)::DOUBLE AS median, sum(days)::DOUBLE / count(days) AS mean,
    sqrt(greatest(0, sum(days * days)::DOUBLE / count(days) - (sum(days)::DOUBLE / count(days)) * (sum(days)::DOUBLE / count(days)))) AS spread FROM leads GROUP BY 1 HAVING count(days) >= 3)
    SELECT *, CASE WHEN n >= 10 AND spread / nullif(mean, 0) <= 0.15 THEN 'high' WHEN n >= 5 AND spread / nullif(mean, 0) <= 0.3 THEN 'medium' ELSE 'low' END AS confidence FROM s""",
)
def duration_calibration(t: Tables) -> DataFrame:
    n, mean = F.count("days"), F.sum("days").cast("double") / F.count("days")
    square = F.sum(F.col("days") * F.col("days")).cast("double") / n
    stats = leads(t).groupBy("category").agg(n.alias("n"), mean.alias("mean"), F.sqrt(F.greatest(F.lit(0.0), square - mean * mean)).alias("spread")).where("n >= 3")
    middles = exact_quantiles(leads(t), ["category"], "days", {"median": 0.5}, count="*").select("category", F.col("median").cast("double").alias("median"))
    stats = stats.join(middles, "category")
    return stats.withColumn("confidence", schedule.confidence(F.col("n"), F.try_divide("spread", "mean")))


@query(
    "working_day_finish",
    """WITH c AS (SELECT d::DATE AS day FROM (SELECT unnest(generate_series(min(o_orderdate::DATE)::TIMESTAMP, max(o_orderdate::DATE) + INTERVAL 30 DAY, INTERVAL 1 DAY)) AS d FROM orders)
      WHERE isodow(d) <= 5), n AS (SELECT day, row_number() OVER (ORDER BY day) AS no FROM c),
    o AS (SELECT o_orderkey, o_orderdate::DATE AS start, o_orderkey % 10 AS days FROM orders),
    f AS (SELECT o.*, (SELECT min(no) FROM n WHERE day >= start AND day <= start + 3) AS first_no FROM o)
    SELECT o_orderkey, start, days, day AS finish FROM f LEFT JOIN n ON no = first_no + days""",
)
def working_day_finish(t: Tables) -> DataFrame:
    day = F.col("o_orderdate").cast("date")
    every = t.orders.agg(F.explode(F.sequence(F.min(day), F.date_add(F.max(day), 30))).alias("day"))
    dates = t.orders.select("o_orderkey", day.alias("start"), (F.col("o_orderkey") % 10).alias("days"))
    return schedule.add_working_days(dates, "start", "days", every.withColumn("working", F.weekday("day") < 5)).select("o_orderkey", "start", "days", "finish")
