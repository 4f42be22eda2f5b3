"""Bill-of-quantities queries. A line item is a bill line; its part's brand is the section and its type the category."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import boq
from ..registry import Tables, query

MONEY = "decimal(38,4)"


def lines(t: Tables) -> DataFrame:
    """Bill lines: (order, line, item, description, section, category, quantity, unit_cost, total_cost)."""
    return t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_orderkey").alias("order_id"),
        F.col("l_linenumber").alias("line_no"),
        F.col("l_partkey").alias("item_key"),
        F.col("p_name").alias("description"),
        F.col("p_brand").alias("section"),
        F.col("p_type").alias("category"),
        F.col("l_linestatus").alias("status"),
        F.col("l_quantity").alias("quantity"),
        F.try_divide("l_extendedprice", "l_quantity").alias("unit_cost"),
        F.col("l_extendedprice").cast(MONEY).alias("total_cost"),
    )


LINES = """(SELECT l_orderkey AS order_id, l_linenumber AS line_no, l_partkey AS item_key, p_name AS description, p_brand AS section,
  p_type AS category, l_linestatus AS status, l_quantity AS quantity, CASE WHEN l_quantity <> 0 THEN l_extendedprice / l_quantity END AS unit_cost,
  l_extendedprice::DECIMAL(38,4) AS total_cost FROM lineitem JOIN part ON l_partkey = p_partkey)"""


@query(
    "boq_section_totals",
    f"""WITH s AS (SELECT section, count(*) AS n_lines, sum(total_cost) AS t FROM {LINES} GROUP BY section)
    SELECT section, n_lines, t::DOUBLE AS section_total, t::DOUBLE * 100 / (sum(t) OVER ())::DOUBLE AS share_pct FROM s""",
)
def boq_section_totals(t: Tables) -> DataFrame:
    out = boq.section_totals(lines(t))
    return out.select("section", "n_lines", F.col("section_total").cast("double").alias("section_total"), (F.col("section_total").cast("double") * 100 / F.sum("section_total").over(boq.Window.partitionBy()).cast("double")).alias("share_pct"))


@query(
    "boq_row_filter",
    f"SELECT order_id, line_no, description, quantity FROM {LINES} WHERE trim(coalesce(description, '')) <> '' AND coalesce(quantity, 0) <> 0",
)
def boq_row_filter(t: Tables) -> DataFrame:
    return boq.row_filter(lines(t), "description", "quantity").select("order_id", "line_no", "description", "quantity")


@query(
    "boq_merge_lines",
    f"""SELECT trim(regexp_replace(lower(description), '[^a-z0-9]+', ' ', 'g')) AS work, count(*) AS n_lines, sum(quantity::DECIMAL(38,4))::DOUBLE AS quantity,
    sum(total_cost)::DOUBLE AS total_cost, arg_min(unit_cost, (order_id, line_no, item_key, unit_cost)) AS unit_cost FROM {LINES} GROUP BY 1""",
)
def boq_merge_lines(t: Tables) -> DataFrame:
    exact = lines(t).withColumn("quantity", F.col("quantity").cast(MONEY))
    merged = boq.merge_lines(exact, "description", "quantity", "total_cost", ["order_id", "line_no", "item_key", "unit_cost"])
    return merged.withColumn("quantity", F.col("quantity").cast("double")).withColumn("total_cost", F.col("total_cost").cast("double"))


@query(
    "boq_validate_flags",
    """WITH x AS (SELECT l_orderkey, l_linenumber, l_quantity AS q, p_retailprice AS r, l_extendedprice AS a FROM lineitem JOIN part ON l_partkey = p_partkey)
    SELECT l_orderkey AS order_id, l_linenumber AS line_no, CASE WHEN q = 0 OR r = 0 THEN 'zero' WHEN abs(q * r - a) > 0.5 AND
    abs(q * r - a) / greatest(abs(q * r), abs(a)) > 0.001 THEN 'mismatch' ELSE 'ok' END AS flag FROM x""",
)
def boq_validate_flags(t: Tables) -> DataFrame:
    joined = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    flagged = boq.line_flags(joined, "l_quantity", "p_retailprice", "l_extendedprice")
    return flagged.select(F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("line_no"), "flag")


@query(
    "boq_bottom_line_drift",
    """WITH s AS (SELECT l_orderkey AS order_id, sum(l_extendedprice::DECIMAL(38,4))::DOUBLE AS summed FROM lineitem GROUP BY 1)
    SELECT order_id, summed, o_totalprice AS declared, summed - o_totalprice AS drift,
    abs(summed - o_totalprice) > 0.5 AND abs(summed - o_totalprice) / greatest(abs(summed), abs(o_totalprice)) > 0.001 AS drifted
    FROM s JOIN orders ON order_id = o_orderkey""",
)
def boq_bottom_line_drift(t: Tables) -> DataFrame:
    sums = t.lineitem.groupBy(F.col("l_orderkey").alias("order_id")).agg(F.sum(F.col("l_extendedprice").cast(MONEY)).cast("double").alias("summed"))
    drift = F.col("summed") - F.col("o_totalprice")
    both = sums.join(t.orders, F.col("order_id") == F.col("o_orderkey"))
    drifted = (F.abs(drift) > 0.5) & (F.try_divide(F.abs(drift), F.greatest(F.abs("summed"), F.abs("o_totalprice"))) > 0.001)
    return both.select("order_id", "summed", F.col("o_totalprice").alias("declared"), drift.alias("drift"), drifted.alias("drifted"))


RATES = "count(unit_cost) AS n, quantile_cont(unit_cost, 0.25) AS p25, median(unit_cost) AS median, quantile_cont(unit_cost, 0.75) AS p75, min(unit_cost) AS low, max(unit_cost) AS high"


@query("rate_card_stats", f"SELECT section, category, {RATES} FROM {LINES} GROUP BY ALL HAVING count(unit_cost) >= 2")
def rate_card_stats(t: Tables) -> DataFrame:
    return boq.unit_rates(lines(t), ["section", "category"], "unit_cost")


@query(
    "rate_card_grouping_sets",
    f"""SELECT section, category, count(*) AS n, sum(total_cost)::DOUBLE AS total, grouping(section) AS g_section, grouping(category) AS g_category
    FROM {LINES} GROUP BY GROUPING SETS ((section, category), (section), (category), ())""",
)
def rate_card_grouping_sets(t: Tables) -> DataFrame:
    cube = lines(t).cube("section", "category").agg(
        F.count("*").alias("n"), F.sum("total_cost").cast("double").alias("total"), F.grouping("section").cast("long").alias("g_section"), F.grouping("category").cast("long").alias("g_category")
    )
    return cube


@query(
    "rate_card_reconcile",
    f"""WITH x AS (SELECT category, median(unit_cost) AS rate_a FROM {LINES} WHERE status = 'F' GROUP BY 1),
    y AS (SELECT category, median(unit_cost) AS rate_b FROM {LINES} WHERE status <> 'F' GROUP BY 1)
    SELECT coalesce(x.category, y.category) AS category, rate_a, rate_b, (rate_b - rate_a) * 100 / rate_a AS diff_pct,
    CASE WHEN y.category IS NULL THEN 'left' WHEN x.category IS NULL THEN 'right' ELSE 'both' END AS side FROM x FULL JOIN y ON x.category = y.category""",
)
def rate_card_reconcile(t: Tables) -> DataFrame:
    """The card of finished lines against that of open ones."""
    cards = boq.exact_quantiles(lines(t).withColumn("done", F.col("status") == "F").where("done IS NOT NULL"), ["category", "done"], "unit_cost", {"rate": 0.5}, count="*")
    both = cards.groupBy("category").agg(*(F.max(F.when(F.col("done") == d, F.col("rate"))).alias(name) for d, name in ((True, "rate_a"), (False, "rate_b"))), F.max("done").alias("a"), F.max(~F.col("done")).alias("b"))
    side = F.when(~F.col("b"), "left").when(~F.col("a"), "right").otherwise("both")
    return both.select("category", "rate_a", "rate_b", boq.variance(F.col("rate_b"), F.col("rate_a")).alias("diff_pct"), side.alias("side"))


TIERS = f"""e AS (SELECT section, category, median(unit_cost) AS rate FROM {LINES} GROUP BY ALL HAVING count(*) >= 8),
c AS (SELECT category, median(unit_cost) AS rate FROM {LINES} GROUP BY ALL HAVING count(*) >= 200),
s AS (SELECT section, median(unit_cost) AS rate FROM {LINES} GROUP BY ALL),
priced AS (SELECT l.*, coalesce(e.rate, c.rate, s.rate) AS rate, CASE WHEN e.rate IS NOT NULL THEN 'exact' WHEN c.rate IS NOT NULL THEN 'category'
WHEN s.rate IS NOT NULL THEN 'section' ELSE 'no rate' END AS rate_source FROM {LINES} l LEFT JOIN e USING (section, category) LEFT JOIN c USING (category) LEFT JOIN s USING (section))"""


def priced(t: Tables) -> DataFrame:
    return boq.tiered_price(lines(t), *boq.rate_cards(lines(t), {("section", "category"): 8, ("category",): 200, ("section",): 1}, "unit_cost"))


@query("price_tiered_fallback", f"WITH {TIERS} SELECT order_id, line_no, rate, rate_source FROM priced")
def price_tiered_fallback(t: Tables) -> DataFrame:
    return priced(t).select("order_id", "line_no", "rate", "rate_source")


@query(
    "priced_summary",
    f"WITH {TIERS} SELECT rate_source, count(*) AS n_lines, sum((quantity * rate)::DECIMAL(38,2))::DOUBLE AS amount FROM priced GROUP BY 1",
)
def priced_summary(t: Tables) -> DataFrame:
    return priced(t).groupBy("rate_source").agg(F.count("*").alias("n_lines"), F.sum((F.col("quantity") * F.col("rate")).cast("decimal(38,2)")).cast("double").alias("amount"))


@query(
    "variance_vs_benchmark",
    f"""WITH b AS (SELECT category, median(unit_cost) AS expected FROM {LINES} GROUP BY 1 HAVING median(unit_cost) > 0)
    SELECT order_id, line_no, (unit_cost - expected) * 100 / expected AS variance_pct,
    CASE WHEN abs((unit_cost - expected) * 100 / expected) > 40 THEN 'high' WHEN abs((unit_cost - expected) * 100 / expected) > 20 THEN 'medium' ELSE 'low' END AS severity
    FROM {LINES} JOIN b USING (category)""",
)
def variance_vs_benchmark(t: Tables) -> DataFrame:
    bench = boq.exact_quantiles(lines(t), ["category"], "unit_cost", {"expected": 0.5}, count="*").drop("n").where("expected > 0")
    percent = boq.variance(F.col("unit_cost"), F.col("expected"))
    return lines(t).join(bench, "category").select("order_id", "line_no", percent.alias("variance_pct"), boq.severity(percent, 20).alias("severity"))


@query(
    "qty_variance",
    """WITH d AS (SELECT p_partkey, p_size::DOUBLE AS drawn FROM part), b AS (SELECT l_partkey, sum(l_quantity::DECIMAL(38,4))::DOUBLE AS billed FROM lineitem GROUP BY 1)
    SELECT p_partkey AS item_key, billed, drawn, (billed - drawn) * 100 / drawn AS variance_pct FROM b JOIN d ON l_partkey = p_partkey""",
)
def qty_variance(t: Tables) -> DataFrame:
    billed = t.lineitem.groupBy("l_partkey").agg(F.sum(F.col("l_quantity").cast(MONEY)).cast("double").alias("billed"))
    drawn = t.part.select("p_partkey", F.col("p_size").cast("double").alias("drawn"))
    both = billed.join(drawn, F.col("l_partkey") == F.col("p_partkey"))
    return both.select(F.col("p_partkey").alias("item_key"), "billed", "drawn", boq.variance(F.col("billed"), F.col("drawn")).alias("variance_pct"))


@query(
    "unit_price_outliers",
    f"""WITH m AS (SELECT order_id, sum(total_cost)::DOUBLE / count(*) AS mean FROM {LINES} GROUP BY 1)
    SELECT order_id, line_no, total_cost::DOUBLE AS total_cost FROM {LINES} JOIN m USING (order_id) WHERE total_cost::DOUBLE > 3 * mean""",
)
def unit_price_outliers(t: Tables) -> DataFrame:
    bid = boq.Window.partitionBy("order_id")
    mean = F.sum("total_cost").over(bid).cast("double") / F.count("*").over(bid)
    return lines(t).withColumn("mean", mean).where(F.col("total_cost").cast("double") > 3 * F.col("mean")).select("order_id", "line_no", F.col("total_cost").cast("double").alias("total_cost"))


@query(
    "norms_weighted",
    f"SELECT category, sum(total_cost)::DOUBLE / sum(quantity::DECIMAL(38,4))::DOUBLE AS norm FROM {LINES} GROUP BY 1 HAVING sum(quantity) > 0",
)
def norms_weighted(t: Tables) -> DataFrame:
    sums = lines(t).groupBy("category").agg(F.sum("total_cost").cast("double").alias("c"), F.sum(F.col("quantity").cast(MONEY)).cast("double").alias("q"))
    return sums.where("q > 0").select("category", (F.col("c") / F.col("q")).alias("norm"))
