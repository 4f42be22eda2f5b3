"""Scenarios, matches, registers and validation over bills and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import ranking, registers
from ..registry import Tables, query
from .boq import LINES, lines
from .schedule import NETWORK, networks
from .works import LIST, PARTS, parts

FAST = NETWORK.replace("max(l_quantity)::BIGINT % 10 + 1 AS duration", "greatest(1, (max(l_quantity)::BIGINT % 10 + 1) - CASE WHEN max(l_quantity)::BIGINT % 10 + 1 > 6 THEN 3 ELSE 0 END) AS duration")


@query(
    "schedule_compression",
    f"""WITH a AS (WITH RECURSIVE {NETWORK} SELECT network, max(early_finish) AS before FROM cpm GROUP BY 1), b AS (WITH RECURSIVE {FAST} SELECT network, max(early_finish) AS after FROM cpm GROUP BY 1)
    SELECT network, before, after, before - after AS saved FROM a JOIN b USING (network)""",
)
def schedule_compression(t: Tables) -> DataFrame:
    """Activities of over six days take three days less."""
    acts, edges = networks(t)
    reduced = F.greatest(F.lit(1), F.col("duration") - F.when(F.col("duration") > 6, 3).otherwise(0))
    return registers.compressed(acts, edges, reduced)


@query(
    "float_summary",
    """WITH a AS (SELECT l_orderkey AS network, l_quantity - 1 AS total_float, l_shipdate::DATE AS start, l_shipdate::DATE + l_linenumber AS finish FROM lineitem), m AS (SELECT *, min(total_float) OVER (PARTITION BY network) AS low FROM a),
    c AS (SELECT *, CASE WHEN low <= 0.1 THEN total_float <= 0.1 ELSE total_float <= low + 0.1 END AS critical FROM m)
    SELECT network, count_if(critical) AS n_critical, date_diff('day', min(start) FILTER (critical), max(finish) FILTER (critical)) AS days, count_if(total_float > 0 AND total_float < 5) AS n_near, sum(total_float::DECIMAL(38,4))::DOUBLE / count(*) AS mean_float FROM c GROUP BY 1""",
)
def float_summary(t: Tables) -> DataFrame:
    """Given floats are trusted: critical is what has none, else what has the least."""
    given = t.lineitem.select(F.col("l_orderkey").alias("network"), (F.col("l_quantity") - 1).alias("total_float"), F.to_date("l_shipdate").alias("start"), F.date_add("l_shipdate", F.col("l_linenumber")).alias("finish"))
    low = F.min("total_float").over(Window.partitionBy("network"))
    marked = given.withColumn("low", low).withColumn("critical", F.col("total_float") <= F.when(F.col("low") <= 0.1, 0.1).otherwise(F.col("low") + 0.1))
    days = F.datediff(F.max(F.when(F.col("critical"), F.col("finish"))), F.min(F.when(F.col("critical"), F.col("start")))).cast("long")
    near = F.count_if((F.col("total_float") > 0) & (F.col("total_float") < 5))
    mean = F.sum(F.col("total_float").cast("decimal(38,4)")).cast("double") / F.count("*")
    return marked.groupBy("network").agg(F.count_if("critical").alias("n_critical"), days.alias("days"), near.alias("n_near"), mean.alias("mean_float"))


@query(
    "rate_card_first",
    f"""SELECT category, count(unit_cost) AS n, median(unit_cost) AS median, list_sort(list(unit_cost))[count(unit_cost) // 4 + 1] AS low_quarter, list_sort(list(unit_cost))[3 * count(unit_cost) // 4 + 1] AS high_quarter
    FROM {LINES} WHERE unit_cost IS NOT NULL GROUP BY 1 HAVING count(unit_cost) >= 2""",
)
def rate_card_first(t: Tables) -> DataFrame:
    """Quarters by place in the sorted rates, not interpolated."""
    from ..operators.boq import exact_quantiles

    rated = lines(t).where("unit_cost IS NOT NULL")
    cards = exact_quantiles(rated, ["category"], "unit_cost", {"median": 0.5}, least=2, places={"low_quarter": 0.25, "high_quarter": 0.75})
    return cards.select("category", "n", "median", "low_quarter", "high_quarter")


EQUIPMENT = ("chiller", "cable", "sprinkler", "truss", "windows", "pipe", "sanitary")
VERBS = r"(?i)\b(lay|laid|install|glazed|fittings|heads|and|in)\b"


@query(
    "long_lead_links",
    f"""SELECT e.name AS equipment, p_partkey FROM (SELECT unnest({LIST(EQUIPMENT)}) AS name) e JOIN {PARTS} p ON contains(lower(description), e.name) AND regexp_matches(description, '{VERBS}')""",
)
def long_lead_links(t: Tables) -> DataFrame:
    """Works that name long-lead equipment and something done to it; the list of equipment is short and goes to all tasks."""
    equipment = F.broadcast(t.part.sparkSession.createDataFrame([(e,) for e in EQUIPMENT], "equipment string"))
    works = parts(t).where(F.col("description").rlike(VERBS)).withColumn("low", F.lower("description"))
    return works.join(equipment, F.expr("contains(low, equipment)")).select("equipment", "p_partkey")


@query(
    "capable_suppliers",
    """WITH s AS (SELECT s_suppkey AS supplier, s_acctbal AS score, CASE s_suppkey % 4 WHEN 0 THEN [] WHEN 1 THEN ['STANDARD', 'SMALL'] WHEN 2 THEN ['LARGE', 'PROMO'] ELSE ['ECONOMY'] END AS can FROM supplier),
    i AS (SELECT p_partkey AS item, p_type AS material FROM part), r AS (SELECT item, supplier, row_number() OVER (PARTITION BY item ORDER BY score DESC, supplier) AS rank FROM i JOIN s ON len(can) = 0 OR list_contains(can, material))
    SELECT item, supplier, rank FROM r WHERE rank <= 3""",
)
def capable_suppliers(t: Tables) -> DataFrame:
    n = F.col("s_suppkey") % 4
    none = F.array().cast("array<string>")
    can = F.when(n == 0, none).when(n == 1, F.array(F.lit("STANDARD"), F.lit("SMALL"))).when(n == 2, F.array(F.lit("LARGE"), F.lit("PROMO"))).otherwise(F.array(F.lit("ECONOMY")))
    suppliers = t.supplier.select(F.col("s_suppkey").alias("supplier"), F.col("s_acctbal").alias("score"), can.alias("can"))
    return registers.capable(t.part.select(F.col("p_partkey").alias("item"), F.col("p_type").alias("material")), suppliers, 3)


@query(
    "photo_tiers",
    """WITH d AS (SELECT user_id AS photo, event_type AS class, max(value / 100) AS confidence FROM events WHERE value / 100 >= 0.05 GROUP BY ALL) SELECT *, CASE WHEN confidence >= 0.3 THEN 'detected' ELSE 'low' END AS tier FROM d""",
)
def photo_tiers(t: Tables) -> DataFrame:
    return registers.strongest(t.events.select(F.col("user_id").alias("photo"), F.col("event_type").alias("class"), (F.col("value") / 100).alias("confidence")))


@query(
    "rendered_notes",
    "SELECT o_orderkey, 'Order ' || o_orderkey || ' (' || o_orderpriority || '): status ' || o_orderstatus || ', ' || CASE WHEN o_orderstatus = 'F' THEN o_custkey::VARCHAR ELSE '' END || '.' AS note FROM orders",
)
def rendered_notes(t: Tables) -> DataFrame:
    """Templates with columns in them; the customer is known of finished orders only."""
    known = t.orders.withColumn("who", F.when(F.col("o_orderstatus") == "F", F.col("o_custkey")))
    return known.select("o_orderkey", registers.rendered("Order {o_orderkey} ({o_orderpriority}): status {o_orderstatus}, {who}.", ["o_orderkey", "o_orderpriority", "o_orderstatus", "who"]).alias("note"))


@query(
    "submittal_log",
    """SELECT l_orderkey, l_linenumber, l_partkey, 'SUB-' || lpad((row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey))::VARCHAR, 3, '0') AS number FROM lineitem""",
)
def submittal_log(t: Tables) -> DataFrame:
    return registers.numbered(t.lineitem, "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey"], "SUB").select("l_orderkey", "l_linenumber", "l_partkey", "number")


@query(
    "risk_register",
    """WITH r AS (SELECT l_orderkey AS project, l_linenumber, l_partkey, (l_discount * 10) * (l_quantity / 50) * 100 AS score FROM lineitem) SELECT project, l_linenumber, l_partkey, score, row_number() OVER (PARTITION BY project ORDER BY score DESC, l_linenumber, l_partkey) AS rank FROM r QUALIFY rank <= 5""",
)
def risk_register(t: Tables) -> DataFrame:
    """The five worst risks of each order: probability times impact."""
    score = (F.col("l_discount") * 10) * (F.col("l_quantity") / 50) * 100
    return ranking.top(t.lineitem.select(F.col("l_orderkey").alias("project"), "l_linenumber", "l_partkey", score.alias("score")), ["project"], [F.desc("score"), F.col("l_linenumber"), F.col("l_partkey")], 5)


@query(
    "value_engineering",
    """WITH a AS (SELECT l_orderkey AS project, l_extendedprice * (CASE p_type WHEN 'LARGE' THEN -0.1 WHEN 'PROMO' THEN 0.05 WHEN 'SMALL' THEN -0.02 ELSE 0 END) AS cost, l_quantity * (CASE p_type WHEN 'LARGE' THEN 0.2 WHEN 'PROMO' THEN -0.3 ELSE 0 END) AS carbon FROM lineitem JOIN part ON l_partkey = p_partkey),
    s AS (SELECT project, coalesce(sum(CASE WHEN cost < 0 THEN -cost::DECIMAL(38,6) END), 0)::DOUBLE AS aggressive, coalesce(sum(CASE WHEN carbon < 0 THEN -carbon::DECIMAL(38,6) END), 0)::DOUBLE AS carbon_saved FROM a GROUP BY 1)
    SELECT project, aggressive / 2 AS conservative, aggressive, carbon_saved FROM s""",
)
def value_engineering(t: Tables) -> DataFrame:
    share = lambda **of: F.coalesce(*(F.when(F.col("p_type") == k, v) for k, v in of.items()), F.lit(0.0))
    both = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    cost, carbon = F.col("l_extendedprice") * share(LARGE=-0.1, PROMO=0.05, SMALL=-0.02), F.col("l_quantity") * share(LARGE=0.2, PROMO=-0.3)
    changes = both.select(F.col("l_orderkey").alias("project"), cost.cast("decimal(38,6)").alias("cost"), carbon.cast("decimal(38,6)").alias("carbon"))
    return registers.scenarios(changes, "project")


FRAMES = ("Please {}", "{} now", "Tell me: {}")


@query(
    "augmented_texts",
    f"""WITH b AS (SELECT DISTINCT p_brand AS label, p_name AS text FROM part), c AS (SELECT label, count(*) AS n FROM b GROUP BY 1 HAVING count(*) < 40),
    m AS (SELECT b.label, n, b.text AS seed, k, replace({LIST(FRAMES)}[k + 1], '{{}}', b.text) AS text FROM b JOIN c ON b.label = c.label, (SELECT unnest([0, 1, 2]) AS k)),
    f AS (SELECT label, text, any_value(n) AS n, min((k, seed)) AS place FROM m GROUP BY ALL), p AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY place, text) AS p FROM f WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.label = f.label AND b.text = f.text))
    SELECT label, text, 0.3::DOUBLE AS weight FROM p WHERE p <= 40 - n""",
)
def augmented_texts(t: Tables) -> DataFrame:
    """Names of parts as texts, their brands as labels: phrases around them until a brand has forty."""
    rows = t.part.select(F.col("p_brand").alias("label"), F.col("p_name").alias("text")).distinct()
    return registers.augmented(rows, "label", "text", list(FRAMES), 40)


@query(
    "five_stage_validation",
    """SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_quantity IS NULL OR l_quantity < 0 THEN 'syntactic' WHEN p_size <= 2 THEN 'dimensional' WHEN l_extendedprice / nullif(l_quantity, 0) > 4000 THEN 'physical'
    WHEN l_extendedprice / nullif(l_quantity, 0) > 2 * p_retailprice OR l_extendedprice / nullif(l_quantity, 0) < p_retailprice / 2 THEN 'empirical' WHEN l_discount > 0.08 THEN 'operational' END AS failed FROM lineitem JOIN part ON l_partkey = p_partkey""",
)
def five_stage_validation(t: Tables) -> DataFrame:
    """The first stage that a line fails; the empirical one allows a factor of two."""
    rate = F.try_divide("l_extendedprice", "l_quantity")
    stages = {
        "syntactic": F.col("l_quantity").isNotNull() & (F.col("l_quantity") >= 0),
        "dimensional": F.col("p_size") > 2,
        "physical": rate <= 4000,
        "empirical": rate.between(F.col("p_retailprice") / 2, F.col("p_retailprice") * 2),
        "operational": F.col("l_discount") <= 0.08,
    }
    both = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    return both.select("l_orderkey", "l_linenumber", "l_partkey", registers.first_failure(stages).alias("failed"))


@query(
    "esg_scores",
    """WITH s AS (SELECT s_nationkey AS company, sum(s_acctbal::DECIMAL(38,4))::DOUBLE / count(*) AS m, count(*) AS n FROM supplier GROUP BY 1)
    SELECT company, CASE WHEN m >= 6000 THEN 90 WHEN m >= 4000 THEN 70 ELSE 40 END AS environmental, CASE WHEN n >= 5 THEN 80 WHEN n >= 3 THEN 60 ELSE 30 END AS social,
    CASE WHEN (CASE WHEN m >= 6000 THEN 90 WHEN m >= 4000 THEN 70 ELSE 40 END + CASE WHEN n >= 5 THEN 80 WHEN n >= 3 THEN 60 ELSE 30 END) / 2.0 >= 70 THEN 'eligible' ELSE 'not eligible' END AS certificate FROM s""",
)
def esg_scores(t: Tables) -> DataFrame:
    stats = t.supplier.groupBy(F.col("s_nationkey").alias("company")).agg((F.sum(F.col("s_acctbal").cast("decimal(38,4)")).cast("double") / F.count("*")).alias("m"), F.count("*").alias("n"))
    scored = stats.select("company", F.when(F.col("m") >= 6000, 90).when(F.col("m") >= 4000, 70).otherwise(40).alias("environmental"), F.when(F.col("n") >= 5, 80).when(F.col("n") >= 3, 60).otherwise(30).alias("social"))
    return scored.withColumn("certificate", F.when((F.col("environmental") + F.col("social")) / 2 >= 70, "eligible").otherwise("not eligible"))


@query(
    "catalog_groups",
    rf"""WITH k AS (SELECT * FROM (VALUES ('ring', 'rings', 2), ('small ring', 'rings', 6), ('widget', 'widgets', 2), ('red widget', 'widgets', 6), ('bolt', 'bolts', 2), ('gear', 'gears', 2), ('gizmo', 'gizmos', 2)) v(word, grp, weight)),
    s AS (SELECT p_partkey, grp, sum(weight)::BIGINT AS score FROM part JOIN k ON contains(lower(p_name), word) GROUP BY ALL) SELECT p_partkey, grp, score, CASE WHEN score >= 6 THEN 'high' WHEN score >= 2 THEN 'medium' ELSE 'low' END AS confidence FROM s QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY score DESC, grp) = 1""",
)
def catalog_groups(t: Tables) -> DataFrame:
    """The group whose keywords score most in a name; phrases weigh more than words."""
    words = [("ring", "rings", 2), ("small ring", "rings", 6), ("widget", "widgets", 2), ("red widget", "widgets", 6), ("bolt", "bolts", 2), ("gear", "gears", 2), ("gizmo", "gizmos", 2)]
    low = F.lower("p_name")
    groups = sorted({g for _, g, _ in words})
    scores = [F.struct(sum((F.when(low.contains(w), weight).otherwise(0) for w, g, weight in words if g == group), F.lit(0)).cast("long").alias("score"), F.lit(-i).alias("i"), F.lit(group).alias("grp")) for i, group in enumerate(groups)]
    best = t.part.select("p_partkey", F.greatest(*scores).alias("b")).where("b.score > 0")
    return best.select("p_partkey", "b.grp", "b.score", F.when(F.col("b.score") >= 6, "high").when(F.col("b.score") >= 2, "medium").otherwise("low").alias("confidence"))
