"""Work lines: trades, units, programmes, purchases, cash and claims. An order is a bill; its lines are works named by their parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import parsing, works
from ..operators import works as ops
from ..operators.schedule import cut
from ..registry import Tables, query

MONEY = "decimal(38,4)"
#: What parts stand for, by key.
WORKS = (
    "Bulk excavation to reduced level", "Reinforced concrete C40 to raft foundation", "Reinforced concrete C40 to columns", "High yield rebar to slabs", "Formwork to soffit of slab",
    "Blockwork 200mm to walls", "Plaster render to blockwork walls", "Waterproofing membrane to wet area floors", "Tanking to retaining walls, waterproofing", "UPVC pipe DN150 laid in trench",
    "Asphalt wearing course", "Aluminium windows double glazed", "LV cable in containment", "Chiller and AHU", "Sprinkler heads", "Sanitary fittings to toilets", "Topsoil and shrub planting",
    "Preliminaries and insurance", "Demolition of existing wall", "Structural steel truss", "Bored piling 600mm", "Blinding layer 50mm lean concrete", "Site sundries", "Painting to ceiling",
)
UNITS = ("m3", "Sq.m", "cum", "nos", "L.M", "tonne", "", "LS", "m²", "no.")
PICK = lambda table, key: F.element_at(F.array(*map(F.lit, table)), (F.col(key) % len(table) + 1).cast("int"))
LIST = lambda table: "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in table) + "]"

PARTS = f"(SELECT p_partkey, {LIST(WORKS)}[(p_partkey % {len(WORKS)})::INTEGER + 1] || ' ' || p_name AS description, {LIST(UNITS)}[p_size % {len(UNITS)} + 1] AS unit FROM part)"


def parts(t: Tables) -> DataFrame:
    """Parts with the works they stand for, dealt out to all tasks: the table is one small file, and its texts meet many patterns."""
    dealt = t.part.select("p_partkey", "p_name", "p_size").repartition(int(t.spark.conf.get("spark.sql.shuffle.partitions")), "p_partkey")
    return dealt.select("p_partkey", F.concat_ws(" ", PICK(WORKS, "p_partkey"), "p_name").alias("description"), PICK(UNITS, "p_size").alias("unit"))


def category_sql(x: str) -> str:
    """The category of ``x`` without look-ahead, which DuckDB lacks: what it would leave out is written in capitals first."""
    masked = rf"regexp_replace(regexp_replace(lower({x}), 'concrete(\s*block)', 'CONCRETE\1', 'g'), 'reinforc(ed\s+concrete)', 'REINFORC\1', 'g')"
    at = []
    for p in works.CATEGORIES.values():
        p = p.replace(r"(?!\s*block)", "").replace(r"(?!ed\s+concrete)", "")
        at.append(f"CASE WHEN regexp_matches({masked}, '{p}') THEN length(regexp_extract({masked}, '(?s)^(.*?)(?:{p})', 1)) ELSE 1000000 END")
    names = LIST([*works.CATEGORIES, works.OTHER])
    return f"{names}[list_position([{', '.join(at)}, 999999], list_min([{', '.join(at)}, 999999]))]"


CATEGORY = f"(SELECT *, {category_sql('description')} AS category FROM {PARTS})"
STAGE = f"""CASE WHEN category IN ('Piling/Foundations', 'Earthworks/Excavation', 'Demolition') THEN 'substructure' WHEN category IN ('Concrete', 'Reinforcement', 'Formwork', 'Waterproofing/Insulation', 'Masonry/Blockwork')
AND regexp_matches(description, '{works.SUBSTRUCTURE}') THEN 'substructure' ELSE 'superstructure' END"""
RANK = f"""CASE WHEN regexp_matches(description, '{works.ENABLING}') THEN 3.5 WHEN stage = 'substructure' AND category = 'Waterproofing/Insulation' AND regexp_matches(description, '{works.AFTER_POUR}') THEN 6.5
WHEN stage = 'substructure' AND category = 'Waterproofing/Insulation' THEN 3.7 ELSE list_position({LIST(works.SEQUENCE)}, category) - 1 END"""


@query("work_categories", f"SELECT p_partkey, description, category FROM {CATEGORY}")
def work_categories(t: Tables) -> DataFrame:
    return parts(t).select("p_partkey", "description", works.category(F.col("description")).alias("category"))


@query("work_stages", f"SELECT p_partkey, category, stage, ({RANK})::DOUBLE AS place FROM (SELECT *, {STAGE} AS stage FROM {CATEGORY})")
def work_stages(t: Tables) -> DataFrame:
    placed = work_categories(t)
    return placed.select("p_partkey", "category", works.stage(F.col("description"), F.col("category")).alias("stage"), works.site_rank(F.col("description"), F.col("category")).alias("place"))


EXPECTED = "CASE " + " ".join(f"WHEN regexp_matches(description, '(?i){p}') THEN '{u}'" for u, p in works.UNIT_RULES) + " END"
BARE = "replace(translate(lower(trim(unit)), '²³', '23'), ' ', '')"
MAPPED = lambda table: f"coalesce(map({LIST(table)}, {LIST(table.values())})[{BARE}], {BARE})"


@query(
    "work_units",
    f"""WITH x AS (SELECT *, {EXPECTED} AS e, trim(unit) AS u, {MAPPED(works.MEASURED)} AS m, coalesce(nullif({MAPPED(parsing.UNITS)}, ''), '?') AS card_unit FROM {PARTS})
    SELECT p_partkey, card_unit, CASE WHEN u = '' THEN coalesce(e, '') ELSE u END AS unit, CASE WHEN u = '' AND e IS NOT NULL THEN 'inferred' ELSE 'parsed' END AS source,
    u <> '' AND coalesce(m <> e, false) AS suspect, CASE WHEN u <> '' AND m <> e THEN e END AS expected FROM x""",
)
def work_units(t: Tables) -> DataFrame:
    made = parts(t).select("p_partkey", parsing.unit(F.col("unit")).alias("card_unit"), works.reconciled_unit(F.col("unit"), F.col("description")).alias("r"))
    return made.select("p_partkey", "card_unit", "r.*")


NORMS = {c: 0.25 * (i + 1) for i, c in enumerate(works.SEQUENCE)}
LINES = f"(SELECT l_orderkey AS bill, l_linenumber AS line, p_partkey, description, unit, l_quantity AS quantity, category FROM lineitem JOIN {CATEGORY} ON l_partkey = p_partkey)"


def bill_lines(t: Tables) -> DataFrame:
    """Lines of bills; a line number that repeats in an order is told apart by its part."""
    both = t.lineitem.join(parts(t), F.col("l_partkey") == F.col("p_partkey"))
    return both.select(F.col("l_orderkey").alias("bill"), F.struct(F.col("l_linenumber").cast("long").alias("n"), "p_partkey").alias("line"), "description", "unit", F.col("l_quantity").cast(MONEY).alias("quantity"))


PROGRAMME = f"""m AS (SELECT bill, lower(description) AS work, arg_min(description, (line, p_partkey)) AS description, min((line, p_partkey)) AS first, sum(quantity::DECIMAL(38,4)) AS quantity, count(*) AS n_lines,
  any_value(category) AS category FROM {LINES} GROUP BY bill, lower(description) HAVING sum(quantity) > 0),
s AS (SELECT *, {STAGE} AS stage FROM m), r AS (SELECT *, ({RANK})::DOUBLE AS place FROM s),
a AS (SELECT *, (dense_rank() OVER (PARTITION BY bill ORDER BY stage, place, category))::VARCHAR || '.' || (row_number() OVER (PARTITION BY bill, stage, place, category ORDER BY first))::VARCHAR AS activity,
  (quantity::DOUBLE * map({LIST(NORMS)}, [{", ".join(map(str, NORMS.values()))}]::DOUBLE[])[category]) AS manhours FROM r)"""


@query(
    "boq_programme",
    f"""WITH {PROGRAMME} SELECT bill, activity, description AS name, category, stage, quantity::DOUBLE AS quantity, n_lines, manhours, greatest(1, ceil(manhours / 32))::BIGINT AS days,
    lag(activity) OVER (PARTITION BY bill ORDER BY stage, place, category, first) AS predecessor FROM a""",
)
def boq_programme(t: Tables) -> DataFrame:
    return ops.programme(bill_lines(t), NORMS).withColumn("quantity", F.col("quantity").cast("double"))


@query("programme_manhours", f"WITH {PROGRAMME} SELECT bill, round(sum(manhours::DECIMAL(38,6)), 1)::DOUBLE AS manhours, count(*) AS n FROM a GROUP BY 1")
def programme_manhours(t: Tables) -> DataFrame:
    acts = ops.programme(bill_lines(t), NORMS)
    return acts.groupBy("bill").agg(F.round(F.sum(F.col("manhours").cast("decimal(38,6)")), 1).cast("double").alias("manhours"), F.count("*").alias("n"))


GIVEN = {c: NORMS[c] for c in ("Concrete", "Earthworks/Excavation", "Masonry/Blockwork", "Finishes", "Formwork")}


@query("missing_norms", f"SELECT category, min(unit) AS unit, count(*) AS n FROM {LINES} WHERE quantity > 0 AND category NOT IN ('Concrete', 'Earthworks/Excavation', 'Masonry/Blockwork', 'Finishes', 'Formwork') GROUP BY 1")
def missing_norms(t: Tables) -> DataFrame:
    return ops.missing_norms(bill_lines(t), GIVEN)


GOODS_SQL = lambda i: "CASE " + " ".join(f"WHEN regexp_matches(lower(description), '{row[0]}') THEN {row[i]!r}" for row in works.GOODS) + f" ELSE {works.REST_OF_GOODS[i - 1]!r} END"


@query(
    "procurement_list",
    f"""WITH g AS (SELECT l_orderkey AS bill, l_linenumber AS line, l_partkey AS item, {GOODS_SQL(1)} AS category, {GOODS_SQL(2)} AS lead_weeks, {GOODS_SQL(3)} AS supplier, l_shipdate FROM lineitem JOIN {PARTS} ON l_partkey = p_partkey)
    SELECT bill, line, item, category, lead_weeks, supplier, CASE WHEN lead_weeks >= 12 THEN 'critical' WHEN lead_weeks >= 6 THEN 'high' ELSE 'normal' END AS priority, (l_shipdate::DATE - lead_weeks * 7)::DATE AS order_by FROM g""",
)
def procurement_list(t: Tables) -> DataFrame:
    named = parts(t).select("p_partkey", works.goods(F.col("description")).alias("g"))
    both = t.lineitem.join(named, F.col("l_partkey") == F.col("p_partkey"))
    weeks = F.col("g.lead_weeks")
    priority = F.when(weeks >= 12, "critical").when(weeks >= 6, "high").otherwise("normal")
    return both.select(F.col("l_orderkey").alias("bill"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("item"), "g.category", "g.lead_weeks", "g.supplier", priority.alias("priority"), F.date_sub("l_shipdate", weeks * 7).alias("order_by"))


@query(
    "procurement_groups",
    f"SELECT {GOODS_SQL(1)} AS category, count(*) AS n_items, round(sum(l_extendedprice::DECIMAL(38,4)), 2)::DOUBLE AS total FROM lineitem JOIN {PARTS} ON l_partkey = p_partkey GROUP BY 1",
)
def procurement_groups(t: Tables) -> DataFrame:
    named = parts(t).select("p_partkey", works.goods(F.col("description"))["category"].alias("category"))
    both = t.lineitem.join(named, F.col("l_partkey") == F.col("p_partkey"))
    return both.groupBy("category").agg(F.count("*").alias("n_items"), F.round(F.sum(F.col("l_extendedprice").cast(MONEY)), 2).cast("double").alias("total"))


@query(
    "unit_class_rates",
    f"""WITH u AS (SELECT p_partkey, category, {MAPPED(parsing.UNITS)} AS unit FROM {CATEGORY}), c AS (SELECT *, map({LIST(works.UNIT_CLASSES)}, {LIST(works.UNIT_CLASSES.values())})[unit] AS class FROM u),
    r AS (SELECT category, class, count(*) AS n, median(l_extendedprice / nullif(l_quantity, 0)) AS rate FROM lineitem JOIN c ON l_partkey = p_partkey GROUP BY ALL) SELECT * FROM r""",
)
def unit_class_rates(t: Tables) -> DataFrame:
    """Median rate of each category and class of unit: a rate a metre never prices a lump sum."""
    classed = cut(parts(t).select("p_partkey", works.category(F.col("description")).alias("category"), works.unit_class(parsing.unit(F.col("unit"))).alias("class")))  # read by both passes
    from ..operators.boq import exact_quantiles

    rates = t.lineitem.join(classed, F.col("l_partkey") == F.col("p_partkey")).withColumn("rate", F.try_divide("l_extendedprice", "l_quantity"))
    return exact_quantiles(rates, ["category", "class"], "rate", {"rate": 0.5}, count="*")


@query(
    "cash_flow_curve",
    """WITH c AS (SELECT o_orderkey AS contract, o_totalprice AS amount, (o_orderkey % 18 + 3)::INTEGER AS months FROM orders), m AS (SELECT *, unnest(range(1, months + 1))::INTEGER AS month FROM c),
    p AS (SELECT *, month::DOUBLE / months AS t, (month - 1)::DOUBLE / months AS s, greatest(1, floor(months * 0.8))::INTEGER AS w FROM m),
    q AS (SELECT *, CASE WHEN t <= 0.25 THEN t * 0.8 WHEN t <= 0.5 THEN 0.2 + (t - 0.25) * 1.2 WHEN t <= 0.75 THEN 0.5 + (t - 0.5) * 1.2 ELSE least(0.95, 0.8 + (t - 0.75) * 0.6) END AS progress FROM p),
    b AS (SELECT *, coalesce(lag(progress) OVER (PARTITION BY contract ORDER BY month), 0) AS before FROM q),
    v AS (SELECT *, (progress - before) * amount AS value, CASE WHEN month <= w THEN amount * 0.1 / w ELSE 0 END AS recovery, CASE WHEN progress >= 0.95 AND before < 0.95 THEN progress * amount * 0.1 ELSE 0 END AS released FROM b)
    SELECT contract, month, progress, value, recovery, value * 0.1 AS held, released, value * 0.9 + CASE WHEN month = 1 THEN amount * 0.1 ELSE 0 END - recovery + released AS cash FROM v""",
)
def cash_flow_curve(t: Tables) -> DataFrame:
    contracts = t.orders.select(F.col("o_orderkey").alias("contract"), F.col("o_totalprice").alias("amount"), (F.col("o_orderkey") % 18 + 3).cast("int").alias("months"))
    return ops.cash_flow(contracts)


@query(
    "prolongation_claims",
    """WITH e AS (SELECT o_custkey AS claim, (o_orderkey % 30)::BIGINT AS days, CASE WHEN o_custkey % 3 = 0 THEN o_totalprice::DECIMAL(38,4) END AS cost FROM orders),
    s AS (SELECT claim, sum(days)::BIGINT AS days, sum(cost) AS given FROM e GROUP BY 1), x AS (SELECT *, coalesce(given::DOUBLE, days * 1234.5) AS total FROM s)
    SELECT claim, days, CASE WHEN given IS NULL THEN 'daily_rate' ELSE 'event_sum' END AS mode, total, total * 0.30 AS site_staff, total * 0.20 AS site_accommodation,
    total * 0.25 AS plant_standing, total * 0.10 AS insurances_bonds, total * 0.15 AS overheads_profit FROM x""",
)
def prolongation_claims(t: Tables) -> DataFrame:
    cost = F.when(F.col("o_custkey") % 3 == 0, F.col("o_totalprice").cast(MONEY))
    events = t.orders.select(F.col("o_custkey").alias("claim"), (F.col("o_orderkey") % 30).alias("days"), cost.alias("cost"))
    sums = events.groupBy("claim").agg(F.sum("days").alias("days"), F.sum("cost").cast("double").alias("cost"))
    return ops.prolongation(sums, 1234.5)


@query(
    "variation_prices",
    """SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_returnflag = 'R' THEN 'omission' ELSE 'addition' END AS kind,
    CASE WHEN l_returnflag = 'R' THEN l_extendedprice - l_extendedprice * 0.18 ELSE l_extendedprice * 1.15 + l_extendedprice * 1.15 * 0.18 END AS price FROM lineitem""",
)
def variation_prices(t: Tables) -> DataFrame:
    kind = F.when(F.col("l_returnflag") == "R", "omission").otherwise("addition")
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", kind.alias("kind"), ops.variation_price(F.col("l_extendedprice"), kind).alias("price"))


REQUESTS = ("Add extra work to new work area", "Delete and remove fence", "Redesign with substitution", "Unforeseen ground condition, latent rock", "Delay and acceleration", "Minor matter", "extra additional rooms, delete one")


@query(
    "change_orders",
    f"""WITH r AS (SELECT o_orderkey, {LIST(REQUESTS)}[(o_orderkey % 7)::INTEGER + 1] || ' ' || repeat(o_orderpriority, (o_orderkey % 60)::INTEGER) AS text, o_totalprice AS direct FROM orders), l AS (SELECT *, lower(text) AS low FROM r),
    n AS (SELECT *, [{", ".join("(" + " + ".join(f"contains(low, '{w}')::INTEGER" for w in words) + ")" for words in ops.CHANGES.values())}] AS hits FROM l),
    k AS (SELECT *, CASE WHEN list_max(hits) > 0 THEN {LIST(ops.CHANGES)}[list_position(hits, list_max(hits))] ELSE 'general' END AS kind FROM n)
    SELECT o_orderkey, kind, direct * (1.2 + CASE WHEN kind = 'scope_addition' THEN 0.1 ELSE 0 END + CASE WHEN length(text) > 500 THEN 0.2 WHEN length(text) > 200 THEN 0.1 ELSE 0.05 END) AS total FROM k""",
)
def change_orders(t: Tables) -> DataFrame:
    text = F.concat_ws(" ", PICK(REQUESTS, "o_orderkey"), F.repeat("o_orderpriority", (F.col("o_orderkey") % 60).cast("int")))
    kinds = t.orders.select("o_orderkey", "o_totalprice", text.alias("text")).withColumn("kind", ops.change_kind(F.col("text")))
    return kinds.select("o_orderkey", "kind", ops.change_impact(F.col("o_totalprice"), F.col("kind"), F.col("text")).alias("total"))


WEIGHTS = {"price": 0.30, "schedule": 0.20, "experience": 0.15, "financial": 0.15, "safety": 0.10, "quality": 0.10}


@query(
    "tender_scores",
    """WITH b AS (SELECT s_nationkey AS tender, s_suppkey AS bidder, s_acctbal AS price, (s_suppkey % 90 + 30)::DOUBLE AS days, (s_suppkey % 61 + 40)::DOUBLE AS experience, (s_suppkey % 57 + 44)::DOUBLE AS financial,
      (s_suppkey % 47 + 54)::DOUBLE AS safety, (s_suppkey % 31 + 70)::DOUBLE AS quality FROM supplier),
    g AS (SELECT tender, min(price) AS lp, sum(price::DECIMAL(38,4))::DOUBLE / count(*) AS mp, min(days) AS ld, sum(days) / count(*) AS md FROM b GROUP BY 1),
    s AS (SELECT b.*, CASE WHEN price <= 0 THEN 50 WHEN price = lp THEN 100 WHEN price <= mp THEN 80 WHEN price <= mp * 1.1 THEN 60 ELSE 40 END AS ps,
      CASE WHEN days <= 0 THEN 50 WHEN days = ld THEN 100 WHEN days <= md THEN 80 WHEN days <= md * 1.1 THEN 60 ELSE 40 END AS ss, (financial < 60)::INTEGER + (safety < 70)::INTEGER + (experience < 50)::INTEGER AS faults FROM b JOIN g USING (tender)),
    t AS (SELECT tender, bidder, ps::INTEGER AS price_score, ss::INTEGER AS schedule_score, round(ps * 0.3::DOUBLE + ss * 0.2::DOUBLE + experience * 0.15::DOUBLE + financial * 0.15::DOUBLE + safety * 0.1::DOUBLE + quality * 0.1::DOUBLE, 2) AS score,
      CASE WHEN faults >= 2 THEN 'high' WHEN faults = 1 THEN 'medium' ELSE 'low' END AS risk FROM s)
    SELECT *, row_number() OVER (PARTITION BY tender ORDER BY score DESC, bidder) AS rank FROM t QUALIFY rank <= 3""",
)
def tender_scores(t: Tables) -> DataFrame:
    """The three best bids of each tender; later ones are dropped before the shuffle."""
    mark = lambda size, least, name: (F.col("s_suppkey") % size + least).cast("double").alias(name)
    bids = t.supplier.select(F.col("s_nationkey").alias("tender"), F.col("s_suppkey").alias("bidder"), F.col("s_acctbal").cast(MONEY).alias("price"), mark(90, 30, "days"), mark(61, 40, "experience"), mark(57, 44, "financial"), mark(47, 54, "safety"), mark(31, 70, "quality"))
    from ..operators.ranking import top

    return top(ops.weighted_tender(bids, WEIGHTS), ["tender"], [F.desc("score"), F.col("bidder")], 3)


@query(
    "measured_quantities",
    """WITH m AS (SELECT l_orderkey AS project, CASE l_linenumber % 4 WHEN 0 THEN 'area' WHEN 1 THEN 'floor_area' WHEN 2 THEN 'count' ELSE CASE WHEN l_orderkey % 2 = 0 THEN 'volume' ELSE 'dimension' END END AS kind, l_quantity AS value FROM lineitem),
    s AS (SELECT project, least(coalesce(sum(CASE WHEN kind IN ('area', 'floor_area') THEN value END), 0), 500000) AS floor_area, coalesce(sum(CASE WHEN kind = 'volume' THEN value END), 0) AS v FROM m GROUP BY 1),
    c AS (SELECT project, floor_area, least(CASE WHEN v > 0 THEN v ELSE floor_area * 0.15 END, 750000) AS concrete FROM s)
    SELECT project, floor_area, concrete, concrete * 120 AS steel, concrete * 250 AS concrete_co2, concrete * 120 * 2.3 AS steel_co2 FROM c""",
)
def measured_quantities(t: Tables) -> DataFrame:
    n = F.col("l_linenumber") % 4
    kind = F.when(n == 0, "area").when(n == 1, "floor_area").when(n == 2, "count").when(F.col("l_orderkey") % 2 == 0, "volume").otherwise("dimension")
    return ops.measured_quantities(t.lineitem.select(F.col("l_orderkey").alias("project"), kind.alias("kind"), F.col("l_quantity").alias("value")))


@query(
    "delay_methods",
    """WITH e AS (SELECT l_orderkey AS network, greatest(0, date_diff('day', o_orderdate::DATE, l_shipdate::DATE) - 60) AS days, l_linenumber <= 2 AS critical FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
    SELECT network, count(*) FILTER (days > 0) AS n_events, coalesce(sum(days) FILTER (critical), 0)::BIGINT AS added, (60 + coalesce(sum(days) FILTER (critical), 0))::BIGINT AS predicted,
    (60 + coalesce(max(days), 0))::BIGINT AS as_built, (coalesce(sum(days) FILTER (critical), 0) - coalesce(max(days), 0))::BIGINT AS bias, (60 + coalesce(max(days), 0) - coalesce(sum(days) FILTER (critical), 0))::BIGINT AS collapsed FROM e GROUP BY 1""",
)
def delay_methods(t: Tables) -> DataFrame:
    """Of each order as a network planned for 60 days: delay added to the plan by events on its critical lines (impacted as planned), and the built time without them (collapsed as built)."""
    both = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    days = F.greatest(F.lit(0), F.datediff("l_shipdate", "o_orderdate") - 60)
    events = both.select(F.col("l_orderkey").alias("network"), days.alias("days"), (F.col("l_linenumber") <= 2).alias("critical"))
    added, longest = F.coalesce(F.sum(F.when(F.col("critical"), F.col("days"))), F.lit(0)), F.max("days")
    return events.groupBy("network").agg(
        F.count_if(F.col("days") > 0).alias("n_events"), added.alias("added"), (60 + added).alias("predicted"), (60 + longest).cast("long").alias("as_built"), (added - longest).alias("bias"), (60 + longest - added).alias("collapsed")
    )


@query(
    "baseline_slips",
    """WITH b AS (SELECT o_orderkey AS id, o_orderdate::DATE AS planned FROM orders WHERE o_orderstatus <> 'P'), c AS (SELECT l_orderkey AS id, min(l_shipdate)::DATE AS started, max(l_shipdate)::DATE AS finished FROM lineitem GROUP BY 1)
    SELECT coalesce(b.id, c.id) AS id, CASE WHEN b.id IS NULL THEN 'new' WHEN c.id IS NULL THEN 'deleted' ELSE 'both' END AS side, date_diff('day', planned, started) AS start_slip, date_diff('day', planned, finished) AS finish_slip
    FROM b FULL JOIN c ON b.id = c.id""",
)
def baseline_slips(t: Tables) -> DataFrame:
    """Orders not in progress as the baseline, shipped lines as what became of it."""
    base = t.orders.where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("b"), "o_orderdate")
    now = t.lineitem.groupBy(F.col("l_orderkey").alias("c")).agg(F.min("l_shipdate").alias("started"), F.max("l_shipdate").alias("finished"))
    both = base.join(now, F.col("b") == F.col("c"), "full")
    side = F.when(F.col("b").isNull(), "new").when(F.col("c").isNull(), "deleted").otherwise("both")
    slip = lambda c: F.datediff(c, "o_orderdate").cast("long")
    return both.select(F.coalesce("b", "c").alias("id"), side.alias("side"), slip("started").alias("start_slip"), slip("finished").alias("finish_slip"))


@query(
    "critical_set_change",
    """WITH b AS (SELECT DISTINCT l_orderkey AS id FROM lineitem WHERE l_linenumber = 1), u AS (SELECT DISTINCT l_orderkey AS id FROM lineitem WHERE l_quantity > 40)
    SELECT id, 'entered' AS change FROM (SELECT id FROM u EXCEPT SELECT id FROM b) UNION ALL SELECT id, 'left' FROM (SELECT id FROM b EXCEPT SELECT id FROM u) UNION ALL SELECT id, 'stayed' FROM (SELECT id FROM b INTERSECT SELECT id FROM u)""",
)
def critical_set_change(t: Tables) -> DataFrame:
    """Orders that are critical by their first line before, and by a large quantity now: both sets in one pass."""
    flags = t.lineitem.groupBy(F.col("l_orderkey").alias("id")).agg(F.bool_or(F.col("l_linenumber") == 1).alias("was"), F.bool_or(F.col("l_quantity") > 40).alias("is"))
    change = F.when(F.col("was") & F.col("is"), "stayed").when(F.col("is"), "entered").when(F.col("was"), "left")
    return flags.select("id", change.alias("change")).where("change IS NOT NULL")


@query(
    "price_z_scores",
    """WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, p_brand, l_extendedprice / l_quantity AS rate FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_quantity <> 0),
    g AS (SELECT p_brand, sum(rate::DECIMAL(38,8))::DOUBLE / count(*) AS mean, count(*) AS n, sum((rate * rate)::DECIMAL(38,8))::DOUBLE AS sq FROM r GROUP BY 1)
    SELECT l_orderkey, l_linenumber, l_partkey, (rate - mean) * 100 / mean AS variance_pct, (rate - mean) / sqrt(sq / n - mean * mean) AS z FROM r JOIN g USING (p_brand)""",
)
def price_z_scores(t: Tables) -> DataFrame:
    rates = t.lineitem.where("l_quantity <> 0").join(t.part, F.col("l_partkey") == F.col("p_partkey")).withColumn("rate", F.col("l_extendedprice") / F.col("l_quantity"))
    exact = lambda c: F.sum(c.cast("decimal(38,8)")).cast("double")
    stats = rates.groupBy("p_brand").agg((exact(F.col("rate")) / F.count("*")).alias("mean"), (exact(F.col("rate") * F.col("rate")) / F.count("*")).alias("square"))
    spread = F.sqrt(F.col("square") - F.col("mean") * F.col("mean"))
    both = rates.join(stats, "p_brand")
    return both.select("l_orderkey", "l_linenumber", "l_partkey", ((F.col("rate") - F.col("mean")) * 100 / F.col("mean")).alias("variance_pct"), ((F.col("rate") - F.col("mean")) / spread).alias("z"))


@query(
    "progress_status",
    """WITH x AS (SELECT o_orderkey, o_totalprice AS bac, (o_orderkey % 101)::DOUBLE AS planned, (o_orderkey * 7 % 101)::DOUBLE AS actual, o_totalprice * (o_orderkey % 37) / 40 AS cost FROM orders),
    y AS (SELECT *, bac * actual / 100 AS ev, bac * planned / 100 AS pv FROM x)
    SELECT o_orderkey, actual - planned AS variance, ev / nullif(pv, 0) AS spi, ev / nullif(cost, 0) AS cpi,
    CASE WHEN actual - planned >= 0 THEN 'on track' WHEN actual - planned >= -5 THEN 'slightly behind' WHEN actual - planned >= -15 THEN 'behind' ELSE 'critical' END AS status FROM y""",
)
def progress_status(t: Tables) -> DataFrame:
    planned, actual, bac = (F.col("o_orderkey") % 101).cast("double"), (F.col("o_orderkey") * 7 % 101).cast("double"), F.col("o_totalprice")
    gap, value = actual - planned, bac * actual / 100
    status = F.when(gap >= 0, "on track").when(gap >= -5, "slightly behind").when(gap >= -15, "behind").otherwise("critical")
    return t.orders.select("o_orderkey", gap.alias("variance"), F.try_divide(value, bac * planned / 100).alias("spi"), F.try_divide(value, bac * (F.col("o_orderkey") % 37) / 40).alias("cpi"), status.alias("status"))


@query(
    "concurrent_days",
    """WITH e AS (SELECT o_orderkey, o_custkey, unnest(range(0, (o_orderkey % 9 + 1)::BIGINT)) AS k, o_orderdate::DATE AS d FROM orders), x AS (SELECT o_custkey, (d + k::INTEGER)::DATE AS day, count(*) AS n FROM e GROUP BY ALL)
    SELECT o_custkey AS project, count(*) AS days, count(*) FILTER (n > 1) AS concurrent, max(n) AS most FROM x GROUP BY 1""",
)
def concurrent_days(t: Tables) -> DataFrame:
    """Days that a customer's orders cover, each as an event of some days, and those that several cover."""
    last = F.date_add("o_orderdate", (F.col("o_orderkey") % 9).cast("int"))
    days = t.orders.select("o_custkey", F.explode(F.sequence(F.to_date("o_orderdate"), last)).alias("day")).groupBy("o_custkey", "day").agg(F.count("*").alias("n"))
    return days.groupBy(F.col("o_custkey").alias("project")).agg(F.count("*").alias("days"), F.count_if(F.col("n") > 1).alias("concurrent"), F.max("n").alias("most"))
