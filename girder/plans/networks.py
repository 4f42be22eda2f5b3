"""Order of activities, impact of events and generated work breakdowns. An order is a network, its lines are activities; the parts of a brand are a template."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import networks as net
from ..registry import Tables, query
from .schedule import networks


@query(
    "topological_order",
    """WITH RECURSIVE acts AS (SELECT DISTINCT l_orderkey AS network, l_linenumber AS activity FROM lineitem),
    links AS (SELECT network, activity - k AS pred, activity AS succ FROM acts, (VALUES (1), (3)) AS v(k) UNION ALL SELECT network, 2, 1 FROM acts WHERE activity = 1 AND network % 11 = 0),
    arcs AS (SELECT links.* FROM links JOIN acts ON links.network = acts.network AND pred = activity),
    ahead AS (SELECT network, activity, 0 AS depth FROM acts UNION SELECT a.network, succ, depth + 1 FROM ahead a JOIN arcs r ON a.network = r.network AND activity = pred WHERE depth < 8),
    levels AS (SELECT network, activity, max(depth) AS level FROM ahead GROUP BY 1, 2), blocked AS (SELECT network, activity FROM levels WHERE level = 8),
    back AS (SELECT network, activity, 0 AS depth FROM blocked UNION SELECT b.network, pred, depth + 1 FROM back b JOIN arcs r ON b.network = r.network AND b.activity = succ JOIN blocked k ON k.network = r.network AND k.activity = pred WHERE depth < 8),
    cycles AS (SELECT network, activity, max(depth) = 8 AS cycle FROM back GROUP BY 1, 2),
    seats AS (SELECT *, row_number() OVER (PARTITION BY network ORDER BY level, activity)::INTEGER AS position FROM levels WHERE level < 8),
    lost AS (SELECT network, succ AS activity, count(*)::INTEGER AS n FROM links l WHERE NOT EXISTS (SELECT 1 FROM acts a WHERE a.network = l.network AND activity = pred) GROUP BY 1, 2)
    SELECT network, activity, s.level::INTEGER AS level, position, coalesce(n, 0)::INTEGER AS n_unknown, CASE WHEN s.level IS NULL THEN CASE WHEN cycle THEN 'cycle' ELSE 'behind a cycle' END END AS problem
    FROM acts LEFT JOIN seats s USING (network, activity) LEFT JOIN cycles USING (network, activity) LEFT JOIN lost USING (network, activity)""",
)
def topological_order(t: Tables) -> DataFrame:
    """Each line follows the one and the third before it; of some orders the first two wait for each other."""
    acts = t.lineitem.select(F.col("l_orderkey").alias("network"), F.col("l_linenumber").alias("activity")).distinct()
    back = F.explode(F.array(F.lit(1), F.lit(3)))
    links = acts.select("network", F.col("activity").alias("succ"), back.alias("k")).select("network", (F.col("succ") - F.col("k")).alias("pred"), "succ")
    loops = acts.where("activity = 1 AND network % 11 = 0").select("network", F.lit(2).alias("pred"), F.lit(1).alias("succ"))
    return net.ordered(acts, links.unionByName(loops))


@query(
    "time_impact",
    """WITH RECURSIVE base AS (SELECT l_orderkey AS network, l_linenumber AS activity, max(l_quantity)::BIGINT % 10 + 1 AS duration, max(l_suppkey) % 3 AS s, count(*) FILTER (l_returnflag = 'R') AS hit, max(l_quantity)::BIGINT % 7 - 1 AS delay
      FROM lineitem GROUP BY 1, 2),
    versions AS (SELECT DISTINCT network, 0 AS m FROM base UNION ALL SELECT network, activity FROM base WHERE hit > 0),
    acts AS (SELECT v.network, m, activity, s, duration + CASE WHEN hit > 0 AND activity <= m THEN delay ELSE 0 END AS duration FROM versions v JOIN base USING (network)),
    arcs AS (SELECT p.network, p.m, p.activity AS pred, q.activity AS succ, CASE q.activity - p.activity WHEN 1 THEN p.duration WHEN 2 THEN p.s ELSE p.duration - q.duration - 1 END AS w
      FROM acts p JOIN acts q ON p.network = q.network AND p.m = q.m AND q.activity - p.activity BETWEEN 1 AND 3),
    paths AS (SELECT network, m, activity AS b, 0::BIGINT AS len FROM acts UNION SELECT p.network, p.m, r.succ, p.len + r.w FROM paths p JOIN arcs r ON p.network = r.network AND p.m = r.m AND p.b = r.pred),
    early AS (SELECT network, m, b AS activity, max(len) AS es FROM paths GROUP BY 1, 2, 3),
    ends AS (SELECT network, m, max(es + duration) AS finish FROM early JOIN acts USING (network, m, activity) GROUP BY 1, 2),
    steps AS (SELECT *, lag(finish) OVER o AS before, lag(m) OVER o AS was FROM ends WINDOW o AS (PARTITION BY network ORDER BY m)),
    moved AS (SELECT s.network, s.m, count(*) FILTER (a.es <> b.es) AS n FROM steps s JOIN early a ON a.network = s.network AND a.m = s.m JOIN early b ON b.network = s.network AND b.m = s.was AND b.activity = a.activity GROUP BY 1, 2)
    SELECT network, m::INTEGER AS activity, 'R' || m AS event, delay, before AS finish_before, finish AS finish_after, finish - before AS impact, n AS n_moved, duration + delay AS duration
    FROM steps JOIN moved USING (network, m) JOIN base USING (network) WHERE m > 0 AND base.activity = m""",
)
def time_impact(t: Tables) -> DataFrame:
    """Returned lines delay their activity (or, rarely, speed it up), in the order of lines."""
    acts, edges = networks(t)
    delays = t.lineitem.groupBy(F.col("l_orderkey").alias("network"), F.col("l_linenumber").alias("activity")).agg(
        (F.max("l_quantity").cast("long") % 7 - 1).alias("delay"), F.count_if(F.col("l_returnflag") == "R").alias("hit")
    )
    events = delays.where("hit > 0").select("network", "activity", F.concat(F.lit("R"), F.col("activity").cast("string")).alias("event"), "delay", F.col("activity").alias("seq"))
    return net.time_impact(acts, edges, events)


def template(t: Tables) -> tuple[DataFrame, DataFrame]:
    place = F.row_number().over(Window.partitionBy("p_brand").orderBy("p_type", F.col("p_size") % 2, "p_partkey"))
    size = F.col("p_size")
    rows = t.part.select(F.col("p_brand").alias("project"), place.alias("place"), F.col("p_type").alias("phase"), (size % 2).cast("string").alias("part"), F.col("p_name").alias("name"), (size % 10 + 1).alias("duration"), (size > 25).alias("zoneable"))
    return rows, t.part.groupBy(F.col("p_brand").alias("project")).agg((F.count("*") * 3).alias("target"))


BREAKDOWN = """rows AS (SELECT p_brand AS project, row_number() OVER (PARTITION BY p_brand ORDER BY p_type, p_size % 2, p_partkey) AS place, p_type AS phase, (p_size % 2)::VARCHAR AS part, p_name AS name, p_size % 10 + 1 AS duration, p_size > 25 AS zoneable FROM part),
    counts AS (SELECT project, count(*) FILTER (zoneable) AS zoned, count(*) AS n FROM rows GROUP BY 1),
    zones AS (SELECT project, coalesce((SELECT min(z) FROM range(1, 80) AS r(z) WHERE n - zoned + z * zoned >= 3 * n), 80)::INTEGER AS zones FROM counts),
    coded AS (SELECT *, CASE WHEN zoneable THEN zones ELSE 1 END AS n, phase || '.' || part || '.' || row_number() OVER (PARTITION BY project, phase, part ORDER BY place) AS code FROM rows JOIN zones USING (project)),
    each AS (SELECT *, CASE WHEN n > 1 THEN code || '.' || zone ELSE code END AS activity FROM coded, unnest(range(1, n + 1)) AS u(zone))"""


@query(
    "wbs_activities",
    f"""WITH {BREAKDOWN} SELECT project AS network, activity, CASE WHEN n > 1 THEN name || ' - Hall ' || CASE WHEN zone <= 26 THEN chr((64 + zone)::INTEGER) ELSE chr((64 + (zone - 1) // 26)::INTEGER) || chr((65 + (zone - 1) % 26)::INTEGER) END ELSE name END AS name,
    (duration + CASE WHEN n > 1 THEN zone - 1 ELSE 0 END)::BIGINT AS duration, phase FROM each""",
)
def wbs_activities(t: Tables) -> DataFrame:
    """Three times as many activities as a brand has parts, by zones."""
    return net.work_breakdown(*template(t))[0]


@query(
    "wbs_links",
    f"""WITH {BREAKDOWN} SELECT b.project AS network, a.activity AS pred, b.activity AS succ, 'FS' AS kind, 0::BIGINT AS lag FROM each b JOIN each a ON a.project = b.project AND a.place = b.place - 1
    WHERE NOT (a.n > 1 AND b.n > 1 AND a.phase = b.phase AND a.part = b.part) OR a.zone = b.zone""",
)
def wbs_links(t: Tables) -> DataFrame:
    return net.work_breakdown(*template(t))[1]
