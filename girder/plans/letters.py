"""Letters, sheets, answers and summaries: an order is a letter and a bill, a line one of its sentences and a sheet; the texts are made of the lines' own values."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import catalog, prose, works
from ..operators import gates, networks, registers, summaries
from ..registry import Tables, query
from .drawings import sheets
from .networks import BREAKDOWN, template
from .works import CATEGORY, LIST, PICK, parts, work_categories

#: What a line's sentence says, by its number, in words that both engines fill from columns.
SENTENCES = (
    "Losses of the {name} stay ≤ {little}% at {quantity}.5 MW and 11 kV.", "Completion within {quantity} weeks under the TFO permit of {month}.", "Generators for {name} arrive in {size} days; the chiller in {quantity} Weeks.",
    "Permit delay and Winter put {month} {year} milestone {name} back.", "RFS by {month} {year}, or EOY {year} for {name}.", "The {name} package is {word} by the engineer.", "Supply chain: load-shed of {size}0 MW > {quantity} ft, {name} switchgear in {size} weeks.",
)
VERBS = ("approved", "accepted", "reviewed", "unapproved", "Approves")
#: The values as columns and in SQL.
VALUES = {
    "name": ("p_name", "p_name"),
    "little": ("string(int(l_quantity % 9))", "(l_quantity::INTEGER % 9)"),
    "quantity": ("string(int(l_quantity))", "l_quantity::INTEGER"),
    "size": ("string(p_size)", "p_size"),
    "month": ("date_format(l_shipdate, 'MMMM')", "monthname(l_shipdate)"),
    "year": ("date_format(l_shipdate, 'yyyy')", "year(l_shipdate)"),
    "word": (f"element_at(array{tuple(VERBS)}, int(l_suppkey % {len(VERBS)} + 1))", f"{LIST(VERBS)}[l_suppkey % {len(VERBS)} + 1]"),
}


def parts_of(sentence: str) -> list[str]:
    """A sentence cut at its values, which stand in braces."""
    return [x for x in re.split(r"(\{\w+\})", sentence) if x]


def filled(sentence: str) -> Column:
    return F.concat(*(F.expr(VALUES[x[1:-1]][0]) if x[0] == "{" else F.lit(x) for x in parts_of(sentence)))


def filled_sql(sentence: str) -> str:
    return " || ".join(VALUES[x[1:-1]][1] if x[0] == "{" else f"'{x}'" for x in parts_of(sentence))


SAYS = "CASE l_linenumber " + " ".join(f"WHEN {i} THEN {filled_sql(s)}" for i, s in enumerate(SENTENCES, 1)) + " END"
LETTERS = f"(SELECT l_orderkey AS letter, string_agg({SAYS}, chr(10) ORDER BY l_linenumber, p_partkey, {SAYS}) AS text FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1)"


def letters(t: Tables) -> DataFrame:
    line = F.coalesce(*(F.when(F.col("l_linenumber") == i, filled(s)) for i, s in enumerate(SENTENCES, 1)))
    return sheets(t, line).withColumnRenamed("sheet", "letter")


def mentioned(kind: str) -> str:
    """SQL for (letter, place, raw, start, context) of a kind's mentions: texts cut at marks around each match."""
    each = []
    for place, p in enumerate(prose.PATTERNS[kind]):
        plain = re.sub(r"\?P<\w+>", "?:", p)
        each.append(f"SELECT letter, text, {place} AS place, string_split(regexp_replace(text, '(?i)({plain})', chr(1) || '\\1' || chr(1), 'g'), chr(1)) AS pieces FROM {LETTERS}")
    n = prose.AROUND[kind]
    return f"""(SELECT letter, place, raw, start, regexp_replace(substr(text, greatest(start - {n}, 0) + 1, least(start, {n}) + length(raw) + {n}), '^\\s+|\\s+$', '', 'g') AS context
      FROM (SELECT letter, text, place, pieces[i] AS raw, list_sum(list_transform(pieces[1:i - 1], lambda x: length(x)))::BIGINT AS start FROM ({' UNION ALL '.join(each)}), unnest(range(2, len(pieces) + 1, 2)) AS u(i)))"""


def part_of(kind: str, name: str, source: str = "raw") -> str:
    """SQL for a named part of a mention."""
    cases = []
    for place, p in enumerate(prose.PATTERNS[kind]):
        if f"?P<{name}>" in p:
            only = re.sub(r"\(\?P<\w+>", "(?:", p.replace(f"(?P<{name}>", "(@")).replace("(@", "(")
            cases.append(f"WHEN {place} THEN regexp_extract({source}, '(?i)^(?:{only})', 1)")
    return f"coalesce(CASE place {' '.join(cases)} END, '')"


LIMITS = f"SELECT letter, place, start, raw, context, {part_of('constraint', 'value')} AS value, {part_of('constraint', 'unit')} AS unit, {part_of('constraint', 'operator')} AS operator FROM {mentioned('constraint')}"
DATES = f"""SELECT letter, place, start, raw, context, {part_of('target', 'month')} AS month, {part_of('target', 'year')} AS year,
    CASE WHEN place = 3 THEN regexp_extract(raw, '[0-9]+')::BIGINT * CASE WHEN contains(lower(raw), 'day') THEN 1 WHEN contains(lower(raw), 'week') THEN 7 ELSE 30 END END AS duration_days FROM {mentioned('target')}"""


@query("letter_limits", LIMITS)
def letter_limits(t: Tables) -> DataFrame:
    return prose.constraints(prose.mentions(letters(t), ["constraint"], "letter"))


@query("letter_dates", DATES)
def letter_dates(t: Tables) -> DataFrame:
    return prose.targets(prose.mentions(letters(t), ["target"], "letter"))


@query(
    "letter_lead_times",
    f"""WITH g AS (SELECT letter, upper(substr({part_of('lead_time', 'equipment')}, 1, 1)) || lower(substr({part_of('lead_time', 'equipment')}, 2)) AS equipment,
      CASE place WHEN 0 THEN {part_of('lead_time', 'days')} END::BIGINT AS d, CASE place WHEN 1 THEN {part_of('lead_time', 'weeks')} END::BIGINT * 7 AS w, start FROM {mentioned('lead_time')}),
    u AS (SELECT unnest({LIST(prose.LEAD_TIMES)}) AS equipment, unnest({list(prose.LEAD_TIMES.values())})::BIGINT AS days)
    SELECT letter, equipment, coalesce(w, d, 0) AS days, start, true AS given FROM g UNION ALL
    SELECT letter, u.equipment, days, NULL, false FROM (SELECT DISTINCT letter FROM g) x, u WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.letter = x.letter AND g.equipment = u.equipment)""",
)
def letter_lead_times(t: Tables) -> DataFrame:
    return prose.lead_times(prose.mentions(letters(t), ["lead_time"], "letter"), "letter")


@query(
    "letter_risks",
    f"""WITH l AS ({LIMITS}), d AS ({DATES})
    SELECT letter, 'keyword_match' AS type, raw AS keyword, CASE WHEN regexp_matches(lower(raw), 'blast radius|winter|supply chain|permit delay|labour shortage') THEN 'high' WHEN regexp_matches(lower(raw), 'tfo|indigenous|load shed|weather') THEN 'medium' ELSE 'low' END AS severity, start, context FROM {mentioned('risk')}
    UNION ALL SELECT letter, 'schedule_dependency', 'external_dependency', 'high', start, context FROM d WHERE regexp_matches(lower(context), 'tfo|permit|indigenous|supply')
    UNION ALL SELECT letter, 'tight_constraint', operator || value::DOUBLE || '%', 'high', start, context FROM l WHERE unit = '%' AND operator IN ('≤', '<') AND value::DOUBLE <= 5
    UNION ALL SELECT letter, 'scale_constraint', value::DOUBLE || ' MW', 'medium', start, context FROM l WHERE lower(unit) = 'mw' AND value::DOUBLE >= 50""",
)
def letter_risks(t: Tables) -> DataFrame:
    return prose.risks(prose.mentions(letters(t), ["constraint", "target", "risk"], "letter"), "letter")


@query(
    "rule_violations",
    f"""SELECT letter, 'no_approved_on_design' AS rule, 'PRC-501' AS procedure FROM {LETTERS} WHERE regexp_matches(text, '(?i)\\b(approve|approves|approved|approval)\\b') AND regexp_matches(text, '(?i)design|drawing|package|review|consultant|architect|engineer|document')""",
)
def rule_violations(t: Tables) -> DataFrame:
    return prose.violations(letters(t), "letter")


CODES = ("A", "ST", "INF", "ZZ", "fp")
KINDS = ("architectural", "structural", "infrastructure", None, "fire protection")


@query(
    "sheet_title_blocks",
    f"""SELECT l_orderkey, l_linenumber, l_partkey, number AS drawing_number, p_name || ' plan' AS drawing_title, letter AS revision, CASE WHEN l_returnflag = 'R' THEN 'N.T.S' ELSE '1:' || p_size END AS scale, strftime(l_shipdate, '%d/%m/%Y') AS date,
      NULL::VARCHAR AS drawn_by, 'O' || chr(39) || 'Neil-' || chr((65 + l_suppkey % 26)::INTEGER) AS checked_by, NULL::VARCHAR AS approved_by, NULL::VARCHAR AS project_name, 'Supplier ' || l_suppkey AS client, l_linenumber || ' of 7' AS sheet_number, discipline,
      8 + (discipline IS NOT NULL)::INTEGER AS fields_found
    FROM (SELECT *, {LIST(CODES)}[l_partkey % 5 + 1] || '-' || l_orderkey || '-' || l_linenumber AS number, CASE WHEN l_quantity > 25 THEN 'C' || l_linenumber ELSE 'A' END AS letter, {str(list(KINDS)).replace('None', 'NULL')}[l_partkey % 5 + 1] AS discipline FROM lineitem JOIN part ON l_partkey = p_partkey)""",
)
def sheet_title_blocks(t: Tables) -> DataFrame:
    """A sheet for each line: earlier labels in its notes, labels without values, then the title block, in which some revisions are lacking."""
    col = lambda c: F.col(c).cast("string")
    lines = (
        "SEE DRAWING NO: X-0000 REV A, SCALE 1:999", F.concat(F.lit("CLIENT: Supplier "), col("l_suppkey")), "DRAWN BY:", F.concat(F.lit("CHECKED BY: O'Neil-"), F.char(F.lit(65) + F.col("l_suppkey") % 26)), "APPROVED BY -",
        F.concat(F.lit("DWG No. "), PICK(CODES, "l_partkey"), F.lit("-"), col("l_orderkey"), F.lit("-"), col("l_linenumber")), F.concat(F.lit("Drawing title: "), F.col("p_name"), F.lit(" plan  ")),
        F.when(F.col("l_quantity") > 25, F.concat(F.lit("Rev. C"), col("l_linenumber"))).otherwise("REV: no letter yet"), F.concat(F.lit("Scale "), F.when(F.col("l_returnflag") == "R", "N.T.S.").otherwise(F.concat(F.lit("1:"), col("p_size")))),
        F.concat(F.lit("DATE "), F.date_format("l_shipdate", "dd/MM/yyyy")), F.concat(F.lit("sheet "), col("l_linenumber"), F.lit(" of 7")),
    )
    text = F.concat_ws("\n", *(F.lit(x) if isinstance(x, str) else x for x in lines))
    return t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", "l_linenumber", "l_partkey", *prose.title_fields(text))


PRICED = f"""(SELECT l_orderkey AS bill, l_linenumber::BIGINT AS position, category AS section, description, l_quantity AS quantity, unit, CASE WHEN l_orderkey % 7 > 0 THEN l_extendedprice::DECIMAL(38,2) END AS amount FROM lineitem JOIN {CATEGORY} ON l_partkey = p_partkey)"""
NAMED = "(SELECT o_orderkey AS bill, 'Bill ' || o_orderkey AS name, CASE WHEN o_custkey % 3 > 0 THEN 'SAR' END AS currency, (o_orderpriority = '1-URGENT')::INTEGER AS skipped FROM orders)"


@query(
    "bill_summary_chunks",
    f"""WITH l AS {PRICED}, s AS (SELECT bill, section, sum(amount) AS amount, bool_or(regexp_matches(lower(description), 'sewer|foul|waste water|wastewater|sanitary')) AS sewer FROM l GROUP BY ALL),
    b AS (SELECT *, coalesce(currency, '') AS cash FROM {NAMED} LEFT JOIN (SELECT bill, sum(amount) AS total, bool_or(sewer) AS sewer FROM s GROUP BY 1) USING (bill)),
    p AS (SELECT bill, string_agg(section || ' ' || amount || ' ' || cash || ' (' || (((amount * 100)::HUGEINT * 2000 + (total * 100)::HUGEINT) // (2 * (total * 100)::HUGEINT) / 10)::DECIMAL(38,1) || '%)', '; ' ORDER BY amount DESC, section) AS parts FROM s JOIN b USING (bill) WHERE amount IS NOT NULL GROUP BY 1)
    SELECT bill, 'total' AS kind, 0::BIGINT AS place, 'BOQ total [' || name || '] — total package value, total contract value, total cost: ' || total || ' ' || cash AS text FROM b WHERE total IS NOT NULL AND skipped = 0
    UNION ALL SELECT bill, 'partial', 0, 'BOQ partial total [' || name || '] — total package value, INCOMPLETE, ' || skipped || ' pages not read: ' || total || ' ' || cash FROM b WHERE total IS NOT NULL AND skipped > 0
    UNION ALL SELECT bill, 'sections', 0, 'BOQ cost by section [' || name || '] — ' || parts FROM b JOIN p USING (bill)
    UNION ALL SELECT bill, 'terms', 0, 'BOQ terms [' || name || ']: sewer, foul and sanitary drainage and waste water are one network; storm and surface water is another' FROM b WHERE total IS NOT NULL AND sewer
    UNION ALL SELECT bill, 'guard', 0, 'GUARD [' || name || ']: a bill of quantities without a verified total. Do NOT state a total value from it' FROM b WHERE total IS NULL
    UNION ALL SELECT bill, 'line', position, 'BOQ line item [' || name || '] — ' || trim(description) || ': total quantity ' || quantity::INTEGER || '.0' || CASE WHEN unit <> '' THEN ' ' || unit ELSE '' END || ', unit price (rate) ' || coalesce(((((amount * 100)::HUGEINT * 2 + quantity::HUGEINT) // (2 * quantity::HUGEINT))::DECIMAL(38,0) * 0.01)::DECIMAL(38,2)::VARCHAR, '') || ', total price (amount) ' || coalesce(amount::VARCHAR, '') || ' ' || cash FROM l JOIN b USING (bill)""",
)
def bill_summary_chunks(t: Tables) -> DataFrame:
    """Every order as a bill of works; urgent ones had a page that could not be read, a seventh has no prices."""
    amount = F.when(F.col("l_orderkey") % 7 > 0, F.col("l_extendedprice").cast("decimal(20,2)"))
    # By a merge, as the estimate of their size misses the texts made: a million parts would go through the driver.
    works_of = parts(t).withColumn("category", works.category(F.col("description"))).hint("merge")
    lines = t.lineitem.join(works_of, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_orderkey").alias("bill"), F.col("l_linenumber").alias("position"), F.col("category").alias("section"), "description", F.col("l_quantity").alias("quantity"), "unit",
        (amount / F.col("l_quantity").cast("decimal(10,0)")).cast("decimal(38,2)").alias("rate"), amount.alias("amount"),
    )
    bills = t.orders.select(F.col("o_orderkey").alias("bill"), F.concat(F.lit("Bill "), F.col("o_orderkey").cast("string")).alias("name"), F.when(F.col("o_custkey") % 3 > 0, "SAR").alias("currency"), (F.col("o_orderpriority") == "1-URGENT").cast("int").alias("skipped"))
    return summaries.bill_chunks(bills, lines)


@query(
    "cost_loaded_breakdown",
    f"""WITH {BREAKDOWN}, links AS (SELECT b.project AS network, a.activity AS pred, b.activity AS succ FROM each b JOIN each a ON a.project = b.project AND a.place = b.place - 1
      WHERE NOT (a.n > 1 AND b.n > 1 AND a.phase = b.phase AND a.part = b.part) OR a.zone = b.zone),
    acts AS (SELECT project AS network, activity, (duration + CASE WHEN n > 1 THEN zone - 1 ELSE 0 END)::BIGINT AS duration, phase, CASE WHEN phase IN ('LARGE', 'PROMO') THEN 6 ELSE CASE WHEN phase = 'SMALL' THEN 1 ELSE 2 * 4 END END AS heads FROM each)
    SELECT a.network, activity, phase AS wbs, duration, coalesce(string_agg(pred, ',' ORDER BY pred), '') AS predecessors, heads::INTEGER AS manpower, heads * duration AS man_days, round(heads * duration * 310.5, 2)::DOUBLE AS cost
    FROM acts a LEFT JOIN links l ON l.network = a.network AND succ = activity GROUP BY ALL""",
)
def cost_loaded_breakdown(t: Tables) -> DataFrame:
    """Generated breakdowns with heads: stated for two phases, one for a phase without trades, else by two trades."""
    acts, links = networks.work_breakdown(*template(t))
    phase = F.col("phase")
    manned = acts.withColumn("crew_size", F.when(phase.isin("LARGE", "PROMO"), 6)).withColumn("trades", F.when(phase == "SMALL", F.array().cast("array<string>")).otherwise(F.array(F.lit("mason"), F.lit("steel fixer"))))
    full = summaries.cost_loaded(manned, links, day_rate=310.5)
    return full.select("network", "activity", "wbs", "duration", F.array_join("predecessors", ",").alias("predecessors"), "manpower", "man_days", "cost")


def golden(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Benchmark texts as questions that want their first word and not their second; conversations answer them, several each."""
    words = F.split(F.regexp_replace(F.lower("text"), "[^a-z ]", ""), " +")
    entries = t.benchmark.select(F.col("item_id").alias("id"), F.array(F.concat(F.lit(r"\b"), F.get(words, F.lit(0)), F.lit(r"\b"))).alias("expect"), F.array(F.concat(F.lit("^"), F.get(words, F.lit(1)), F.lit(r"\b"))).alias("reject"), F.when(F.col("item_id") % 2 == 0, "assist").alias("source"))
    turns = t.conversations.where("turn IS NOT NULL AND turn < 1000")
    log = turns.select(
        (F.col("conv_id") % 50).alias("id"), (F.col("conv_id") * 1000 + F.col("turn")).alias("seq"), F.col("text").alias("answer"), F.when((F.col("conv_id") + F.col("turn")) % 17 == 0, "timeout").alias("error"), F.array("role").alias("sources")
    )
    return entries, log


VERDICTS = r"""e AS (SELECT item_id AS id, '(?im)\b' || w[1] || '\b' AS expect, '(?im)^' || w[2] || '\b' AS reject, CASE WHEN item_id % 2 = 0 THEN 'assist' ELSE '' END AS source FROM (SELECT item_id, regexp_split_to_array(regexp_replace(lower(text), '[^a-z ]', '', 'g'), ' +') AS w FROM benchmark)),
    r AS (SELECT conv_id % 50 AS id, conv_id * 1000 + turn AS seq, text AS answer, (conv_id + turn) % 17 = 0 AS error, role FROM conversations WHERE turn < 1000), l AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq DESC, answer DESC NULLS LAST, error DESC, role DESC NULLS LAST) = 1),
    j AS (SELECT e.id, l.seq IS NOT NULL AS there, NOT regexp_matches(coalesce(answer, ''), expect) AS miss, regexp_matches(coalesce(answer, ''), reject) AS hit, CASE WHEN source <> '' THEN coalesce(contains(lower(role), source), false) END AS ok, error::INTEGER + (trim(coalesce(answer, '')) = '')::INTEGER AS faults FROM e LEFT JOIN l USING (id)),
    v AS (SELECT id, there, miss, hit, ok, miss::INTEGER + hit::INTEGER + coalesce((NOT ok)::INTEGER, 0) + faults AS n FROM j)"""


@query("golden_verdicts", f"WITH {VERDICTS} SELECT id, CASE WHEN NOT there THEN 'none' WHEN n = 0 THEN 'PASS' ELSE 'FAIL' END AS verdict, CASE WHEN there THEN miss::INTEGER END AS n_misses, CASE WHEN there THEN hit::INTEGER END AS n_hits, CASE WHEN there THEN ok END AS retrieval_ok, CASE WHEN there THEN n END::INTEGER AS n_reasons FROM v")
def golden_verdicts(t: Tables) -> DataFrame:
    judged = gates.verdicts(*golden(t))
    return judged.select("id", "verdict", F.size("misses").alias("n_misses"), F.size("hits").alias("n_hits"), "retrieval_ok", "n_reasons")


@query(
    "golden_gate",
    f"""WITH {VERDICTS}, s AS (SELECT count(*) AS n, count(*) FILTER (there AND n = 0) AS passed, count(*) FILTER (there AND n > 0) AS failed, count(*) FILTER (NOT there) AS missing FROM v)
    SELECT *, ceil(n * 90 / 100.0)::BIGINT AS needed, passed >= ceil(n * 90 / 100.0) AS met FROM s""",
)
def golden_gate(t: Tables) -> DataFrame:
    return gates.gate(gates.verdicts(*golden(t)))


PLACES = ("Riyadh", "US-NYC", "abu_dhabi", "Atlantis", "", "HONG/KONG", "uk")
PROJECTS = ("industrial", "Healthcare", "data_center", "residential")
FACTORS = {"Riyadh": 0.85, "US-NYC": 1.35, "abu_dhabi": 0.95, "Atlantis": None, "": None, "HONG/KONG": 1.45, "uk": 1.25}


@query(
    "benchmark_rates",
    f"""WITH x AS (SELECT p_partkey, lower(description) AS d, {str([FACTORS[p] for p in PLACES]).replace('None', 'NULL')}[p_size % {len(PLACES)} + 1] AS place, [1.10, 1.20, 1.0, 0.95][(p_partkey % 4)::INTEGER + 1] AS kind FROM {CATEGORY}  JOIN part USING (p_partkey)),
    y AS (SELECT *, CASE WHEN contains(d, 'concrete') THEN 'concrete' WHEN contains(d, 'steel') THEN 'steel' WHEN contains(d, 'rebar') THEN 'rebar' WHEN contains(d, 'formwork') THEN 'formwork' WHEN contains(d, 'blockwork') THEN 'blockwork' WHEN contains(d, 'plaster') THEN 'plaster'
      WHEN contains(d, 'paint') THEN 'paint' WHEN contains(d, 'asphalt') THEN 'asphalt' WHEN contains(d, 'excavation') THEN 'excavation' END AS item FROM x)
    SELECT p_partkey, item, round(r * coalesce(place, 1) * kind, 2)::DOUBLE AS adjusted, place IS NOT NULL AS location_known
    FROM (SELECT *, CASE item WHEN 'concrete' THEN 150 WHEN 'formwork' THEN 35 WHEN 'blockwork' THEN 45 WHEN 'plaster' THEN 18 WHEN 'paint' THEN 12 WHEN 'asphalt' THEN 40 WHEN 'excavation' THEN 15 ELSE CASE WHEN item IS NOT NULL THEN 1 END END AS r FROM y)""",
)
def benchmark_rates(t: Tables) -> DataFrame:
    """Indicative rates of all works, at several places and kinds of projects."""
    named = work_categories(t).select("p_partkey", "description").join(t.part.select("p_partkey", PICK(PLACES, "p_size").alias("place"), PICK(PROJECTS, "p_partkey").alias("project")), "p_partkey")
    return named.withColumn("r", works.benchmark_rate(F.col("description"), F.col("place"), F.col("project"))).select("p_partkey", "r.item", "r.adjusted", "r.location_known")


#: A catalog of works: kind and keywords of each group.
GROUPS = {
    "earthworks": ("labour", ["excavation", "bulk excavation", "topsoil", "trench", "reduced level"]),
    "concrete": ("material", ["concrete", "reinforced concrete", "lean concrete", "raft", "column", "blinding"]),
    "rebar": ("material", ["rebar", "high yield rebar", "reinforcing bar", "bend"]),
    "formwork": ("labour", ["formwork", "soffit of slab", "shutter"]),
    "masonry": ("material", ["blockwork", "block wall", "brick"]),
    "waterproofing": ("material", ["waterproofing membrane", "waterproof", "tanking", "wet area"]),
    "piping": ("material", ["upvc pipe", "pipe", "sprinkler", "sanitary fittings"]),
    "piling rig": ("equipment", ["bored piling", "pile", "rig"]),
    "chillers": ("equipment", ["chiller", "ahu", "cooling tower"]),
    "finishes": ("labour", ["plaster", "painting", "painting to ceiling", "render"]),
    "hoists": ("equipment", ["hoist", "crane", "steel truss", "large gear"]),
}
STOPS = ["and", "for", "the", "with"]
KEYWORDS = "(VALUES " + ", ".join(f"({i}, '{g}', '{k}', '{w}', {len(ws)})" for i, (g, (k, ws)) in enumerate(GROUPS.items()) for w in ws) + ") v(place, grp, kind, word, n)"


def catalog_sql(where: str) -> str:
    return f"""WITH d AS (SELECT DISTINCT lower(description) AS low, description FROM {CATEGORY}), w AS (SELECT *, list_filter(regexp_extract_all(low, '[a-z]+'), lambda x: length(x) >= 3 AND x NOT IN ('and', 'for', 'the', 'with')) AS words FROM d),
    s AS (SELECT description, place, grp, kind, n, sum(CASE WHEN contains(low, word) THEN CASE WHEN contains(word, ' ') THEN 6 ELSE 2 END WHEN len(list_filter(words, lambda x: contains(word, x) OR contains(x, word))) > 0 THEN 1 ELSE 0 END)::BIGINT AS score FROM w, {KEYWORDS} WHERE {where} GROUP BY ALL),
    b AS (SELECT * FROM s WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY description ORDER BY score DESC, place) = 1)
    SELECT p_partkey, grp, kind, score, CASE WHEN score >= 0.7 * n THEN 'high' WHEN score >= 0.36 * n THEN 'medium' WHEN score > 0 THEN 'low' END AS confidence FROM {CATEGORY} LEFT JOIN b USING (description)"""


def grouped(t: Tables, kind: str | None) -> DataFrame:
    """Each part's group; a description is scored once."""
    parts = work_categories(t).select("p_partkey", "description")
    best = parts.select("description").distinct().withColumn("b", catalog.best_group(F.col("description"), GROUPS, STOPS, kind))
    return parts.join(best, "description").select("p_partkey", F.col("b.group").alias("grp"), "b.kind", F.col("b.score").cast("long").alias("score"), "b.confidence")


@query("catalog_best_group", catalog_sql("true"))
def catalog_best_group(t: Tables) -> DataFrame:
    return grouped(t, None)


@query("catalog_equipment", catalog_sql("kind = 'equipment'"))
def catalog_equipment(t: Tables) -> DataFrame:
    return grouped(t, "equipment")


OPENINGS = ("Extract", "estimate", "price", "check", "process", "the", "generate")
REQUESTS = f"(SELECT p_brand || '/' || p_size AS label, p_partkey AS seq, {LIST(OPENINGS)}[(p_partkey % {len(OPENINGS)})::INTEGER + 1] || '  ' || p_name AS text FROM part)"
SWAPS = "(VALUES " + ", ".join(f"('{verb}', {6 + i}, '{other}')" for verb, others in registers.SYNONYMS.items() for i, other in enumerate(others)) + ") v(verb, k, other)"
WRAPS = "(VALUES " + ", ".join(f"({i}, '{p}')" for i, p in enumerate(registers.PHRASES)) + ") v(k, phrase)"


@query(
    "paraphrased_requests",
    f"""WITH r AS {REQUESTS}, c AS (SELECT label, count(*) AS n FROM r GROUP BY 1 HAVING count(*) < 20), few AS (SELECT * FROM r JOIN c USING (label)),
    m AS (SELECT label, n, seq, k, replace(phrase, '{{}}', text) AS text FROM few, {WRAPS} UNION ALL SELECT label, n, seq, k, other || ' ' || split_part(text, '  ', 2) FROM few JOIN {SWAPS} ON verb = lower(split_part(text, '  ', 1))),
    f AS (SELECT label, text, any_value(n) AS n, min((seq, k)) AS place FROM m GROUP BY ALL), p AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY place, text) AS p FROM f WHERE NOT EXISTS (SELECT 1 FROM few WHERE few.label = f.label AND few.text = f.text))
    SELECT label, text, 0.3::DOUBLE AS weight FROM p WHERE p <= 20 - n""",
)
def paraphrased_requests(t: Tables) -> DataFrame:
    """Requests by brand and size, until each has twenty."""
    label = F.concat_ws("/", "p_brand", F.col("p_size").cast("string"))
    return registers.paraphrased(t.part.select(label.alias("label"), F.col("p_partkey").alias("seq"), F.concat(PICK(OPENINGS, "p_partkey"), F.lit("  "), "p_name").alias("text")), 20)
