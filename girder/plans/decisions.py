"""Rules over lines, actions that messages ask for, and changes between two listings of a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.actions import matched
from ..operators.rules import Rule, evaluated
from ..registry import Tables, query
from ..streaming.snapshots import changes

RULES = [
    Rule("unit_rate", "extendedprice / quantity", "USD/unit", "quantity > 0", 4),
    Rule("net_price", "extendedprice * (1 - discount) * (1 + tax)", "USD", None, 2, "US"),
    Rule("discount_by_tax", "discount / tax", None, None, 5),
    Rule("bulk_side", "sqrt(quantity - 25) * max(1, min(linenumber, 3))", "m", None, 3),
    Rule("late_share", "abs(discount - tax) * 100", "%", "discount > tax and not linenumber == 1 or quantity >= 40", 6, "GCC"),
    Rule("weight", "quantity * density", "t"),
    Rule("attack", "__import__('os').getcwd()"),
    Rule("approval", "submit", kind="workflow"),
]


@query(
    "knowledge_rules_evaluated",
    """WITH l AS (SELECT l_orderkey AS order_id, l_linenumber AS linenumber, l_partkey AS part_id, l_quantity::DOUBLE AS q, l_extendedprice::DOUBLE AS p, l_discount::DOUBLE AS d, l_tax::DOUBLE AS t FROM lineitem),
    r AS (
      SELECT order_id, linenumber, part_id, 'unit_rate' AS rule_id, CASE WHEN q > 0 THEN p / q END AS result, 'USD/unit' AS unit, 4 AS tier, '' AS warnings, CASE WHEN NOT q > 0 THEN 'guard' END AS error FROM l
      UNION ALL SELECT order_id, linenumber, part_id, 'net_price', p * (1 - d) * (1 + t), 'USD', 2, 'credibility tier 2; region US', NULL FROM l
      UNION ALL SELECT order_id, linenumber, part_id, 'discount_by_tax', d / nullif(t, 0), NULL, 5, '', CASE WHEN t = 0 THEN 'no number' END FROM l
      UNION ALL SELECT order_id, linenumber, part_id, 'bulk_side', CASE WHEN q >= 25 THEN sqrt(greatest(0, q - 25)) * greatest(1, least(linenumber, 3)) END, 'm', 3, 'credibility tier 3', CASE WHEN q < 25 THEN 'no number' END FROM l
      UNION ALL SELECT order_id, linenumber, part_id, 'late_share', CASE WHEN (d > t AND linenumber <> 1) OR q >= 40 THEN abs(d - t) * 100 END, '%', 6, 'region GCC', CASE WHEN NOT ((d > t AND linenumber <> 1) OR q >= 40) THEN 'guard' END FROM l
      UNION ALL SELECT order_id, linenumber, part_id, 'weight', NULL, 't', NULL, '', 'missing: density' FROM l
      UNION ALL SELECT order_id, linenumber, part_id, 'attack', NULL, NULL, NULL, '', 'Call isn''t allowed in a formula' FROM l
      UNION ALL SELECT order_id, linenumber, part_id, 'approval', NULL, NULL, NULL, '', 'only formulas have results, not a workflow' FROM l)
    SELECT order_id, linenumber, part_id, rule_id, round(result, 6) AS result, unit, tier::INTEGER AS tier, warnings, error FROM r""",
)
def knowledge_rules_evaluated(t: Tables) -> DataFrame:
    """Formulas with guards over every line of every bill; what a rule can't give is an error in its row."""
    named = {"l_orderkey": "order_id", "l_linenumber": "linenumber", "l_partkey": "part_id", "l_quantity": "quantity", "l_extendedprice": "extendedprice", "l_discount": "discount", "l_tax": "tax"}
    rows = t.lineitem.select(*(F.col(c).alias(name) for c, name in named.items()))
    return evaluated(rows, RULES, ["order_id", "linenumber", "part_id"]).withColumn("result", F.round("result", 6))


ACTIONS = [
    ("price_bill", ["the", "and the", "price"]),
    ("make_programme", ["in", "of the", "that"]),
    ("check_safety", ["is", "that in", "hazard"]),
    ("read_drawing", ["die", "der und", "ung"]),
    ("price_bill", ["with", "of"]),
    ("review_contract", ["le", "de la", "que"]),
    ("find_clashes", ["clash", "that the"]),
]
FILES = {"assistant": "read_drawing", "system": "check_safety"}
GATES = {"make_programme": 0.2, "find_clashes": 0.2}


def action_sql() -> str:
    merged: dict[str, list[str]] = {}
    for action, keywords in ACTIONS:
        merged.setdefault(action, []).extend(k for k in keywords if k not in merged[action])
    rows = ", ".join(f"('{a}', '{k}', {len(k.split())}, '(^|[^a-z0-9_]){k}($|[^a-z0-9_])')" for a, ks in merged.items() for k in ks)
    gates = " ".join(f"WHEN '{a}' THEN {g}" for a, g in GATES.items())
    files = ", ".join(f"('{kind}', '{a}')" for kind, a in FILES.items())
    return f"""WITH k(action, keyword, words, pattern) AS (VALUES {rows}), f(role, action) AS (VALUES {files}),
    m AS (SELECT conv_id * 1000 + turn AS id, role, lower(text) AS text FROM conversations),
    h AS (SELECT id, action, sum(words) AS words, list_sort(list(keyword)) AS keywords, 0 AS file FROM m JOIN k ON regexp_matches(text, pattern) GROUP BY ALL),
    b AS (SELECT id, action, words, keywords, file FROM h UNION ALL SELECT id, action, 0, []::VARCHAR[], 1 FROM m JOIN f USING (role)),
    s AS (SELECT id, action, sum(words) * 0.2::DOUBLE + max(file) * 0.8::DOUBLE AS score, flatten(list(keywords)) AS keywords FROM b GROUP BY ALL),
    g AS (SELECT id, action, round(least(score, 1.0), 3)::DOUBLE AS confidence, keywords FROM s WHERE score >= CASE action {gates} ELSE 0.3 END - 1e-9)
    SELECT id, action, confidence, array_to_string(keywords, ', ') AS keywords, row_number() OVER (PARTITION BY id ORDER BY confidence DESC, action)::INTEGER AS rank FROM g"""


@query("action_matches", action_sql())
def action_matches(t: Tables) -> DataFrame:
    """What each turn of each conversation asks for, by keywords in one pass; who speaks stands for the type of a file."""
    messages = t.conversations.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text", F.col("role").alias("file_type"))
    return matched(messages, ACTIONS, FILES, GATES).withColumn("keywords", F.array_join("keywords", ", "))


@query(
    "folder_changes",
    """WITH b AS (SELECT source || '/' || doc_id AS path, md5(text) AS was FROM documents WHERE length(text) % 11 <> 0),
    a AS (SELECT CASE WHEN length(text) % 7 = 0 THEN lang ELSE source END || '/' || doc_id AS path, md5(CASE WHEN length(text) % 13 = 0 THEN text || '.' ELSE text END) AS now FROM documents WHERE length(text) % 17 <> 0),
    j AS (SELECT coalesce(b.path, a.path) AS path, was, now, b.path AS bp, a.path AS ap FROM b FULL JOIN a ON a.path = b.path),
    came AS (SELECT path, now AS hash, row_number() OVER (PARTITION BY now ORDER BY path) AS k FROM j WHERE bp IS NULL),
    went AS (SELECT path AS old_path, was AS hash, row_number() OVER (PARTITION BY was ORDER BY path) AS k FROM j WHERE ap IS NULL)
    SELECT 'changed' AS change, path, NULL AS old_path, now AS hash FROM j WHERE bp IS NOT NULL AND ap IS NOT NULL AND was <> now
    UNION ALL SELECT CASE WHEN old_path IS NULL THEN 'new' WHEN path IS NULL THEN 'deleted' ELSE 'renamed' END, coalesce(path, old_path), CASE WHEN path IS NOT NULL THEN old_path END, coalesce(c.hash, w.hash)
      FROM came c FULL JOIN went w ON c.hash = w.hash AND c.k = w.k""",
)
def folder_changes(t: Tables) -> DataFrame:
    """Two listings of the documents as files: some come, some go, some move to the folder of their language, some change."""
    size = F.length("text")
    path = lambda folder: F.concat_ws("/", folder, F.col("doc_id").cast("string"))
    before = t.documents.where(size % 11 != 0).select(path(F.col("source")).alias("path"), F.md5("text").alias("hash"))
    folder = F.when(size % 7 == 0, F.col("lang")).otherwise(F.col("source"))
    after = t.documents.where(size % 17 != 0).select(path(folder).alias("path"), F.md5(F.when(size % 13 == 0, F.concat("text", F.lit("."))).otherwise(F.col("text"))).alias("hash"))
    return changes(before, after)
