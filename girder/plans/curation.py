"""Curation of a corpus, sets of ids and text mining."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import mining
from ..operators import curation, overlap, ranking
from ..registry import Tables, query
from .retrieval import CLASSED, NAMED, classed, names
from .works import LIST, PICK


@query(
    "duplicate_strings",
    "SELECT hash, left(text, 60) AS opening, n FROM (SELECT sha256(text) AS hash, any_value(text) AS text, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1) ORDER BY n DESC, hash LIMIT 20",
)
def duplicate_strings(t: Tables) -> DataFrame:
    """The twenty texts that repeat most, compared whole by their hashes and shown by their openings."""
    found = t.documents.where("text IS NOT NULL").groupBy(F.sha2("text", 256).alias("hash")).agg(F.min(F.substring("text", 1, 60)).alias("opening"), F.count("*").alias("n")).where("n > 1")
    return found.orderBy(F.desc("n"), "hash").limit(20).select("hash", "opening", "n")


@query(
    "contradiction_scan",
    "SELECT source, lang, bool_or(regexp_matches(text, '(?i)\\b(all rights reserved|no part)\\b')) AS against, bool_or(regexp_matches(text, '(?i)\\b(free software|permission is|CC BY)\\b')) AS for_it, count(*) AS n FROM documents GROUP BY ALL HAVING bool_or(regexp_matches(text, '(?i)\\b(all rights reserved|no part)\\b')) AND bool_or(regexp_matches(text, '(?i)\\b(free software|permission is|CC BY)\\b'))",
)
def contradiction_scan(t: Tables) -> DataFrame:
    """Sources and languages with verdicts for and against."""
    against, for_it = r"(?i)\b(all rights reserved|no part)\b", r"(?i)\b(free software|permission is|CC BY)\b"
    return curation.contradictions(t.documents, ["source", "lang"], F.col("text").rlike(against), F.col("text").rlike(for_it))


@query(
    "provenance_coverage",
    """SELECT l_linestatus AS file, count(*) AS n, count(*) FILTER (NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderstatus = 'F')) AS unknown FROM lineitem GROUP BY 1""",
)
def provenance_coverage(t: Tables) -> DataFrame:
    rows = t.lineitem.select(F.col("l_linestatus").alias("file"), F.col("l_orderkey").alias("k"))
    return curation.coverage(rows, t.orders.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("k")), ["k"], "file")


@query(
    "corpus_audit",
    """WITH c AS (SELECT doc_id, count(*) AS n_labels FROM labels GROUP BY 1), d AS (SELECT d.doc_id, source, sha256(coalesce(text, '')) AS sha, coalesce(n_labels, 0) AS n_labels FROM documents d LEFT JOIN c USING (doc_id)),
    s AS (SELECT source, sha, count(*) AS k FROM d GROUP BY ALL)
    SELECT d.source, count(*) AS n, count(*) FILTER (n_labels = 0) AS without, count(*) FILTER (k > 1) AS repeated FROM d JOIN s ON s.source IS NOT DISTINCT FROM d.source AND s.sha = d.sha GROUP BY 1""",
)
def corpus_audit(t: Tables) -> DataFrame:
    return curation.audit(t.documents, t.labels, "doc_id", "source", "text")


@query(
    "layer_backfill",
    f"SELECT layer, authority, count(*) AS n, count(*) FILTER (doc_id NOT IN (SELECT doc_id FROM labels)) AS untagged FROM {CLASSED} GROUP BY GROUPING SETS ((layer, authority), (layer), ())",
)
def layer_backfill(t: Tables) -> DataFrame:
    tagged = t.labels.select("doc_id").distinct().withColumn("tagged", F.lit(1))
    both = classed(t).join(tagged, "doc_id", "left")
    return both.rollup("layer", "authority").agg(F.count("*").alias("n"), F.count_if(F.col("tagged").isNull()).alias("untagged"))


@query(
    "coverage_sample",
    f"""WITH a AS (SELECT doc_id, authority, row_number() OVER (PARTITION BY authority ORDER BY doc_id) AS k FROM {CLASSED}) SELECT doc_id, authority, row_number() OVER (ORDER BY k > 1, doc_id) AS place FROM a QUALIFY place <= 10""",
)
def coverage_sample(t: Tables) -> DataFrame:
    """One document of each authority first, then others by id, ten in all."""
    return curation.sample_covering(classed(t), "authority", "doc_id", 10)


@query("extension_breakdown", rf"SELECT lower(regexp_extract(name, '\.([A-Za-z0-9]+)$', 1)) AS extension, count(*) AS n FROM {NAMED} GROUP BY 1")
def extension_breakdown(t: Tables) -> DataFrame:
    return names(t).groupBy(F.lower(F.regexp_extract("name", r"\.([A-Za-z0-9]+)$", 1)).alias("extension")).agg(F.count("*").alias("n"))


@query("folder_summary", "SELECT string_split(regexp_replace(url, '^[a-z]+://', ''), '/')[2] AS folder, count(*) AS n, sum(length(html))::BIGINT AS chars FROM pages GROUP BY 1")
def folder_summary(t: Tables) -> DataFrame:
    folder = F.get(F.split(F.regexp_replace("url", "^[a-z]+://", ""), "/"), F.lit(1))
    return t.pages.groupBy(folder.alias("folder")).agg(F.count("*").alias("n"), F.sum(F.length("html")).alias("chars"))


@query("document_pages", "SELECT doc_id, source, n_chars FROM documents ORDER BY doc_id DESC LIMIT 50 OFFSET 25")
def document_pages(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", "source", "n_chars").orderBy(F.desc("doc_id")).offset(25).limit(50)


@query("shard_filter", "SELECT doc_id FROM (SELECT doc_id, ('0x' || substr(sha256(doc_id::VARCHAR), 1, 12))::BIGINT % 4 AS s FROM documents) WHERE s = 2 ORDER BY doc_id LIMIT 40 OFFSET 10")
def shard_filter(t: Tables) -> DataFrame:
    """A page of one shard by the first 48 bits of a hash, in stable order."""
    own = F.conv(F.substring(F.sha2(F.col("doc_id").cast("string"), 256), 1, 12), 16, 10).cast("long") % 4 == 2
    return t.documents.where(own).select("doc_id").orderBy("doc_id").offset(10).limit(40)


@query(
    "duplicate_names",
    "SELECT p_partkey, p_name, first FROM (SELECT p_partkey, p_name, min(p_partkey) OVER (PARTITION BY p_name, p_brand) AS first FROM part) WHERE p_partkey <> first",
)
def duplicate_names(t: Tables) -> DataFrame:
    """Parts of a name and brand that a smaller key has, too."""
    first = t.part.groupBy("p_name", "p_brand").agg(F.min("p_partkey").alias("first"))
    return t.part.join(first, ["p_name", "p_brand"]).where("p_partkey <> first").select("p_partkey", "p_name", "first")


@query(
    "near_names",
    "WITH n AS (SELECT DISTINCT p_name AS name FROM part) SELECT a.name AS a, b.name AS b, levenshtein(a.name, b.name) AS distance FROM n a JOIN n b ON a.name < b.name AND levenshtein(a.name, b.name) < 5",
)
def near_names(t: Tables) -> DataFrame:
    return curation.near_strings(t.part.select(F.col("p_name").alias("name")).distinct(), "name", 4)


@query(
    "knowledge_rules",
    """WITH r AS (SELECT item_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z]{5,}'))) AS w FROM benchmark), q AS (SELECT conv_id, turn, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z]{5,}'))) AS w FROM conversations WHERE role = 'user'),
    s AS (SELECT conv_id, turn, item_id, count(*)::DOUBLE AS score FROM q JOIN r USING (w) GROUP BY ALL) SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY score DESC, item_id) AS rank FROM s QUALIFY rank <= 3""",
)
def knowledge_rules(t: Tables) -> DataFrame:
    """The rules that share most words with a message."""
    words = lambda df, *keys: df.select(*keys, F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]{5,})"), F.lit(1)))).alias("term"))
    messages = words(t.conversations.where("role = 'user'"), F.struct("conv_id", "turn").alias("query_id"))
    rules = words(t.benchmark, F.col("item_id").alias("doc_id"), F.lit(0).alias("chunk_index"))
    best = overlap.overlap_top(messages, rules, 3)
    return best.select("query_id.*", F.col("doc_id").alias("item_id"), F.col("score").cast("double").alias("score"), "rank")


@query(
    "shared_tokens",
    """SELECT l.doc_id, array_to_string(list_sort(list_intersect(list_distinct(regexp_extract_all(lower(d.text), '[a-z]{4,}')), list_distinct(regexp_extract_all(lower(e.text), '[a-z]{4,}')))), ' ') AS shared
    FROM labels l JOIN documents d USING (doc_id) JOIN documents e ON e.doc_id = l.doc_id + 1""",
)
def shared_tokens(t: Tables) -> DataFrame:
    """Words that a labelled document shares with the next one."""
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]{4,})"), F.lit(1)))
    bags = t.documents.select("doc_id", words.alias("bag"))
    following = bags.select((F.col("doc_id") - 1).alias("doc_id"), F.col("bag").alias("other"))
    both = t.labels.select("doc_id").join(bags, "doc_id").join(following, "doc_id")
    return both.select("doc_id", F.array_join(F.sort_array(F.array_intersect("bag", "other")), " ").alias("shared"))


#: Sentences that documents stand for, by id: contract language with figures.
CLAUSES = (
    "The Contractor shall provide a generator of 500 kW.", "The Employer must give access within 28 days.", "Payment will be made in forty days at USD 1,250,000.00.", "Use C40 concrete to BS EN 206 and ASTM C150.",
    "Retention is 5% of AED 3,000.50.", "The chiller is required by milestone two.", "Rebar grade B500B to ISO 6935.", "Two hundred and five metres of fence.", "Delay damages are 0.1% a day.", "Scale 1:100, Rev C, Drawing A-101.",
)
SAID = f"(SELECT doc_id, {LIST(CLAUSES)}[(doc_id % {len(CLAUSES)})::INTEGER + 1] || ' ' || {LIST(CLAUSES)}[(doc_id * 3 % {len(CLAUSES)})::INTEGER + 1] || ' ' || coalesce(text, '') AS text FROM documents)"


def said(t: Tables) -> DataFrame:
    second = F.element_at(F.array(*map(F.lit, CLAUSES)), (F.col("doc_id") * 3 % len(CLAUSES) + 1).cast("int"))
    return t.documents.select("doc_id", F.concat_ws(" ", PICK(CLAUSES, "doc_id"), second, F.coalesce("text", F.lit(""))).alias("text"))


SENTENCES = rf"(SELECT doc_id, unnest(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))) AS sentence FROM {SAID})"
KIND = "CASE " + " ".join(f"WHEN {' OR '.join(f'''contains(lower(sentence), '{w}')''' for w in words)} THEN '{k}'" for k, words in mining.REQUIREMENTS.items()) + " ELSE 'general' END"


@query(
    "requirement_mining",
    f"""SELECT doc_id, trim(sentence) AS sentence, {KIND} AS category, upper(regexp_extract(sentence, '(?i)\\b(SHALL|MUST|REQUIRED|WILL BE REQUIRED)\\b', 1)) AS obligation FROM {SENTENCES}
    WHERE length(sentence) >= 10 AND regexp_matches(sentence, '(?i)\\b(SHALL|MUST|REQUIRED|WILL BE REQUIRED)\\b')""",
)
def requirement_mining(t: Tables) -> DataFrame:
    return mining.requirements(said(t))


@query(
    "standards_scan",
    f"""SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(text, '{mining.STANDARD}'))), '; ') AS standards, array_to_string(list_sort(list_distinct(regexp_extract_all(text, '{mining.GRADE}'))), '; ') AS grades FROM {SAID}""",
)
def standards_scan(t: Tables) -> DataFrame:
    listed = lambda p: F.array_join(F.sort_array(F.array_distinct(F.regexp_extract_all("text", F.lit(p), F.lit(0)))), "; ")
    return said(t).select("doc_id", listed(mining.STANDARD).alias("standards"), listed(mining.GRADE).alias("grades"))


@query(
    "money_figures",
    f"""WITH f AS (SELECT doc_id, unnest(regexp_extract_all(text, '{mining.MONEY}', 0)) AS raw FROM {SAID}) SELECT doc_id, substr(raw, 1, 3) AS currency, sum(replace(regexp_extract(raw, '[0-9][0-9,.]*[0-9]'), ',', '')::DECIMAL(38,2))::DOUBLE AS total, count(*) AS n FROM f GROUP BY ALL""",
)
def money_figures(t: Tables) -> DataFrame:
    return mining.money_figures(said(t))


@query(
    "money_grounding",
    f"""WITH f AS (SELECT doc_id, unnest(regexp_extract_all(text, '{mining.MONEY}', 0)) AS raw FROM {SAID}), v AS (SELECT doc_id, replace(regexp_extract(raw, '[0-9][0-9,.]*[0-9]'), ',', '')::DOUBLE AS value FROM f),
    k AS (SELECT doc_id, (doc_id % 2 * 1250000 + 3000)::DOUBLE AS known FROM documents) SELECT doc_id, count(*) AS n, count(*) FILTER (abs(value - known) <= 0.01 * known OR abs(value - known - 1250000) <= 12500) AS grounded FROM v JOIN k USING (doc_id) GROUP BY 1""",
)
def money_grounding(t: Tables) -> DataFrame:
    """Figures of a text that are within a hundredth of a known result."""
    known = (F.col("doc_id") % 2 * 1250000 + 3000).cast("double")
    values = mining.money_values(said(t))
    near = (F.abs(F.col("value") - known) <= 0.01 * known) | (F.abs(F.col("value") - known - 1250000) <= 12500)
    return values.groupBy("doc_id").agg(F.count("*").alias("n"), F.count_if(near).alias("grounded"))


@query(
    "title_blocks",
    rf"""SELECT doc_id, nullif(regexp_extract(text, '(?i)\bscale\s+(1:\d+)', 1), '') AS scale, nullif(upper(regexp_extract(text, '(?i)\brev\s+([A-Z0-9]{{1,3}})\b', 1)), '') AS revision, nullif(regexp_extract(text, '(?i)\bdrawing\s+([A-Z]{{1,3}}[-_]?\d{{3,6}})', 1), '') AS drawing FROM {SAID}""",
)
def title_blocks(t: Tables) -> DataFrame:
    return said(t).select("doc_id", *mining.title_block(F.col("text")))


@query(
    "number_words",
    f"""WITH w AS (SELECT doc_id, string_split(lower({LIST(mining.WORDED)}[(doc_id % {len(mining.WORDED)})::INTEGER + 1]), ' ') AS words FROM documents) SELECT doc_id, {LIST(mining.WORDED.values())}[list_position({LIST(mining.WORDED)}, array_to_string(words, ' '))]::DOUBLE AS value FROM w""",
)
def number_words(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", mining.worded_number(PICK(tuple(mining.WORDED), "doc_id")).alias("value"))


@query(
    "text_predicates",
    r"""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '') AS w FROM documents)
    SELECT doc_id, len(list_filter(range(3, len(w) + 1), lambda i: w[i] = w[i - 1] AND w[i] = w[i - 2])) > 0 AS repeated_run, len(list_filter(w, lambda x: regexp_full_match(x, '[a-z]{1,3}-?[0-9]+[a-z]?'))) AS n_tags FROM w""",
)
def text_predicates(t: Tables) -> DataFrame:
    """Whether a word stands three times in a row, and how many words are tags of drawings."""
    words = F.filter(F.split(F.lower("text"), r"\s+"), lambda w: w != "")
    held = t.documents.select("doc_id", words.alias("w"))
    tags = F.size(F.filter("w", lambda w: w.rlike("^[a-z]{1,3}-?[0-9]+[a-z]?$"))).cast("long")
    return held.select("doc_id", mining.repeated_run(F.col("w"), 3).alias("repeated_run"), tags.alias("n_tags"))


@query(
    "extraction_confidence",
    """WITH s AS (SELECT doc_id, [CASE WHEN text IS NOT NULL THEN least(1.0, length(text) / 2000.0) END, CASE WHEN n_chars > 0 THEN 1.0 END, CASE lang WHEN 'en' THEN 0.9 WHEN 'de' THEN 0.7 END]::DOUBLE[] AS signals FROM documents)
    SELECT doc_id, list_sum(list_filter(signals, lambda x: x IS NOT NULL)) / nullif(len(list_filter(signals, lambda x: x IS NOT NULL)), 0) AS confidence FROM s""",
)
def extraction_confidence(t: Tables) -> DataFrame:
    """The mean of the signals that there are: density of text, a known length, a language."""
    signals = (F.least(F.lit(1.0), F.length("text") / 2000.0), F.when(F.col("n_chars") > 0, 1.0), F.when(F.col("lang") == "en", 0.9).when(F.col("lang") == "de", 0.7))
    return t.documents.select("doc_id", mining.mean_of(*signals).alias("confidence"))


@query(
    "rule_predicates",
    """SELECT l_orderkey, l_linenumber, l_partkey, (l_quantity > 30)::INTEGER + (l_discount BETWEEN 0.02 AND 0.05)::INTEGER + contains(lower(l_returnflag), 'r')::INTEGER AS hits FROM lineitem""",
)
def rule_predicates(t: Tables) -> DataFrame:
    rules = [("l_quantity", "gt", 30), ("l_discount", "between", (0.02, 0.05)), ("l_returnflag", "contains", "R")]
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", curation.rules_met(rules).cast("int").alias("hits"))


@query("retention_purge", "SELECT event_type, count(*) AS n FROM events WHERE ts < TIMESTAMP '2024-01-20' - INTERVAL 7 DAY GROUP BY 1")
def retention_purge(t: Tables) -> DataFrame:
    """What a retention of seven days as of a stated day would remove."""
    return curation.expired(t.events, "ts", "2024-01-20", 7).groupBy("event_type").agg(F.count("*").alias("n"))


@query(
    "template_success",
    "SELECT event_type AS template, user_id % 5 AS project_type, count(*) AS uses, count_if(value >= 30) * 100.0::DOUBLE / count(*) AS success_pct FROM events GROUP BY ALL HAVING count(*) >= 3",
)
def template_success(t: Tables) -> DataFrame:
    rate = F.count_if(F.col("value") >= 30) * 100.0 / F.count("*")
    return t.events.groupBy(F.col("event_type").alias("template"), (F.col("user_id") % 5).alias("project_type")).agg(F.count("*").alias("uses"), rate.alias("success_pct")).where("uses >= 3")


@query(
    "tier_distribution",
    """WITH f AS (SELECT user_id, count(*) AS n FROM events GROUP BY 1) SELECT CASE WHEN n >= 200 THEN 'platinum' WHEN n >= 50 THEN 'gold' WHEN n >= 10 THEN 'silver' ELSE 'bronze' END AS tier, count(*) AS n FROM f GROUP BY 1""",
)
def tier_distribution(t: Tables) -> DataFrame:
    uses = t.events.groupBy("user_id").agg(F.count("*").alias("n"))
    tier = F.when(F.col("n") >= 200, "platinum").when(F.col("n") >= 50, "gold").when(F.col("n") >= 10, "silver").otherwise("bronze")
    return uses.groupBy(tier.alias("tier")).agg(F.count("*").alias("n"))


@query(
    "error_trend",
    """SELECT event_id, user_id, n FROM (SELECT event_id, user_id, count(*) FILTER (event_type = 'error') OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS n FROM events) WHERE n >= 3""",
)
def error_trend(t: Tables) -> DataFrame:
    """Events after which three or more of a user's last ten were errors."""
    n = F.count(F.when(F.col("event_type") == "error", 1)).over(ranking.rolling(["user_id"], ["ts", "event_id"], 10))
    return t.events.select("event_id", "user_id", n.alias("n")).where("n >= 3")


@query(
    "latest_observations",
    """WITH k AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) SELECT user_id, array_to_string(list(event_id ORDER BY k DESC), ',') AS ids, count(*) AS n FROM k WHERE k <= 10 GROUP BY 1""",
)
def latest_observations(t: Tables) -> DataFrame:
    """The last ten of each user, oldest first."""
    last = ranking.top(t.events.select("user_id", "event_id", "ts"), ["user_id"], [F.desc("ts"), F.desc("event_id")], 10, "k")
    return last.groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("k")).alias("k"), "event_id"))), lambda x: x.event_id), ",").alias("ids"), F.count("*").alias("n"))


@query(
    "daily_budgets",
    """WITH d AS (SELECT user_id, date_trunc('day', ts) AS day, sum(value::DECIMAL(38,6))::DOUBLE AS used FROM events GROUP BY ALL) SELECT *, greatest(0, 100 - used) AS "left", used >= 100 AS degraded FROM d""",
)
def daily_budgets(t: Tables) -> DataFrame:
    from ..streaming.events import daily_budget

    return daily_budget(t.events, "user_id", "value", 100.0)


@query(
    "health_aggregate",
    """WITH s AS (SELECT user_id, event_type, CASE WHEN m >= 60 THEN 100 WHEN m >= 40 THEN 60 ELSE 20 END AS score FROM (SELECT user_id, event_type, sum(value::DECIMAL(38,6))::DOUBLE / count(value) AS m FROM events GROUP BY ALL)), a AS (SELECT user_id, sum(score)::DOUBLE / count(*) AS score FROM s GROUP BY 1)
    SELECT *, CASE WHEN score >= 80 THEN 'healthy' WHEN score >= 60 THEN 'warning' ELSE 'critical' END AS band FROM a""",
)
def health_aggregate(t: Tables) -> DataFrame:
    """Bands by means of exact decimals, so that one on a limit does not depend on the order of its values."""
    mean = F.sum(F.col("value").cast("decimal(38,6)")).cast("double") / F.count("value")
    domains = t.events.groupBy("user_id", "event_type").agg(mean.alias("m"))
    score = F.when(F.col("m") >= 60, 100).when(F.col("m") >= 40, 60).otherwise(20)
    both = domains.groupBy("user_id").agg((F.sum(score).cast("double") / F.count("*")).alias("score"))
    return both.withColumn("band", F.when(F.col("score") >= 80, "healthy").when(F.col("score") >= 60, "warning").otherwise("critical"))


@query(
    "spend_caps",
    """WITH c AS (SELECT user_id, ts::DATE AS day, sum((value * CASE event_type WHEN 'click' THEN 0.002 WHEN 'view' THEN 0.001 ELSE 0 END)::DECIMAL(38,8))::DOUBLE AS cost FROM events GROUP BY ALL) SELECT *, cost >= 0.2 AS over FROM c""",
)
def spend_caps(t: Tables) -> DataFrame:
    """Cost by a price list; what has no price costs nothing."""
    prices = t.events.sparkSession.createDataFrame([("click", 0.002), ("view", 0.001)], "event_type string, price double")
    priced = t.events.join(F.broadcast(prices), "event_type", "left")  # one row for each price
    cost = F.sum((F.col("value") * F.coalesce("price", F.lit(0.0))).cast("decimal(38,8)")).cast("double")
    return priced.groupBy("user_id", F.to_date("ts").alias("day")).agg(cost.alias("cost")).withColumn("over", F.col("cost") >= 0.2)


@query(
    "json_rows",
    """SELECT event_type, sum((json_extract(props, '$.k'))::BIGINT)::BIGINT AS total, count(*) FILTER (json_extract(props, '$.k') IS NULL) AS without FROM events GROUP BY 1""",
)
def json_rows(t: Tables) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    return t.events.groupBy("event_type").agg(F.sum(k).alias("total"), F.count_if(k.isNull()).alias("without"))


@query(
    "label_split",
    """SELECT quality, toxic, ('0x' || substr(md5('split' || doc_id::VARCHAR), 1, 8))::BIGINT % 5 = 0 AS held_out, count(*) AS n FROM labels GROUP BY ALL""",
)
def label_split(t: Tables) -> DataFrame:
    """A fifth of each class held out by a hash of the id."""
    out = F.conv(F.substring(F.md5(F.concat(F.lit("split"), F.col("doc_id").cast("string"))), 1, 8), 16, 10).cast("long") % 5 == 0
    return t.labels.groupBy("quality", "toxic", out.alias("held_out")).agg(F.count("*").alias("n"))


@query(
    "cumulative_checks",
    """WITH c AS (SELECT o_custkey, sum(o_totalprice::DECIMAL(38,4)) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING) - (o_orderkey % 7 = 0)::INTEGER * 100000 AS x, o_orderdate, o_orderkey FROM orders),
    d AS (SELECT o_custkey, x < lag(x) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS falls FROM c) SELECT o_custkey, count(*) AS n, count(*) FILTER (falls) AS falls FROM d GROUP BY 1""",
)
def cumulative_checks(t: Tables) -> DataFrame:
    """How often a running total, as reported, falls."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    reported = F.sum(F.col("o_totalprice").cast("decimal(38,4)")).over(w.rowsBetween(Window.unboundedPreceding, 0)) - (F.col("o_orderkey") % 7 == 0).cast("int") * 100000
    totals = t.orders.select("o_custkey", "o_orderdate", "o_orderkey", reported.alias("x"))
    falls = totals.withColumn("falls", F.col("x") < F.lag("x").over(w))
    return falls.groupBy("o_custkey").agg(F.count("*").alias("n"), F.count_if("falls").alias("falls"))


@query(
    "pipe_length_totals",
    """WITH r AS (SELECT p_size AS diameter, l_quantity AS depth, l_extendedprice::DECIMAL(38,4) AS length FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_brand <> 'Brand#1'),
    b AS (SELECT diameter, CASE WHEN depth <= 10 THEN 'shallow' WHEN depth <= 30 THEN 'middle' ELSE 'deep' END AS band, length FROM r)
    SELECT diameter, band, sum(length)::DOUBLE AS length, count(*) AS n FROM b GROUP BY GROUPING SETS ((diameter), (band), ())""",
)
def pipe_length_totals(t: Tables) -> DataFrame:
    """Lengths by diameter and by band of depth; one class of parts is ancillary and left out, as the operator does."""
    both = t.lineitem.join(t.part.where("p_brand <> 'Brand#1'"), F.col("l_partkey") == F.col("p_partkey"))
    band = F.when(F.col("l_quantity") <= 10, "shallow").when(F.col("l_quantity") <= 30, "middle").otherwise("deep")
    rows = both.select(F.col("p_size").alias("diameter"), band.alias("band"), F.col("l_extendedprice").cast("decimal(38,4)").alias("length"))
    sets = rows.groupingSets([[F.col("diameter")], [F.col("band")], []], F.col("diameter"), F.col("band"))
    return sets.agg(F.sum("length").cast("double").alias("length"), F.count("*").alias("n"))
