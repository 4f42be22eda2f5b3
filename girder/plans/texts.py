"""Text, curation and retrieval queries on documents, conversations, pages and embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import corpus
from ..registry import Tables, query


@query(
    "chunk_words",
    r"""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS words FROM documents)
    SELECT doc_id, i::INTEGER AS chunk_index, array_to_string(words[i * 100 + 1 : i * 100 + 100], ' ') AS text FROM w, unnest(range(0, ((len(words) + 99) // 100)::BIGINT)) AS u(i)""",
)
def chunk_words(t: Tables) -> DataFrame:
    return corpus.word_chunks(t.documents, 100)


@query(
    "chunk_sliding",
    """SELECT doc_id, i::INTEGER AS chunk_index, substr(text, (i * 462 + 1)::BIGINT, 512) AS text FROM documents, unnest(range(0, 1 + greatest(0, ceil((length(text) - 512) / 462.0)::BIGINT))) AS u(i)
    WHERE length(text) > 0""",
)
def chunk_sliding(t: Tables) -> DataFrame:
    return corpus.sliding_chunks(t.documents, 512, 50)


@query(
    "top_keywords",
    """SELECT word, count(*) AS n FROM (SELECT unnest(regexp_split_to_array(lower(text), '[^a-z0-9]+')) AS word FROM conversations WHERE role = 'user')
    WHERE length(word) >= 4 AND word NOT IN ('that', 'with', 'this', 'from', 'have') GROUP BY 1 ORDER BY n DESC, word LIMIT 25""",
)
def top_keywords(t: Tables) -> DataFrame:
    words = t.conversations.where("role = 'user'").select(F.explode(tx.tokens(F.col("text"), 4)).alias("word"))
    return words.where(~F.col("word").isin("that", "with", "this", "from", "have")).groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(25)


# What users say when something is wrong.
COMPLAINT = r"(?i)\b(error|broken|doesn'?t work|not working|wrong|fail(ed|s)?|missing|empty|why|stuck|help)\b"


@query(
    "friction_signals",
    """WITH u AS (SELECT conv_id, lower(trim(substr(text, 1, 40))) AS head, regexp_matches(text, '{}') AS complains FROM conversations WHERE role = 'user'), g AS (SELECT conv_id, head, count(*) AS n, count_if(complains) AS c FROM u GROUP BY ALL)
    SELECT conv_id, sum(CASE WHEN head <> '' THEN n - 1 ELSE 0 END)::BIGINT AS repeats, sum(c)::BIGINT AS complaints FROM g GROUP BY 1""".format(COMPLAINT.replace("'", "''")),
)
def friction_signals(t: Tables) -> DataFrame:
    """Complaints are sought in whole messages; those with the same first 40 characters are repeats."""
    users = t.conversations.where("role = 'user'")
    heads = users.groupBy("conv_id", F.lower(F.trim(F.substring("text", 1, 40))).alias("head")).agg(F.count("*").alias("n"), F.count_if(F.col("text").rlike(COMPLAINT)).alias("c"))
    return heads.groupBy("conv_id").agg(F.sum(F.when(F.col("head") != "", F.col("n") - 1).otherwise(0)).alias("repeats"), F.sum("c").alias("complaints"))


@query(
    "top_user_asks",
    """SELECT substr(text, 1, 60) AS ask, min(conv_id * 1000 + turn) AS first_seen FROM conversations WHERE role = 'user' GROUP BY 1 ORDER BY first_seen, ask LIMIT 20""",
)
def top_user_asks(t: Tables) -> DataFrame:
    asks = t.conversations.where("role = 'user'").groupBy(F.substring("text", 1, 60).alias("ask")).agg(F.min(F.col("conv_id") * 1000 + F.col("turn")).alias("first_seen"))
    return asks.orderBy("first_seen", "ask").limit(20)


@query(
    "chat_pairs",
    """SELECT conv_id, turn, text AS prompt, reply FROM (SELECT *, lead(role) OVER w AS next_role, lead(text) OVER w AS reply FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
    WHERE role = 'user' AND next_role = 'assistant' AND length(text) BETWEEN 20 AND 2000 AND length(reply) BETWEEN 20 AND 2000""",
)
def chat_pairs(t: Tables) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn")
    both = t.conversations.withColumn("next_role", F.lead("role").over(w)).withColumn("reply", F.lead("text").over(w))
    fits = F.length("text").between(20, 2000) & F.length("reply").between(20, 2000)
    return both.where((F.col("role") == "user") & (F.col("next_role") == "assistant") & fits).select("conv_id", "turn", F.col("text").alias("prompt"), "reply")


@query(
    "identifier_extract",
    """SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(text, '([A-Z]{1,4}-?[0-9]{2,})', 1))), ' ') AS ids, len(list_distinct(regexp_extract_all(text, '([A-Z]{1,4}-?[0-9]{2,})', 1))) AS n
    FROM documents""",
)
def identifier_extract(t: Tables) -> DataFrame:
    found = t.documents.select("doc_id", tx.identifiers(F.col("text")).alias("found"))
    return found.select("doc_id", F.array_join(F.sort_array("found"), " ").alias("ids"), F.size("found").cast("long").alias("n"))


CATEGORIES = {"first": "tion", "second": "ment", "third": "ung", "fourth": "ing"}


@query(
    "category_earliest",
    """WITH p AS (SELECT doc_id, strpos(lower(text), 'tion') AS a, strpos(lower(text), 'ment') AS b, strpos(lower(text), 'ung') AS c, strpos(lower(text), 'ing') AS d FROM documents),
    m AS (SELECT *, least(CASE WHEN a > 0 THEN a ELSE 1000000000 END, CASE WHEN b > 0 THEN b ELSE 1000000000 END, CASE WHEN c > 0 THEN c ELSE 1000000000 END, CASE WHEN d > 0 THEN d ELSE 1000000000 END) AS x FROM p)
    SELECT doc_id, CASE WHEN x = 1000000000 THEN 'other' WHEN a = x THEN 'first' WHEN b = x THEN 'second' WHEN c = x THEN 'third' ELSE 'fourth' END AS category FROM m""",
)
def category_earliest(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", tx.earliest(F.col("text"), CATEGORIES, "other").alias("category"))


@query(
    "doc_type_scores",
    """SELECT doc_id, (2 * regexp_matches(lower(text), 'rights')::INTEGER + regexp_matches(lower(text), 'license|permission')::INTEGER) AS licence,
    regexp_matches(text, '(password|token) *=')::INTEGER AS secret, (length(text) - length(replace(text, '|', '')))::INTEGER AS bars FROM documents""",
)
def doc_type_scores(t: Tables) -> DataFrame:
    low = F.lower("text")
    licence = 2 * low.rlike("rights").cast("int") + low.rlike("license|permission").cast("int")
    bars = F.length("text") - F.length(F.replace("text", F.lit("|"), F.lit("")))
    return t.documents.select("doc_id", licence.alias("licence"), F.col("text").rlike("(password|token) *=").cast("int").alias("secret"), bars.alias("bars"))


@query("scrub_text", "SELECT doc_id, md5(replace(replace(text, 'reserved', '[X]'), 'the', '[X]')) AS scrubbed FROM documents")
def scrub_text(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.md5(tx.scrub(F.col("text"), ["the", "reserved"])).alias("scrubbed"))


@query("html_extract", r"SELECT page_id, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS title, len(regexp_extract_all(html, '<p[ >]')) AS n_paragraphs, regexp_extract(url, '^[a-z]+://([^/:]+)', 1) AS host FROM pages")
def html_extract(t: Tables) -> DataFrame:
    title = F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1)
    return t.pages.select("page_id", title.alias("title"), F.regexp_count("html", F.lit("<p[ >]")).cast("long").alias("n_paragraphs"), F.regexp_extract("url", "^[a-z]+://([^/:]+)", 1).alias("host"))


@query(
    "quality_gate_counts",
    "SELECT source, count(*) AS n, count(*) FILTER (text IS NULL OR text = '') AS n_empty, count(*) FILTER (length(text) BETWEEN 1 AND 28) AS n_short FROM documents GROUP BY 1",
)
def quality_gate_counts(t: Tables) -> DataFrame:
    empty = F.col("text").isNull() | (F.col("text") == "")
    return t.documents.groupBy("source").agg(F.count("*").alias("n"), F.count_if(empty).alias("n_empty"), F.count_if(F.length("text").between(1, 28)).alias("n_short"))


INSTRUCTION = r"sha1(regexp_replace(regexp_replace(trim(lower(text)), '\s+', ' ', 'g'), '[.!? ]+$', ''))"


@query("instruction_dedupe", f"SELECT min(doc_id) AS doc_id, {INSTRUCTION} AS key, count(*) AS n FROM documents GROUP BY 2")
def instruction_dedupe(t: Tables) -> DataFrame:
    key = F.sha1(F.regexp_replace(F.regexp_replace(F.trim(F.lower("text")), r"\s+", " "), "[.!? ]+$", ""))
    return t.documents.groupBy(key.alias("key")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n")).select("doc_id", "key", "n")


@query(
    "source_drop_report",
    f"""WITH k AS (SELECT source, doc_id, row_number() OVER (PARTITION BY {INSTRUCTION} ORDER BY doc_id) AS r FROM documents)
    SELECT source, count(*) AS before, count(*) FILTER (r = 1) AS after, count(*) FILTER (r > 1) * 100.0::DOUBLE / count(*) AS drop_pct FROM k GROUP BY 1""",
)
def source_drop_report(t: Tables) -> DataFrame:
    first = instruction_dedupe(t).select("doc_id", F.lit(1).alias("kept"))
    marked = t.documents.select("doc_id", "source").join(first, "doc_id", "left")
    dropped = F.count_if(F.col("kept").isNull()) * F.lit(100.0) / F.count("*")
    return marked.groupBy("source").agg(F.count("*").alias("before"), F.count("kept").alias("after"), dropped.alias("drop_pct"))


@query("stratified_counts", "SELECT quality, toxic, (doc_id % 5 = 0) AS held_out, count(*) AS n FROM labels GROUP BY ALL")
def stratified_counts(t: Tables) -> DataFrame:
    return t.labels.groupBy("quality", "toxic", (F.col("doc_id") % 5 == 0).alias("held_out")).agg(F.count("*").alias("n"))


@query(
    "arith_row_gate",
    """SELECT l_returnflag AS flag, count(*) FILTER (abs(l_quantity * p_retailprice - l_extendedprice) <= greatest(1.0, 0.005 * l_extendedprice)) AS n_pass, count(*) AS n
    FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1""",
)
def arith_row_gate(t: Tables) -> DataFrame:
    both = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    fits = F.abs(F.col("l_quantity") * F.col("p_retailprice") - F.col("l_extendedprice")) <= F.greatest(F.lit(1.0), 0.005 * F.col("l_extendedprice"))
    return both.groupBy(F.col("l_returnflag").alias("flag")).agg(F.count_if(fits).alias("n_pass"), F.count("*").alias("n"))


UNIT = "(SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE / nullif(sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE))), 0)) AS v FROM embeddings)"
COSINE = f"""(SELECT query_id, vec_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM (SELECT q.vec_id AS query_id, e.vec_id, round(list_dot_product(e.v, q.v), 6) AS score
FROM {UNIT} e, {UNIT} q WHERE q.vec_id % 50 = 0)) WHERE rank <= 10)"""


def nearest(t: Tables) -> DataFrame:
    return corpus.cosine_top(t.embeddings, t.embeddings.where("vec_id % 50 = 0"), 10)


@query("cosine_topk", f"SELECT * FROM {COSINE}")
def cosine_topk(t: Tables) -> DataFrame:
    return nearest(t)


@query("recall_at_k", f"SELECT avg(hit) AS recall, count(*) AS n FROM (SELECT query_id, max(CASE WHEN e.label = q.label THEN 1.0 ELSE 0.0 END)::DOUBLE AS hit FROM {COSINE} c JOIN embeddings e USING (vec_id) JOIN embeddings q ON q.vec_id = c.query_id WHERE rank > 1 GROUP BY 1)")
def recall_at_k(t: Tables) -> DataFrame:
    hits = nearest(t).where("rank > 1").join(t.embeddings.select("vec_id", "label"), "vec_id")
    asked = t.embeddings.select(F.col("vec_id").alias("query_id"), F.col("label").alias("wanted"))
    return hits.join(asked, "query_id").groupBy("query_id").agg(F.max(F.when(F.col("label") == F.col("wanted"), 1.0).otherwise(0.0)).alias("hit")).agg(F.avg("hit").alias("recall"), F.count("*").alias("n"))


SIZED = f"(SELECT query_id, vec_id, rank, greatest(1, length(coalesce(text, '')) // 4) AS tokens FROM {COSINE} JOIN documents ON vec_id = doc_id)"


@query(
    "token_cap",
    f"""WITH RECURSIVE r AS (SELECT query_id, vec_id, tokens, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS k FROM {SIZED}),
    s AS (SELECT query_id, vec_id, k, tokens <= 2000 AS kept, CASE WHEN tokens <= 2000 THEN tokens ELSE 0 END AS used FROM r WHERE k = 1 UNION ALL
      SELECT r.query_id, r.vec_id, r.k, s.used + r.tokens <= 2000, s.used + CASE WHEN s.used + r.tokens <= 2000 THEN r.tokens ELSE 0 END FROM s JOIN r ON s.query_id = r.query_id AND r.k = s.k + 1)
    SELECT query_id, vec_id FROM s WHERE kept""",
)
def token_cap(t: Tables) -> DataFrame:
    """The nearest documents whose estimated tokens fit into 2,000: one that doesn't is skipped, and later ones are tried."""
    tokens = F.greatest(F.lit(1), F.floor(F.length(F.coalesce("text", F.lit(""))) / 4)).cast("long")
    sized = nearest(t).join(t.documents.select(F.col("doc_id").alias("vec_id"), tokens.alias("tokens")), "vec_id")
    return corpus.token_cap(sized, 2000)
