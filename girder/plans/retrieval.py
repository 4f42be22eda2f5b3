"""Retrieval: questions are the opening words of documents with ids divisible by 50, and conversations; embeddings are of the documents with their ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import questions as qs
from ..functions.text import revision_rank
from ..operators import corpus, overlap, retrieval
from ..operators import lexical as lexical_index
from ..operators.schedule import cut
from ..registry import Tables, query
from .texts import COSINE, nearest
from .works import LIST, PICK

#: What documents are called, by id; the number of their drawing and their revision go in.
NAMES = (
    "A-{0} Rev {1} floor plan.pdf", "Contract agreement {0}.docx", "Priced BOQ {0}.xlsx", "PRC {0} procedure.pdf", "Weekly report {0}.pdf", "superseded S_{0}_R{1} section.dwg",
    "~$lock {0}.tmp", "memo {0}.txt", "M{0}-Rev{2} layout.dwg", "notes on {0}",
)
REVISIONS, NUMBERS = ("A", "B", "C", "AA"), ("1", "2", "9", "10")


def names(t: Tables) -> DataFrame:
    put = lambda c, mark, value: F.replace(c, F.lit(mark), value)
    text = put(put(put(PICK(NAMES, "doc_id"), "{0}", (F.col("doc_id") % 40 + 100).cast("string")), "{1}", PICK(REVISIONS, "doc_id")), "{2}", PICK(NUMBERS, "doc_id"))
    return t.documents.select("doc_id", text.alias("name"))


PICKED = lambda table: f"{LIST(table)}[(doc_id % {len(table)})::INTEGER + 1]"
NAMED = f"(SELECT doc_id, lang, replace(replace(replace({PICKED(NAMES)}, '{{0}}', (doc_id % 40 + 100)::VARCHAR), '{{1}}', {PICKED(REVISIONS)}), '{{2}}', {PICKED(NUMBERS)}) AS name FROM documents)"


@query("boundary_chunks")
def boundary_chunks(t: Tables) -> DataFrame:
    return retrieval.boundary_chunks(t.documents)


@query("markdown_chunks")
def markdown_chunks(t: Tables) -> DataFrame:
    return retrieval.markdown_chunks(t.documents)


@query(
    "markdown_rows",
    r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS content, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM documents)
    SELECT doc_id, line::INTEGER AS line, array_to_string(list_transform(string_split(regexp_replace(trim(content), '^\||\|$', '', 'g'), '|'), lambda c: trim(c)), ' / ') AS cells FROM l
    WHERE trim(content) LIKE '|%' AND NOT regexp_full_match(content, '\s*\|[\s:|-]+\|\s*')""",
)
def markdown_rows(t: Tables) -> DataFrame:
    return retrieval.markdown_rows(t.documents).withColumn("cells", F.array_join("cells", " / "))


@query(
    "boundary_row_lines",
    r"""SELECT doc_id, len(regexp_extract_all(text, '\|')) AS bars, len(string_split(text, chr(10))) AS lines, array_to_string(list_slice(list_filter(regexp_split_to_array(trim(text), '\s+'), lambda w: true), 1, 50), ' ') AS snippet FROM documents""",
)
def boundary_row_lines(t: Tables) -> DataFrame:
    """What the chunkers cut at, and the first fifty words."""
    lines = F.size(F.split("text", "\n", -1)).cast("long")
    return t.documents.select("doc_id", F.regexp_count("text", F.lit(r"\|")).cast("long").alias("bars"), lines.alias("lines"), qs.snippet(F.col("text")).alias("snippet"))


STOP = LIST(qs.STOP_WORDS)
TERMS = f"list_filter(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]{{4,}}')), lambda w: NOT list_contains({STOP}, w))"


@query("significant_terms", f"SELECT conv_id, turn, len({TERMS}) AS n, array_to_string(list_sort({TERMS}), ' ') AS terms FROM conversations")
def significant_terms(t: Tables) -> DataFrame:
    terms = qs.significant_terms(F.col("text"))
    return t.conversations.select("conv_id", "turn", F.size(terms).cast("long").alias("n"), F.array_join(F.sort_array(terms), " ").alias("terms"))


@query(
    "rescue_pairs",
    f"""WITH w AS (SELECT conv_id, turn, unnest(regexp_extract_all(text, '[A-Za-z][A-Za-z0-9]{{3,}}')) AS w, generate_subscripts(regexp_extract_all(text, '[A-Za-z][A-Za-z0-9]{{3,}}'), 1) AS i FROM conversations),
    f AS (SELECT conv_id, turn, lower(w) AS term, arg_min(w, i) AS w, min(i) AS i FROM w GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY (NOT regexp_matches(substr(w, 1, 1), '[A-Z]')), -length(w), i) AS r FROM f
      WHERE NOT list_contains({LIST((*qs.STOP_WORDS, *qs.MORE_STOP_WORDS))}, term)),
    t AS (SELECT conv_id, turn, list(term ORDER BY r) AS terms FROM k WHERE r <= 5 GROUP BY ALL)
    SELECT conv_id, turn, array_to_string(terms, ' ') AS terms, (len(terms) * (len(terms) - 1) // 2)::BIGINT AS n_pairs FROM t""",
)
def rescue_pairs(t: Tables) -> DataFrame:
    found = t.conversations.select("conv_id", "turn", qs.rescue_terms(F.col("text")).alias("t")).where(F.size("t") > 0)
    return found.select("conv_id", "turn", F.array_join("t", " ").alias("terms"), F.size(qs.pairs(F.col("t"))).cast("long").alias("n_pairs"))


#: Question words between characters of no word, in any script; a second pass finds those that share one with the word before.
ASKING = lambda text: f"regexp_replace({text}, '{QUESTION_WORD}', '\\1 \\2', 'g')"
QUESTION_WORD = r"(?i)(^|[^\p{L}\p{N}_])(?:how\s+(?:many|much|long)|what|which|who|whose|when|why|does|did|please)([^\p{L}\p{N}_]|$)"
LED = r"""regexp_replace(regexp_replace(base, '(?i)^(?:in|from|under|per|according\s+to|based\s+on|as\s+per)\s+[^,]{1,60},\s*', ''), '(?i)^(?:please\s+)?(?:tell\s+me|give\s+me|show\s+me|state|list|specify)\s+', '')"""
ASKS = ("In the contract, how many days is ", "Please tell me the ", "What is ", "", "List ", "Which of these does ")


@query(
    "unwrapped_questions",
    rf"""WITH q AS (SELECT conv_id, turn, regexp_replace(trim(regexp_replace({LIST(ASKS)}[(conv_id % 6)::INTEGER + 1] || array_to_string(list_slice(regexp_split_to_array(trim(text), '\s+'), 1, 8), ' ') || '?', '\?+$', '')), '\s+$', '') AS base FROM conversations),
    b AS (SELECT *, regexp_replace(regexp_replace({ASKING(ASKING(LED))}, '\s{{2,}}', ' ', 'g'), '^[ ,.;:]+|[ ,.;:]+$', '', 'g') AS bare FROM q)
    SELECT conv_id, turn, CASE WHEN len(regexp_split_to_array(bare, '\s+')) >= 3 AND lower(bare) <> lower(base) THEN bare END AS bare FROM b""",
)
def unwrapped_questions(t: Tables) -> DataFrame:
    question = F.concat(PICK(ASKS, "conv_id"), qs.snippet(F.col("text"), 8), F.lit("?"))
    return t.conversations.select("conv_id", "turn", qs.unwrapped(question).alias("bare"))


@query(
    "or_queries",
    r"""SELECT item_id, array_to_string(list_filter(regexp_split_to_array(trim(regexp_replace(text, '[^\w\s]+', ' ', 'g')), '\s+'), lambda w: w <> '' AND lower(w) NOT IN ('or', 'and', 'not')), ' OR ') AS query FROM benchmark""",
)
def or_queries(t: Tables) -> DataFrame:
    return t.benchmark.select("item_id", qs.any_of(F.col("text")).alias("query"))


AUTHORITY = "CASE " + " ".join(f"WHEN regexp_matches(name, '(?i){p}') THEN '{a}'" for a, p in qs.AUTHORITY) + " ELSE CASE layer WHEN 'project_record' THEN 'operational' WHEN 'user_session' THEN 'operational' ELSE 'policy' END END"
LAYER = "CASE doc_id % 4 WHEN 0 THEN 'shared_domain' WHEN 1 THEN 'company_rules' WHEN 2 THEN 'project_record' ELSE 'user_session' END"
CLASSED = f"(SELECT *, {AUTHORITY} AS authority FROM (SELECT *, {LAYER} AS layer FROM {NAMED}))"
BONUS = f"0.05::DOUBLE * (7 - list_position({LIST(qs.STRENGTH)}, authority) + 1) / 7 + 0.05::DOUBLE * map({LIST(qs.LAYERS)}, [1.0, 0.7, 0.5, 0.3]::DOUBLE[])[layer]"


def classed(t: Tables) -> DataFrame:
    n = F.col("doc_id") % 4
    layer = F.when(n == 0, "shared_domain").when(n == 1, "company_rules").when(n == 2, "project_record").otherwise("user_session")
    return names(t).withColumn("layer", layer).withColumn("authority", qs.authority(F.col("name"), F.col("layer")))


@query("document_authority", f"SELECT doc_id, name, layer, authority, {BONUS} AS bonus FROM {CLASSED}")
def document_authority(t: Tables) -> DataFrame:
    return classed(t).withColumn("bonus", qs.precedence_bonus(F.col("layer"), F.col("authority")))


MARKED = rf"""(SELECT *, upper(regexp_extract(name, '(?i)[A-Z]{{1,3}}[-_]?\d{{3,6}}')) AS drawing, upper(regexp_extract(name, '(?:^|[^A-Za-z0-9])[Rr][Ee]?[Vv]?\s*[-_]?\s*([0-9]{{1,3}}|[A-Z]{{1,2}})\b', 1)) AS rev FROM {NAMED})"""
RANKED = f"""(SELECT *, CASE WHEN regexp_full_match(rev, '[0-9]+') THEN 0 WHEN regexp_full_match(rev, '[A-Z]{{1,2}}') THEN 1 END AS kind, CASE WHEN regexp_full_match(rev, '[0-9]+') THEN rev::INTEGER
  WHEN length(rev) = 1 THEN ascii(rev) - 64 WHEN length(rev) = 2 THEN (ascii(rev[1]) - 64) * 26 + ascii(rev[2]) - 64 END AS value FROM {MARKED})"""
CURRENT = f"(SELECT doc_id, name FROM (SELECT *, max(value) OVER (PARTITION BY drawing, kind) AS best FROM {RANKED}) WHERE drawing = '' OR kind IS NULL OR value = best)"


@query("document_revisions", f"SELECT doc_id, drawing, rev, kind, value::INTEGER AS value, regexp_matches(name, '(?i){qs.SUPERSEDED}') AS superseded, regexp_matches(name, '^~') AS noise FROM {RANKED}")
def document_revisions(t: Tables) -> DataFrame:
    rev = qs.revision(F.col("name"))
    r = revision_rank(rev)
    return names(t).select("doc_id", qs.drawing_number(F.col("name")).alias("drawing"), rev.alias("rev"), r["kind"].alias("kind"), r["value"].alias("value"), qs.superseded(F.col("name")).alias("superseded"), F.col("name").rlike(qs.LOCK_FILE).alias("noise"))


@query("current_documents", f"SELECT * FROM {CURRENT}")
def current_documents(t: Tables) -> DataFrame:
    return retrieval.current(names(t))


@query("noise_filter", f"SELECT count(*) AS n, count(*) FILTER (regexp_matches(name, '^~')) AS dropped FROM {NAMED}")
def noise_filter(t: Tables) -> DataFrame:
    return names(t).agg(F.count("*").alias("n"), F.count_if(F.col("name").rlike(qs.LOCK_FILE)).alias("dropped"))


@query(
    "identifier_search",
    f"""WITH q AS (SELECT doc_id AS query_id, unnest(['a-' || (doc_id % 40 + 100)::VARCHAR, 'rev b', 'boq ' || (doc_id % 40 + 101)::VARCHAR]) AS identifier FROM documents WHERE doc_id % 50 = 0),
    p AS (SELECT DISTINCT query_id, identifier, unnest(list_filter(regexp_split_to_array(identifier, '[^a-z0-9]+'), lambda w: w <> '')) AS token FROM q),
    k AS (SELECT DISTINCT doc_id, unnest(list_filter(regexp_split_to_array(lower(name), '[^a-z0-9]+'), lambda w: w <> '')) AS token FROM {NAMED}),
    n AS (SELECT query_id, identifier, count(*) AS need FROM p GROUP BY ALL), h AS (SELECT query_id, identifier, doc_id, count(*) AS have FROM p JOIN k USING (token) GROUP BY ALL),
    s AS (SELECT query_id, doc_id, count(*) / 3.0::DOUBLE AS score FROM h JOIN n USING (query_id, identifier) WHERE have = need GROUP BY ALL)
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s""",
)
def identifier_search(t: Tables) -> DataFrame:
    """All documents whose names have a question's identifiers, each as whole words in any order, those with most first."""
    number = F.col("doc_id") % 40
    asked = F.array(F.concat(F.lit("a-"), (number + 100).cast("string")), F.lit("rev b"), F.concat(F.lit("boq "), (number + 101).cast("string")))
    queries = t.documents.where("doc_id % 50 = 0").select(F.col("doc_id").alias("query_id"), asked.alias("phrases"))
    return lexical_index.Index(names(t).withColumnRenamed("name", "text")).holding(queries)


@query(
    "followup_queries",
    rf"""WITH u AS (SELECT conv_id, turn, text, list_filter(regexp_extract_all(text, '[A-Za-z0-9][A-Za-z0-9/.-]*'), lambda w: length(w) > 2 AND NOT list_contains({STOP}, lower(w))) AS terms FROM conversations WHERE role = 'user'),
    p AS (SELECT a.conv_id, a.turn, a.text, len(a.terms) AS n, b.turn AS t2, array_to_string(b.terms, ' ') AS said, row_number() OVER (PARTITION BY a.conv_id, a.turn ORDER BY b.turn DESC) AS k FROM u a LEFT JOIN u b ON a.conv_id = b.conv_id AND b.turn < a.turn AND len(b.terms) > 0 AND trim(b.text) <> trim(a.text)),
    g AS (SELECT conv_id, turn, any_value(text) AS text, any_value(n) AS n, string_agg(said, ' ' ORDER BY t2) FILTER (k <= 2 AND said IS NOT NULL) AS context FROM p GROUP BY ALL)
    SELECT conv_id, turn, CASE WHEN n < 4 AND context IS NOT NULL THEN trim(substr(context, 1, 400) || ' ' || text) ELSE text END AS query FROM g""",
)
def followup_queries(t: Tables) -> DataFrame:
    return retrieval.with_context(t.conversations)


QUESTIONS = r"(SELECT doc_id AS query_id, array_to_string(list_slice(regexp_split_to_array(trim(text), '\s+'), 1, 12), ' ') AS text FROM documents WHERE doc_id % 50 = 0)"
WORDS = lambda rel, key: f"(SELECT {key}, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM {rel})"
LEXICAL = f"""(WITH tf AS (SELECT doc_id, term, count(*) AS tf FROM {WORDS('documents', 'doc_id')} GROUP BY ALL), len AS (SELECT doc_id, sum(tf) AS len FROM tf GROUP BY 1), g AS (SELECT count(*) AS n, avg(len) AS mean FROM len),
  q AS (SELECT DISTINCT * FROM {WORDS(QUESTIONS, 'query_id')}), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
  s AS (SELECT query_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean))), 6) AS score FROM q JOIN tf USING (term) JOIN df USING (term) JOIN len USING (doc_id), g GROUP BY ALL)
  SELECT query_id, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s) WHERE rank <= 50)"""


def asked(t: Tables) -> DataFrame:
    return t.documents.where("doc_id % 50 = 0").select(F.col("doc_id").alias("query_id"), qs.snippet(F.col("text"), 12).alias("text"))


def lexical(t: Tables) -> DataFrame:
    return lexical_index.bm25_top(t.documents, asked(t), 50)


HYBRID = f"""(SELECT query_id, doc_id, rrf, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, doc_id) AS rank FROM (SELECT coalesce(a.query_id, b.query_id) AS query_id, coalesce(a.vec_id, b.doc_id) AS doc_id,
  round(coalesce(1.0::DOUBLE / (60 + a.rank), 0) + coalesce(1.0::DOUBLE / (60 + b.rank), 0), 9) AS rrf FROM {COSINE} a FULL JOIN {LEXICAL} b ON a.query_id = b.query_id AND a.vec_id = b.doc_id)) WHERE rank <= 50)"""


def hybrid(t: Tables, words: DataFrame) -> DataFrame:
    semantic = nearest(t).select("query_id", F.col("vec_id").alias("doc_id"), "rank")
    return retrieval.fused(semantic, words, "doc_id", 50)


@query("hybrid_search", f"SELECT * FROM {HYBRID} WHERE rank <= 10")
def hybrid_search(t: Tables) -> DataFrame:
    """Cosine and BM25 lists fused."""
    return hybrid(t, lexical(t)).where("rank <= 10")


@query(
    "rrf_fusion",
    f"""WITH f AS (SELECT coalesce(a.query_id, b.query_id) AS query_id, coalesce(a.vec_id, b.doc_id) AS vec_id, round(coalesce(1.0::DOUBLE / (60 + a.rank), 0) + coalesce(1.0::DOUBLE / (60 + b.rank), 0), 9) AS rrf
      FROM {COSINE} a FULL JOIN (SELECT * FROM {LEXICAL} WHERE rank <= 10) b ON a.query_id = b.query_id AND a.vec_id = b.doc_id)
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, vec_id) AS rank FROM f) WHERE rank <= 10""",
)
def rrf_fusion(t: Tables) -> DataFrame:
    return retrieval.fused(nearest(t), lexical(t).where("rank <= 10").withColumnRenamed("doc_id", "vec_id"), "vec_id", 10)


@query("lexical_search", f"SELECT * FROM {LEXICAL} WHERE rank <= 10")
def lexical_search(t: Tables) -> DataFrame:
    return lexical(t).where("rank <= 10")


DUAL = LEXICAL.replace(WORDS(QUESTIONS, "query_id"), WORDS("asks", "query_id"))
BARE = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(base, '(?i)^(?:in|from|under|per|according\s+to|based\s+on|as\s+per)\s+[^,]{1,60},\s*', ''),
  '(?i)^(?:please\s+)?(?:tell\s+me|give\s+me|show\s+me|state|list|specify)\s+', ''), '(?i)\b(?:how\s+(?:many|much|long)|what|which|who|whose|when|why|does|did|please)\b', ' ', 'g'), '\s{2,}', ' ', 'g'), '^[ ,.;:]+|[ ,.;:]+$', '', 'g')"""


@query(
    "dual_search",
    rf"""WITH base AS (SELECT query_id, {LIST(ASKS)}[(query_id % 6)::INTEGER + 1] || text AS base FROM {QUESTIONS}), bare AS (SELECT query_id, base, {BARE} AS bare FROM base),
    asks AS (SELECT 2 * query_id AS query_id, base || '?' AS text FROM base UNION ALL SELECT 2 * query_id + 1, bare FROM bare WHERE len(regexp_split_to_array(bare, '\s+')) >= 3 AND lower(bare) <> lower(trim(base))),
    m AS (SELECT query_id // 2 AS query_id, doc_id, max(score) AS score FROM {DUAL} GROUP BY ALL)
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM m) WHERE rank <= 10""",
)
def dual_search(t: Tables) -> DataFrame:
    """The question as it is asked and without its wrapper as two searches, each document with its better score."""
    raw = asked(t).select("query_id", F.concat(PICK(ASKS, "query_id"), "text", F.lit("?")).alias("text"))
    return retrieval.dual(lambda questions: lexical_index.bm25_top(t.documents, questions, 50), raw, 10)


@query(
    "candidate_pool",
    f"""WITH a AS (SELECT query_id, doc_id, score, 0 AS pool FROM {LEXICAL}), b AS (SELECT query_id, vec_id AS doc_id, score, 1 AS pool FROM {COSINE})
    SELECT query_id, doc_id, arg_max(score, pool) AS score, max(pool)::INTEGER AS pool FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY ALL""",
)
def candidate_pool(t: Tables) -> DataFrame:
    semantic = nearest(t).select("query_id", F.col("vec_id").alias("doc_id"), "score")
    return retrieval.pooled([lexical(t).select("query_id", "doc_id", "score"), semantic], ["query_id", "doc_id"])


@query(
    "confidence_gate",
    f"SELECT query_id, max(score) AS top, count(*) AS n, max(score) >= 20 OR bool_or(regexp_matches(q.text, '[A-Z]{{1,4}}-?[0-9]{{2,}}')) AS kept FROM {LEXICAL} JOIN {QUESTIONS} q USING (query_id) GROUP BY 1",
)
def confidence_gate(t: Tables) -> DataFrame:
    """What is kept of the questions: those with a good enough hit, and those that name an identifier."""
    best = lexical(t).groupBy("query_id").agg(F.max("score").alias("top"), F.count("*").alias("n"))
    named = asked(t).select("query_id", (F.size(retrieval.codes(F.col("text"))) > 0).alias("named"))
    return best.join(named, "query_id").select("query_id", "top", "n", ((F.col("top") >= 20) | F.col("named")).alias("kept"))


OWN = f"(SELECT l.query_id, doc_id, l.score, lang = 'en' AS own FROM {LEXICAL} l JOIN documents USING (doc_id))"


def owned(t: Tables) -> DataFrame:
    return lexical(t).join(t.documents.select("doc_id", (F.col("lang") == "en").alias("own")), "doc_id")


@query("background_margin", f"SELECT query_id, doc_id, score FROM (SELECT *, max(score) FILTER (own) OVER (PARTITION BY query_id) AS best FROM {OWN}) WHERE own OR best IS NULL OR score >= best + 2")
def background_margin(t: Tables) -> DataFrame:
    return retrieval.within_margin(owned(t), F.col("own"), 2.0).select("query_id", "doc_id", "score")


@query(
    "background_cap",
    f"""WITH s AS (SELECT *, sum((NOT own)::INTEGER) OVER (PARTITION BY query_id ORDER BY score DESC, doc_id ROWS UNBOUNDED PRECEDING) AS seen FROM {OWN}), l AS (SELECT *, NOT own AND seen > 2 AS late FROM s)
    SELECT query_id, doc_id, own, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY late, score DESC, doc_id) AS rank FROM l) WHERE rank <= 10""",
)
def background_cap(t: Tables) -> DataFrame:
    hits = owned(t).drop("rank").withColumnRenamed("doc_id", "item")
    return retrieval.capped(hits, ~F.col("own"), 2, 10).select("query_id", F.col("item").alias("doc_id"), "own", "rank")


#: Questions about a drawing in the words of a document, and passages with the names of their documents.
ASKED = rf"(SELECT doc_id AS query_id, {LIST(ASKS)}[(doc_id % 6)::INTEGER + 1] || array_to_string(list_slice(regexp_split_to_array(trim(text), '\s+'), 1, 10), ' ') || ' ' || drawing || '?' AS question FROM documents JOIN {MARKED} m USING (doc_id) WHERE doc_id % 50 = 0)"
PASSAGES = f"(SELECT c.doc_id, c.name, layer, authority, c.lang = 'en' AS own, c.name || ': ' || text AS passage FROM {CLASSED} c JOIN documents d USING (doc_id))"
SHARE = lambda phrases: f"CASE WHEN len({phrases}) > 0 THEN len(list_filter({phrases}, lambda x: len(list_filter(string_split(x, ' '), lambda w: NOT contains(lower(passage), w))) = 0)) / len({phrases})::DOUBLE ELSE 0 END"
FULL_SQL = f"""WITH p AS MATERIALIZED (SELECT *, list_distinct(regexp_extract_all(lower(passage), '[a-z0-9]+')) AS toks FROM {PASSAGES}), q0 AS (SELECT * FROM {ASKED}),
    w AS (SELECT query_id, unnest(regexp_extract_all(question, '[A-Za-z][A-Za-z0-9]{{3,}}')) AS w, generate_subscripts(regexp_extract_all(question, '[A-Za-z][A-Za-z0-9]{{3,}}'), 1) AS i FROM q0),
    f AS (SELECT query_id, lower(w) AS term, arg_min(w, i) AS w, min(i) AS i FROM w GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY (NOT regexp_matches(substr(w, 1, 1), '[A-Z]')), -length(w), i) AS r FROM f WHERE NOT list_contains({LIST((*qs.STOP_WORDS, *qs.MORE_STOP_WORDS))}, term)),
    two AS (SELECT a.query_id, list(a.term || ' ' || b.term) AS pairs FROM r a JOIN r b ON a.query_id = b.query_id AND a.r < b.r AND b.r <= 5 GROUP BY 1),
    q AS (SELECT q0.*, coalesce(pairs, []) AS pairs, list_transform(list_distinct(regexp_extract_all(question, '([A-Z]{{1,4}}-?[0-9]{{2,}})', 1)), lambda c: replace(lower(c), '-', ' ')) AS ids FROM q0 LEFT JOIN two USING (query_id)),
    held AS (SELECT query_id, doc_id, len(list_filter(ids, lambda x: list_has_all(toks, string_split(x, ' ')))) AS n_ids, len(list_filter(pairs, lambda x: list_has_all(toks, string_split(x, ' ')))) AS n_pairs FROM q, p),
    by_id AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY n_ids DESC, doc_id) AS k FROM held WHERE n_ids > 0),
    by_pair AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY n_pairs DESC, doc_id) AS k FROM held WHERE n_pairs > 0),
    pool AS (SELECT coalesce(a.query_id, b.query_id) AS query_id, coalesce(a.doc_id, b.doc_id) AS doc_id, coalesce(rrf, 0) AS score FROM {HYBRID} a FULL JOIN (SELECT * FROM by_id WHERE k <= 20) b ON a.query_id = b.query_id AND a.doc_id = b.doc_id),
    hits AS (SELECT *, false AS extra FROM pool UNION ALL SELECT query_id, doc_id, 0, true FROM by_pair WHERE k <= 20 AND (query_id, doc_id) NOT IN (SELECT (query_id, doc_id) FROM pool)),
    told AS (SELECT b.*, question, p.* EXCLUDE (doc_id), 2 * {SHARE('ids')} AS code, {SHARE('pairs')} AS pair FROM hits b JOIN q USING (query_id) JOIN p USING (doc_id)),
    led AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY extra, score + code DESC, doc_id) AS lead FROM told),
    gated AS (SELECT *, max(pair > 0 AND lead <= 5 AND NOT extra) OVER (PARTITION BY query_id) AS grounded, max(pair > 0 AND NOT extra) OVER (PARTITION BY query_id) AS there FROM led),
    scored AS (SELECT *, score + CASE WHEN extra THEN pair WHEN grounded THEN code ELSE greatest(code, pair) END + words + CASE WHEN own THEN 0.1::DOUBLE ELSE 0 END AS total
      FROM (SELECT *, CASE WHEN own THEN 0 ELSE least(1.2::DOUBLE, 0.25::DOUBLE * len(list_filter({TERMS.replace('text', 'question')}, lambda w: contains(lower(passage), w)))) END AS words FROM gated WHERE NOT extra OR NOT there)),
    above AS (SELECT *, max(total) FILTER (own) OVER (PARTITION BY query_id) AS best FROM scored),
    final AS (SELECT query_id, doc_id, own, name, round(total - CASE WHEN regexp_matches(name, '(?i){qs.SUPERSEDED}') THEN 0.5 ELSE 0 END + {BONUS}, 9) AS score FROM above WHERE own OR best IS NULL OR total - words >= best + 0.15),
    marked AS (SELECT f.*, drawing, kind, value, max(value) OVER (PARTITION BY query_id, drawing, kind) AS newest FROM final f JOIN {RANKED} m USING (doc_id)),
    seen AS (SELECT *, NOT own AND sum((NOT own)::INTEGER) OVER (PARTITION BY query_id ORDER BY score DESC, doc_id ROWS UNBOUNDED PRECEDING) > 2 AS late FROM marked WHERE (drawing = '' OR kind IS NULL OR value = newest) AND NOT regexp_matches(name, '^~'))
    SELECT query_id, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY late, score DESC, doc_id) AS rank FROM seen) WHERE rank <= 5"""


@query("full_retrieval", FULL_SQL)
def full_retrieval(t: Tables) -> DataFrame:
    """The fused search with identifiers and rescued words, all bonuses, the margin with fold, current revisions and the cap on background."""
    drawing = qs.drawing_number(F.col("name"))
    text = F.concat(PICK(ASKS, "doc_id"), qs.snippet(F.col("text"), 10), F.lit(" "), drawing, F.lit("?"))
    wanted = t.documents.where("doc_id % 50 = 0").join(names(t), "doc_id").select(F.col("doc_id").alias("query_id"), text.alias("question"))
    passages = classed(t).join(t.documents.select("doc_id", "text", (F.col("lang") == "en").alias("own")), "doc_id")
    passages = cut(passages.select("doc_id", "name", "layer", "authority", "own", F.lower(F.concat("name", F.lit(": "), "text")).alias("low")))
    phrases = retrieval.phrased(wanted)
    words = phrases.select(F.explode(F.concat("codes", "pairs")).alias("phrase")).select(F.explode(lexical_index.terms_of("phrase")).alias("term"))
    index = lexical_index.Index(t.documents, words.unionByName(asked(t).select(F.explode(lexical_index.terms_of("text")).alias("term"))))
    named = index.with_words(passages.where("low IS NOT NULL").select("doc_id", F.col("name").alias("text")))
    by_code, by_pair = (named.holding(phrases.select("query_id", F.col(c).alias("phrases")), 20).select("query_id", "doc_id") for c in ("codes", "pairs"))
    found = hybrid(t, index.best(asked(t), 50)).select("query_id", "doc_id", "rrf").join(by_code, ["query_id", "doc_id"], "full").select("query_id", "doc_id", F.coalesce("rrf", F.lit(0.0)).alias("score"))
    return retrieval.full_scores(found, by_pair.withColumn("score", F.lit(0.0)), phrases, passages, 5, boost=0.1, margin=0.15, fold=True, cap=2)


@query(
    "best_chunks",
    rf"""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS words FROM documents),
    c AS (SELECT doc_id, i::INTEGER AS chunk_index, lower(array_to_string(words[i * 100 + 1 : i * 100 + 100], ' ')) AS chunk FROM w, unnest(range(0, ((len(words) + 99) // 100)::BIGINT)) AS u(i)),
    q AS (SELECT query_id, unnest({TERMS}) AS term FROM {QUESTIONS}), k AS (SELECT DISTINCT doc_id, chunk_index, unnest(regexp_extract_all(chunk, '[a-z0-9]{{4,}}')) AS term FROM c),
    s AS (SELECT query_id, doc_id, chunk_index, count(*) AS score FROM q JOIN k USING (term) GROUP BY ALL), b AS (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY score DESC, chunk_index) AS k FROM s)
    SELECT query_id, doc_id, chunk_index, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM b WHERE k = 1) WHERE rank <= 5""",
)
def best_chunks(t: Tables) -> DataFrame:
    """Chunks by the words that they share with a question; each document by its best one."""
    terms = asked(t).select("query_id", F.explode(qs.significant_terms(F.col("text"))).alias("term"))
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("([a-z0-9]{4,})"), F.lit(1)))
    held = corpus.word_chunks(t.documents, 100).select("doc_id", "chunk_index", F.explode(words).alias("term"))
    return overlap.overlap_top(terms, held, 5)


@query(
    "context_blocks",
    rf"""SELECT query_id, string_agg('[' || doc_id || ' ' || printf('%.3f', score) || '] ' || array_to_string(list_slice(regexp_split_to_array(trim(text), '\s+'), 1, 10), ' '), chr(10) ORDER BY rank) AS context FROM {LEXICAL} JOIN documents USING (doc_id) WHERE rank <= 3 GROUP BY 1""",
)
def context_blocks(t: Tables) -> DataFrame:
    return retrieval.as_context(lexical(t).drop("rank").join(t.documents.select("doc_id", "text"), "doc_id"), 3)
