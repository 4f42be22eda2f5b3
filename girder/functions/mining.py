"""Requirements, standards, figures, grades and number words out of texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words of each kind of requirement, first match first.
REQUIREMENTS = {
    "electrical": ["electrical", "power", "voltage", "mw", "kw", "generator", "switchgear"],
    "mechanical": ["mechanical", "chiller", "cooling", "pcw", "tcs", "cfm", "crac"],
    "security": ["security", "access", "badge", "layer", "cctv"],
    "it": ["it", "network", "fiber", "cable", "anr", "rack"],
    "schedule": ["schedule", "milestone", "date", "completion", "rfs"],
}
OBLIGATION = r"(?i)\b(SHALL|MUST|REQUIRED|WILL BE REQUIRED)\b"
STANDARD = r"(?:BS EN|ASTM|ISO|ACI|AASHTO|BS|EN) ?[A-Z]?[0-9]+"
GRADE = r"\b[CB][0-9]{2,3}[A-Z]?\b"
MONEY = r"(?:USD|AED|SAR|EUR|GBP) [0-9][0-9,.]*[0-9]"
SMALL = dict(zip(
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split(), range(20), strict=True,
)) | dict(zip("twenty thirty forty fifty sixty seventy eighty ninety".split(), range(20, 100, 10), strict=True))
SCALES = {"thousand": 1_000, "million": 1_000_000, "billion": 1_000_000_000}
#: Number words and what they stand for, for checks.
WORDED = {"forty": "40", "two hundred and five": "205", "one thousand": "1000", "three million two hundred thousand and one": "3200001", "nineteen": "19", "ninety nine": "99", "hundred": "100"}


def requirement_kind(sentence: Column) -> Column:
    low = F.lower(sentence)
    found = None
    for kind, words in REQUIREMENTS.items():
        hit = low.contains(words[0])
        for w in words[1:]:
            hit = hit | low.contains(w)
        found = F.when(hit, kind) if found is None else found.when(hit, kind)
    return found.otherwise("general")


def requirements(docs: DataFrame) -> DataFrame:
    """(doc_id, sentence, category, obligation) of the sentences of ten characters or more that oblige somebody."""
    sentences = docs.select("doc_id", F.explode(F.split("text", r"(?<=[.!?])\s+")).alias("sentence"))
    obliging = sentences.where((F.length("sentence") >= 10) & F.col("sentence").rlike(OBLIGATION))
    return obliging.select("doc_id", F.trim("sentence").alias("sentence"), requirement_kind(F.col("sentence")).alias("category"), F.upper(F.regexp_extract("sentence", OBLIGATION, 1)).alias("obligation"))


def money_values(docs: DataFrame) -> DataFrame:
    """(doc_id, currency, value) of each sum of money."""
    raw = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(MONEY), F.lit(0))).alias("raw"))
    number = F.replace(F.regexp_extract("raw", "[0-9][0-9,.]*[0-9]", 0), F.lit(","), F.lit(""))
    return raw.select("doc_id", F.substring("raw", 1, 3).alias("currency"), number.cast("decimal(38,2)").alias("value"))


def money_figures(docs: DataFrame) -> DataFrame:
    return money_values(docs).groupBy("doc_id", "currency").agg(F.sum("value").cast("double").alias("total"), F.count("*").alias("n"))


def title_block(text: Column) -> list[Column]:
    """Scale, revision and drawing number where they are labelled, else null."""
    field = lambda p: F.nullif(F.regexp_extract(text, p, 1), F.lit(""))
    return [
        field(r"(?i)\bscale\s+(1:\d+)").alias("scale"),
        F.upper(field(r"(?i)\brev\s+([A-Z0-9]{1,3})\b")).alias("revision"),
        field(r"(?i)\bdrawing\s+([A-Z]{1,3}[-_]?\d{3,6})").alias("drawing"),
    ]


def worded_number(text: Column) -> Column:
    """The number that English words stand for; null where a word is none of them."""
    from .works import lookup

    words = F.filter(F.split(F.lower(F.trim(text)), r"[\s-]+"), lambda w: (w != "") & (w != "and"))
    small, scale = (lambda w: lookup(SMALL, w)), (lambda w: lookup(SCALES, w))
    zero = F.lit(0).cast("long")
    start = F.struct(zero.alias("total"), zero.alias("now"), F.lit(True).alias("ok"))
    one = lambda n: F.when(n == 0, F.lit(1)).otherwise(n)
    step = lambda a, w: (
        F.when(small(w).isNotNull(), F.struct(a.total.alias("total"), (a.now + small(w)).cast("long").alias("now"), a.ok.alias("ok")))
        .when(w == "hundred", F.struct(a.total.alias("total"), (one(a.now) * 100).cast("long").alias("now"), a.ok.alias("ok")))
        .when(scale(w).isNotNull(), F.struct((a.total + one(a.now) * scale(w)).cast("long").alias("total"), zero.alias("now"), a.ok.alias("ok")))
        .otherwise(F.struct(a.total.alias("total"), a.now.alias("now"), F.lit(False).alias("ok")))
    )
    return F.aggregate(words, start, step, lambda a: F.when(a.ok & (F.size(words) > 0), (a.total + a.now).cast("double")))


def repeated_run(words: Column, n: int) -> Column:
    """Whether a word stands ``n`` times in a row."""
    start = F.struct(F.lit("").alias("last"), F.lit(0).alias("run"), F.lit(0).alias("most"))

    def step(a: Column, w: Column) -> Column:
        run = F.when(a.last == w, a.run + 1).otherwise(1)
        return F.struct(w.alias("last"), run.alias("run"), F.greatest(a.most, run).alias("most"))

    return F.aggregate(words, start, step, lambda a: a.most >= n)


def mean_of(*signals: Column) -> Column:
    """The mean of those that aren't null."""
    there = F.filter(F.array(*signals), lambda x: x.isNotNull())
    return F.try_divide(F.aggregate(there, F.lit(0.0), lambda a, x: a + x), F.size(there))


# Who owes what in a contract, and the words that tell an obligation's field and weight, the first match counts.
OBLIGED = (
    (r"(?:contractor|builder)[\s\w]{0,50}(?:shall|must|will|agrees to)[\s\w]{0,100}(?:\.)", "contractor_obligation"),
    (r"(?:employer|owner|client)[\s\w]{0,50}(?:shall|must|will|agrees to)[\s\w]{0,100}(?:\.)", "employer_obligation"),
    (r"(?:both parties|each party)[\s\w]{0,50}(?:shall|must|will)[\s\w]{0,100}(?:\.)", "mutual_obligation"),
    (r"(?:architect|engineer|supervisor)[\s\w]{0,50}(?:shall|must|will)[\s\w]{0,100}(?:\.)", "consultant_obligation"),
)
OBLIGATION_FIELDS = {
    "safety": ["safety", "health", "protect"],
    "risk": ["insurance", "indemnif", "liability"],
    "financial": ["payment", "invoice", "cost"],
    "quality": ["quality", "defect", "warranty", "guarantee"],
    "schedule": ["time", "schedule", "milestone", "delay", "completion"],
}
OBLIGATION_WEIGHTS = {"high": ["shall", "must", "required", "mandatory"], "medium": ["will", "agrees to", "responsible for"]}


def first_with(text: Column, table: dict[str, list[str]], otherwise: str) -> Column:
    """The first entry of ``table`` one of whose words the text has as a part."""
    low, out = F.lower(text), F.lit(otherwise)
    for name, words in reversed(table.items()):
        out = F.when(sum((low.contains(w).cast("int") for w in words), F.lit(0)) > 0, name).otherwise(out)
    return out


def obligations(text: Column, most: int = 20) -> Column:
    """(type, text, category, priority) of the obligations in a text, by who owes them, then as they come, ``most`` at most."""
    found = []
    for pattern, kind in OBLIGED:
        hits = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"(?i){pattern}"), F.lit(0))
        found.append(F.transform(hits, _telling(kind)))
    return F.slice(F.concat(*found), 1, most)


def _telling(kind: str):
    return lambda x: F.struct(F.lit(kind).alias("type"), x.alias("text"), first_with(x, OBLIGATION_FIELDS, "general").alias("category"), first_with(x, OBLIGATION_WEIGHTS, "low").alias("priority"))
