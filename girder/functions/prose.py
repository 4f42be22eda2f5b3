"""Limits, dates, lead times, risks and forbidden words that letters and reports mention, with the words around them."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

# What is looked for, by kind; how many characters around it are kept.
PATTERNS = {
    "constraint": [
        r"(?P<value>\d+\.?\d*)\s*(?P<unit>MW|kW|V|cfm/kW|ft|%)",
        r"(?P<operator>[≤≥<>=])\s*(?P<value>\d+\.?\d*)\s*(?P<unit>%|ft|MW|kW|V)",
    ],
    "target": [
        r"(?:operational|RFS|completion|substantial completion)\s+(?:by|before|no later than)\s+(?P<month>\w+)\s+(?P<year>\d{4})",
        r"EOY\s+(?P<year>\d{4})",
        r"(?P<month>\w+)\s+(?P<year>\d{4})\s+(?:target|milestone|RFS)",
        r"(?:completion|complete|handover|hand-over|duration)\s+(?:within|in|of)\s+(?P<qty>\d+)\s*(?P<unit>months?|weeks?|days?)",
    ],
    "lead_time": [
        r"(?P<equipment>generator|chiller|switchgear|transformer|UPS|CRAH)\w*\s+.*?(?P<days>\d+)\s*days?",
        r"(?P<equipment>generator|chiller|switchgear|transformer|UPS|CRAH)\w*\s+.*?(?P<weeks>\d+)\s*weeks?",
    ],
    "risk": [r"\b(winter|supply chain|Indigenous|TFO|blast radius|load.shed|permit delay|weather|labour shortage)\b"],
}
#: A match of a pattern has one of these, in lower case; texts without any are not searched for it.
NEEDED = {
    "constraint": [(), ("≤", "≥", "<", ">", "=")],
    "target": [("operational", "rfs", "completion"), ("eoy",), ("target", "milestone", "rfs"), ("complet", "hand", "duration")],
    "lead_time": [("generator", "chiller", "switchgear", "transformer", "ups", "crah")] * 2,
    "risk": [("winter", "supply chain", "indigenous", "tfo", "blast radius", "load", "permit delay", "weather", "labour shortage")],
}
#: Characters that match i, k or s whatever their case, though not by their lower case: texts with one are searched for all.
ODD = re.compile("[\u0130\u0131\u017f\u212a]")
AROUND = {"constraint": 60, "target": 80, "lead_time": 50, "risk": 80}
SEVERITIES = {"high": ["blast radius", "winter", "supply chain", "permit delay", "labour shortage"], "medium": ["tfo", "indigenous", "load shed", "weather"]}
OUTSIDE = ["tfo", "permit", "indigenous", "supply"]
DAYS = {"day": 1, "week": 7, "month": 30}
LEAD_TIMES = {"Cdu": 0, "Generator": 120, "Chiller": 90, "Switchgear": 75, "Transformer": 80, "Ups": 60, "Crah": 70}
# A word that must not stand in texts of a kind, and what tells that kind.
RULES = {
    "no_approved_on_design": {
        "forbidden": r"\bapprove[ds]?\b|\bapproval\b",
        "about": ["design", "drawing", "package", "review", "consultant", "architect", "engineer", "document"],
        "procedure": "PRC-501",
    }
}

MENTION = "kind string, place int, start long, raw string, context string, groups map<string, string>"
#: Characters of texts whose mentions leave together.
CHARS = 4 << 20


def mentions(docs: DataFrame, kinds: list[str] | None = None, key: str = "doc_id") -> DataFrame:
    """(key, kind, place, start, raw, context, groups) of all that whole texts mention; ``place`` is that of the pattern in its kind.

    Matches of one pattern don't overlap, those of several may. ``start`` counts characters from 0, ``context`` is
    trimmed and its whitespace kept. Texts without any match, and nulls, are ruled out before they leave the JVM.
    """
    wanted = [(k, i, p) for k, ps in PATTERNS.items() if kinds is None or k in kinds for i, p in enumerate(ps)]
    # Java's classes are a little narrower than Python's.
    plain = "|".join(re.sub(r"\?P<\w+>", "?:", p).replace(r"\s", r"[\s\x1c-\x1f]").replace(r"\w", r"[\w\p{N}]") for _, _, p in wanted)

    schema = StructType([docs.select(key).schema[0], *StructType.fromDDL(MENTION).fields])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A word is never given back to blanks after it, so it may be taken for good.
        ready = [(k, i, re.compile(re.sub(r"(\\w[+*])(?=\)?\\s)", r"\1+", p), re.IGNORECASE), AROUND[k], NEEDED[k][i]) for k, i, p in wanted]
        for batch in batches:
            out, held = Mentions(), 0
            for row, text in enumerate(batch.column(1)):
                text = text.as_py()
                low, every = text.lower(), ODD.search(text)
                for k, i, p, n, needed in ready:
                    if needed and not every and not any(x in low for x in needed):
                        continue
                    names = tuple(p.groupindex)
                    for m in p.finditer(text):
                        out.add(row, k, i, m, n, text, names)
                held += len(text)
                if held >= CHARS:
                    yield out.told(batch.column(0), arrow)
                    out, held = Mentions(), 0
            yield out.told(batch.column(0), arrow)

    return docs.where(F.col("text").rlike(f"(?idU)(?:{plain})")).select(key, "text").mapInArrow(run, schema)


class Mentions:
    """Mentions as columns, with the rows of the texts that they are in."""

    def __init__(self):
        self.columns: tuple[list, ...] = ([], [], [], [], [], [])
        self.names, self.values, self.ends = [], [], [0]

    def add(self, row: int, kind: str, place: int, m: re.Match, around: int, text: str, names: tuple[str, ...]) -> None:
        start, end = m.span()
        for column, value in zip(self.columns, (row, kind, place, start, m.group(), text[max(0, start - around) : end + around].strip()), strict=True):
            column.append(value)
        for name in names:
            if (value := m.group(name)) is not None:
                self.names.append(name)
                self.values.append(value)
        self.ends.append(len(self.names))

    def told(self, keys: pa.Array, schema: pa.Schema) -> pa.RecordBatch:
        row, *rest = self.columns
        columns = [keys.take(pa.array(row, pa.int64())), *(pa.array(c, f.type) for c, f in zip(rest, list(schema)[1:-1], strict=True))]
        groups = pa.MapArray.from_arrays(pa.array(self.ends, pa.int32()), pa.array(self.names, pa.string()), pa.array(self.values, pa.string()))
        return pa.RecordBatch.from_arrays([*columns, groups.cast(schema[-1].type)], schema=schema)


def group(name: str) -> Column:
    return F.coalesce(F.col("groups")[name], F.lit(""))


def constraints(found: DataFrame) -> DataFrame:
    """Mentions of limits with value, unit and operator (blank where none stands before)."""
    return found.where("kind = 'constraint'").select("*", group("value").alias("value"), group("unit").alias("unit"), group("operator").alias("operator")).drop("kind", "groups")


def targets(found: DataFrame) -> DataFrame:
    """Mentions of dates with month and year, or with a duration in days."""
    days = F.expr("CASE trim(TRAILING 's' FROM lower(groups['unit'])) " + " ".join(f"WHEN '{u}' THEN {n}" for u, n in DAYS.items()) + " END * try_cast(groups['qty'] AS BIGINT)")
    return found.where("kind = 'target'").select("*", group("month").alias("month"), group("year").alias("year"), days.alias("duration_days")).drop("kind", "groups")


def lead_times(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, equipment, days, start, given) of equipment with a lead time, and usual lead times of what a text gives none for.

    Only texts that mention the lead time of anything get usual ones.
    """
    own = found.where("kind = 'lead_time'").withColumn("equipment", F.initcap(group("equipment")))
    days = F.coalesce(F.expr("try_cast(groups['weeks'] AS BIGINT) * 7"), F.expr("try_cast(groups['days'] AS BIGINT)"), F.lit(0).cast("long"))
    given = own.select(key, "equipment", days.alias("days"), "start", F.lit(True).alias("given"))
    named = own.groupBy(key).agg(F.collect_set("equipment").alias("named"))  # of seven kinds at most
    usual = F.array(*(F.struct(F.lit(e).alias("equipment"), F.lit(n).cast("long").alias("days")) for e, n in LEAD_TIMES.items()))
    lacking = named.select(key, F.inline(F.filter(usual, lambda u: ~F.array_contains("named", u.equipment))))
    return given.unionByName(lacking.select(key, "equipment", "days", F.lit(None).cast("long").alias("start"), F.lit(False).alias("given")))


def any_of(text: Column, words: list[str]) -> Column:
    return F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(text, w))


def risks(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, type, keyword, severity, start, context): words of risk, dates that hang on others, tight and large limits.

    Each mention tells its risks where it is; nothing is shuffled.
    """
    low, number = F.lower("raw"), F.expr("try_cast(groups['value'] AS DOUBLE)")
    unit, operator = F.lower(group("unit")), group("operator")
    worded = F.when(F.abs(number) < 1e7, number.cast("string")).otherwise(F.format_string("%.1f", number))
    severity = F.when(any_of(low, SEVERITIES["high"]), "high").when(any_of(low, SEVERITIES["medium"]), "medium").otherwise("low")
    kind = F.col("kind")
    risk = lambda of, kind, word, weight: F.when(of, F.struct(F.lit(kind).alias("type"), word.alias("keyword"), weight.alias("severity")))
    told_by = F.array(
        risk(kind == "risk", "keyword_match", F.col("raw"), severity),
        risk((kind == "target") & any_of(F.lower("context"), OUTSIDE), "schedule_dependency", F.lit("external_dependency"), F.lit("high")),
        risk((kind == "constraint") & (unit == "%") & operator.isin("≤", "<") & (number <= 5), "tight_constraint", F.concat(operator, worded, F.lit("%")), F.lit("high")),
        risk((kind == "constraint") & (unit == "mw") & (number >= 50), "scale_constraint", F.concat(worded, F.lit(" MW")), F.lit("medium")),
    )
    return found.select(key, "start", "context", F.inline(F.array_compact(told_by)))


def violations(docs: DataFrame, key: str = "doc_id", rules: dict | None = None) -> DataFrame:
    """(key, rule, procedure) of each rule that a text breaks: a forbidden word in a text of the rule's kind."""
    low = F.lower("text")
    broken = [
        F.when(low.rlike(r["forbidden"]) & any_of(low, r["about"]), F.struct(F.lit(name).alias("rule"), F.lit(r["procedure"]).alias("procedure")))
        for name, r in (rules or RULES).items()
    ]
    return docs.select(key, F.inline(F.array_compact(F.array(*broken))))


# The labelled fields of a title block; a value stands on its label's line.
FIELDS = {
    "drawing_number": r"(?:DRAWING|DWG|SHEET)[ \t]*(?:NO\.?|NUMBER|#)[ \t]*[:\-.]?[ \t]*([A-Z0-9][A-Z0-9\-_/\.]{3,})",
    "drawing_title": r"(?:DRAWING[ \t]*TITLE|SHEET[ \t]*TITLE|TITLE)[ \t]*[:\-.]?[ \t]*([^\r\n]{3,80})",
    "revision": r"\bREV(?:ISION)?\.?[ \t]*(?:NO\.?)?[ \t]*[:\-.]?[ \t]*([A-Z]?\d{1,2}[A-Z]?|[A-Z])(?=[ \t]*$|\W)",
    "scale": r"\bSCALE[ \t]*[:\-.]?[ \t]*(1[ \t]*:[ \t]*\d{1,5}|N\.?T\.?S\.?|NOT[ \t]*TO[ \t]*SCALE|AS[ \t]*SHOWN)",
    "date": r"\bDATE[ \t]*[:\-.]?[ \t]*(\d{1,2}[/\-.]\d{1,2}[/\-.]\d{2,4}|\d{4}[/\-.]\d{1,2}[/\-.]\d{1,2})",
    "drawn_by": r"\b(?:DRAWN|DRAFTED|DES(?:IGNED)?)(?:[ \t]*BY)?[ \t]*[:\-.]?[ \t]*([A-Z][A-Za-z0-9 .&'\-]{1,40})",
    "checked_by": r"\bCHECKED(?:[ \t]*BY)?[ \t]*[:\-.]?[ \t]*([A-Z][A-Za-z0-9 .&'\-]{1,40})",
    "approved_by": r"\b(?:APPROVED|AUTHORISED|AUTHORIZED)(?:[ \t]*BY)?[ \t]*[:\-.]?[ \t]*([A-Z][A-Za-z0-9 .&'\-]{1,40})",
    "project_name": r"\bPROJECT[ \t]*(?:NAME|TITLE)?[ \t]*[:\-.]?[ \t]*([^\r\n]{3,80})",
    "client": r"\b(?:CLIENT|EMPLOYER|OWNER)[ \t]*[:\-.]?[ \t]*([^\r\n]{3,80})",
    "sheet_number": r"\b(?:SHEET|SH\.?)[ \t]*[:\-.]?[ \t]*(\d{1,3}[ \t]*(?:OF|/)[ \t]*\d{1,3})",
}
LABELS = r"(?i)^(?:no|title|by|date|rev|scale)\.?$"
DISCIPLINES = {
    "A": "architectural", "AR": "architectural", "S": "structural", "ST": "structural", "C": "civil", "CV": "civil", "M": "mechanical", "ME": "mechanical",
    "E": "electrical", "EL": "electrical", "P": "plumbing", "PL": "plumbing", "L": "landscape", "FP": "fire protection", "INF": "infrastructure",
}


def title_fields(text: Column) -> list[Column]:
    """The fields of a sheet's title block, null where not read: each label's last value, the discipline by the number, and how many were found."""
    from .works import lookup

    read = {}
    for name, pattern in FIELDS.items():
        last = F.get(F.reverse(F.regexp_extract_all(text, F.lit(f"(?i){pattern}"), F.lit(1))), F.lit(0))
        value = F.btrim(last, F.lit(" :-.\t"))
        read[name] = F.when((value != "") & ~value.rlike(LABELS), value)
    read["discipline"] = lookup(DISCIPLINES, F.upper(F.get(F.split(read["drawing_number"], "[-_/]"), F.lit(0))))
    n = sum((c.isNotNull().cast("int") for c in read.values()), F.lit(0))
    return [c.alias(name) for name, c in read.items()] + [n.alias("fields_found")]
