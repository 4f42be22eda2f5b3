"""Questions, file names and passages for retrieval, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that say nothing about what is sought.
STOP_WORDS = (
    "what", "which", "when", "where", "whom", "whose", "does", "did", "how",
    "the", "and", "for", "are", "was", "were", "this", "that", "these", "those",
    "from", "with", "into", "your", "our", "their", "please", "tell", "give",
    "answer", "question", "about", "standard", "project", "document", "documents",
    "knowledge", "base", "using", "used", "there", "here", "have", "has", "will",
)
MORE_STOP_WORDS = ("this", "that", "with", "from", "have", "what", "when", "where", "which", "about", "please", "thank", "thanks", "hello", "help")
# What a question is wrapped in, and file names that are noise.
LEAD = r"(?i)^(?:in|from|under|per|according\s+to|based\s+on|as\s+per)\s+[^,]{1,60},\s*"
IMPERATIVE = r"(?i)^(?:please\s+)?(?:tell\s+me|give\s+me|show\s+me|state|list|specify)\s+"
INTERROGATIVE = r"(?i)(?<![\p{L}\p{N}_])(?:how\s+(?:many|much|long)|what|which|who|whose|when|why|does|did|please)(?![\p{L}\p{N}_])"
LOCK_FILE = r"^(~\$)"
# What file names say of a document's authority, first match first; authorities from the strongest; what layers weigh.
SUPERSEDED = r"superseded|obsolete|archive|\bold\b|previous|deprecated"
AUTHORITY = (
    ("contractual", r"contract|agreement|conditions of contract|fidic|variation|\bvo\b|\bclaim\b|particular conditions|general conditions"),
    ("design", r"drawing|\bdwg\b|\bdxf\b|\bdgn\b|\bifc\b|\bga\b|layout|\bplan\b|detail|\bsection\b|elevation|\bdesign\b"),
    ("commercial", r"\bboq\b|bill of quant|\brate\b|priced|tender|\bcost\b|estimat|valuation|\bipc\b|\bipa\b|payment|budget|cash[\s_-]?flow"),
    ("policy", r"procedure|\bprc[\s_-]|\btem[\s_-]|policy|method statement|\bmethod\b|specification|\bspec\b|standard|\bcode\b|manual|guideline|template|workflow|checklist"),
    ("operational", r"report|\blog\b|minutes|daily|weekly|\brfi\b|\bncr\b|inspection|submittal|schedule|programme|progress|transmittal"),
    ("historical", SUPERSEDED),
    ("personal", r"\bdraft\b|\bmemo\b|\bnote\b|working|scratch|personal"),
)
STRENGTH = ("contractual", "design", "commercial", "operational", "policy", "historical", "personal")
LAYERS = {"project_record": 1.0, "company_rules": 0.7, "shared_domain": 0.5, "user_session": 0.3}
BY_LAYER = {"shared_domain": "policy", "company_rules": "policy", "project_record": "operational", "user_session": "operational"}
DRAWING = r"(?i)[A-Z]{1,3}[-_]?\d{3,6}"
REVISION = r"(?:^|[^A-Za-z0-9])[Rr][Ee]?[Vv]?\s*[-_]?\s*([0-9]{1,3}|[A-Z]{1,2})\b"


def among(words: tuple[str, ...]) -> Column:
    return F.array(*map(F.lit, words))


def significant_terms(text: Column) -> Column:
    """Distinct words of four letters or digits or more that aren't stop words."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-z0-9]{4,})"), F.lit(1))
    return F.array_except(F.array_distinct(found), among(STOP_WORDS))


def bonus(n: Column, each: float = 0.25, most: float = 1.2) -> Column:
    """So much for each of ``n`` terms that a text has, and no more than ``most``."""
    return F.least(F.lit(most), n * F.lit(each))


def rescue_terms(text: Column, most: int = 5) -> Column:
    """The words that tell most: capitalised first, then longer ones, then as they come."""
    words = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("([A-Za-z][A-Za-z0-9]{3,})"), F.lit(1))
    low = F.transform(words, lambda w: F.lower(w))
    known = F.transform(words, lambda w, i: F.struct((~F.substring(w, 1, 1).rlike("[A-Z]")).alias("small"), (-F.length(w)).alias("short"), i.alias("at"), F.lower(w).alias("term")))
    first = F.filter(known, lambda x: F.array_position(low, x.term) == x["at"] + 1)
    kept = F.filter(first, lambda x: ~F.array_contains(among((*STOP_WORDS, *MORE_STOP_WORDS)), x.term))
    return F.transform(F.slice(F.array_sort(kept), 1, most), lambda x: x.term)


def pairs(terms: Column) -> Column:
    """All pairs of two terms, as phrases."""
    return F.flatten(F.transform(terms, lambda a, i: F.transform(F.slice(terms, i + 2, F.size(terms)), lambda b: F.concat_ws(" ", a, b))))


def unwrapped(question: Column) -> Column:
    """A question without what it is wrapped in; null where nothing goes or fewer than three words are left."""
    base = F.rtrim(F.regexp_replace(F.trim(F.coalesce(question, F.lit(""))), r"\?+$", ""))
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(base, LEAD, ""), IMPERATIVE, ""), INTERROGATIVE, " ")
    bare = F.regexp_replace(F.regexp_replace(bare, r"\s{2,}", " "), r"^[ ,.;:]+|[ ,.;:]+$", "")
    return F.when((F.size(F.split(bare, r"\s+")) >= 3) & (F.lower(bare) != F.lower(base)), bare)


def any_of(question: Column) -> Column:
    """The words of a question joined by OR, without signs and without words that a search would read as operators."""
    words = F.split(F.trim(F.regexp_replace(F.coalesce(question, F.lit("")), r"[^\w\s]+", " ")), r"\s+")
    return F.array_join(F.filter(words, lambda w: (w != "") & ~F.lower(w).isin("or", "and", "not")), " OR ")


def content_terms(text: Column) -> Column:
    """Words of three characters or more that aren't stop words, in order."""
    words = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"([A-Za-z0-9][A-Za-z0-9/.-]*)"), F.lit(1))
    return F.filter(words, lambda w: (F.length(w) > 2) & ~F.lower(w).isin(*STOP_WORDS))


def snippet(text: Column, words: int = 50) -> Column:
    return F.array_join(F.slice(F.split(F.trim(text), r"\s+"), 1, words), " ")


def authority(name: Column, layer: Column) -> Column:
    """What the name of a document says of its authority, else what its layer implies."""
    from .works import lookup

    return F.coalesce(*(F.when(name.rlike(f"(?i){p}"), a) for a, p in AUTHORITY), lookup(BY_LAYER, layer))


def precedence_bonus(layer: Column, of: Column, by_authority: float = 0.05, by_layer: float = 0.05) -> Column:
    """A small bonus for strong authorities and layers."""
    from .works import lookup

    weights = {a: (len(STRENGTH) - i) / len(STRENGTH) for i, a in enumerate(STRENGTH)}
    return by_authority * F.coalesce(lookup(weights, of), F.lit(0.0)) + by_layer * F.coalesce(lookup(LAYERS, layer), F.lit(0.0))


def superseded(name: Column) -> Column:
    return name.rlike(f"(?i){SUPERSEDED}")


def drawing_number(name: Column) -> Column:
    return F.upper(F.regexp_extract(name, DRAWING, 0))


def revision(name: Column) -> Column:
    return F.upper(F.regexp_extract(name, REVISION, 1))
