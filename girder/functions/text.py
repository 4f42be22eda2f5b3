"""Column functions on text: classes, tokens, identifiers, revisions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

def tokens(text: Column, least: int = 1) -> Column:
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda x: F.length(x) >= least)


def earliest(text: Column, patterns: dict[str, str], otherwise: str) -> Column:
    """The name whose pattern matches first in the text; at equal places, the first in the table."""
    at = [F.struct(F.regexp_instr(F.lower(text), F.lit(p)).alias("at"), F.lit(i).alias("i"), F.lit(n).alias("name")) for i, (n, p) in enumerate(patterns.items())]
    found = F.array_min(F.filter(F.array(*at), lambda s: s.at > 0))
    return F.coalesce(found["name"], F.lit(otherwise))


def revision_rank(token: Column) -> Column:
    """(0, number) for digits, (1, base 26) for one or two letters, else null: kinds never compare with each other."""
    up = F.upper(token)
    letter = lambda i: F.ascii(F.substring(up, i, 1)) - 64
    value = F.when(F.length(up) == 1, letter(1)).otherwise(letter(1) * 26 + letter(2))
    return F.when(up.rlike("^[0-9]+$"), F.struct(F.lit(0).alias("kind"), up.try_cast("int").alias("value"))).when(
        up.rlike("^[A-Z]{1,2}$"), F.struct(F.lit(1).alias("kind"), value.alias("value"))
    )


def scrub(text: Column, terms: list[str], mark: str = "[X]") -> Column:
    """Each term replaced by ``mark``, longest first."""
    for term in sorted(terms, key=lambda x: (-len(x), x)):
        text = F.replace(text, F.lit(term), F.lit(mark))
    return text


def identifiers(text: Column) -> Column:
    """Distinct code-like words (letters and digits joined, such as AB-12), longest first, then by code point."""
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(r"([A-Z]{1,4}-?[0-9]{2,})"), F.lit(1)))
    order = lambda a, b: F.when(F.length(a) != F.length(b), F.length(b) - F.length(a)).when(a < b, -1).when(a > b, 1).otherwise(0)
    return F.array_sort(found, order)
