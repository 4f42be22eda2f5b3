"""The group of a catalog that a description's words speak for most."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Points of a phrase and of a word that the text has, and of a keyword that shares a part with one of its words.
PHRASE, WORD, PART = 6, 2, 1
#: Shares of two points for each of a group's keywords from which a match is sure, or likely.
SURE, LIKELY = 0.35, 0.18
#: The shortest word that can share a part with a keyword.
SHORTEST = 3


def best_group(text: Column, groups: dict[str, tuple[str, list[str]]], stop_words: list[str] = (), kind: str | None = None) -> Column:
    """(group, kind, score, confidence, matched): the group with the most points, the first of equals; null without any.

    ``groups`` gives each group's kind and its keywords, in lower case; with ``kind`` only groups of it count. A
    keyword that stands in the text has PHRASE points if it has a blank, else WORD. One that doesn't has PART if a
    word of the text, of SHORTEST letters and no stop word, is a part of it or has it as a part. ``matched`` lists the
    keywords with points. A null text matches nothing.
    """
    low = F.lower(F.coalesce(text, F.lit("")))
    stops = F.array(*map(F.lit, stop_words)) if stop_words else F.array().cast("array<string>")
    words = F.filter(F.array_distinct(F.regexp_extract_all(low, F.lit("[a-z]+"), F.lit(0))), lambda w: (F.length(w) >= SHORTEST) & ~F.array_contains(stops, w))

    def points(k: Column) -> Column:
        whole = F.when(F.contains(k, F.lit(" ")), PHRASE).otherwise(WORD)
        shared = F.exists(words, lambda w: F.contains(k, w) | F.contains(w, k))
        return F.when(F.contains(low, k), whole).when(shared, PART).otherwise(0)

    chosen = [(name, of, keywords) for name, (of, keywords) in groups.items() if kind in (None, of)]
    table = F.array(*(F.struct(F.lit(-i).alias("at"), F.lit(n).alias("group"), F.lit(of).alias("kind"), F.array(*map(F.lit, ks)).alias("keywords")) for i, (n, of, ks) in enumerate(chosen)))

    def scored(g: Column) -> Column:
        score = F.aggregate(g.keywords, F.lit(0), lambda a, k: a + points(k))
        return F.struct(score.alias("score"), g["at"].alias("at"), g.group.alias("group"), g.kind.alias("kind"), g.keywords.alias("keywords"))

    best = F.array_max(F.transform(table, scored))
    share = best.score / (F.size(best.keywords) * WORD)
    confidence = F.when(share >= SURE, "high").when(share >= LIKELY, "medium").otherwise("low")
    matched = F.filter(best.keywords, lambda k: points(k) > 0)
    return F.when(best.score > 0, F.struct(best.group.alias("group"), best.kind.alias("kind"), best.score.alias("score"), confidence.alias("confidence"), matched.alias("matched")))
