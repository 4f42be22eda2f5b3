"""Which actions a message asks for: all keywords of all actions found in one pass over each text."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MATCHES = "id long, action string, confidence double, keywords array<string>, rank int"
WORD = frozenset("abcdefghijklmnopqrstuvwxyz0123456789_")
#: What a word of a keyword adds, and what the type of an attached file does.
BY_WORD, BY_FILE = 0.2, 0.8


def automaton(patterns: list[tuple[str, list[str]]]) -> ahocorasick.Automaton:
    found: dict[str, list[tuple[str, int]]] = {}
    for place, (action, keywords) in enumerate(patterns):
        for keyword in keywords:
            owners = found.setdefault(keyword.lower(), [])
            if action not in (a for a, _ in owners):
                owners.append((action, place))
    out = ahocorasick.Automaton()
    for keyword, owners in found.items():
        out.add_word(keyword, (keyword, [a for a, _ in owners]))
    out.make_automaton()
    return out


def matched(messages: DataFrame, patterns: list[tuple[str, list[str]]], files: dict[str, str], gates: dict[str, float], gate: float = 0.3) -> DataFrame:
    """MATCHES of (id, text, file_type): the actions of each message at or above their gates, best first.

    Each keyword that stands in the text as whole words adds BY_WORD for each of its words, once; lists of one action are
    merged. A file type in ``files`` adds BY_FILE to its action. Confidence is 1 at most, in three digits; equal ones
    stand by name. A null text has no keywords.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = automaton(patterns)
        for batch in batches:
            rows = []
            for own, text, kind in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                low, hits = (text or "").lower(), {}
                for end, (keyword, actions) in known.iter(low):
                    start = end - len(keyword) + 1
                    if (start and low[start - 1] in WORD and keyword[0] in WORD) or (end + 1 < len(low) and low[end + 1] in WORD and keyword[-1] in WORD):
                        continue
                    for action in actions:
                        hits.setdefault(action, set()).add(keyword)
                # Whole numbers of words, so that sums don't depend on their order.
                scores = {a: sum(len(k.split()) for k in ks) * BY_WORD for a, ks in hits.items()}
                if kind in files:
                    scores[files[kind]] = scores.get(files[kind], 0.0) + BY_FILE
                good = [(-round(min(s, 1.0), 3), a) for a, s in scores.items() if s >= gates.get(a, gate) - 1e-9]
                rows += [(own, a, -c, sorted(hits.get(a, ())), k + 1) for k, (c, a) in enumerate(sorted(good))]
            kinds = (pa.int64(), pa.string(), pa.float64(), pa.list_(pa.string()), pa.int32())
            columns = zip(*rows, strict=True) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["id", "action", "confidence", "keywords", "rank"])

    return messages.select(F.col("id").cast("long").alias("id"), F.col("text").cast("string").alias("text"), F.col("file_type").cast("string").alias("file_type")).mapInArrow(run, MATCHES)
