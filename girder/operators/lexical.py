"""BM25 over an inverted index, and the k best for many questions at once.

Documents are dealt out to shards of a bounded number of postings. Each shard meets all questions, some millions of
their terms at a time, adds up its scores in one array and leaves its k best for each question, whose best are those of
all. So what is shuffled is the postings once, and k rows for each shard and question; pairs of a question and a
document are never rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranking import numbered, top
from .schedule import cut

K1, B = 1.2, 0.75
#: Postings of a shard, and terms of questions that it meets at a time.
SHARD, ASKED = 4_000_000, 4_000_000
#: Characters of texts whose words are counted at a time.
COUNT_CHARS = 4 << 20
#: A term in more than this share of a shard's documents is common; documents times k of whose scores the floor is made.
COMMON, SAMPLED = 1 / 8, 16
#: Scores are rounded to six digits; bounds leave more than that.
SLACK = 1e-5


def terms_of(text: str) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), 0)


COUNTED = "doc_id long, term string, tf int, len int"
#: Bytes of words as they are, all others as blanks.
IN_WORDS = bytes(b if chr(b) in "abcdefghijklmnopqrstuvwxyz0123456789" else 32 for b in range(256))


def term_rows(ids: list, texts: list[str]) -> pa.RecordBatch:
    """COUNTED rows of some documents, and the one without a term."""
    raw = [text.lower().encode("utf-8", "replace") for text in texts]
    after = np.cumsum([len(x) + 1 for x in raw])
    flat = np.frombuffer(b" ".join(raw).translate(IN_WORDS), np.uint8)
    inside = np.zeros(len(flat) + 2, bool)
    inside[1:-1] = flat != 32
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    n = np.diff(np.searchsorted(starts, after), prepend=0)
    cuts = np.append(0, np.cumsum(ends - starts)).astype(np.int64)
    words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(cuts), pa.py_buffer(flat[inside[1:-1]])).dictionary_encode()
    rows, tf = np.unique(np.repeat(np.arange(len(raw)), n) * np.int64(len(words.dictionary)) + words.indices.to_numpy(), return_counts=True)
    doc, term = np.divmod(rows, max(1, len(words.dictionary)))
    last = pa.array([None], pa.int64())
    columns = [
        pa.concat_arrays([pa.array(ids, pa.int64()).take(pa.array(doc)), last]),
        pa.concat_arrays([words.dictionary.take(pa.array(term)).cast(pa.string()), last.cast(pa.string())]),
        pa.array(np.append(tf, np.count_nonzero(n)), pa.int32()),
        pa.array(np.append(n[doc], len(starts)), pa.int32()),
    ]
    return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in COUNTED.split(", ")])


def counted(docs: DataFrame) -> DataFrame:
    """COUNTED rows of each document and term, and for each COUNT_CHARS of texts one without a term: the number of documents with terms, and of their terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, held = [], [], 0
            for doc_id, text in zip(*batch.columns, strict=True):
                ids.append(doc_id.as_py())
                texts.append(text.as_py() or "")
                held += len(texts[-1])
                if held >= COUNT_CHARS:
                    yield term_rows(ids, texts)
                    ids, texts, held = [], [], 0
            yield term_rows(ids, texts)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, COUNTED)


def met(held: DataFrame, n: int, asked: DataFrame, size: int, key: str):
    """``n`` postings by shard and ``size`` rows asked by part of ``key``, grouped so that each shard meets each part."""
    shards, parts = (max(1, -(-total // most)) for total, most in ((n, SHARD), (size, ASKED)))
    dealt = lambda c, name, count: F.pmod(F.xxhash64(c), F.lit(count)).cast("int").alias(name)
    spread = lambda name, count: F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias(name)
    return (
        held.select("*", dealt("doc_id", "shard", shards)).select("*", spread("part", parts)).groupBy("shard", "part"),
        asked.select("*", dealt(key, "part", parts)).select("*", spread("shard", shards)).groupBy("shard", "part"),
    )


def numbers(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The values in order, and the place of each row's among them, in four bytes a row: Arrow numbers them without sorting all."""
    coded = column.combine_chunks().dictionary_encode()
    coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
    values = coded.dictionary.to_numpy()
    order = np.argsort(values)
    at = np.empty(len(values), np.int32)
    at[order] = np.arange(len(values), dtype=np.int32)
    return values[order], at[coded.indices.to_numpy()]


def listed(held: pa.Table) -> tuple[np.ndarray, ...]:
    """(docs, terms, places, ends, order) of postings (doc_id, no): the list of terms[t] is places[ends[t]:ends[t + 1]], which ascend and are places in docs; order leads from the rows to places."""
    (docs, place), (terms, term) = numbers(held["doc_id"]), numbers(held["no"])
    order = np.argsort(term * np.int64(len(docs)) + place, kind="stable")
    return docs, terms, place[order], np.append(0, np.cumsum(np.bincount(term, minlength=len(terms))[: len(terms)])), order


SCORED = "query_id long, doc_id long, score double"


def best_of_shard(held: pa.Table, asked: pa.Table, k: int) -> pa.Table:
    """SCORED rows: the ``k`` best documents of a shard's postings (doc_id, no, impact) for each question (query_id, no, idf).

    A question's lists are added up, those of common terms last, which are rows of a matrix. If these weigh less than
    the k-th best so far, no other document can be among the best, and only those found are looked up in them. The k
    best of some documents are a floor for all, so that few are ever ordered.
    """
    docs, terms, place, ends, order = listed(held)
    impact = held["impact"].to_numpy()[order]
    del order
    most = np.maximum.reduceat(impact, ends[:-1]) if len(terms) else impact
    query, no, idf = (asked[c].to_numpy() for c in ("query_id", "no", "idf"))
    at = np.minimum(np.searchsorted(terms, no), max(len(terms) - 1, 0))
    known = np.flatnonzero(terms[at] == no) if len(terms) else np.array([], np.int64)
    common = np.flatnonzero(np.diff(ends) > COMMON * len(docs))
    dense = np.zeros((len(common), len(docs)))
    row = np.full(len(terms), -1)
    row[common] = np.arange(len(common))
    for r, t in enumerate(common):
        dense[r, place[ends[t] : ends[t + 1]]] = impact[ends[t] : ends[t + 1]]
    known = known[np.lexsort((no[known], row[at[known]] >= 0, query[known]))]
    query, at, idf = query[known], at[known], idf[known]
    total, weighed, step, out = np.zeros(len(docs)), np.zeros(len(docs)), max(1, len(docs) // (SAMPLED * k)), []
    for lo, hi in pairwise(np.append(np.flatnonzero(np.diff(query, prepend=query[:1] - 1)), len(query))):
        total[:] = 0
        own, weights, rows = at[lo:hi], idf[lo:hi], row[at[lo:hi]]
        rare = np.count_nonzero(rows < 0)
        for t, weight in zip(own[:rare], weights[:rare], strict=True):
            part = slice(ends[t], ends[t + 1])
            total[place[part]] += weight * impact[part]
        hits = np.flatnonzero(total > 0) if rare else None
        left = weights[rare:] @ most[own[rare:]]
        floor = np.partition(total[hits], -k)[-k] - SLACK if rare and len(hits) >= k else 0
        if left < floor:
            hits = hits[total[hits] + left >= floor]
            for r, weight in zip(rows[rare:], weights[rare:], strict=True):
                total[hits] += weight * dense[r, hits]
        elif rare < hi - lo:
            for r, weight in zip(rows[rare:], weights[rare:], strict=True):
                total += np.multiply(dense[r], weight, out=weighed)
            some = total[::step]
            floor = np.partition(some, -k)[-k] - SLACK if len(some) >= k else 0
            hits = np.flatnonzero(total >= floor if floor > 0 else total > 0)
        if len(hits) > k:
            hits = hits[total[hits] >= np.partition(total[hits], -k)[-k] - SLACK]
        score = np.floor(total[hits] * 1e6 + 0.5) / 1e6
        kept = np.lexsort((hits, -score))[:k]  # docs ascend
        out.append((np.full(len(kept), query[lo]), docs[hits[kept]], score[kept]))
    columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.array([], t) for t in (np.int64, np.int64, np.float64)]
    return pa.table(dict(zip(("query_id", "doc_id", "score"), columns, strict=True)))


HELD = "set_id long, doc_id long, n long"


def most_held(held: pa.Table, asked: pa.Table, k: int | None) -> pa.Table:
    """HELD rows: the documents of a shard's postings (doc_id, no) with most phrases of each set (set_id, phrase, no), ``k`` or all; a phrase is held with all its words."""
    docs, terms, place, ends, _ = listed(held)
    once = np.append(True, place[1:] != place[:-1])[: len(place)]  # a document can have a word in several of its texts
    once[ends[:-1]] = True
    place, ends = place[once], np.append(0, np.cumsum(once))[ends]
    lists = dict(zip(terms.tolist(), np.split(place, ends[1:-1]), strict=True)) if len(terms) else {}
    sets: dict[int, dict[int, list]] = {}
    for set_id, phrase, term in zip(*(asked[c].to_pylist() for c in ("set_id", "phrase", "no")), strict=True):
        sets.setdefault(set_id, {}).setdefault(phrase, []).append(lists.get(term, place[:0]))
    out = []
    for set_id, phrases in sets.items():
        held_by = []
        for words in phrases.values():
            words.sort(key=len)
            hits = words[0]
            for other in words[1:]:
                at = np.searchsorted(other, hits)
                hits = hits[np.append(other, -1)[at] == hits] if len(hits) else hits
            held_by.append(hits)
        hits, n = np.unique(np.concatenate(held_by), return_counts=True)
        if k and len(hits) > k:
            some = n >= np.partition(n, -k)[-k]
            hits, n = hits[some], n[some]
        kept = np.argsort(-n, kind="stable")[:k]  # docs ascend
        out.append((np.full(len(kept), set_id), docs[hits[kept]], n[kept]))
    columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.array([], np.int64)] * 3
    return pa.table(dict(zip(("set_id", "doc_id", "n"), columns, strict=True)))


class Index:
    """Postings (term, doc_id, impact) of ``docs`` (doc_id, text) and the lexicon (term, df, idf, no).

    With ``terms`` (term) only their lists are built. Each row is a document; a null text has no terms. Words are
    counted in one pass, in Arrow batches, so that no document is shuffled.
    """

    def __init__(self, docs: DataFrame, terms: DataFrame | None = None):
        rows = counted(docs)
        if terms is not None:
            rows = rows.join(cut(terms.distinct()).withColumn("__asked", F.lit(True)), "term", "left").where("__asked OR term IS NULL").select("doc_id", "term", "tf", "len")
        rows = cut(rows)
        n, total = rows.where("term IS NULL").agg(F.sum("tf"), F.sum("len")).first()
        n, mean = n or 0, (total or 0) / (n or 1)
        impact = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.lit(mean or 1.0)))
        self.postings = rows.where("term IS NOT NULL").select("term", "doc_id", impact.alias("impact"))
        lexicon = self.postings.groupBy("term").agg(F.count("*").alias("df"))
        self.lexicon = cut(lexicon.select("term", "df", F.log(1 + (F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"), F.monotonically_increasing_id().alias("no")))

    def best(self, queries: DataFrame, k: int) -> DataFrame:
        """(query_id, doc_id, score, rank): the ``k`` best for each of ``queries`` (query_id, text); ties to the smaller id."""
        words = queries.select(F.col("query_id").cast("long").alias("query_id"), F.explode(terms_of("text")).alias("term")).distinct()
        asked = cut(words.join(self.lexicon, "term").select("query_id", "no", "idf", "term"))
        wanted = self.lexicon.join(asked.select("term").distinct(), "term", "left_semi")
        n, size = wanted.agg(F.sum("df")).first()[0] or 0, asked.count()
        held, asked = met(self.postings.join(wanted.select("term", "no"), "term").select("doc_id", "no", "impact"), n, asked.select("query_id", "no", "idf"), size, "query_id")
        found = held.cogroup(asked).applyInArrow(lambda a, b: best_of_shard(a, b, k), SCORED)
        best = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
        return found.withColumn("rank", F.row_number().over(best).cast("long")).where(F.col("rank") <= k)

    def with_words(self, docs: DataFrame) -> Index:
        """This index with the words that its documents have in ``docs`` (doc_id, text), too, for ``holding`` alone: the texts indexed before are not counted again."""
        both = Index.__new__(Index)
        more = docs.select(F.explode(F.array_distinct(terms_of("text"))).alias("term"), F.col("doc_id").cast("long").alias("doc_id"))
        both.postings = self.postings.select("term", "doc_id").unionByName(more).where("doc_id IS NOT NULL")
        both.lexicon = cut(both.postings.groupBy("term").agg(F.count("*").alias("df")).withColumn("no", F.monotonically_increasing_id()))
        return both

    def holding(self, queries: DataFrame, k: int | None = None) -> DataFrame:
        """(query_id, doc_id, score, rank): the ``k`` documents, or all, with the largest share of a question's phrases, ties to the smaller id.

        ``queries`` has query_id and phrases; a document has a phrase if it has each of its words. Questions with the
        same phrases are asked once, and shards of postings meet all of them. Without ``k`` all are ranked in ranges,
        and the result has a row for each question and document with a phrase in common.
        """
        keyed = queries.select("query_id", F.array_sort(F.array_distinct("phrases")).alias("phrases")).where(F.size("phrases") > 0)
        sets = cut(keyed.groupBy("phrases").agg(F.min("query_id").cast("long").alias("set_id")))
        each = sets.select("set_id", F.posexplode("phrases").alias("phrase", "text")).select("set_id", "phrase", F.explode(F.array_distinct(terms_of("text"))).alias("term"))
        words = each.join(self.lexicon.select("term", "no", "df"), "term", "left")
        # A phrase with a word that no document has is held by none.
        whole = F.count_if(F.col("no").isNull()).over(Window.partitionBy("set_id", "phrase")) == 0
        asked = cut(words.withColumn("whole", whole).where("whole").select("set_id", "phrase", "no", "term"))
        wanted = self.lexicon.join(asked.select("term").distinct(), "term", "left_semi")
        n = wanted.agg(F.sum("df")).first()[0] or 0
        held, parts = met(self.postings.join(wanted.select("term", "no"), "term").select("doc_id", "no"), n, asked.select("set_id", "phrase", "no"), asked.count(), "set_id")
        hits = held.cogroup(parts).applyInArrow(lambda a, b: most_held(a, b, k), HELD)
        order = [F.desc("n"), F.col("doc_id")]
        ranked = top(hits, ["set_id"], order, k) if k else numbered(hits, ["set_id"], order)
        scored = ranked.join(sets, "set_id").select("phrases", "doc_id", (F.col("n") / F.size("phrases")).alias("score"), "rank")
        return keyed.join(scored, "phrases").select("query_id", "doc_id", "score", "rank")


def bm25_top(docs: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, doc_id, score, rank): the ``k`` best of ``docs`` for each of ``queries``, over an index of the terms asked for."""
    queries = queries.select("query_id", "text")
    return Index(docs, queries.select(F.explode(terms_of("text")).alias("term"))).best(queries, k)
