"""The passages that share most words with a question.

Chunks are dealt out by document to shards of a bounded number of postings, as in ``lexical``. Each shard meets all
questions, adds up the words shared with each chunk in one array and leaves the best chunks of its k best documents, whose
best are those of all. So the postings are shuffled once, and pairs of a question and a chunk are never rows.
"""

from __future__ import annotations

from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lexical import met
from .retrieval import ranked
from .schedule import cut

SHARED = "query_id long, doc_id long, chunk_index long, score long"


def best_of_shard(held: pa.Table, asked: pa.Table, k: int) -> pa.Table:
    """SHARED rows: the best chunks of the ``k`` best documents of a shard's postings (doc_id, chunk_index, no) for each question (query_id, no, weight)."""
    doc, chunk, no = (held[c].to_numpy() for c in ("doc_id", "chunk_index", "no"))
    order = np.lexsort((chunk, doc))
    doc, chunk, no = doc[order], chunk[order], no[order]
    new_doc = np.diff(doc, prepend=doc[:1] - 1) != 0
    new_chunk = new_doc | (np.diff(chunk, prepend=chunk[:1] - 1) != 0)
    place = np.cumsum(new_chunk) - 1
    chunk, docs = chunk[new_chunk], doc[new_doc]
    starts = np.append(place[new_doc], len(chunk))
    order = np.lexsort((place, no))
    place, no = place[order], no[order]
    once = (np.diff(no, prepend=no[:1] - 1) != 0) | (np.diff(place, prepend=place[:1] - 1) != 0)
    place, no = place[once], no[once]
    terms, first = np.unique(no, return_index=True)
    ends = np.append(first, len(no))
    query, no, weight = (asked[c].to_numpy() for c in ("query_id", "no", "weight"))
    at = np.minimum(np.searchsorted(terms, no), max(len(terms) - 1, 0))
    known = np.flatnonzero(terms[at] == no) if len(terms) else np.array([], np.int64)
    known = known[np.argsort(query[known], kind="stable")]
    query, at, weight = query[known], at[known], weight[known]
    total, out = np.zeros(len(chunk), np.int64), []
    for lo, hi in pairwise(np.append(np.flatnonzero(np.diff(query, prepend=query[:1] - 1)), len(query))):
        total[:] = 0
        for t, w in zip(at[lo:hi], weight[lo:hi], strict=True):
            total[place[ends[t] : ends[t + 1]]] += w
        best = np.maximum.reduceat(total, starts[:-1])
        hits = np.flatnonzero(best)
        if len(hits) > k:
            hits = hits[best[hits] >= np.partition(best[hits], -k)[-k]]
        hits = hits[np.argsort(-best[hits], kind="stable")[:k]]  # documents ascend
        found = [starts[h] + np.argmax(total[starts[h] : starts[h + 1]]) for h in hits]
        out.append((np.full(len(hits), query[lo]), docs[hits], chunk[found], best[hits]))
    columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.array([], np.int64)] * 4
    return pa.table({name.split()[0]: pa.array(c, pa.int64()) for name, c in zip(SHARED.split(", "), columns, strict=True)})


def overlap_top(asked: DataFrame, held: DataFrame, k: int) -> DataFrame:
    """(query_id, doc_id, chunk_index, score, rank): the ``k`` documents whose best chunk shares most with a question.

    ``asked`` has query_id and term, ``held`` doc_id, chunk_index and term; a term that is asked repeatedly counts so
    often, one that a chunk has repeatedly once. Ties go to the smaller chunk and document; null terms and questions
    without a term in any chunk give no row.
    """
    kinds = {c: held.schema[c].dataType for c in ("doc_id", "chunk_index")}
    long = lambda c: F.col(c).cast("long").alias(c)
    listed = asked.where("term IS NOT NULL AND query_id IS NOT NULL").groupBy("query_id").agg(F.collect_list("term").alias("terms"))  # a question's terms are few
    numbered = cut(listed.select(F.col("query_id").alias("name"), F.monotonically_increasing_id().alias("query_id"), "terms"))
    wanted = numbered.select("query_id", F.explode("terms").alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("weight"))
    lexicon = cut(numbered.select(F.explode("terms").alias("term")).distinct().select("term", F.monotonically_increasing_id().alias("no")))
    postings = cut(held.where("doc_id IS NOT NULL AND chunk_index IS NOT NULL").join(lexicon, "term").select(long("doc_id"), long("chunk_index"), "no"))
    known = cut(wanted.join(lexicon, "term").select("query_id", "no", "weight"))
    shards, questions = met(postings, postings.count(), known, known.count(), "query_id")
    found = shards.cogroup(questions).applyInArrow(lambda a, b: best_of_shard(a, b, k), SHARED)
    best = ranked(found, "query_id", "score", "doc_id", k).join(numbered.select("query_id", "name"), "query_id")
    return best.select(F.col("name").alias("query_id"), *(F.col(c).cast(kind).alias(c) for c, kind in kinds.items()), "score", "rank")
