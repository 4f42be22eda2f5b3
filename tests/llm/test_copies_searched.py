"""Documents with equal bags of terms are searched once, and found as often as they are there."""

import math
import os
import random
import tempfile
from collections import Counter

import numpy as np
import pyarrow as pa

from girder.llm import search


def test_copies_are_found_but_not_searched(spark, monkeypatch):
    rng = random.Random(2)
    bags = [[f"t{int(rng.paretovariate(0.6)) % 60}" for _ in range(rng.randint(0, 25))] for _ in range(60)]
    texts = [" ".join(rng.sample(bag, len(bag))) for bag in bags * 3 + bags[:9] * 7]
    # Alike in score but not in terms, with copies whose ids lie on both sides of the other's.
    texts += ["x1 only", "x2 only", "x1 only", "only x1", "x2 and more words", "words and more x2"]
    ids = [i if i % 11 else None for i in range(len(texts) - 6)] + [1001, 1050, 1100, 1101, 1200, 1201]
    ids[20] = ids[80] = 7
    docs = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string").repartition(5)
    asked = [(q, texts[q]) for q in range(0, len(texts), 13)] + [(999, "x1 x2"), (998, "x1 x2")]
    counts = [Counter(t.split()) for t in texts]
    n, mean, df = len(counts), sum(c.total() for c in counts) / len(counts), Counter(t for c in counts for t in c)
    monkeypatch.setattr(search, "SHARD_DOCS", 20)
    for k in (3, 6):
        got = search.top_k(docs, spark.createDataFrame(asked, "doc_id long, text string"), k).collect()
        for q, text in asked:
            scores = []
            for i, c in zip(ids, counts):
                norm = 1.2 * (0.25 + 0.75 * c.total() / mean)
                s = sum(m * math.log1p((n - df[t] + 0.5) / (df[t] + 0.5)) * c[t] * 2.2 / (c[t] + norm) for t, m in Counter(text.split()).items() if t in c)
                if s > 0:
                    scores.append((-round(s, 6), i is None, i or 0))
            want = [(r, d if not null else None, -s) for r, (s, null, d) in enumerate(sorted(scores)[:k], 1)]
            mine = sorted((r["rank"], r.doc_id, r.score) for r in got if r.query_id == q)
            assert [m[0] for m in mine] == [w[0] for w in want] and all(abs(m[2] - w[2]) < 2e-6 for m, w in zip(mine, want, strict=True))
            if q in (998, 999):
                assert [m[1] for m in mine] == [1001, 1050, 1100, 1101, 1200, 1201][:k]
        index = search.build_index(search.id_and_text(docs))
        copies = search.copies_of(index, k)
        distinct = Counter(tuple(sorted(c.items())) for c in counts)
        assert copies.where("copy = 1").count() == len(distinct) and copies.count() == sum(min(k, m) for m in distinct.values())


def test_a_shard_answers_with_what_reaches_the_floor_and_has_only_its_places():
    texts = [f"common other w{i % 7} w{i}" for i in range(640)]
    held = list(search.term_counts(pa.array(texts)))
    path = os.path.join(tempfile.mkdtemp(), "shard")
    with open(path, "wb") as f:
        f.write(search.shard_file(list(range(640)), held))
    shard = search.Shard(f"file://{path}", 4.0, np.arange(640), np.ones(640, np.int64))
    terms = held[3][0]
    at = np.searchsorted(shard.terms, terms)
    for floor, n in ((0.0, 5), (3.5, None), (1e6, 0)):
        query, place, score = shard.search(np.zeros(len(at), np.int64), at, np.ones(len(at)), np.array([floor]), 5)
        assert len(query) == (n if n is not None else min(5, len(query))) and (score >= floor).all()
    some = search.Shard(f"file://{path}", 4.0, np.array([9, 2, 300]), np.array([1, 2, 3]))
    assert some.n == 3 and some.copies.tolist() == [2, 1, 3] and len(some.docs) == len(some.impact) == some.ends[-1]
