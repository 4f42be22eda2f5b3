"""Jaccard join and search against brute force on corpora made to be hard for them."""

import math
import random
import re
from collections import Counter

from girder.llm import jaccard, search

from test_operators import LOW, components


def near_copies(seed, families, members, length, shared):
    """Families of texts with edits that put many pairs close to a similarity of 0.8, chains among them, and common passages."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 6)))
    passages = [[word() for _ in range(shared)] for _ in range(3)]
    texts = []
    for _ in range(families):
        base = [word() for _ in range(rng.randint(6, length))] + rng.choice(passages)
        for _ in range(rng.randint(1, members)):
            text = list(base)
            for _ in range(rng.randint(0, max(1, len(text) // 40))):
                at, what = rng.randrange(len(text)), rng.random()
                if what < 0.4:
                    text[at] = word()
                elif what < 0.6:
                    del text[at]
                elif what < 0.8:
                    text.insert(at, word())
                else:
                    text = text[: max(1, int(len(text) * rng.uniform(0.75, 1)))]
            texts.append(" ".join(text))
            if rng.random() < 0.3:
                base = text  # a chain: the next one is made from this one
            if rng.random() < 0.2:
                texts.append(texts[-1])
    rng.shuffle(texts)
    return [(i * 3, t) for i, t in enumerate(texts)]


def test_jaccard_join_near_the_threshold(spark):
    for seed, families, members, length, shared in ((1, 60, 9, 120, 12), (2, 6, 90, 60, 8), (3, 150, 4, 20, 5)):
        rows = near_copies(seed, families, members, length, shared)
        got = Counter(tuple(r) for r in jaccard.join_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(7)).collect())
        assert got == components(rows), seed


def test_jaccard_join_other_thresholds(spark):
    rows = near_copies(4, 30, 8, 50, 10)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for size, percent in ((3, 60), (1, 90)):
        assert Counter(tuple(r) for r in jaccard.join_components(docs, size, percent).collect()) == components(rows, size, percent)


def test_search_over_many_shards(spark):
    rows = near_copies(5, 80, 6, 150, 10)
    rng = random.Random(9)
    common = [f"w{i}" for i in range(300)]
    rows = [(i, t + " " + " ".join(rng.choices(common, [1 / (1 + j) for j in range(300)], k=rng.randint(0, 200)))) for i, t in rows] + [(None, "w1 w2 w3"), (3, "w1 w2 w3")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(13)
    asked = [r for r in rows if r[0] is not None and r[0] % 21 == 0]
    bags = [Counter(re.findall(r"(?:[a-zA-Z0-9]|[^\x00-\x7f])+", t.translate(LOW))) for _, t in rows]
    n, mean = len(bags), sum(sum(b.values()) for b in bags) / len(bags)
    df = Counter(t for b in bags for t in b)
    got = search.top_k(docs, spark.createDataFrame(asked, "doc_id long, text string").repartition(5), 7).collect()
    for q, text in asked:
        own = Counter(re.findall(r"(?:[a-zA-Z0-9]|[^\x00-\x7f])+", text.translate(LOW)))
        scores = []
        for (i, _), b in zip(rows, bags):
            length = sum(b.values())
            s = sum(c * math.log1p((n - df[t] + 0.5) / (df[t] + 0.5)) * b[t] * 2.2 / (b[t] + 1.2 * (0.25 + 0.75 * length / mean)) for t, c in own.items() if t in b)
            scores.append((-s, i is None, i or 0))
        want = sorted(scores)[:7]
        mine = sorted((-r.score, r.doc_id is None, r.doc_id or 0) for r in got if r.query_id == q)
        assert len(mine) == len(want) and all(abs(x[0] - y[0]) < 1e-5 for x, y in zip(mine, want))
        last = want[-1][0] - 1e-4
        assert sorted(x[1:] for x in mine if x[0] < last) == sorted(x[1:] for x in want if x[0] < last)
