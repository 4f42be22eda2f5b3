"""What found passages hold, and words counted by columns, against looking into each text."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from girder.operators import corpus, lexical, retrieval


def test_each_text_is_searched_once_and_stays_behind(spark, monkeypatch):
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abc1", k=rng.randint(1, 3)))
    texts = [(i, " ".join(word() for _ in range(rng.randint(0, 9))), f"n{i}") for i in range(80)] + [(3, "abc again", "twice"), (90, None, "null")]
    sought = [(q, rng.randint(0, 85), [word() for _ in range(4)]) for q in range(300)] + [(q, 7, ["a", "b"]) for q in range(200)] + [(1, 90, ["a"]), (2, None, ["a"]), (3, 4, [])]
    monkeypatch.setattr(retrieval, "GROUP_CHARS", 100)
    got = retrieval.words_held(spark.createDataFrame(sought, "query_id long, doc_id long, words array<string>"), spark.createDataFrame(texts, "doc_id long, low string, name string"))
    want = [(q, d, n, tuple(w for w in words if w in (low or ""))) for q, d, words in sought for i, low, n in texts if i == d]
    assert "low" not in got.columns and sorted((r.query_id, r.doc_id, r.name, tuple(r.held)) for r in got.collect()) == sorted(want)
    searched = Counter()

    class Text(str):
        def __contains__(self, w):
            searched[w] += 1
            return super().__contains__(w)

    class Low:
        as_py = staticmethod(lambda: Text("a text"))

    class Texts(dict):
        column_names, take = ("doc_id", "low"), lambda self, rows: pa.table({"doc_id": [7] * len(rows)})

    rows = pa.table({"query_id": [1, 2, 3], "doc_id": [7, 7, 7], "words": [["a", "b"], ["a"], ["b", "text"]]})
    found = retrieval.found_in(Texts(doc_id=pa.array([7]), low=[Low]), rows, ["query_id", "doc_id"])
    assert found["held"].to_pylist() == [["a"], ["a"], ["text"]] and searched == {"a": 1, "b": 1, "text": 1}


def test_words_are_counted_as_patterns_find_them():
    for ids, texts in (([1, 2, 5, 5], ["KB Éa-1 İx a a", "", "é z.z", " . q"]), ([], []), ([4], ["…"])):
        counts = [Counter(re.findall("[a-z0-9]+", x.lower())) for x in texts]
        rows = list(zip(*lexical.term_rows(ids, texts).to_pydict().values()))
        assert sorted(rows[:-1]) == sorted((i, w, n, c.total()) for i, c in zip(ids, counts) for w, n in c.items())
        assert rows[-1] == (None, None, sum(map(bool, counts)), sum(c.total() for c in counts))


def test_the_nearest_of_a_block_are_found_without_ordering_it(monkeypatch):
    rng = np.random.default_rng(3)
    vectors = rng.integers(-1, 2, (500, 4)).astype(float).tolist()  # many ties
    held = pa.table({"vec_id": rng.permutation(500), "embedding": vectors})
    asked = pa.table({"query_id": np.arange(40), "embedding": vectors[:40]})
    monkeypatch.setattr(corpus, "MET", 16)
    ordered, sort = [], np.argsort
    monkeypatch.setattr(corpus.np, "argsort", lambda a, *x, **y: ordered.append(a.size) or sort(a, *x, **y))
    for rows in (500, 10, 3):
        (ids, matrix), (queries, wanted) = corpus.units(held.slice(0, rows), "vec_id"), corpus.units(asked, "query_id")
        score = np.round(wanted @ matrix.T, 6)
        want = [(q, ids[j], score[n, j]) for n, q in enumerate(queries) for j in sorted(range(len(ids)), key=lambda j: (-score[n, j], ids[j]))[:10]]
        assert list(zip(*corpus.best_of_block(held.slice(0, rows), asked, 10).to_pydict().values())) == want
    assert max(ordered, default=0) < 500


def test_words_of_names_add_to_those_of_texts(spark):
    texts = [(1, "plan a-100 of the house"), (2, "house"), (3, None), (None, "plan house"), (4, "nothing")]
    names = [(1, "A-100 plan"), (2, "Plan 100 a"), (4, "House plan, plan")]
    asked = [(10, ["a 100", "plan house"]), (11, ["house"]), (12, ["plan"])]
    index = lexical.Index(spark.createDataFrame(texts, "doc_id long, text string")).with_words(spark.createDataFrame(names, "doc_id long, text string"))
    got = sorted(tuple(r) for r in index.holding(spark.createDataFrame(asked, "query_id long, phrases array<string>"), 2).collect())
    assert got == [(10, 1, 1.0, 1), (10, 2, 1.0, 2), (11, 1, 1.0, 1), (11, 2, 1.0, 2), (12, 1, 1.0, 1), (12, 2, 1.0, 2)]
