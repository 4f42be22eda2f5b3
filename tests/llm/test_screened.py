"""Line dedup, the prefix trie and resampling against brute force, with nulls, ties, repeats and empty tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from girder.llm import line_dedup, prefix_trie, resampling, screening

from test_operators import LOW

LAST = line_dedup.LAST_ID
BLANK = " \t\n\v\f\r"


def line_rows():
    rng = random.Random(8)
    line = lambda: "".join(rng.choice("abcdef ÄéÜ日") for _ in range(rng.randint(0, 40)))
    common = [line() for _ in range(30)] + ["0123456789", "012345678", "  Shared Line of Text\t", "shared line of text", "Ä" * 10, "ä" * 10, "\x1c" + "x" * 10, "x" * 10]
    texts = ["\n".join(rng.choice(common) if rng.random() < 0.4 else line() for _ in range(rng.randint(1, 12))) for _ in range(80)]
    texts += ["", "\n", "\n\n\n", None, "shared line of text", "SHARED LINE OF TEXT\n SHARED line of text \nother", "z" * 100_000 + "\n" + common[0], "\n".join(common) + "\n"]
    rows = [(i * 3, t) for i, t in enumerate(texts)]
    return rows + [(6, texts[2]), (6, texts[5]), (None, texts[3]), (None, texts[3]), (LAST, texts[4])]


def deduplicated(rows, least=10):
    key = lambda x: x.strip(BLANK).translate(LOW)
    own = lambda i: LAST if i is None else i
    holders = defaultdict(set)
    for i, t in rows:
        for x in (t or "").split("\n"):
            holders[key(x)].add(own(i))
    out = Counter()
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key(x)) < least or own(i) == min(holders[key(x)])]
        out[(i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest(), "\n".join(kept))] += 1
    return out


@pytest.mark.parametrize("partitions", [1, 5])
def test_line_dedup(spark, partitions):
    rows = line_rows()
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, owner string, row int").repartition(partitions)
    got = Counter(tuple(r) for r in line_dedup.drop_repeated_lines(docs).collect())
    assert got == deduplicated(rows) and sum(r[2] for r in got) > 50
    assert Counter(tuple(r) for r in line_dedup.drop_repeated_lines(docs, 1).collect()) == deduplicated(rows, 1)
    assert line_dedup.drop_repeated_lines(docs.limit(0)).count() == 0


def test_line_held_by_all_documents(spark):
    rows = [(i, f"a line that all hold\nown line number {i}\na line that all hold") for i in range(3000, 0, -1)]
    got = {r.doc_id: r.n_dropped for r in line_dedup.drop_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(7)).collect()}
    assert got == {i: 2 * (i > 1) for i, _ in rows}


def nodes_by_definition(rows):
    def order(r):
        whole = f"{len((r[2] or '').encode())}:{r[2] or ''}{r[3] or ''}".encode()
        return (r[1] is not None, r[1] or 0, hashlib.sha256(whole).digest()[:16])

    own = defaultdict(list)
    for r in sorted((r for r in rows if r[0] is not None), key=order):
        own[r[0]].append((r[2] or "", r[3] or ""))
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = tuple(own.get(c - c % 20, [])[:h] + turns[h:])
    members = defaultdict(list)
    for c, turns in sorted(built.items()):
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t))
    out, totals = Counter(), {}
    for node in sorted(members, key=len, reverse=True):
        below = [totals[x] for x in children[node]]
        saved = (len(members[node]) - 1) * words(node[-1][1]) if node else 0
        totals[node] = (sum(a for a, _ in below) or 1, saved + sum(b for _, b in below))
        ends = ",".join(str(c) for c in members[node] if built[c] == node)
        above = members[node[:-1]][0] if node else None
        out[(members[node][0], len(node), above, len(members[node]), len(children[node]), *totals[node], hashlib.sha256(ends.encode()).hexdigest())] += 1
    return out


def conversation_rows(seed, n, vocabulary):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(n * 2), n):
        for turn in range(rng.choice([1, 1, 2, 3, 5, 8])):
            rows.append((c, turn, rng.choice(["user", "assistant", None]), f"say {rng.randrange(vocabulary)} things" if rng.random() < 0.9 else None))
    rows += [(7, None, "user", "null turn"), (7, 0, "user", "tie a"), (7, 0, "user", "tie b"), (None, 0, "user", "nobody"), (41, 3, "user", "same"), (41, 3, "user", "same")]
    return rows + [(10**12 + k, t, "user", "say it again and again") for k in range(40) for t in range(5)]


@pytest.mark.parametrize("seed,n,vocabulary", [(1, 150, 2), (2, 150, 50), (3, 60, 1)])
def test_prefix_trie(spark, seed, n, vocabulary):
    rows = conversation_rows(seed, n, vocabulary)
    table = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, digest string").repartition(4)
    got = Counter(tuple(r) for r in prefix_trie.prefix_nodes(table).collect())
    assert got == nodes_by_definition(rows)
    assert prefix_trie.prefix_nodes(table.limit(0)).count() == 0


def test_trie_of_one_long_conversation_and_none(spark):
    rows = [(c, t, "user", f"turn {t}") for c in (20, 40) for t in range(3000)] + [(5, 0, "a", "b")]
    got = Counter(tuple(r) for r in prefix_trie.prefix_nodes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect())
    assert got == nodes_by_definition(rows)


def test_sketches_never_miss_a_repeat():
    rng = np.random.default_rng(4)
    for kind in (screening.BloomPair, screening.CountMin):
        sketch = kind(2000)
        parts = [np.unique(rng.integers(0, 3000, 700)).astype("<u4") for _ in range(4)]
        for part in parts:
            sketch.add(part, False)
        sketch.add(np.array([5000], "<u4"), True)
        times = Counter(x for part in parts for x in part.tolist())
        often = np.array([x for x, n in times.items() if n > 1] + [5000], "<u4")
        assert sketch.may_repeat(often).all()
        rare = np.array([x for x, n in times.items() if n == 1], "<u4")
        assert sketch.may_repeat(rare).mean() < 0.3


def resampled(rows, target, percent, least, longest, buckets):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOW))
    runs = lambda w: [" ".join(w[i : i + k]) for k in range(1, longest + 1) for i in range(len(w) - k + 1)]
    bag = lambda t: Counter(zlib.crc32(x.encode()) % buckets for x in runs(words(t)))
    bags, s, t = [bag(text) for _, text in rows], Counter(), Counter()
    for b in bags:
        s.update(b)
    for text in target:
        t.update(bag(text))
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (sum(s.values()) + buckets) / ((s[b] + 1) * (sum(t.values()) + buckets))))
    out = []
    for (i, _), b in zip(rows, bags):
        n = sum(b.values())
        weight = sum(c * gain(k) for k, c in b.items()) // n if n else 0
        h = int(hashlib.sha256(f"2024:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, n, weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(able[: percent * len(able) // 100]):
        r[4] = k + 1
    return Counter(map(tuple, out))


@pytest.mark.parametrize("longest,buckets,percent", [(1, 10_000, 10), (3, 500, 35)])
def test_resampling(spark, longest, buckets, percent):
    rng = random.Random(longest)
    word = lambda: rng.choice(["alpha", "Beta", "γάμμα", "x1", "z" * 60, "d" * 48, "e" * 49, "Ü"])
    line = lambda: " ".join(word() + rng.choice(["", ",", "--"]) for _ in range(rng.randint(0, 9)))
    hot = "a boilerplate line that many texts have"
    texts = ["\n".join(rng.choice([hot, line(), line()]) for _ in range(rng.randint(1, 8))) for _ in range(120)] + ["", None, "...", "one", "\n\n", "q" * 200_000]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, texts[0]), (3, texts[3]), (4, texts[5])]
    target = [line() for _ in range(9)] + [hot, None]
    docs = spark.createDataFrame([(i, t, "s") for i, t in rows], "doc_id long, text string, score string").repartition(3)
    aim = spark.createDataFrame([(t,) for t in target], "text string")
    got = Counter(tuple(r) for r in resampling.resample(docs, aim, percent, 20, longest, buckets).collect())
    assert got == resampled(rows, target, percent, 20, longest, buckets)
    assert resampling.resample(docs.limit(0), aim).count() == 0
    assert resampling.resample(docs, aim.limit(0)).count() == len(rows)
    kept = resampling.drawn(docs, aim, percent=percent, longest=longest, buckets=buckets)
    assert kept.columns == docs.columns and 0 < kept.count() < len(rows)
