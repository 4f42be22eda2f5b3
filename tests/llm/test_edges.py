"""Odd inputs, and what the operators promise beyond their queries, by brute force."""

import bisect
import hashlib
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from girder.llm import fingerprints, mixing, packing, private, quality, search, sstable, suffixes, token_counts
from girder.llm.hashing import U, window_hashes
from girder.llm.tokenizing import encoder, vocabulary

LAST = (1 << 63) - 1


def test_pieces_join_to_the_tokenizers_ids(docs, rows):
    path = vocabulary("word_bpe_49k.json")
    whole = encoder(path).whole
    texts = defaultdict(list)
    for r in rows:
        texts[r[0]].append(whole(r[1] or "") + b"\2\0\0\0")
    pieces = packing.pack_documents(docs, path).collect()
    own = defaultdict(list)
    for p in pieces:
        own[p.doc_id].append(p)
    assert set(own) == set(texts)
    for i, held in own.items():
        # Several rows can have one id: their pieces start anew at 0, and each row's pieces have its ids.
        want = Counter()
        for ids in texts[i]:
            cuts = sorted({p.start for p in held if p.doc_tokens == len(ids) // 4} | {len(ids) // 4})
            want[len(ids) // 4] += 1
            if len(texts[i]) == 1:
                assert [zlib.crc32(ids[4 * a : 4 * b]) for a, b in zip(cuts, cuts[1:])] == [p.ids_crc32 for p in sorted(held, key=lambda p: p.start)]
                assert [b - a for a, b in zip(cuts, cuts[1:])] == [p.length for p in sorted(held, key=lambda p: p.start)]
        assert sum(p.length for p in held) == sum(len(x) // 4 for x in texts[i])
        assert sum(p.start == 0 for p in held) == len(texts[i])
    sequences = defaultdict(list)
    for p in pieces:
        sequences[p.sequence_id].append((p.offset, p.length))
    for held in sequences.values():
        held.sort()
        assert held[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(held, held[1:])) and sum(held[-1]) <= 4096


def test_packing_cuts_few_and_balances():
    import random

    rng = random.Random(2)
    lengths = [min(30_000, int(rng.lognormvariate(6, 1.2)) + 1) for _ in range(6000)]
    pieces = packing.pack(lengths, 4096)
    times = Counter(p[0] for p in pieces)
    fitting = [i for i, n in enumerate(lengths) if n <= 4096]
    assert sum(times[i] > 1 for i in fitting) < 0.01 * len(fitting)
    fill = Counter()
    for _, _, n, k, _ in pieces:
        fill[k] += n
    assert sum(4096 - n for n in fill.values() if n & (n - 1)) < 0.02 * sum(lengths)


def naive_anchors(raw: bytes) -> dict[int, int]:
    """Hash -> first place of each run of K bytes whose smallest inner run of S bytes is at an edge."""
    k, s = fingerprints.K, fingerprints.S
    data = np.frombuffer(raw, np.uint8)
    small, large = window_hashes(data, s).tolist(), (window_hashes(data, k) >> U(32)).tolist()
    out: dict[int, int] = {}
    for i in range(len(raw) - k + 1):
        inner = small[i : i + k - s + 1]
        if min(inner) in (inner[0], inner[-1]):
            out.setdefault(large[i], i)
    return out


def naive_likeness(a: bytes, b: bytes) -> float:
    x, y = naive_anchors(a), naive_anchors(b)
    if a == b:
        return 1.0
    if not x or not y:
        return 0.0
    there, ends = [y[h] for h in sorted(x, key=x.get) if h in y], []
    for p in there:
        at = bisect.bisect_left(ends, p)
        ends[at : at + 1] = [p]
    return len(ends) / (len(x) + len(y) - len(there))


def test_fingerprints_by_brute_force(docs, rows):
    order = sorted(((r[0], r[1] or "") for r in rows), key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    want = Counter()
    for (i, t), (_, u) in zip(order, order[1:] + order[:1]):
        edited = fingerprints.edit(t, u)
        want[(i, len(t), round(naive_likeness(t.encode(), edited.encode()), 9), round(naive_likeness(t.encode(), u.encode()), 9))] += 1
    got = fingerprints.fingerprint_edits(docs, 1).collect()
    assert Counter((r.doc_id, r.n_chars, round(r.near_edited, 9), round(r.near_next, 9)) for r in got) == want
    by_text = {}
    for r in rows:
        by_text.setdefault(r[0], r[1] or "")
    one = next(r for r in got if r.doc_id == 10)
    assert one.fingerprint == ",".join(f"{h:08x}:{p:x}" for h, p in sorted(naive_anchors(by_text[10].encode()).items(), key=lambda x: x[1]))


@pytest.mark.parametrize("length", [7, 25, 51])
def test_suffixes_of_any_length(spark, length):
    import random

    rng = random.Random(length)
    say = lambda n: "".join(rng.choice("ab ") for _ in range(n)) if length < 20 else "".join(rng.choice("abcdefgh ") for _ in range(n))
    shared = say(80)
    rows = [(i, say(40) + (shared[: 30 + i % 50] if i % 2 else "") + say(30)) for i in range(60)] + [(LAST, shared), (None, shared), (7, shared)]
    first = {}
    for i, t in sorted(rows, key=lambda r: LAST if r[0] is None else r[0]):
        for p in range(len(t) - length + 1):
            first.setdefault(t[p : p + length], LAST if i is None else i)
    want = Counter()
    for i, t in rows:
        gone = [False] * len(t)
        for p in range(len(t) - length + 1):
            if first[t[p : p + length]] < (LAST if i is None else i):
                gone[p : p + length] = [True] * length
        want[(i, sum(gone), hashlib.sha256("".join(c for c, g in zip(t, gone) if not g).encode()).hexdigest())] += 1
    got = suffixes.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), length)
    assert Counter((r.doc_id, r.n_removed, r.kept_sha256) for r in got.collect()) == want


def test_gumbel_noise_samples_by_weight():
    weights = np.log(np.array([0.5, 0.25, 0.15, 0.1]))
    ids = np.arange(4)
    taken = Counter()
    for seed in range(4000):
        noise = -np.log(-np.log(quality.uniform(ids, seed)))
        taken[int(np.argmax(weights + noise))] += 1
    assert all(abs(taken[i] / 4000 - math.exp(weights[i])) < 0.03 for i in range(4))


def test_quantile_is_exact(spark):
    values = [float((i * 7919) % 1000) for i in range(1000)] + [None]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    known = sorted(v for v in values if v is not None)
    for share in (0.001, 0.01, 0.5, 0.999, 1.0):
        assert quality.quantile(df, "x", share) == known[max(0, math.ceil(share * 1000) - 1)]
    assert quality.quantile(df.where("false"), "x", 0.5) is None


def test_clashing_columns_nulls_and_repeats(spark):
    texts = ["good words in here " * 5, "bad ### text ### " * 5, None, "", "good words in here " * 5]
    rows = [(i, t, "a", True, 1, 2, 3) for i, t in enumerate(texts)] + [(None, "x", None, False, 0, 0, 0), (0, texts[0], "a", True, 1, 2, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, __good boolean, weight int, row int, good int")
    labels = spark.createDataFrame([(0, 1, 0), (1, 0, 0), (4, 1, 0)], "doc_id long, quality int, toxic int")
    kept = quality.Selection(docs, labels).keep(docs)
    assert kept.columns == docs.columns and kept.count() >= 1
    assert quality.resample(docs, labels).where("doc_id = 0").count() in (0, 2)
    assert mixing.mix_documents(docs, [3, 1, 2]).columns == docs.columns
    taken = Counter(r.doc_id for r in mixing.copies(docs, [3, 1, 2]).where("text IS NULL").select("doc_id", "__size").collect())
    assert taken == Counter({2: 1})
    assert private.redact(docs).columns == docs.columns and private.redact(docs).count() == len(rows)
    asked = spark.createDataFrame([(1, "good words"), (1, "good words"), (2, None), (3, "zzz")], "doc_id long, text string")
    found = search.top_k(docs, asked, 2).collect()
    assert Counter(r.query_id for r in found) == Counter({1: 4}) and search.top_k(docs.where("false"), asked, 2).count() == 0
    assert search.top_k(docs, asked.where("false"), 2).count() == 0


def test_long_units_are_not_kept():
    u = token_counts.unigram(vocabulary("piece_bpe_32k.model"))
    e = encoder(vocabulary("byte_bpe_50k.json"))
    long = "ab1" * 400
    assert u.tokens(long) == u.viterbi("▁" + long) and e.ids(" " + long) == e.whole(" " + long)
    assert not any(len(k) > 64 for k in u.known) and not any(len(k) > 64 for k in e.units)


def test_wide_ids_are_refused():
    w = sstable.Writer(2)
    with pytest.raises(ValueError):
        w.add(sstable.key_of(1), (70_000).to_bytes(4, "little"))


def test_planted_identifiers_are_found(spark):
    """Recall and precision of discovery: unseen kinds behind learned contexts, decoys elsewhere."""
    seeds = [f"note {i} badge no: {4000 + i}-11 and mail to: u{i}@h{i}.example.org ok" for i in range(60)]
    hidden = [f"other {i} mail to: user{i}[at]site{i} ok" for i in range(10)] + [f"more {i} mail to: staff{i}#intranet ok" for i in range(10)]
    clean = [f"room {i}00123456 and item user{i}[at]desk stay" for i in range(40)]
    docs = spark.createDataFrame(list(enumerate(seeds + hidden + clean)), "doc_id long, text string")
    got = {r.doc_id: r for r in private.find_private(docs).collect()}
    found = sum(got[len(seeds) + i].n_added > 0 for i in range(len(hidden)))
    wrong = sum(got[len(seeds) + len(hidden) + i].n_added > 0 for i in range(len(clean)))
    assert found == len(hidden) and wrong == 0


def test_pipeline_stage_by_stage(spark, docs, rows, tmp_path):
    import corpus_pipeline

    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "private", "mixing", "packing"]
    stage = dict(corpus_pipeline.STAGES)
    spark.createDataFrame([(i, 1, 0) for i in range(20)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    at = str(tmp_path)
    good = stage["quality"](spark, docs, at)
    assert good.columns == docs.columns
    assert good.join(docs.select(F.col("doc_id").alias("i"), F.col("text").alias("t")), F.col("doc_id").eqNullSafe(F.col("i")) & F.col("text").eqNullSafe(F.col("t")), "left_anti").count() == 0
    clean = stage["private"](spark, docs, at)
    bare = {r[0]: r[1] for r in rows}
    for r in clean.collect():
        spans = private.base_spans(bare[r.doc_id] or "") if r.doc_id not in (3, 5, None) else []
        if spans:
            assert all(bare[r.doc_id][s:e] not in r.text for _, s, e in spans)
    mixed = stage["mixing"](spark, docs.where("doc_id IS NOT NULL"), at)
    assert mixed.columns == docs.columns and max(Counter((r.doc_id, r.text) for r in mixed.collect()).values()) <= 4
    packed = stage["packing"](spark, docs, at).collect()
    whole = encoder(vocabulary("word_bpe_49k.json")).whole
    assert sum(p.length for p in packed) == sum(len(whole(r[1] or "")) // 4 + 1 for r in rows)
