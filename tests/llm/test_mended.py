"""Counts by kind, packing in small partitions, long strings and fingerprints that are compared as they are returned."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest

from girder.llm import fingerprints, packing, private, suffixes
from girder.llm.tokenizing import encoder, vocabulary


def mixed_texts():
    rng = random.Random(11)
    say = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(n))
    parts = ["bob.x+1@mail.example.com", "a@b.example", "10.0.0.1", "10.0.0.256", "192.168.1.77", "4111 1111 1111 1111", "5500-0000-0000-0004", "4111 1111 1111 1112", "+1 (555) 123-4567", "+44 20 7946 0958", "+1 5", "0123456789abcdef0123456789abcdef"]
    return [" ".join([say(3), *rng.sample(parts, rng.randint(0, 6)), say(2)]) for _ in range(200)] + ["", None]


def test_private_counts_of_every_kind(spark):
    texts = mixed_texts()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in private.find_private(docs).collect()}
    kinds = Counter()
    for i, text in enumerate(texts):
        spans = private.base_spans(text or "")
        want = Counter(k for k, _, _ in spans)
        kinds += want
        r = got[i]
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(want[k] for k in range(4)), text
        assert r.base_sha256 == hashlib.sha256(",".join(f"{private.KINDS[k]}:{s}:{e}" for k, s, e in spans).encode()).hexdigest()
        every = set(r.spans.split(",")) - {""}
        assert {f"{private.KINDS[k]}:{s}:{e}" for k, s, e in spans} <= every
        assert r.n_spans == len(spans) + r.n_secret + r.n_added and r.n_secret == (text or "").count("0123456789abcdef0123456789abcdef")
    assert all(kinds[k] > 20 for k in range(4))


@pytest.mark.parametrize("partitions", [1, 3, 16])
def test_packing_whatever_the_partitions(spark, partitions):
    rng = random.Random(3)
    texts = ["".join(rng.choice("abcdefg ") for _ in range(int(10 ** rng.uniform(1, 4)))) for _ in range(300)] + ["", None, "word " * 9000]
    path = vocabulary("word_bpe_49k.json")
    ids = {i: encoder(path).whole(t or "") + b"\2\0\0\0" for i, t in enumerate(texts)}
    got = packing.pack_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(partitions), path).collect()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    padding = 0
    for spans in sequences.values():
        spans.sort()
        assert spans[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:]))
        filled = sum(n for _, n in spans)
        assert 0 < filled <= 4096
        padding += 4096 - filled if filled & (filled - 1) else 0
    cut = 0
    for i, own in ids.items():
        at = 0
        for r in sorted(pieces[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(own) // 4
            at += r.length
            assert r.ids_crc32 == zlib.crc32(own[4 * r.start : 4 * at])
        assert at == len(own) // 4
        cut += len(pieces[i]) > 1 and at <= 4096
    assert padding <= 0.01 * sum(len(x) // 4 for x in ids.values()) and cut <= {1: 0.02, 3: 0.04, 16: 0.15}[partitions] * len(texts)


@pytest.mark.parametrize("length", [511, 600, 1200])
def test_long_repeats(spark, length):
    rng = random.Random(length)
    say = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    shared = say(2000)
    rows = [(1, shared), (2, say(100) + shared + say(90)), (3, say(50) + shared[: length - 1] + say(50)), (4, shared[300 : 300 + length] + say(40) + shared[700:]), (5, "z" * 3000), (6, "z" * length)]
    first, want = {}, {}
    for i, t in rows:
        for p in range(len(t) - length + 1):
            first.setdefault(t[p : p + length], i)
    for i, t in rows:
        gone = [False] * len(t)
        for p in range(len(t) - length + 1):
            if first[t[p : p + length]] < i:
                gone[p : p + length] = [True] * length
        want[i] = (sum(gone), hashlib.sha256("".join(c for c, g in zip(t, gone) if not g).encode()).hexdigest())
    got = suffixes.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(2), length).collect()
    assert {r.doc_id: (r.n_removed, r.kept_sha256) for r in got} == want
    with pytest.raises(ValueError):
        suffixes.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), suffixes.LONGEST + 1)


def test_returned_fingerprints_are_what_is_compared(docs):
    """As sets of the returned anchors (no text of the fixture has anchors of both in another order)."""
    for r in fingerprints.fingerprint_edits(docs, part=1).collect():
        a, b = ({x.split(":")[0] for x in f.split(",")} for f in (r.fingerprint, r.edited_fingerprint))
        likeness = len(a & b) / len(a | b)
        assert r.near_edited <= likeness + 1e-9 and r.near_edited > likeness - 0.05
