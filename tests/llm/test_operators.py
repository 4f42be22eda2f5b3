"""The training-data operators against brute force, round trips and held-out labels."""

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest

from girder.llm import fingerprints, jaccard, mixing, packing, private, quality, search, sstable, suffixes, token_counts
from girder.llm.common import id_and_text, new_dir
from girder.llm.tokenizing import encoder, vocabulary

LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def test_suffix_dedup_is_exact(docs, rows, nothing):
    seen, want = {}, Counter()
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    first = {}
    for r in order:
        b = (r[1] or "").encode()
        for p in range(len(b) - 49):
            first.setdefault(b[p : p + 50], r[0] if r[0] is not None else math.inf)
    for r in rows:
        b, own = (r[1] or "").encode(), r[0] if r[0] is not None else math.inf
        gone = bytearray(len(b))
        for p in range(len(b) - 49):
            if first[b[p : p + 50]] < own:
                gone[p : p + 50] = b"\1" * 50
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        want[(r[0], len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())] += 1
    assert Counter(tuple(r)[:5] for r in suffixes.remove_repeats(docs).collect()) == want
    assert suffixes.remove_repeats(nothing).count() == 0


def components(rows, size=5, percent=80):
    sets = []
    for r in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (r[1] or "").translate(LOW))
        sets.append({tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set()))
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, s in enumerate(sets):
        for j in range(i):
            if s and 100 * len(s & sets[j]) >= percent * len(s | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        k = find(i)
        if r[0] is not None:
            least[k] = min(least.get(k, r[0]), r[0])
    return Counter((r[0], len(sets[i]), least.get(find(i)) if sets[i] else r[0]) for i, r in enumerate(rows))


def test_jaccard_join_is_exact(docs, rows, nothing):
    assert Counter(tuple(r) for r in jaccard.join_components(docs).collect()) == components(rows)
    assert jaccard.join_components(nothing).count() == 0


def test_near_duplicates_keeps_one_row_of_each_group(spark, docs, rows):
    import corpus_pipeline

    text = "one two three four five six seven eight nine ten"
    small = [(None, text), (None, text), (None, text), (9, "some other words that stand alone here"), (9, "some other words that stand alone here")]
    small += [(2, "a b c d e f g h i j"), (5, "a b c d e f g h i j"), (5, "clean text under a known id and no copy"), (None, ""), (None, ""), (7, None)]
    table = spark.createDataFrame(small, "doc_id long, text string").repartition(3)
    got = Counter(tuple(r) for r in corpus_pipeline.near_duplicates(spark, table, "").collect())
    want = Counter({(None, text): 1, small[3]: 1, small[5]: 1, small[7]: 1, (None, ""): 2, (7, None): 1})
    assert got == want

    groups = Counter()  # brute force over the common corpus: each text's component, by giving each row an id of its own
    own = [(i, r[1]) for i, r in enumerate(rows)]
    least = {i: c for i, _, c in components(own)}
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0))
    for i in order:
        groups.setdefault(least[i] if (rows[i][1] or "").split() else ("wordless", i), rows[i][0])
    kept = [r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()]
    assert Counter(kept) == Counter(groups.values())


def test_search_is_exact(docs, rows, nothing):
    term = lambda t: Counter(re.findall(r"(?:[a-zA-Z0-9]|[^\x00-\x7f])+", (t or "").translate(LOW)))
    bags = [term(r[1]) for r in rows]
    n, mean = len(bags), sum(sum(b.values()) for b in bags) / len(bags)
    df = Counter(t for b in bags for t in b)
    got = search.top_k(docs, docs.where("doc_id IN (0, 7, 50, 60)"), 5).collect()
    for q in (0, 7, 50, 60):
        own = next(b for r, b in zip(rows, bags) if r[0] == q)
        scores = []
        for r, b in zip(rows, bags):
            s = sum(c * math.log1p((n - df[t] + 0.5) / (df[t] + 0.5)) * b[t] * 2.2 / (b[t] + 1.2 * (0.25 + 0.75 * sum(b.values()) / mean)) for t, c in own.items() if t in b)
            if s > 0:
                scores.append((-round(s, 6), r[0] is None, r[0]))
        want = sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:5]
        mine = sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)
        assert [r.doc_id for r in mine] == [d for _, _, d in want]
        assert all(abs(r.score + s) < 1e-5 for r, (s, _, _) in zip(mine, want))
    assert search.top_k(docs, nothing, 5).count() == 0


def test_pack_fills_every_sequence():
    lengths = [5000, 1, 1, 0, 4096, 300, 77, 12000, 2048, 9]
    pieces = packing.pack(lengths, 4096)
    for d, n in enumerate(lengths):
        own = sorted((s, m) for i, s, m, _, _ in pieces if i == d)
        assert sum(m for _, m in own) == n and all(a + b == c for (a, b), (c, _) in zip(own, own[1:]))
    for k in {p[3] for p in pieces}:
        own = sorted((at, m) for _, _, m, i, at in pieces if i == k)
        total = sum(m for _, m in own)
        assert own[0][0] == 0 and all(a + b == c for (a, b), (c, _) in zip(own, own[1:]))
        assert total == 4096 or total & (total - 1) == 0


def test_packed_ids_are_the_tokenizers(docs, rows, nothing):
    path = vocabulary("word_bpe_49k.json")
    whole = encoder(path).whole
    want = Counter((r[0], zlib.crc32(whole(r[1] or "") + b"\2\0\0\0")) for r in rows)
    got = Counter(tuple(r) for r in packing.pack_documents(docs, path).where("length = doc_tokens").select("doc_id", "ids_crc32").collect())
    assert not got - want and sum(got.values()) > 0.9 * len(rows)
    totals = packing.pack_documents(docs, path).groupBy("sequence_id").sum("length").collect()
    assert all(r[1] <= 4096 for r in totals)
    assert packing.pack_documents(nothing, path).count() == 0


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_remembered_units_equal_whole_texts(rows, name):
    e = encoder(vocabulary(name))
    odd = ["it's It'S", "a  b\n\n c", "<|endoftext|>x <|startoftext|>", "\xa0 a", "½²³ ªº ÀÉß", "x y", "\x1d a", " \n a \r\n"]
    assert all(e.ids(t) == e.whole(t) for t in odd + [r[1] or "" for r in rows])


def test_token_counts_equal_the_library(docs, rows, nothing):
    from tokenizers import Tokenizer, models, normalizers

    path = vocabulary("piece_bpe_32k.model")
    u = token_counts.Unigram(path)
    t = Tokenizer(models.Unigram(u.vocab, unk_id=u.unk, byte_fallback=True))
    t.normalizer = normalizers.Sequence([normalizers.Prepend("▁"), normalizers.Replace(" ", "▁")])
    want = Counter((r[0], len(r[1] or ""), len(t.encode(r[1] or "", add_special_tokens=False).ids)) for r in rows)
    assert Counter(tuple(r) for r in token_counts.count_tokens(docs, path).collect()) == want
    assert token_counts.count_tokens(nothing, path).count() == 0


def test_mix_meets_targets(spark, docs, nothing):
    big = spark.createDataFrame([(i, "w " * (1 + i % 9), "abc"[i % 7 % 3]) for i in range(3000)], "doc_id long, text string, source string")
    got = mixing.copies(big, [3, 1, 2]).groupBy("source").agg({"__target": "max", "__source_size": "max"}).collect()
    sizes = {r.source: r["max(__source_size)"] for r in got}
    targets = {r.source: r["max(__target)"] for r in got}
    assert math.isclose(sum(targets.values()), 1.5 * sum(sizes.values())) and all(targets[s] <= 2 * sizes[s] for s in sizes)
    taken = Counter()
    for r in mixing.copies(big, [3, 1, 2]).collect():
        taken[r.source] += r["__size"] * r["__copies"]
        assert r["__copies"] <= 2
    assert all(abs(taken[s] - targets[s]) < 0.06 * targets[s] for s in targets)
    assert mixing.copies(nothing, [3, 1, 2]).count() == 0 and mixing.mix_documents(docs, [3, 1, 2]).columns == docs.columns


def test_base_spans_equal_the_patterns(rows):
    def base(t):
        out = [(0, *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
        out += [(1, *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m.group().split("."))]
        for k, p, lo, hi in ((2, r"[0-9]([\x20-]?[0-9])+", 16, 19), (3, r"\+[0-9][\x20().0-9-]+[0-9]", 8, 15)):
            for m in re.finditer(p, t):
                d = re.sub("[^0-9]", "", m.group())
                if lo <= len(d) <= hi and (k == 3 or private.passes_luhn(d)):
                    out.append((k, *m.span()))
        return out

    odd = ["a@b.c@d.e", "@@x@y", "a@b", "x@y.z.", "1.2.3.4.5.6.7.8.9", "001.0002.3.4", "+1+22222222 333", "4111-1111 1111 1111 1", "..@a.b", "1" * 40, "é@x.y a_b@c.d"]
    for t in odd + [r[1] or "" for r in rows]:
        assert private.base_spans(t) == base(t), t


def test_patterns_discover_and_redact(spark, nothing):
    seed = [(i, f"filler words mail to: user{i}@host{i}.example.org thanks", 1) for i in range(40)]
    hidden = [(100 + i, f"other words mail to: user{i}[at]host{i}99 thanks", 1) for i in range(4)]
    clean = [(200 + i, f"room {i}1234567 is fine", 1) for i in range(20)]
    docs = spark.createDataFrame(seed + hidden + clean, "doc_id long, text string, n_chars long")
    got = {r.doc_id: r for r in private.find_private(docs).collect()}
    assert all(got[i].n_email == 1 for i in range(40)) and all(got[100 + i].n_added == 1 for i in range(4))
    assert not any(got[200 + i].spans for i in range(20))
    out = {r.doc_id: r for r in private.redact(docs).collect()}
    assert out[7].text == "filler words mail to: [EMAIL] thanks" and out[7].n_chars == len(out[7].text)
    assert out[203].text == "room 31234567 is fine" and private.find_private(nothing).count() == 0


def test_patterns_discover_words_and_groups(spark):
    """Digit-free and spelled addresses, numbers in groups; ordinary words count in a pattern, so a common context marks none."""
    rows = [f"filler words mail to: user{i}@host{i}.example.org thanks" for i in range(40)]
    rows += [f"filler words call me +1 (555) 123-{4000 + i} thanks" for i in range(40)]
    rows += [f"it went to the 10.1.2.{i} today" for i in range(20)] + [f"it went to the {'abcdefghij'[i % 10] * (6 + i // 10)} today" for i in range(60)]
    rows += ["it went to the X123456 today"]
    hidden = {
        "mail to: jane[at]mail.example": "jane[at]mail.example",
        "mail to: bob at mail dot com": "bob at mail dot com",
        "call me (743) 555-3824": "(743) 555-3824",
        "call me DE89 3704 0044 0532 0130 00": "DE89 3704 0044 0532 0130 00",
        "call me 4111 1111 1111 1112": "4111 1111 1111 1112",
    }
    first = len(rows)
    rows += [f"other words {text} thanks" for text in hidden]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {r.doc_id: r for r in private.find_private(docs).collect()}
    for i, (text, want) in enumerate(hidden.items(), first):
        spans = [s.split(":")[1:] for s in got[i].spans.split(",") if s]
        assert [rows[i][int(s) : int(e)] for s, e in spans] == [want], text
    assert not any(got[i].n_added for i in range(first))
    out = {r.doc_id: r.text for r in private.redact(docs).collect()}
    assert [out[i] for i in range(first, first + 5)] == ["other words mail to: [EMAIL] thanks"] * 2 + ["other words call me [PHONE] thanks"] * 3 and out[first - 1] == rows[first - 1]


def test_shards_keep_and_find_ids(spark, docs, rows, nothing):
    path = vocabulary("byte_bpe_50k.json")
    whole, folder = encoder(path).whole, new_dir(spark, "sst-test")
    manifest = sstable.write_shards(id_and_text(docs), folder, lambda: encoder(path).ids, 2, 0)
    got = sstable.read_shards(manifest, folder).orderBy("start").collect()
    ids = {}
    for r in rows:
        ids.setdefault(r[0], []).append(whole(r[1] or "") + bytes(4))
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == Counter((i, len(x) // 4, zlib.crc32(x)) for i, v in ids.items() for x in v)
    assert [r.doc_id is None or r.doc_id for r in got] == sorted((r.doc_id is None or r.doc_id for r in got), key=lambda x: (x is not True, x))
    assert all(a.start + a.n_tokens == b.start for a, b in zip(got, got[1:]))
    shards = [sstable.Reader(open(r.path.removeprefix("file://"), "rb").read()) for r in manifest.collect()]
    assert any((x := s.get(7)) is not None and x.tobytes() == ids[7][0] for s in shards)
    assert all(s.get(10**12) is None for s in shards)


def test_fingerprints(docs, rows, nothing):
    got = fingerprints.fingerprint_edits(docs).collect()
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    want = Counter()
    for r, following in zip(order, order[1:] + order[:1]):
        want[(r[0], len(r[1] or ""), hashlib.sha256(fingerprints.edit(r[1] or "", following[1] or "").encode()).hexdigest())] += 1
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == want
    same = {}
    for r in got:
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    by_id = {r.doc_id: r.fingerprint for r in got if r.doc_id not in (None, 3, 5)}
    assert by_id[0] == by_id[40] and by_id[0] != by_id[1]
    assert fingerprints.fingerprint_edits(nothing).count() == 0
    assert sum(r.near_edited for r in got) > 5 * sum(r.near_next for r in got if r.near_next < 1)


def test_likeness_is_of_all_anchors(spark):
    import random

    rng = random.Random(3)
    say = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(n))
    passage = say(60)
    texts = [f"{say(9000)} {passage} {say(9000)}", f"{say(3000)} {passage} {say(12000)}", say(50)]

    def all_anchors(text):
        raw = fingerprints.np.frombuffer(text.encode(), fingerprints.np.uint8)
        return {int(h) for h in fingerprints.window_hashes(raw, fingerprints.K)[fingerprints.anchors(raw)] >> fingerprints.U(32)}

    got = {r.doc_id: r for r in fingerprints.fingerprint_edits(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    first, second = all_anchors(texts[0]), all_anchors(texts[1])
    in_passage = all_anchors(passage)
    assert in_passage <= first & second  # the one before, in descending order of ids, is document 1
    assert len(in_passage) <= round(got[1].near_next * len(first | second)) <= len(first & second)
    edited = all_anchors(fingerprints.edit(texts[1], texts[0]))
    assert abs(got[1].near_edited - len(second & edited) / len(second | edited)) < 1e-3
    assert len(got[1].fingerprint.split(",")) > len(second) / 10
    assert len(got[2].fingerprint.split(",")) == len(all_anchors(texts[2])) < fingerprints.SHORT


def test_quality_keeps_clean_and_drops_junk(spark, nothing):
    import random

    rng = random.Random(1)
    words = [f"w{i}" for i in range(300)]
    rows = [(i, " ".join(rng.choice(words) + ("###" if i % 10 == 0 else "") for _ in range(120)), "x") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, weight string")
    labels = spark.createDataFrame([(i, int(i % 10 != 0), 0) for i in range(0, 200)], "doc_id long, quality int, toxic int")
    kept = {r.doc_id for r in quality.resample(docs, labels).collect()}
    clean, junk = [i for i in range(200, 400) if i % 10], [i for i in range(200, 400) if i % 10 == 0]
    assert sum(i in kept for i in clean) > 0.95 * len(clean) and sum(i in kept for i in junk) < 0.1 * len(junk)
    chosen = quality.Selection(docs, labels)
    assert {r.doc_id for r in chosen.keep(docs).collect()} == kept and chosen.keep(docs).columns == docs.columns
    assert quality.resample(nothing, labels).count() == 0 and quality.resample(docs, labels.where("false")).count() == 400
