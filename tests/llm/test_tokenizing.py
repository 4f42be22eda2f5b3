"""Texts encoded together have the ids that the tokenizers library gives each alone."""

import random
import re

import pytest

from girder.llm import sstable, tokenizing
from girder.llm.tokenizing import Encoder, vocabulary


def texts():
    rng = random.Random(8)
    plain = [chr(c) for c in [*range(33, 127), *range(0xA1, 0x100)]]
    say = lambda n, some: " ".join("".join(rng.choice(some) for _ in range(rng.randint(1, 9))) for _ in range(n))
    out = [say(60, plain) for _ in range(40)] + [say(60, "abcdehnorst") for _ in range(40)] + [say(20, "ab'stlrev.,!19") for _ in range(40)]
    out += ["", " ", "a", "a\nb", "Words.\nOther words\nend", "two  blanks", "tab\tand\r\nends ", "\u00a0 other\u2003space", "a \u65e5\u672c \U0001f642 z", "x <|endoftext|> y <|", "w" * 5000 + " " + "q" * 70, "it's we'll I'D don't", "\u00bd \u00b2 \u00aa\u00b5\u00ba \u00d7\u00f7"]
    return out


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
@pytest.mark.parametrize(("together", "most"), [(tokenizing.TOGETHER, 500_000), (700, 500_000), (2000, 30)])
def test_together_as_alone(monkeypatch, name, together, most):
    monkeypatch.setattr(tokenizing, "TOGETHER", together)
    encoder = Encoder(vocabulary(name))
    encoder.strings.most = encoder.units.most = most
    some = texts() * 2
    assert list(encoder.many(some)) == [encoder.whole(t) for t in some]
    assert max(map(len, [*encoder.units, *encoder.strings])) <= tokenizing.LONGEST + 1
    assert list(encoder.many([])) == []


def test_words_are_merged_together(monkeypatch):
    """New words cost no call of the library each, and remembered ones none at all."""
    encoder, calls = Encoder(vocabulary("byte_bpe_50k.json")), []
    monkeypatch.setattr(encoder, "merged", lambda s: calls.append(s) or b"")
    some = [t for t in texts() if re.fullmatch("[a-z ]+", t)]
    assert len(some) > 40
    alone = [encoder.whole(t) for t in some]
    first = {t.split(" ")[0] for t in some}
    encoder.strings.update((f, encoder.whole(f)) for f in first)
    assert list(encoder.many(some)) == alone and not calls


def test_split_as_the_library_does():
    regex = pytest.importorskip("regex")
    chars = [chr(c) for c in [9, 10, 13, *range(32, 127), *range(0xA1, 0x100)]]
    for pattern, _ in tokenizing.SPLITS.values():
        ours, theirs = tokenizing.plain_split(pattern), regex.compile(pattern).findall
        assert all(ours(t) == theirs(t) for a in chars for b in chars for t in (a + b, f" {a}{b}'s", f"{a} {b}"))


def test_table_is_written_together(spark, tmp_path, monkeypatch):
    """The query hands whole batches to the encoder."""
    seen = []
    monkeypatch.setattr(sstable, "write_shards", lambda *a, **k: seen.append((a, k)))
    monkeypatch.setattr(sstable, "read_shards", lambda *a: None)
    spark.createDataFrame([(1, "a b")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    sstable.op8_sstable(spark, str(tmp_path))
    (_, _, encode, *_), how = seen[0]
    assert how == {"together": True} and list(encode()(["a b", ""])) == [Encoder(vocabulary("byte_bpe_50k.json")).whole("a b"), b""]
