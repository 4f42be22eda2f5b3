"""Ids of whole texts by the files of public tokenizers, with a memory of what was encoded before.

Both tokenizers split a text before they merge, and no token crosses from a non-blank character to blanks
that follow it. A text's ids are therefore its units' ids one after the other, a unit being a run of blanks
(space, tab, line ends) and the run of other characters after it. Units repeat, so each worker remembers
their ids as little-endian unsigned 32-bit integers. A text with any other white space is encoded as a whole.

Encoder.many takes many texts at a time: Arrow finds their distinct units, those not remembered are split and merged
together, and the texts' ids are gathered from those of the units.
"""

from __future__ import annotations

import functools
import os
import re
from collections.abc import Iterator
from itertools import accumulate, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

UNIT = re.compile(r"[ \t\r\n]*[^ \t\r\n]+|[ \t\r\n]+")
#: White space other than space, tab and line ends, as Unicode or the libraries see it.
OTHER_SPACE = re.compile("[\x0b\x0c\x1c-\x1f\x85\xa0 ᠎ -‍    ⁠　﻿]")
#: Characters on which Python and the tokenizers library agree about letters, digits and case.
PLAIN = re.compile(r"[\t\n\r -~\xa1-\xff]*")
#: Letters, digits and blanks among these.
LETTERS, DIGITS, BLANKS = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼-¾", r" \t\r\n"
#: How the two tokenizers split a text into the strings that they merge, and whether in lower case.
SPLITS = {
    "byte_bpe_50k.json": (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+", False),
    "word_bpe_49k.json": (r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+", True),
}
#: A text with none of these splits at its single blanks.
DOUBLE = ("  ", " \n", "\n ", "\n\n", "\t", "\r")
#: Units, and strings to merge, that a worker remembers; then it starts anew. Longer ones it forgets at once.
UNITS, STRINGS, LONGEST = 500_000, 500_000, 64
#: Characters of texts whose units are looked up together, and strings that are merged together.
TOGETHER, MERGED = 4 << 20, 2000
#: Stands between strings that are merged together: a byte that no UTF-8 text has.
BETWEEN = b"\xff"


def vocabulary(name: str, folder: str | None = None) -> str:
    """Path of a tokenizer's file: in ``folder`` or where the installed package keeps it."""
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


class Remembered(dict):
    """string -> its ids as bytes."""

    def __init__(self, encode, most: int):
        super().__init__()
        self.encode, self.most = encode, most

    def __missing__(self, unit: str) -> bytes:
        ids = self.encode(unit)
        if len(unit) <= LONGEST:
            if len(self) >= self.most:
                self.clear()
            self[unit] = ids
        return ids

    def keep(self, found: dict[str, bytes]) -> None:
        if len(self) + len(found) > self.most:
            self.clear()
        long = any(map(LONGEST.__lt__, map(len, found)))
        self.update({k: v for k, v in found.items() if len(k) <= LONGEST} if long else found)


def byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies write for each byte: printable ones stand for themselves."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


def plain_split(pattern: str):
    """A pattern of SPLITS for strings of PLAIN characters, by Python's own expressions."""
    sets = {r"[^\s\p{L}\p{N}]": f"[^{BLANKS}{LETTERS}{DIGITS}]", r"\p{L}": f"[{LETTERS}]", r"\p{N}": f"[{DIGITS}]", r"\s": f"[{BLANKS}]", r"\S": f"[^{BLANKS}]"}
    for old, new in sets.items():
        pattern = pattern.replace(old, new)
    return re.compile(pattern).findall


class Encoder:
    """ids(text): the tokenizer's ids without special tokens added, as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        pattern, self.lower = SPLITS.get(os.path.basename(path), (None, False))
        self.split = plain_split(pattern) if pattern else None
        self.letters = byte_letters()
        letter = self.letters[BETWEEN[0]]
        # Strings can be merged together if no merge takes what stands between them.
        self.bare = Tokenizer(self.tokenizer.model) if pattern and sum(letter in t for t in self.tokenizer.get_vocab(False)) == 1 else None
        self.between = self.tokenizer.token_to_id(letter)
        self.strings = Remembered(self.merged, STRINGS)
        self.units = Remembered(self.spaced, UNITS)

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def merged(self, string: str) -> bytes:
        letters = "".join(map(self.letters.__getitem__, string.encode()))
        return b"".join(t.id.to_bytes(4, "little") for t in self.tokenizer.model.tokenize(letters))

    def unit(self, unit: str) -> bytes:
        if self.split is None or "<|" in unit or not PLAIN.fullmatch(unit):
            return self.whole(unit)
        if self.lower:
            unit = unit.lower()
        if unit[1:].isalpha() and unit[0] == " " and not self.lower:
            return self.strings[unit]
        return b"".join(map(self.strings.__getitem__, self.split(unit)))

    def spaced(self, word: str) -> bytes:
        return self.unit(word if word[0] == "\n" else " " + word)

    def ids(self, text: str) -> bytes:
        if not text or OTHER_SPACE.search(text):
            return self.whole(text)
        if text[0] in " \n" or text[-1] in " \n" or any(x in text for x in DOUBLE):
            return b"".join(map(self.unit, UNIT.findall(text)))
        first, *rest = text.replace("\n", " \n").split(" ")
        return self.unit(first) + b"".join(map(self.units.__getitem__, rest))

    def merge(self, strings: list[str]) -> dict[str, bytes]:
        """The ids of ``strings``, which are remembered."""
        found = {}
        for lo in range(0, len(strings), MERGED):
            some = strings[lo : lo + MERGED]
            letters = BETWEEN.join([s.encode() for s in some]).decode("latin-1").translate(self.letters)
            ids = np.array(self.bare.encode_batch_fast([letters], add_special_tokens=False)[0].ids, "<u4")
            ends = np.append(np.flatnonzero(ids == self.between), len(ids))
            starts = np.append(0, ends[:-1] + 1)
            raw = ids.tobytes()
            found.update(zip(some, [raw[a:b] for a, b in zip((4 * starts).tolist(), (4 * ends).tolist(), strict=True)], strict=True))
        self.strings.keep(found)
        return found

    def learn(self, words: list[str]) -> dict[str, bytes]:
        """The ids of distinct ``words``, each with the blank before it; they are remembered."""
        text, found = "\n".join(words), {}
        if "<|" in text or not PLAIN.fullmatch(text):
            found = {w: self.whole(w if w[0] == "\n" else " " + w) for w in words if "<|" in w or not PLAIN.fullmatch(w)}
            words = [w for w in words if w not in found]
        # One flat list: a list for each word would keep Python's collector busy.
        sizes, strings = [], []
        for word in words:
            unit = word if word[0] == "\n" else " " + word
            if word.isalpha() and not self.lower:
                sizes.append(1)
                strings.append(unit)
            else:
                held = self.split(unit.lower() if self.lower else unit)
                sizes.append(len(held))
                strings.extend(held)
        ids = list(map(self.strings.get, strings))
        new = self.merge(list({s for s, i in zip(strings, ids, strict=True) if i is None}))
        ids = [new[s] if i is None else i for s, i in zip(strings, ids, strict=True)]
        found.update(zip(words, [ids[end - 1] if n == 1 else b"".join(ids[end - n : end]) for n, end in zip(sizes, accumulate(sizes), strict=True)], strict=True))
        self.units.keep(found)
        return found

    def together(self, texts: list[str]) -> list[bytes]:
        """ids() of texts that split at single blanks."""
        first, _, rest = zip(*(t.replace("\n", " \n").partition(" ") for t in texts), strict=True)
        counts = [r.count(" ") + 1 if r else 0 for r in rest]
        # The values are those of all lists, as there are no nulls.
        words = pc.split_pattern(pa.array([" ".join(filter(None, rest))], pa.large_string()), " ").values if any(counts) else pa.array([], pa.large_string())
        words = words.dictionary_encode()
        distinct = words.dictionary.to_numpy(zero_copy_only=False).tolist()
        held = list(map(self.units.get, distinct))
        new = self.learn([w for w, i in zip(distinct, held, strict=True) if i is None])
        held = [new[w] if i is None else i for w, i in zip(distinct, held, strict=True)]
        sizes = np.fromiter(map(len, held), np.int64, len(held)) >> 2
        flat, starts = np.frombuffer(b"".join(held), "<u4"), np.cumsum(sizes) - sizes
        word = words.indices.to_numpy()
        size = sizes[word]
        ends = np.cumsum(size)
        ids = flat[np.repeat(starts[word] - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)]
        cuts = np.append(0, ends)[np.append(0, np.cumsum(counts))].tolist()
        return [self.unit(f) + ids[a:b].tobytes() for f, (a, b) in zip(first, pairwise(cuts), strict=True)]

    def many(self, texts: list[str]) -> Iterator[bytes]:
        """ids() of each text, worked out for TOGETHER characters at a time."""
        lo = held = 0
        for hi, text in enumerate(texts, 1):
            held += len(text)
            if held >= TOGETHER or hi == len(texts):
                some = texts[lo:hi]
                plain = [k for k, t in enumerate(some) if self.bare and t and not OTHER_SPACE.search(t) and not (t[0] in " \n" or t[-1] in " \n" or any(x in t for x in DOUBLE))]
                ids = dict(zip(plain, self.together([some[k] for k in plain]) if plain else [], strict=True))
                yield from (ids[k] if k in ids else self.ids(t) for k, t in enumerate(some))
                lo, held = hi, 0


@functools.cache
def encoder(path: str) -> Encoder:
    """One for each worker and file."""
    return Encoder(path)
