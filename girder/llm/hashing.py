"""Vectorised hashes of words, shingles and byte windows over many texts at once (64 bits, numpy)."""

from __future__ import annotations

import hashlib

import numpy as np

U = np.uint64
#: Odd multiplier of the polynomial hashes, and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
_powers: list[np.ndarray] = [np.ones(1, U), np.ones(1, U)]

#: What separates words is the blank and the bytes 9 to 13.
IS_WORD = np.ones(256, bool)
IS_WORD[[32, 9, 10, 11, 12, 13]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose output bits all depend on all input bits."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i for i < n."""
    if len(_powers[0]) < n:
        size = max(n, 1 << 16)
        for k, base in enumerate((BASE, INVERSE)):
            row = np.full(size, base, U)
            row[0] = 1
            _powers[k] = np.multiply.accumulate(row)
    return _powers[0][:n], _powers[1][:n]


def window_hashes(raw: np.ndarray, width: int) -> np.ndarray:
    """Hash of raw[i:i + width] at each i; built by doubling, so that its cost grows with log(width)."""
    if len(raw) < width:
        return np.zeros(0, U)
    one = raw.astype(U) + U(1)
    done, size = one, 1
    for bit in bin(width)[3:]:
        done = done[: len(done) - size] * U(pow(BASE, size, 1 << 64)) + done[size:]
        size *= 2
        if bit == "1":
            done = done[: len(done) - 1] * U(BASE) + one[size : size + len(done) - 1]
            size += 1
    return mix(done)


def words(raw: np.ndarray, offsets: np.ndarray, is_word: np.ndarray = IS_WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text index, start, end) of the words of all texts; no word crosses from one text to the next."""
    if not len(raw):
        return (np.zeros(0, np.int64),) * 3
    inside = is_word[raw]
    before, after = np.empty_like(inside), np.empty_like(inside)
    before[0], before[1:] = False, inside[:-1]
    after[-1], after[:-1] = False, inside[1:]
    cuts = offsets[(offsets > 0) & (offsets < len(raw))]
    before[cuts] = False
    after[cuts - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return np.searchsorted(offsets, starts, "right") - 1, starts, ends


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each word with A-Z in lower case."""
    if not len(starts):
        return np.zeros(0, U)
    up, down = powers(len(raw) + 1)
    total = np.zeros(len(raw) + 1, U)
    np.cumsum((LOWER[raw].astype(U) + U(1)) * up[:-1], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(U))


def shingles(hashes: np.ndarray, text: np.ndarray, n_texts: int, size: int) -> list[np.ndarray]:
    """Per text, the sorted distinct hashes of its runs of ``size`` words; a text with fewer words has its whole run as one."""
    bounds = np.searchsorted(text, np.arange(n_texts + 1))
    runs = np.zeros(0, U)
    if len(hashes) >= size:
        n = len(hashes) - size + 1
        runs = hashes[:n].copy()
        for k in range(1, size):
            runs = runs * U(BASE) + hashes[k : k + n]
        runs = mix(runs)
    out = []
    for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if hi - lo >= size:
            out.append(np.unique(runs[lo : hi - size + 1]))
        elif hi > lo:
            h = 0
            for x in hashes[lo:hi].tolist():
                h = (h * BASE + x) % (1 << 64)
            out.append(mix(np.array([h ^ (hi - lo)], U)))
        else:
            out.append(np.zeros(0, U))
    return out


def set_id(sorted_hashes: np.ndarray) -> int:
    """64-bit signed identifier of a set of hashes."""
    return int.from_bytes(hashlib.blake2b(sorted_hashes.tobytes(), digest_size=8).digest(), "little", signed=True)
