"""Lines of many texts at once: where they are, what is left of them without blanks at both ends, and their hashes."""

from __future__ import annotations

import numpy as np

from .hashing import IS_WORD


def line_spans(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, end) of each line of texts cut at newlines; an empty text has one empty line."""
    breaks = np.flatnonzero(raw == 10)
    starts = np.sort(np.concatenate([offsets[:-1], breaks + 1]), kind="stable")
    ends = np.sort(np.concatenate([breaks, offsets[1:]]), kind="stable")
    per_text = np.searchsorted(breaks, offsets[1:]) - np.searchsorted(breaks, offsets[:-1]) + 1
    return np.repeat(np.arange(len(offsets) - 1), per_text), starts, ends


def stripped(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The spans without blanks and the bytes 9 to 13 at both ends; all blank: an empty span."""
    solid = np.flatnonzero(IS_WORD[raw])
    low, high = np.searchsorted(solid, starts), np.searchsorted(solid, ends)
    some = high > low
    first, last = starts.copy(), starts.copy()
    first[some], last[some] = solid[low[some]], solid[high[some] - 1] + 1
    return first, last


def n_chars(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Code points of each span of UTF-8 bytes."""
    upto = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    return upto[ends] - upto[starts]
