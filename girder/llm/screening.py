"""Keys that may occur under several owners, found by sketches that are spread over the cluster.

A sketch of all keys grows with the corpus, so no task holds it and none is broadcast. It is cut into slices by
the key's hash, of so many keys each; a slice lives in one task. What is dealt out is 4 bytes of a key's hash, not
the text behind it: once for each key and owner of a group of texts, or only once a group where several owners
in it have the key, which the group then knows by itself. Each slice's sketch takes all that came to it and
answers which keys may have come more than once. Such an answer can be wrong; that a key is alone is never wrong.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, saved
from .hashing import U, mix

#: Keys of a slice, on average.
SLICE_KEYS = 1 << 21
ASKED = "slice int, payload binary, owner long, row long, tags array<long>"
ANSWER = "owner long, row long, tags array<long>"
#: Owners, rows and numbers of entries; low hash and tag of each entry; low hashes that are known to be several.
PARTS = (("<i8", 0), ("<i8", 0), ("<u4", 0), ("<u4", 1), ("<u4", 1), ("<u4", 2))


def positions(low: np.ndarray, rows: int, width: int) -> np.ndarray:
    """``rows`` places below ``width`` for each low hash."""
    return np.stack([(mix(low.astype(U) * U(2 * rows) + U(2 * k + 1)) % U(width)).astype(np.int64) for k in range(rows)])


class BloomPair:
    """Two Bloom filters: of keys that came once, and of those that came again."""

    def __init__(self, keys: int, bits: int = 8, hashes: int = 3):
        self.width, self.hashes = bits * keys, hashes
        self.once, self.twice = np.zeros(self.width, bool), np.zeros(self.width, bool)

    def add(self, low: np.ndarray, several: bool) -> None:
        at = positions(low, self.hashes, self.width)
        seen = np.ones(len(low), bool) if several else self.once[at].all(axis=0)
        self.twice[at[:, seen]] = True
        self.once[at] = True

    def may_repeat(self, low: np.ndarray) -> np.ndarray:
        return self.twice[positions(low, self.hashes, self.width)].all(axis=0)


class CountMin:
    """Rows of counters; a key came no more often than the smallest of its counters says."""

    def __init__(self, keys: int, width: int = 4, rows: int = 3):
        self.width, self.rows = width * keys, rows
        self.counts = np.zeros((rows, self.width), np.uint32)

    def add(self, low: np.ndarray, several: bool) -> None:
        for counts, at in zip(self.counts, positions(low, self.rows, self.width), strict=True):
            np.add.at(counts, at, np.uint32(2 if several else 1))

    def may_repeat(self, low: np.ndarray) -> np.ndarray:
        at = positions(low, self.rows, self.width)
        return np.min([counts[p] for counts, p in zip(self.counts, at, strict=True)], axis=0) > 1


def lists(values: np.ndarray, starts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.append(starts, len(values)), pa.int32()), pa.array(values, pa.int64()))


def asked(owner: np.ndarray, row: np.ndarray, key: np.ndarray, tag: np.ndarray, slices: int) -> Iterator[pa.RecordBatch]:
    """ASKED rows of a group: messages to the slices, and what the group knows to be several (no slice).

    ``owner`` and ``row`` say who has a key, ``tag`` what the owner calls it.
    """
    if not len(key):
        return
    order = np.lexsort((row, owner, key))
    owner, row, key, tag = owner[order], row[order], key[order], tag[order]
    new = np.append(True, key[1:] != key[:-1])
    first, group = np.flatnonzero(new), np.cumsum(new) - 1
    last = np.append(first[1:], len(key)) - 1
    several = owner[first] != owner[last]
    known = several[group]
    if known.any():
        o, r, t = owner[known], row[known], tag[known]
        order = np.lexsort((t, r, o))
        o, r, t = o[order], r[order], t[order]
        at = np.flatnonzero(np.append(True, (o[1:] != o[:-1]) | (r[1:] != r[:-1])))
        yield pa.RecordBatch.from_arrays(
            [pa.nulls(len(at), pa.int32()), pa.nulls(len(at), pa.binary()), pa.array(o[at]), pa.array(r[at]), lists(t, at)], names=["slice", "payload", "owner", "row", "tags"]
        )
    low = ((key // U(slices)) & U(0xFFFFFFFF)).astype("<u4")
    where = (key % U(slices)).astype(np.int64)
    single = np.flatnonzero(~known)
    single = single[np.lexsort((tag[single], row[single], owner[single], where[single]))]
    marked = first[several]
    marked = marked[np.argsort(where[marked], kind="stable")]
    cuts = np.searchsorted(where[single], np.arange(slices + 1))
    marks = np.searchsorted(where[marked], np.arange(slices + 1))
    used = np.flatnonzero((np.diff(cuts) > 0) | (np.diff(marks) > 0))
    payload = []
    for s in used.tolist():
        mine = single[cuts[s] : cuts[s + 1]]
        at = np.flatnonzero(np.append(True, (owner[mine][1:] != owner[mine][:-1]) | (row[mine][1:] != row[mine][:-1]))) if len(mine) else np.zeros(0, np.int64)
        flagged = low[marked[marks[s] : marks[s + 1]]]
        columns = (owner[mine[at]], row[mine[at]], np.diff(np.append(at, len(mine))), low[mine], tag[mine], flagged)
        head = np.array([len(at), len(mine), len(flagged)], "<u4").tobytes()
        payload.append(head + b"".join(c.astype(kind).tobytes() for c, (kind, _) in zip(columns, PARTS, strict=True)))
    nothing = pa.nulls(len(used), pa.int64())
    yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(payload, pa.binary()), nothing, nothing, pa.nulls(len(used), pa.list_(pa.int64()))], names=["slice", "payload", "owner", "row", "tags"])


def unpacked(payload: bytes) -> list[np.ndarray]:
    sizes, at, out = np.frombuffer(payload, "<u4", 3), 12, []
    for kind, size in PARTS:
        out.append(np.frombuffer(payload, kind, int(sizes[size]), at))
        at += out[-1].nbytes
    return out


def answers(held: list[bytes], sketch) -> Iterator[pa.RecordBatch]:
    """ANSWER rows to the messages of one slice: first all are added, then each is asked."""
    for payload in held:
        *_, low, _, flagged = unpacked(payload)
        sketch.add(low, False)
        sketch.add(flagged, True)
    for payload in held:
        owner, row, n, low, tag, _ = unpacked(payload)
        hit = sketch.may_repeat(low)
        if hit.any():
            who = np.repeat(np.arange(len(owner)), n)[hit]
            at = np.flatnonzero(np.append(True, who[1:] != who[:-1]))
            yield pa.RecordBatch.from_arrays([pa.array(owner[who[at]]), pa.array(row[who[at]]), lists(tag[hit].astype(np.int64), at)], names=["owner", "row", "tags"])


def may_repeat(df: DataFrame, ask: Callable[[Iterator[pa.RecordBatch], int], Iterator[pa.RecordBatch]], n_keys: int, sketch: Callable, what: str) -> DataFrame:
    """(owner, row, tags): the tags of the keys that other owners may have, too; no row for owners without such.

    ``ask`` makes ASKED rows of the batches of ``df`` and the number of slices; ``n_keys`` is about the number of
    keys, which sizes the slices; ``sketch`` is made for a number of keys.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    slices = max(n, -(-n_keys // SLICE_KEYS))
    keys = -(-n_keys // slices) + 64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = [], None
        for batch in batches:
            for at, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if at != now and held:
                    yield from answers(held, sketch(keys))
                    held = []
                now = at
                held.append(payload)
        if held:
            yield from answers(held, sketch(keys))

    out = saved(map_batches(df, lambda batches: ask(batches, slices), ASKED), f"{what}-asked")
    sent = out.where("slice IS NOT NULL").select("slice", "payload").repartitionById(min(slices, 4 * n), F.pmod("slice", F.lit(min(slices, 4 * n)))).sortWithinPartitions("slice")
    told = map_batches(sent, run, ANSWER).unionByName(out.where("slice IS NULL").select("owner", "row", "tags"))
    return saved(told.groupBy("owner", "row").agg(F.flatten(F.collect_list("tags")).alias("tags")), f"{what}-suspects")
