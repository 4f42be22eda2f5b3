"""Cost-balanced packing of tokenized documents into training sequences.

Each input partition packs its own documents, in groups of bounded size, so nothing is shuffled and no task
grows with the corpus. In a group, the sequences are laid out first: as many of full length as the tokens
fill and a few more; in a group too small for that, one for each power of two in what is left. Documents are
then taken in descending length, and each goes to the sequence with the lowest estimated cost (linear plus
quadratic attention cost of what it holds) among all that have room for it; documents that fit nowhere whole
are cut last, over the rooms that all others have left.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from .common import documents, id_and_text, map_batches
from .tokenizing import encoder, vocabulary

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: Share of sequences beyond those that the tokens fill; so much padding there is at most.
SLACK = 0.005
NAMES = SCHEMA.replace(" long", "").split(", ")


def attention_cost(tokens: int, linear: float, quadratic: float) -> float:
    return tokens * (linear + quadratic * tokens)


def sequence_lengths(tokens: int, capacity: int, slack: float) -> list[int]:
    """Full sequences and ``slack`` of them more; where that is none, the rest has a sequence for each power of two."""
    full, rest = divmod(tokens, capacity)
    if spare := round(slack * full):
        return [capacity] * (full + spare)
    return [capacity] * full + [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]


class Rooms:
    """Sequences by the room that they have left, each room's in order of cost."""

    def __init__(self, capacity: int):
        self.heaps: list[list[tuple[float, int]]] = [[] for _ in range(capacity + 1)]
        self.lowest = np.full(capacity + 1, np.inf)

    def put(self, room: int, cost: float, sequence: int) -> None:
        heapq.heappush(self.heaps[room], (cost, sequence))
        self.lowest[room] = self.heaps[room][0][0]

    def fits(self, want: int) -> bool:
        return bool(np.isfinite(self.lowest[want:]).any())

    def take(self, want: int) -> tuple[int, float, int]:
        """(room, cost, sequence) of the cheapest with ``want`` room or more, of equal ones the fullest; of none, of the one with the most room."""
        room = want + int(self.lowest[want:].argmin())
        if not self.heaps[room]:
            room = int(np.flatnonzero(np.isfinite(self.lowest))[-1])
        cost, sequence = heapq.heappop(self.heaps[room])
        self.lowest[room] = self.heaps[room][0][0] if self.heaps[room] else np.inf
        return room, cost, sequence


def pack(lengths: list[int], capacity: int, linear: float = 1.0, quadratic: float = 1 / 4096, slack: float = SLACK) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) of documents of the given lengths.

    Every token lies in one piece, and sequences are filled from 0 without gaps. What a document has beyond whole
    sequences is put into one that has room for it; where none has, it waits until all smaller ones have their
    place, and then is cut over the rooms that are left. Equal lengths keep their order. Documents of no tokens
    get no piece.
    """
    size = sequence_lengths(sum(lengths), capacity, slack)
    used, rooms, out, waiting = [0] * len(size), Rooms(capacity), [], []
    for k, room in enumerate(size):
        rooms.put(room, 0.0, k)

    def place(doc: int, start: int, most: int) -> int:
        room, cost, k = rooms.take(min(most, capacity))
        n = min(most, room)
        out.append((doc, start, n, k, used[k]))
        used[k] += n
        if room > n:
            rooms.put(room - n, cost + attention_cost(n, linear, quadratic), k)
        return start + n

    for doc in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        start = 0
        while lengths[doc] > start and rooms.fits(min(lengths[doc] - start, capacity)):
            start = place(doc, start, lengths[doc] - start)
        if start < lengths[doc]:
            waiting.append((doc, start))
    for doc, start in waiting:
        while start < lengths[doc]:
            start = place(doc, start, lengths[doc] - start)
    return out


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 2, capacity: int = 4096, group_tokens: int = 16_000_000) -> DataFrame:
    """Pieces of all documents: their ids by ``tokenizer`` and ``end_id``, dealt to sequences of ``capacity``.

    A null or empty text has only the end id. Repeated rows are packed as often as they occur; null ids are
    kept; other columns are ignored; no rows give no rows. ``sequence_id`` is unique in the result: the
    partition's number times 2**32 plus a count. A partition of more than ``group_tokens`` is packed in groups of
    that many, which bounds the memory of a task; descending order holds in a group.
    """

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(tokenizer).ids, end_id.to_bytes(4, "little")
        first = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 32
        names, ids, held = [], [], 0

        def flush(first: int) -> pa.RecordBatch:
            lengths = [len(x) // 4 for x in ids]
            rows = [(names[d], s, n, zlib.crc32(ids[d][4 * s : 4 * (s + n)]), lengths[d], first + k, at) for d, s, n, k, at in pack(lengths, capacity)]
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], names=NAMES)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                got = encode(text) + end
                names.append(doc_id)
                ids.append(got)
                held += len(got) // 4
                if held >= group_tokens:
                    yield flush(first)
                    first += len(sequence_lengths(held, capacity, SLACK))
                    names, ids, held = [], [], 0
        if ids:
            yield flush(first)

    return map_batches(id_and_text(docs), packed, SCHEMA)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir), vocabulary("word_bpe_49k.json"))
