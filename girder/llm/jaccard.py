"""Exact Jaccard join on word shingles by a token-group matrix.

Documents with equal sets of tokens are one set. How many sets have a token is counted exactly: sets are dealt out
token by token, in messages of one batch to one bucket of tokens, and what comes back is which tokens of a set
others have too. A set that has more than a fifth of its tokens alone links with nothing and is done; that is
nearly all of a corpus. The others are ordered rarest token first, and two of them that link share a token of
the first of each, its prefix.

They are parted into groups of similar sets: what links with the most central set that has the same smallest
hash, and sets not yet linked by that hash alone. The matrix has a row for each prefix token and tells in which
groups it occurs, a group being the union of its sets' prefixes. For each set and group the tokens that they
share bound the overlap with every member, and only groups that the bound leaves are opened. Links are decided
on whole sets, block by block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, id_and_text, map_batches, pieces, saved, text_bytes
from .counting import hashed_marks, places
from .graphs import components
from .hashing import U, mix, set_id, shingles, word_hashes, words

SIZE, PERCENT = 5, 80
#: Hashed marks of the documents whose sets are dealt out, one for each set; what more they let through only repeats a set.
MARKS = 1 << 24
#: Smallest hashes by which sets look for a central one.
KEYS = 3
#: Bytes of the sets that meet at once, on either side.
CELL_BYTES = 2 << 20
LISTS, TOKENS = 0, 1
MESSAGE = "bucket int, batch long, kind int, payload binary"
SET = "set_id long, n long, held long, tokens binary, prefix array<long>, keys array<long>"


def shingle_sets(column: pa.Array, size: int) -> Iterator[np.ndarray]:
    raw, offsets = text_bytes(column)
    for lo, hi in pieces(offsets):
        part, own = raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        text, starts, ends = words(part, own)
        yield from shingles(word_hashes(part, starts, ends), text, hi - lo, size)


def needed(n: int | np.ndarray, percent: int):
    """The least overlap of a set of n with any set that it links with."""
    return -(-n * percent // 100)


def shingle_table(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, n, set_id) of each row, and row where ``docs`` has it; set_id is null without words."""
    more = docs.columns[2:]

    def table(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known = [(len(s), set_id(s) if len(s) else None) for s in shingle_sets(batch.column(1), size)]
            made = [batch.column(0), pa.array([n for n, _ in known], pa.int64()), pa.array([i for _, i in known], pa.int64()), *batch.columns[2:]]
            yield pa.RecordBatch.from_arrays(made, names=["doc_id", "n", "set_id", *more])

    return saved(map_batches(docs, table, "doc_id long, n long, set_id long" + "".join(f", {c} long" for c in more)), "shingles")


def message(bucket: int, batch: int, kind: int, *arrays: np.ndarray) -> tuple[int, int, int, bytes]:
    return bucket, batch, kind, b"".join(a.tobytes() for a in arrays)


def messages(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int64(), pa.int32(), pa.binary())
    columns = zip(*rows, strict=True) if rows else [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["bucket", "batch", "kind", "payload"])


def opened(payload: bytes, leveled: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(how many tokens each set of the batch has here, 48 bits of each token, its level) of a message of tokens."""
    sets = int.from_bytes(payload[:4], "little")
    counts = np.frombuffer(payload, "<u4", sets, 4)
    n, at = int(counts.sum()), 4 + 4 * sets
    high, low = np.frombuffer(payload, "<u4", n, at), np.frombuffer(payload, "<u2", n, at + 4 * n)
    level = np.frombuffer(payload, np.uint8, n, at + 6 * n) if leveled else np.zeros(0, np.uint8)
    return counts, high.astype(U) << U(16) | low, level


def token_message(bucket: int, batch: int, counts: np.ndarray, tokens: np.ndarray, level: np.ndarray | None = None) -> tuple:
    """``tokens`` are 48 bits each."""
    parts = [np.array([len(counts)], "<u4"), counts.astype("<u4"), (tokens >> U(16)).astype("<u4"), (tokens & U(0xFFFF)).astype("<u2")]
    return message(bucket, batch, TOKENS, *parts, *([level] if level is not None else []))


def grouped_rows(batches: Iterator[pa.RecordBatch], key: int) -> Iterator[tuple[int, list[tuple]]]:
    """Rows of consecutive equal values in column ``key``, over all batches."""
    held, last = [], None
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and row[key] != last:
                yield last, held
                held = []
            last = row[key]
            held.append(row)
    if held:
        yield last, held


def dealt_tokens(docs: DataFrame, table: DataFrame, size: int, buckets: int) -> DataFrame:
    """MESSAGE rows: the tokens of each set by bucket, and the sets of each batch."""
    least = table.where("n > 0").groupBy("set_id").agg(F.min("doc_id").alias("one")).select("one")
    sent = docs.sparkSession.sparkContext.broadcast(np.packbits(hashed_marks(least, MARKS)).tobytes())  # MARKS bits

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = np.unpackbits(np.frombuffer(sent.value, np.uint8)).astype(bool)
        for batch in batches:
            batch = batch.filter(pa.array(marks[places(batch.column(0), MARKS)]))
            sets = {set_id(s): s for s in shingle_sets(batch.column(1), size) if len(s)}
            if not sets:
                continue
            ids, sizes = np.fromiter(sets, np.int64, len(sets)), np.array([len(s) for s in sets.values()], "<u4")
            name = int.from_bytes(hashlib.blake2b(ids.tobytes(), digest_size=8).digest(), "little", signed=True)
            tokens = np.concatenate(list(sets.values()))
            bucket = (tokens % U(buckets)).astype(np.uint16 if buckets <= 1 << 16 else np.uint32)
            order = np.argsort(bucket, kind="stable")
            owner, tokens = np.repeat(np.arange(len(sets)), sizes)[order], tokens[order] >> U(16)
            bounds = np.searchsorted(bucket[order], np.arange(buckets + 1))
            rows = [message(name % buckets, name, LISTS, np.array([len(ids)], "<u4"), ids, sizes)]
            for b, (lo, hi) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
                if hi > lo:
                    rows.append(token_message(b, name, np.bincount(owner[lo:hi], minlength=len(ids)), tokens[lo:hi]))
            yield messages(rows)

    return map_batches(docs, deal, MESSAGE)


def shared_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each bucket's messages, the tokens that several sets have, with their level: the more sets, the higher."""
    for bucket, rows in grouped_rows(batches, 0):
        yield messages([r for r in rows if r[2] == LISTS])
        # A batch is named by its sets, so one that comes twice says the same twice.
        kept = {r[1]: r[3] for r in rows if r[2] == TOKENS}
        if not kept:
            continue
        parts = [opened(p) for p in kept.values()]
        tokens = np.concatenate([t for _, t, _ in parts])
        order = np.argsort(tokens, kind="stable")
        new = np.ones(len(tokens), bool)
        new[1:] = tokens[order][1:] != tokens[order][:-1]
        at = np.cumsum(new) - 1
        times = np.bincount(at)
        level, several = np.empty(len(tokens), np.uint8), np.empty(len(tokens), bool)
        level[order] = np.minimum(255, 8 * np.log2(times)).astype(np.uint8)[at]
        several[order] = (times > 1)[at]
        lo = 0
        for name, (counts, own, _) in zip(kept, parts, strict=True):
            keep, lv = several[lo : lo + len(own)], level[lo : lo + len(own)]
            lo += len(own)
            if keep.any():
                left = np.bincount(np.repeat(np.arange(len(counts)), counts)[keep], minlength=len(counts))
                yield messages([token_message(bucket, name, left, own[keep], lv[keep])])


def sets_that_may_link(percent: int):
    """Of each batch's messages, the sets that have few enough tokens alone, as SET rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in grouped_rows(batches, 1):
            lists, came = rows[0][3], {r[0]: r[3] for r in rows if r[2] == TOKENS}
            n_sets = int.from_bytes(lists[:4], "little")
            ids, sizes = np.frombuffer(lists, np.int64, n_sets, 4), np.frombuffer(lists, "<u4", n_sets, 4 + 8 * n_sets).astype(np.int64)
            if not came:
                continue
            parts = [(b, *opened(p, True)) for b, p in came.items()]
            owner = np.concatenate([np.repeat(np.arange(n_sets), counts) for _, counts, _, _ in parts])
            tokens = np.concatenate([t << U(16) | U(b & 0xFFFF) for b, _, t, _ in parts])
            level = np.concatenate([lv for *_, lv in parts])
            held = np.bincount(owner, minlength=n_sets)
            may = held >= needed(sizes, percent)
            keep = may[owner]
            owner, tokens, level = owner[keep], tokens[keep], level[keep]
            order = np.lexsort((tokens, level, owner))
            owner, tokens = owner[order], tokens[order]
            bounds = np.searchsorted(owner, np.arange(n_sets + 1))
            out = []
            for i in np.flatnonzero(may).tolist():
                own, n, k = tokens[bounds[i] : bounds[i + 1]], int(sizes[i]), int(held[i])
                prefix = own[: n - needed(n, percent) + 1 - (n - k)].view(np.int64)
                keys = [int(mix(own ^ U(0x51ED270B * (j + 1))).min()) for j in range(KEYS)]
                out.append((int(ids[i]), n, k, np.unique(own).tobytes(), prefix, np.array(keys, U).view(np.int64)))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()))
            columns = zip(*out, strict=True) if out else [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[c.split()[0] for c in SET.split(", ")])

    return run


def linkable_sets(docs: DataFrame, table: DataFrame, size: int, percent: int) -> DataFrame:
    """SET rows of the sets that the tokens which they have alone don't keep from linking.

    ``held`` tokens are also in other sets; ``tokens`` are these, and ``prefix`` those of them among the first by level.
    """
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sent = dealt_tokens(docs, table, size, n).repartitionById(n, F.col("bucket")).sortWithinPartitions("bucket")
    back = map_batches(sent, shared_tokens, MESSAGE).repartition(n, "batch").sortWithinPartitions("batch", "kind", "bucket")
    return saved(map_batches(back, sets_that_may_link(percent), SET), "linkable")


class Block:
    """Sets by their tokens, so that a set meets all of them at once."""

    def __init__(self, sets: list[tuple[int, int, int, np.ndarray]]):
        self.ids, self.labels = [s[0] for s in sets], [s[1] for s in sets]
        self.sizes = np.array([s[2] for s in sets])
        tokens, owner = np.concatenate([s[3] for s in sets]), np.repeat(np.arange(len(sets)), [len(s[3]) for s in sets])
        order = np.argsort(tokens, kind="stable")
        self.owner = owner[order]
        self.tokens, starts = np.unique(tokens[order], return_index=True)
        self.starts = np.append(starts, len(tokens))

    def links(self, tokens: np.ndarray, n: int, percent: int) -> list[int]:
        """Which of the sets share ``percent`` of the union or more with a set of n that has ``tokens`` not alone."""
        at = np.searchsorted(self.tokens, tokens)
        at = at[self.tokens[np.minimum(at, len(self.tokens) - 1)] == tokens]
        sizes = self.starts[at + 1] - self.starts[at]
        held = np.repeat(self.starts[at] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        shared = np.bincount(self.owner[held], minlength=len(self.ids))
        return np.flatnonzero(100 * shared >= percent * (n + self.sizes - shared)).tolist()


class Forest:
    """Which labels are connected so far."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def root(self, x: int) -> int:
        while (up := self.parent.get(x, x)) != x:
            self.parent[x] = x = self.parent.get(up, up)
        return x

    def joins(self, a: int, b: int) -> bool:
        """Connect both; whether they weren't before."""
        a, b = self.root(a), self.root(b)
        self.parent[a] = b
        return a != b


def linked(asks: DataFrame, members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): links between the sets (other, set_id, label, n) of ``asks`` and of ``members``, where ``other`` is the same.

    Sets of one label are known to be connected; of the links that are found where two blocks meet, only those
    are returned that connect further labels. The members of a group and the sets that ask for it are cut into
    blocks of about CELL_BYTES; each two blocks meet in one task, so that a set travels once for each block and
    not for each pair.
    """

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held, block, last, known = None, [], None, None, Forest()
        for batch in batches:
            a, b = [], []
            for *at, asking, node, label, n, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if cell != at:
                    cell, held, block, last, known = at, [], None, None, Forest()
                if last == (asking, node):  # the same set from another row
                    continue
                last = (asking, node)
                if not asking:
                    held.append((node, label, n, np.frombuffer(raw, U)))
                elif held:
                    block = block or Block(held)
                    for i in block.links(np.frombuffer(raw, U), n, percent):
                        if known.joins(label, block.labels[i]):
                            a.append(node)
                            b.append(block.ids[i])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    blocks = lambda df, name: df.groupBy("other").agg(F.ceil(F.sum("n") * 8 / CELL_BYTES).alias(name))
    shape = blocks(asks, "lefts").join(blocks(members, "rights"), "other")
    block = lambda of: F.pmod(F.xxhash64("set_id"), F.col(of))
    each = lambda of: F.explode(F.sequence(F.lit(0).cast("long"), F.col(of) - 1))
    side = lambda df, lefts, rights, asking: df.join(shape, "other").select(
        "other", lefts("lefts").alias("l"), rights("rights").alias("r"), F.lit(asking).alias("asking"), "set_id", "label", "n"
    )
    rows = side(asks, block, each, True).unionByName(side(members, each, block, False)).join(sets.select("set_id", "tokens"), "set_id")
    rows = rows.select("other", "l", "r", "asking", "set_id", "label", "n", "tokens").repartition("other", "l", "r")
    return map_batches(rows.sortWithinPartitions("other", "l", "r", "asking", "set_id"), meet, "a long, b long")


def may_overlap(n: Column, held: Column, least: Column, most: Column, most_held: Column, percent: int) -> Column:
    """Whether a set of n may link with one of between least and most tokens, given how many of each are in other sets too.

    An overlap o of sets of n and m tokens links if (100 + percent) * o >= percent * (n + m), and a token that a set has
    alone is in no overlap.
    """
    p = F.lit(percent)
    return (p * least <= 100 * n) & (p * n <= 100 * most) & (F.lit(100 + percent) * F.least(held, most_held) >= p * (n + least))


def enough(shared: Column, n: Column, low: Column, high: Column, percent: int) -> Column:
    """Whether a set of n may link with a set of between low and high tokens, of whose prefixes it shares so many.

    The prefix that ends first in the order of tokens tells all that both share up to there; beyond it lie at most
    the rest of that set. So the overlap is at most shared + max of both rests, a rest being needed(n) - 1.
    """
    p = F.lit(percent)
    rest = lambda size: F.ceil(p * size / 100)
    lower, upper = F.greatest(low, F.ceil(p * n / 100)), F.least(high, F.floor(n * 100 / p))
    overlap = lambda size: F.ceil(p * (n + size) / (100 + p) - F.lit(1e-9))
    # Overlap needed minus the larger rest, with a slack of one for rounding; least at one of the ends or where both sets are as large.
    gap = lambda size: overlap(size) - F.greatest(rest(n), rest(size)) + 1
    return (lower <= upper) & (shared >= F.least(gap(lower), gap(upper)) - 1)


def star_links(sets: DataFrame, alive: DataFrame, percent: int) -> DataFrame:
    """Links of each set with the most central set of each of its smallest hashes: the one with the least share of tokens alone."""
    keyed = alive.select("set_id", "n", "held", F.explode("keys").alias("key"))
    central = F.min(F.struct((1 - F.col("held") / F.col("n")).alias("alone"), "set_id", "n", "held")).alias("c")
    centres = keyed.groupBy("key").agg(central).select("key", F.col("c.set_id").alias("other"), F.col("c.n").alias("most"), F.col("c.held").alias("most_held"))
    may = may_overlap(F.col("n"), F.col("held"), F.col("most"), F.col("most"), F.col("most_held"), percent)
    asks = keyed.join(centres, "key").where((F.col("set_id") != F.col("other")) & may)
    asks = saved(asks.select("other", "set_id", F.col("set_id").alias("label"), "n", "most").distinct(), "asks")
    members = asks.select("other", F.col("other").alias("set_id"), F.col("other").alias("label"), F.col("most").alias("n")).distinct()
    return saved(linked(asks.drop("most"), members, sets, percent), "links")


def link_sets(table: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """(node, root) of the sets that have links, over all sets of ``table``."""
    sets = linkable_sets(docs, table, size, percent)
    alive = sets.drop("tokens").dropDuplicates(["set_id"])
    links = star_links(sets, alive, percent)
    roots = components(links, "a", "b")

    # Groups: connected sets, and of the others those with the same smallest hash. A part of a group has sets of like size and share of tokens alone.
    lone = F.col("root").isNull()
    part = F.floor(F.log(F.col("n")) * 8) * 32 + F.floor((1 - F.col("held") / F.col("n")) * 100)
    group = F.coalesce("root", F.xxhash64(F.lit("lone"), F.element_at("keys", 1)))
    placed = alive.join(roots, alive.set_id == roots.node, "left")
    placed = saved(placed.select("set_id", "n", "held", "prefix", F.coalesce("root", "set_id").alias("label"), lone.alias("lone"), group.alias("group"), part.alias("part")), "placed")
    rows = placed.select("set_id", "n", "held", "lone", "group", "part", F.explode("prefix").alias("token"))
    unions = rows.groupBy("token", F.col("group").alias("other"), F.col("part").alias("of")).agg(
        F.min("n").alias("least"), F.max("n").alias("most"), F.max("held").alias("most_held"), F.count("*").alias("times"), F.max("lone").alias("open")
    )
    # Tokens of one connected group alone, or of one set, tell nothing.
    spread = unions.groupBy("token").agg(F.min("other").alias("x"), F.max("other").alias("y"), F.sum("times").alias("all"), F.max("open").alias("o"))
    spread = saved(spread.where("x < y OR (o AND all > 1)").select("token"), "spread")
    unions = unions.join(spread, "token")
    others = (F.col("group") > F.col("other")) | (F.col("lone") & (F.col("group") == F.col("other")) & ((F.col("part") != F.col("of")) | (F.col("times") > 1)))
    bound = (
        rows.join(spread, "token").join(unions, "token")
        .where(others & may_overlap(F.col("n"), F.col("held"), F.col("least"), F.col("most"), F.col("most_held"), percent))
        .groupBy("set_id", "n", "other", "of")
        .agg(F.count("*").alias("shared"), F.min("least").alias("least"), F.max("most").alias("most"))
        .where(enough(F.col("shared"), F.col("n"), F.col("least"), F.col("most"), percent))
    )
    cell = F.xxhash64("other", "of").alias("other")
    asks = saved(bound.select(cell, "set_id", "n").join(placed.select("set_id", "label"), "set_id"), "asks")
    members = placed.select(F.xxhash64("group", "part").alias("other"), "set_id", "label", "n").join(asks.select("other").distinct(), "other", "left_semi")
    more = saved(linked(asks, saved(members, "members"), sets, percent), "links")
    return components(links.unionByName(more), "a", "b")


def grouped(docs: DataFrame, size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n, group) of each row of (doc_id, text), and row where ``docs`` has it as a third column; group is null without words."""
    table = shingle_table(docs, size)
    roots = saved(link_sets(table, docs.select("doc_id", "text"), size, percent), "roots")
    return table.join(roots, table.set_id == roots.node, "left").select("doc_id", "n", F.coalesce("root", "set_id").alias("group"), *docs.columns[2:])


def join_components(docs: DataFrame, size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row.

    Two documents link when ``percent`` of the union of their sets of ``size``-word shingles, or more, is in
    both; component_id is the smallest doc_id that links lead to. Words are split at blanks and the bytes 9 to
    13, A-Z in lower case. A text of fewer words has one shingle, a null or empty one none and no links. Null
    ids count as larger than all others; repeated rows each give a row; other columns are ignored; no rows give
    no rows. Sets are equal by a hash of 64 bits; shingles by 48 bits of a hash and their bucket.
    """
    placed = grouped(id_and_text(docs), size, percent)
    least = placed.where("group IS NOT NULL").groupBy("group").agg(F.min("doc_id").alias("component_id"))
    return placed.join(least, "group", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_components(documents(spark, sf_dir))
