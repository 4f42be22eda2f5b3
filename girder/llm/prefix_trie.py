"""The trie of conversation prefixes: which turns conversations share from their start, and what sharing them saves.

Turns become 128-bit digests and numbers of words where they are read, so texts are never shuffled. A prefix has
a digest chained from its turns. A count-min sketch of all prefix digests (screening) tells which may belong to
several conversations: where it says one, the prefix and all longer ones of that conversation are its own, and their
nodes are made on the spot. Only the others are grouped exactly.

What a node has to know of its whole subtree are sums over its members. A node is owned by its smallest member, and
a conversation owns its prefixes from some length on; so of a node's members each counts the children, leaves and
words that it owns, and nothing has to be carried up the trie level by level.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from .common import map_batches, saved
from .mixing import n_words
from .screening import CountMin, asked, may_repeat

#: Conversations of a block take their first turns, HEAD - 1 at most, from its first one.
BLOCK, HEAD = 20, 4
LISTS = "conv long, digests array<binary>, upto array<long>"
#: Prefixes that a task compares by itself, and ids in one row of those that end at a node.
GROUP_KEYS, GROUP_IDS = 1 << 18, 1 << 16


def turn_digests(conversations: DataFrame) -> DataFrame:
    """(conv, block, turn, digest, words) of each turn; rows without conv_id are left out."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    whole = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    conv = F.col("conv_id").cast("long")
    return conversations.where(F.col("conv_id").isNotNull()).select(
        conv.alias("conv"),
        (conv - F.pmod(conv, F.lit(BLOCK).cast("long"))).alias("block"),
        "turn",
        F.unhex(F.substring(F.sha2(whole.cast("binary"), 256), 1, 32)).alias("digest"),
        n_words(text).alias("words"),
    )


def rebuilt(conversations: DataFrame) -> DataFrame:
    """LISTS of each conversation: the digest of each prefix from length 1, the words of each from length 0.

    The first h turns, h by a hash of the id, are those of the block's first conversation, the others its own
    after its first h. Turns go by ``turn``, null first; equal ones by their digests.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        convs, digests, upto, size = [], [], [], 0
        now = block = None
        heads, position, skip = [], 0, 0

        def add(digest: bytes, n: int) -> None:
            own, words = digests[-1], upto[-1]
            own.append(hashlib.blake2b((own[-1] if own else b"") + digest, digest_size=16).digest())
            words.append(words[-1] + n)

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(convs, pa.int64()), pa.array(digests, pa.list_(pa.binary())), pa.array(upto, pa.list_(pa.int64()))], names=["conv", "digests", "upto"]
            )

        for batch in batches:
            for conv, at, digest, n in zip(*(batch.column(k).to_pylist() for k in (0, 1, 3, 4)), strict=True):
                if at != block:
                    block, heads = at, []
                if conv != now:
                    if size > GROUP_KEYS:
                        yield rows()
                        convs, digests, upto, size = [], [], [], 0
                    now, position = conv, 0
                    skip = 0 if conv == block else zlib.crc32(str(conv).encode()) % HEAD
                    convs.append(conv)
                    digests.append([])
                    upto.append([0])
                    for head in heads[:skip]:
                        add(*head)
                if conv == block and len(heads) < HEAD - 1:
                    heads.append((digest, n))
                if position >= skip:
                    add(digest, n)
                position += 1
                size += 1
        if convs:
            yield rows()

    n = int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    turns = turn_digests(conversations).repartition(n, "block").sortWithinPartitions("block", "conv", F.col("turn").asc_nulls_first(), "digest")
    return map_batches(turns, run, LISTS)


def ask(batches: Iterator[pa.RecordBatch], slices: int) -> Iterator[pa.RecordBatch]:
    owners, keys, tags, size = [], [], [], 0

    def flush() -> Iterator[pa.RecordBatch]:
        owner = np.concatenate(owners)
        yield from asked(owner, np.zeros(len(owner), np.int64), np.concatenate(keys), np.concatenate(tags), slices)

    for batch in batches:
        convs, lists = batch.column(0).to_numpy(), batch.column(1)
        raw = b"".join(d[:8] for own in lists.to_pylist() for d in own)
        lengths = np.array([len(x) for x in lists], np.int64)
        if not raw:
            continue
        owners.append(np.repeat(convs, lengths))
        keys.append(np.frombuffer(raw, "<u8"))
        tags.append(np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths) + 1)
        size += len(keys[-1])
        if size >= GROUP_KEYS:
            yield from flush()
            owners, keys, tags, size = [], [], [], 0
    if owners:
        yield from flush()


def ids_at_ends(ends: DataFrame) -> DataFrame:
    """(digest, ends): the hash of the ids of each digest, ascending, joined by commas.

    Ids are dealt out in ranges; the ids of a digest in one range go as one row, or few, to the task that hashes
    them one after the other, which is all that SHA-256 allows.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, digest, ids = [], None, []
        for batch in batches:
            for d, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if ids and (d != digest or len(ids) >= GROUP_IDS):
                    out.append((digest, ids[0], ",".join(map(str, ids))))
                    ids = []
                digest = d
                ids.append(conv)
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], kind) for k, kind in enumerate((pa.binary(), pa.int64(), pa.string()))], names=["digest", "first", "ids"])
            out = []
        if ids:
            yield pa.RecordBatch.from_arrays([pa.array([digest], pa.binary()), pa.array([ids[0]], pa.int64()), pa.array([",".join(map(str, ids))])], names=["digest", "first", "ids"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest, state = None, None
        for batch in batches:
            out = []
            for d, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if d != digest:
                    if state:
                        out.append((digest, state.hexdigest()))
                    digest, state = d, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in out], pa.binary()), pa.array([h for _, h in out], pa.string())], names=["digest", "ends"])
        if state:
            yield pa.RecordBatch.from_arrays([pa.array([digest], pa.binary()), pa.array([state.hexdigest()])], names=["digest", "ends"])

    n = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    packed = map_batches(ends.repartitionByRange(n, "conv").sortWithinPartitions("digest", "conv"), pack, "digest binary, first long, ids string")
    return map_batches(packed.repartition(n, "digest").sortWithinPartitions("digest", "first"), hashed, "digest binary, ends string")


def prefix_nodes(conversations: DataFrame) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of each node.

    Null roles and texts are empty; rows without conv_id belong to no conversation; repeated rows are turns of their
    own; equal turn numbers go by the digests of what is said; a conversation left without turns ends at the root;
    other columns are ignored; no rows give no nodes. A task holds 24 bytes for each turn of its longest conversation.
    """
    lists = saved(rebuilt(conversations), "lists")
    n_keys = lists.agg(F.coalesce(F.sum(F.size("digests")), F.lit(0))).first()[0]
    shared = may_repeat(lists, ask, n_keys, CountMin, "prefixes")
    # Lengths are shared from 1 without a gap; a later one that the sketch takes for shared doesn't count.
    run = F.aggregate(F.array_sort("tags"), F.lit(0), lambda a, t: F.when(t == a + 1, a + 1).otherwise(a))
    known = lists.join(shared.select(F.col("owner").alias("conv"), run.alias("k")), "conv", "left")
    # Prefixes by length, the root's first.
    path = F.concat(F.array(F.lit(b"")), F.slice("digests", 1, F.col("k")))
    known = saved(known.select("conv", "upto", "digests", F.coalesce("k", F.lit(0)).alias("k"), F.size("digests").alias("t")).withColumn("path", path), "known")

    exact = known.select("conv", "t", F.posexplode("path").alias("depth", "digest")).groupBy("digest", "depth")
    nodes = saved(exact.agg(F.min("conv").alias("owner"), F.max("t").alias("longest")), "nodes")
    root = nodes.where("depth = 0").select("owner").first()  # one number
    owners = nodes.groupBy(F.col("owner").alias("conv")).agg(F.min("depth").alias("from"), F.max(F.col("longest") == F.col("depth")).alias("leaf"))
    # A conversation's own prefixes begin at length ``own``; ``leaf``: one of them is a leaf. Beyond k all are its own.
    own = F.coalesce("from", F.col("k") + 1)
    leaf = (F.col("t") > F.col("k")) | F.coalesce("leaf", F.lit(False))
    convs = known.join(owners, "conv", "left").select("conv", "upto", "digests", "path", "k", "t", own.alias("own"), leaf.alias("leaf"))
    convs = saved(convs, "convs")

    above = convs.where("own BETWEEN 2 AND t").select("conv", F.element_at("digests", F.col("own") - 1).alias("digest")).join(nodes.select("digest", "owner"), "digest").select("conv", "owner")
    parents = convs.where("own <= t").select("conv", "own", "k", "t").join(above, "conv", "left")
    parents = saved(parents.select("conv", "own", "k", "t", F.coalesce("owner", F.lit(root[0] if root else None).cast("long")).alias("above")), "parents")
    parent = lambda conv: F.when(F.col("depth") > F.col("own"), F.col(conv)).otherwise(F.col("above"))

    at = F.greatest(F.col("depth"), F.lit(1))
    member = convs.select("conv", "upto", "t", "own", "leaf", F.posexplode("path").alias("depth", "digest")).select(
        "conv",
        "digest",
        "depth",
        ((F.col("own") <= F.col("depth") + 1) & (F.col("t") > F.col("depth"))).cast("long").alias("child"),
        F.col("leaf").cast("long").alias("leaf"),
        (F.element_at("upto", F.greatest(at, "own")) - F.element_at("upto", at)).alias("repeated"),
    )
    sums = member.groupBy("digest", "depth").agg(
        F.min("conv").alias("conv_id"), F.count("*").alias("n_convs"), F.sum("child").alias("n_children"), F.sum("leaf").alias("n_leaves"), F.sum("repeated").alias("saved_tokens")
    )
    ends = ids_at_ends(convs.where("t = k").select(F.element_at("path", F.col("k") + 1).alias("digest"), "conv"))
    none = F.sha2(F.lit(b""), 256)
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    grouped = sums.join(ends, "digest", "left").join(parents.select(F.col("conv").alias("conv_id"), "own", "above"), "conv_id", "left")
    grouped = grouped.withColumn("parent_conv_id", F.when(F.col("depth") > 0, parent("conv_id"))).withColumn("ends_sha256", F.coalesce("ends", none))

    one, zero = F.lit(1).cast("long"), F.lit(0).cast("long")
    tails = parents.where("t > k").withColumn("depth", F.explode(F.sequence(F.col("k") + 1, F.col("t"))))
    last = F.col("depth") == F.col("t")
    alone = tails.select(
        F.col("conv").alias("conv_id"),
        "depth",
        parent("conv").alias("parent_conv_id"),
        one.alias("n_convs"),
        F.when(last, zero).otherwise(one).alias("n_children"),
        one.alias("n_leaves"),
        zero.alias("saved_tokens"),
        F.when(last, F.sha2(F.col("conv").cast("string").cast("binary"), 256)).otherwise(none).alias("ends_sha256"),
    )
    return grouped.select(names).unionByName(alone.select(names)).withColumn("depth", F.col("depth").cast("long"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return prefix_nodes(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


SQL = r"""
WITH src AS (SELECT conv_id AS c, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
turns AS (SELECT c, turn, md5(strlen(role) || ':' || role || text) AS k, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS w FROM src),
own AS (SELECT c, list(k ORDER BY turn NULLS FIRST, k) AS ks, list(w ORDER BY turn NULLS FIRST, k) AS ws FROM turns GROUP BY c),
hashed AS (
  SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
    lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384::BIGINT * (x & 1)))), 4294967295::BIGINT) % 4 AS h
  FROM own
),
rebuilt AS (
  SELECT a.c, list_concat(coalesce(b.ks[1:h], []), a.ks[h + 1:]) AS ks, list_concat(coalesce(b.ws[1:h], []), a.ws[h + 1:]) AS ws
  FROM hashed a LEFT JOIN own b ON b.c = a.c - a.c % 20
),
paths AS (SELECT c, len(ks) AS t, d, array_to_string(ks[1:d], ',') AS prefix, CASE WHEN d > 0 THEN ws[d] ELSE 0 END AS w FROM (SELECT *, unnest(range(len(ks) + 1)) AS d FROM rebuilt)),
nodes AS (SELECT d, prefix, min(c) AS owner, count(*) AS n, max(w) AS w, max(t) = d AS childless, string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (t = d) AS ends FROM paths GROUP BY d, prefix),
parents AS (SELECT v.d, v.prefix, p.prefix AS above FROM nodes v JOIN paths p ON p.c = v.owner AND p.d = v.d - 1),
children AS (SELECT d - 1 AS d, above AS prefix, count(*) AS n_children FROM parents GROUP BY ALL),
subtrees AS (
  SELECT p.d, p.prefix, sum((n - 1) * v.w) AS saved, count(*) FILTER (childless) AS n_leaves
  FROM nodes v JOIN paths p ON p.c = v.owner AND p.d <= v.d GROUP BY p.d, p.prefix
)
SELECT n.owner AS conv_id, n.d::BIGINT AS depth, u.owner AS parent_conv_id, n.n::BIGINT AS n_convs, coalesce(n_children, 0)::BIGINT AS n_children, n_leaves::BIGINT AS n_leaves,
  saved::BIGINT AS saved_tokens, sha256(coalesce(n.ends, '')) AS ends_sha256
FROM nodes n JOIN subtrees USING (d, prefix) LEFT JOIN children USING (d, prefix) LEFT JOIN parents p ON p.d = n.d AND p.prefix = n.prefix LEFT JOIN nodes u ON u.d = n.d - 1 AND u.prefix = p.above
"""
