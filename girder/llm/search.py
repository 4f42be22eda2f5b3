"""Exact BM25 top-k over sharded inverted indexes with block-max WAND pruning.

A shard holds some thousand documents, like ones side by side, cut into blocks of neighbours. The commonest terms are
rows of a matrix, with each term's largest impact in a block; the others keep postings. A query has a floor, which a
document's score must reach. Postings of its rarer terms are added up first. What the best document of a block has of
these and the largest impacts of the common terms there bound the block's scores; blocks that stay below the floor are
skipped, and the others are opened only for the queries that may find something in them. There scores are first summed
in 32 bits, and what may be among the k best within their error is scored exactly.

Shards score with the same global statistics, so their best merge exactly. A query's floor is the k-th best score
that it has so far. It begins in the shards of one partition and then meets as many again in each round, so that a shard
returns few rows that another one beats, however many shards there are. Shards and queries lie in the shared
folder, from where the tasks of a round read a shard and the queries that visit it; they don't pass the driver and
are not shuffled to each other.

Documents with the same bag of terms score alike. Statistics count them all, but only the one with the smallest id is
searched; what it finds is found by its copies, too.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.dataset as ds
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, id_and_text, map_batches, new_dir, pieces, put, saved, text_bytes
from .hashing import U, mix, word_hashes, words

K1, B = 1.2, 0.75
#: Documents and postings of a shard, at most (a single document can have more postings).
SHARD_DOCS, SHARD_POSTINGS = 8192, 3_000_000
BLOCK = 64
#: A term in more than this share of a shard's documents is common.
COMMON = 1 / 16
#: Queries that meet a shard at once, and blocks that are opened at once.
QUERIES, OPENED = 128, 4
#: Relative error that sums of 32-bit numbers are allowed; what may lie within it is scored exactly.
SLACK = 1e-4
#: Letters, digits and all bytes of characters beyond ASCII make terms.
IS_TERM = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])
#: What a shard's file has: of documents, of terms, of their postings.
ARRAYS = {"ids": "<i8", "known": "?", "lengths": "<i8", "bag": "<i8", "more": "<i8", "terms": "<u8", "df": "<u2", "docs": "<u2", "tf": "<u4"}
MANIFEST = "node long, path string, n_docs long, n_terms long"


def term_counts(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(terms in ascending order, how often, length) of each text."""
    raw, offsets = text_bytes(column)
    for lo, hi in pieces(offsets):
        part, own = raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        text, starts, ends = words(part, own, IS_TERM)
        hashes = word_hashes(part, starts, ends)
        bounds = np.searchsorted(text, np.arange(hi - lo + 1))
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            terms, counts = np.unique(hashes[a:b], return_counts=True)
            yield terms, counts, int(b - a)


def starts_of(values: np.ndarray) -> np.ndarray:
    """Where runs of equal values start, and the end."""
    new = np.ones(len(values) + 1, bool)
    new[1:-1] = values[1:] != values[:-1]
    return np.flatnonzero(new)


def like_together(doc: np.ndarray, term: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The place of each document: ordered by which of the 48 commonest terms it has, then by length."""
    n, cuts = len(lengths), starts_of(term)
    mask = np.zeros(n, np.int64)
    for t in np.argsort(-np.diff(cuts), kind="stable")[:48].tolist():
        mask <<= 1
        mask[doc[cuts[t] : cuts[t + 1]]] |= 1
    place = np.empty(n, np.int64)
    place[np.lexsort((lengths, mask))] = np.arange(n)
    return place


def bags_of(term: np.ndarray, tf: np.ndarray, sizes: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of hash of each document's bag of terms, given the documents one after the other."""
    ends = np.cumsum(sizes)
    each = mix(term + mix(tf.astype(U)))
    sums = (np.append(U(0), np.cumsum(x)) for x in (each, mix(each + U(1))))
    return tuple((x[ends] - x[ends - sizes]).view(np.int64) for x in sums)


def shard_file(ids: list, held: list) -> bytes:
    """An Arrow file with the arrays of a shard of documents, given their term_counts."""
    lengths, sizes = np.array([n for *_, n in held], np.int64), [len(t) for t, _, _ in held]
    term, tf = np.concatenate([t for t, _, _ in held]), np.concatenate([c for _, c, _ in held])
    bag, more = bags_of(term, tf, sizes)
    doc = np.repeat(np.arange(len(held)), sizes)
    by_term = np.argsort(term, kind="stable")
    place = like_together(doc[by_term], term[by_term], lengths) if len(term) else np.arange(len(held))
    order = np.argsort(place[doc], kind="stable")
    order = order[np.argsort(term[order], kind="stable")]
    term, doc, tf = term[order], place[doc][order], tf[order]
    cuts = starts_of(term) if len(term) else np.zeros(1, np.int64)
    back = np.argsort(place)
    known = np.array([i is not None for i in ids])
    arrays = {
        "ids": np.array([i or 0 for i in ids])[back],
        "known": known[back],
        "lengths": lengths[back],
        "bag": bag[back],
        "more": more[back],
        "terms": term[cuts[:-1]],
        "df": np.diff(cuts),
        "docs": doc,
        "tf": tf,
    }
    row = pa.RecordBatch.from_pydict({name: pa.array([arrays[name].astype(kind).tobytes()], pa.binary()) for name, kind in ARRAYS.items()})
    out = pa.BufferOutputStream()
    with pa.ipc.new_file(out, row.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as f:
        f.write_batch(row)
    return out.getvalue().to_pybytes()


def read_shard(path: str, names: tuple[str, ...] = tuple(ARRAYS)) -> dict[str, np.ndarray]:
    store, at = fs.FileSystem.from_uri(path)
    with store.open_input_file(at) as f:
        row = pa.ipc.open_file(f, options=pa.ipc.IpcReadOptions(included_fields=[list(ARRAYS).index(n) for n in names])).get_batch(0)
    return {name: np.frombuffer(row.column(name)[0].as_buffer(), ARRAYS[name]) for name in names}


def build_index(docs: DataFrame) -> DataFrame:
    """A row (node, path, n_docs, n_terms) for each shard: files of the rows of each input partition, whose number is their node. Nothing is shuffled."""
    spark = docs.sparkSession
    folder = new_dir(spark, "index")
    store, at = fs.FileSystem.from_uri(folder)
    store.create_dir(at)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, ids, held, postings, rows = TaskContext.get().partitionId(), [], [], 0, []

        def close() -> None:
            path = f"{folder}/shard-{node:08d}-{len(rows):06d}.arrow"
            put(path, shard_file(ids, held))
            rows.append((node, path, len(held), sum(n for *_, n in held)))

        for batch in batches:
            for doc_id, counts in zip(batch.column(0).to_pylist(), term_counts(batch.column(1)), strict=True):
                ids.append(doc_id)
                held.append(counts)
                postings += len(counts[0])
                if len(held) == SHARD_DOCS or postings >= SHARD_POSTINGS:
                    close()
                    ids, held, postings = [], [], 0
        if held:
            close()
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=["node", "path", "n_docs", "n_terms"])

    number = F.row_number().over(Window.orderBy("path")) - 1  # one row a shard
    return saved(saved(map_batches(docs, run, MANIFEST), "manifest").withColumn("shard", number.cast("long")), "shards")


def dealt(index: DataFrame) -> DataFrame:
    """Shards in twice as many partitions as shuffles have, neighbours in different ones."""
    parts = 2 * int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return index.withColumn("part", F.pmod("shard", F.lit(parts)).cast("int")).repartitionById(parts, "part").drop("part")


def copies_of(index: DataFrame, k: int) -> DataFrame:
    """(bag, more, copy, doc_id, shard, place) of the first ``k`` documents with each bag of terms, by id, null ids last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, path in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                a = read_shard(path, ("ids", "known", "bag", "more"))
                n = len(a["ids"])
                ids = pa.array(a["ids"], mask=~a["known"])
                yield pa.RecordBatch.from_arrays([pa.array(a["bag"]), pa.array(a["more"]), ids, pa.array([shard] * n, pa.int64()), pa.array(range(n), pa.int64())], names=["bag", "more", "doc_id", "shard", "place"])

    told = map_batches(dealt(index).select("shard", "path"), run, "bag long, more long, doc_id long, shard long, place long")
    order = Window.partitionBy("bag", "more").orderBy(F.col("doc_id").asc_nulls_last(), "shard", "place")
    return saved(told.withColumn("copy", F.row_number().over(order)).where(F.col("copy") <= k), "copies")


def places_of(lo: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All numbers of the ranges one after the other."""
    ends = np.cumsum(size)
    return np.arange(ends[-1]) + np.repeat(lo - (ends - size), size)


class Shard:
    """One shard's documents at ``places``, with impacts by global statistics; each stands for ``times`` documents. Terms in over COMMON of its documents have a row of a matrix, zeros included, instead of postings."""

    def __init__(self, path: str, average: float, places: np.ndarray, times: np.ndarray):
        arrays, places, order = read_shard(path), np.sort(places), np.argsort(places)
        self.ids, self.known, lengths, self.bag, self.more = (arrays[a][places] for a in ("ids", "known", "lengths", "bag", "more"))
        self.copies = times[order]
        at = np.full(len(arrays["ids"]), -1, np.int32)
        at[places] = np.arange(len(places))
        docs = at[arrays["docs"]]
        df = np.add.reduceat(docs >= 0, np.append(0, np.cumsum(arrays["df"], dtype=np.int64))[:-1], dtype=np.int64) if len(docs) else np.zeros(0, np.int64)
        self.terms, tf, docs, df = arrays["terms"][df > 0], arrays["tf"][docs >= 0], docs[docs >= 0], df[df > 0]
        self.n, self.blocks = len(lengths), len(lengths) // BLOCK + 1
        self.norm = K1 * (1 - B + B * lengths / average)
        self.ends = np.append(0, np.cumsum(df))
        common = np.flatnonzero(df > max(BLOCK, COMMON * self.n))
        self.row = np.full(len(df), -1, np.int64)
        self.row[common] = np.arange(len(common))
        self.times = np.zeros((len(common), self.blocks * BLOCK), np.float32)
        for r, t in enumerate(common.tolist()):
            part = slice(self.ends[t], self.ends[t + 1])
            self.times[r, docs[part]] = tf[part]
        norm = np.ones(self.blocks * BLOCK, np.float32)
        norm[: self.n] = self.norm
        self.dense = self.times * np.float32(K1 + 1) / (self.times + norm)
        self.most = self.dense.reshape(len(common), self.blocks, BLOCK).max(axis=2)
        self.docs = docs
        self.impact = tf * (K1 + 1) / (tf + self.norm[self.docs])

    def search(self, query: np.ndarray, at: np.ndarray, weight: np.ndarray, floor: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, place, score) of the k best of each query that reach its floor, ties to smaller ids, for pairs of a query (ascending) and a term's place in the dictionary."""
        n, width, low = len(floor), self.blocks * BLOCK, floor * (1 - SLACK) - 2e-6  # for sums in another order or of 32 bits, and rounding
        row = self.row[at]
        wide = np.zeros((n, len(self.most)))
        wide[query[row >= 0], row[row >= 0]] = weight[row >= 0]
        narrow = wide.astype(np.float32)
        query, at, weight = query[row < 0], at[row < 0], weight[row < 0]
        lo, size, cuts = self.ends[at], self.ends[at + 1] - self.ends[at], np.searchsorted(query, np.arange(n + 1))
        score = np.zeros((n, width))
        for q in np.flatnonzero(np.diff(cuts)).tolist():
            own = slice(cuts[q], cuts[q + 1])
            postings = places_of(lo[own], size[own])
            score[q] = np.bincount(self.docs[postings], weights=self.impact[postings] * np.repeat(weight[own], size[own]), minlength=width)
        fresh = np.flatnonzero(floor <= 0)
        if len(fresh) and width > k:
            total = narrow[fresh] @ self.dense + score[fresh]
            low[fresh] = np.maximum(low[fresh], np.partition(total, width - k, axis=1)[:, width - k] * (1 - SLACK) - 2e-6)
        # What each block of documents can reach at most.
        live = (narrow @ self.most + score.reshape(n, -1, BLOCK).max(axis=2)) * (1 + SLACK) >= low[:, None]
        found = [(np.zeros(0, np.int64),) * 2]
        for b in range(0, self.blocks, OPENED):
            asking = np.flatnonzero(live[:, b : b + OPENED].any(axis=1))
            if len(asking):
                here = slice(b * BLOCK, (b + OPENED) * BLOCK)
                total = narrow[asking] @ self.dense[:, here] + score[asking, here]
                q, d = np.nonzero((total > 0) & (total * (1 + SLACK) >= low[asking, None]))
                found.append((asking[q], b * BLOCK + d))
        # Nearly scored; those that may be among the k best are scored exactly.
        query, place = (np.concatenate(c) for c in zip(*found, strict=True))
        exact = np.empty(len(query))
        for lo in range(0, len(query), 4096):
            q, d = query[lo : lo + 4096], place[lo : lo + 4096]
            tf = self.times[:, d].T.astype(np.float64)
            exact[lo : lo + 4096] = score[q, d] + np.einsum("ij,ij->i", wide[q], tf * (K1 + 1) / (tf + self.norm[d][:, None]))
        exact = np.round(exact, 6)  # equal texts score alike in any order of sums
        good = (exact > 0) & (exact >= floor[query])
        query, place, exact = query[good], place[good], exact[good]
        order = np.lexsort((self.ids[place], ~self.known[place], -exact, query))
        query, place, exact = query[order], place[order], exact[order]
        rank = np.arange(len(query)) - np.searchsorted(query, query)
        return query[rank < k], place[rank < k], exact[rank < k]


def query_table(queries: DataFrame, index: DataFrame, nodes: int, n_docs: int) -> tuple[DataFrame, DataFrame]:
    """(home, query, terms, weights) of each bag of terms that some document has, home being below ``nodes``; and (query, query_id) of the rows with that bag.

    Equal bags, by 96 bits of hashes, are asked once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            got = list(term_counts(batch.column(1)))
            columns = [pa.array(range(number, number + len(got)), pa.int64()), batch.column(0), pa.array([t.view(np.int64) for t, *_ in got], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([c for _, c, _ in got], pa.list_(pa.int64()))], names=["query", "query_id", "terms", "counts"])
            number += len(got)

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                arrays = read_shard(path, ("terms", "df"))
                terms, df = arrays["terms"].view(np.int64), arrays["df"].astype(np.int64)
                for lo in range(0, len(terms), 1 << 16):
                    yield pa.RecordBatch.from_arrays([pa.array(terms[lo : lo + (1 << 16)]), pa.array(df[lo : lo + (1 << 16)])], names=["term", "df"])

    known = saved(map_batches(queries, run, "query long, query_id long, terms array<long>, counts array<long>"), "queries")
    df = map_batches(dealt(index).select("path"), frequencies, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
    bagged = known.select("query", "query_id", F.xxhash64("terms", "counts").alias("bag"), F.hash("terms", "counts").alias("more"))
    owners = saved(bagged.join(bagged.groupBy("bag", "more").agg(F.min("query").alias("first")), ["bag", "more"]).select(F.col("first").alias("query"), "query_id"), "owners")
    once = known.join(owners.select("query").distinct(), "query", "left_semi")
    words = once.select("query", F.explode(F.arrays_zip("terms", "counts")).alias("t")).select("query", F.col("t.terms").alias("term"), F.col("t.counts").alias("times"))
    weight = F.col("times") * F.log1p((F.lit(n_docs) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    told = words.join(df.hint("merge"), "term").groupBy("query").agg(F.sort_array(F.collect_list(F.struct("term", weight.alias("weight")))).alias("t"))
    home = F.pmod(F.shiftright("query", 32), F.lit(nodes)).alias("home")
    return told.select(home, "query", F.col("t.term").alias("terms"), F.col("t.weight").alias("weights")), owners


def visitors(node: int, stage: int) -> tuple[int, int]:
    """The homes (from, to) whose queries visit a node: its own first, then as many again in each round as they have met."""
    if stage == 0:
        return node, node + 1
    other = (node >> (stage - 1)) ^ 1
    return other << (stage - 1), (other + 1) << (stage - 1)


def read_range(folder: str, columns: list[str], lo: int, hi: int) -> Iterator[pa.RecordBatch]:
    """Rows with a home from lo to hi of a Parquet table in the shared folder."""
    store, at = fs.FileSystem.from_uri(folder)
    some = ds.dataset(at, filesystem=store, format="parquet")
    yield from some.to_batches(columns=columns, filter=(ds.field("home") >= lo) & (ds.field("home") < hi), batch_size=QUERIES, batch_readahead=1, fragment_readahead=1, use_threads=False)


def floors_of(folder: str | None, lo: int, hi: int) -> dict[int, float]:
    if folder is None:
        return {}
    return {q: f for b in read_range(folder, ["query", "floor"], lo, hi) for q, f in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)}


FOUND = "home long, query long, doc_id long, score double, bag long, more long, times long"


def found_by(index: DataFrame, searched: str, asked: str, floors: str | None, stage: int, average: float, k: int) -> DataFrame:
    """FOUND rows: what the shards have for their visitors of a round, if it reaches the floor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for node, number, path in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                own = pa.Table.from_batches([*read_range(searched, ["place", "times"], number, number + 1)], pa.schema({"place": pa.int64(), "times": pa.int64()}))
                shard, (lo, hi) = Shard(path, average, own["place"].to_numpy(), own["times"].to_numpy()), visitors(node, stage)
                if not len(shard.terms):
                    continue
                least = floors_of(floors, lo, hi)
                for part in read_range(asked, ["home", "query", "terms", "weights"], lo, hi):
                    if part.num_rows:
                        yield answers(shard, part, least, k)

    def answers(shard: Shard, part: pa.RecordBatch, least: dict[int, float], k: int) -> pa.RecordBatch:
        terms, weights = part.column(2).flatten().to_numpy().view(U), part.column(3).flatten().to_numpy()
        query = np.repeat(np.arange(part.num_rows), np.diff(part.column(2).offsets.to_numpy()))
        at = np.minimum(np.searchsorted(shard.terms, terms), len(shard.terms) - 1)
        there = shard.terms[at] == terms
        floor = np.array([least.get(q, 0.0) for q in part.column(1).to_pylist()])
        rows, places, score = shard.search(query[there], at[there], weights[there], floor, k)
        columns = [pa.array(shard.ids[places], mask=~shard.known[places]), score, *(a[places] for a in (shard.bag, shard.more, shard.copies))]
        same = part.select([0, 1]).take(pa.array(rows))
        return pa.RecordBatch.from_arrays([*same.columns, *map(pa.array, columns)], names=[c.split()[0] for c in FOUND.split(", ")])

    return map_batches(index.select("node", "shard", "path"), run, FOUND)


def top_k(docs: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, rank, doc_id, score): the ``k`` best of ``docs`` by BM25 for each row of ``queries``.

    A query is the bag of all terms of its whole text: runs of letters and digits, A-Z in lower case. Ties go to
    smaller ids, null ids last. Documents that share no term with a query aren't found; queries without terms have no
    rows; repeated rows of ``docs`` are each found; each row of ``queries`` has its own ranks, also where ids repeat;
    other columns are ignored.
    """
    spark = docs.sparkSession
    index = build_index(id_and_text(docs))
    stats = index.agg(F.sum("n_docs").alias("n"), F.sum("n_terms").alias("terms")).first()
    if not stats.n:
        return spark.createDataFrame([], "query_id long, rank long, doc_id long, score double")
    copies, searched = copies_of(index, k), new_dir(spark, "searched")
    average, parts = max(stats.terms / stats.n, 1e-9), int(spark.conf.get("spark.sql.shuffle.partitions"))
    times = F.max("copy").cast("long").alias("times")
    firsts = copies.groupBy("bag", "more").agg(times, F.min_by(F.struct("shard", "place"), "copy").alias("at")).select(F.col("at.shard").alias("home"), "at.place", "times")
    firsts.repartitionByRange(parts, "home").sortWithinPartitions("home").write.parquet(searched)
    some = index.join(spark.read.parquet(searched).select(F.col("home").alias("shard")).distinct(), "shard", "left_semi")
    some = saved(some.withColumn("node", F.dense_rank().over(Window.orderBy("node")).cast("long") - 1), "shards")  # one row a shard
    nodes, some = some.agg(F.max("node")).first()[0] + 1, dealt(some)
    asked, floors = new_dir(spark, "asked"), None
    bags, owners = query_table(id_and_text(queries), index, nodes, stats.n)
    bags.repartitionByRange(parts, "home").sortWithinPartitions("home").write.parquet(asked)
    order = Window.partitionBy("home", "query").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    least = Window.partitionBy("home", "query").orderBy(F.desc("score"))  # with ties, so that the first k documents by score and id are kept
    alike = Window.partitionBy("home", "query", "score")
    best = spark.createDataFrame([], FOUND)
    for stage in range((nodes - 1).bit_length() + 1):
        both = best.unionByName(found_by(some, searched, asked, floors, stage, average, k))
        ranked = both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        counted = ranked.withColumn("held", F.sum("times").over(least)).withColumn("alike", F.sum("times").over(alike))
        best = saved(counted.where(F.col("held") - F.col("alike") < k).drop("alike"), "best")
        floors = new_dir(spark, "floors")
        best.where(F.col("held") >= k).groupBy("home", "query").agg(F.max("score").alias("floor")).repartitionByRange(parts, "home").write.parquet(floors)
        best = best.drop("rank", "held")
    found = best.drop("doc_id").join(copies.select("bag", "more", "doc_id"), ["bag", "more"])
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last()))
    ranked = found.withColumn("rank", rank.cast("long")).where(F.col("rank") <= k).join(owners, "query")
    return ranked.select("query_id", "rank", "doc_id", "score")


def op3_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return top_k(docs, docs.where(F.col("doc_id") % 50 == 0))
