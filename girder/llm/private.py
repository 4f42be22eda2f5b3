"""Personal data: fixed patterns, and what bootstrapped context patterns find beyond them.

Fixed patterns give seed entities: mail and network addresses, cards, phones, and long hexadecimal secrets. What
stands before an entity makes its lexical patterns: the two words before it, the last one, the one before that with
any word between, each with what is glued to the entity in its own word, or this alone. Whatever follows a
pattern is an instance of it: a word with or without digits, a run of digit groups or an address spelled with "at"
and "dot". All of them count in the size of a pattern, ordinary words too. Patterns and instances form a graph
that is scored in turns: a pattern by the confidence of its instances, an instance by the patterns that it
follows. Patterns of high confidence mark their instances of SHORTEST characters or more. These are seeds of the
next round: where they occur elsewhere, what stands before them makes new patterns.

Patterns are compared by 64-bit hashes of their words, A-Z in lower case.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, map_batches, pieces, saved, text_bytes
from .counting import hashed_marks, places
from .hashing import BASE, U, mix, word_hashes, words

KINDS = ("email", "ip", "card", "phone", "secret")
#: The kinds of the fixed patterns whose spans are counted; "secret" only seeds.
N_BASE = 4
ROUNDS, TURNS = 2, 3
MIN_INSTANCES, MIN_SEEDS, CONFIDENT = 8, 3, 0.6
#: A pattern takes part if of all that follows it at least this share is known.
LEAST_SHARE = 0.1
#: What an instance found in an earlier round is believed.
LEARNED = 0.8
#: Characters of the shortest instance that is marked.
SHORTEST = 6
#: Hashed marks of the patterns that are followed.
MARKS = 1 << 23

# Equal to the contract's patterns, but linear in the text: an e-mail is sought from its @, and digits at the start of their run.
LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL_CHAR = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DIGITS = re.compile(r"[0-9][^\x20\x09-\x0d]*")

SECRET = re.compile(r"(?<![0-9A-Za-z])(?=[0-9]*[a-f])(?=[a-f]*[0-9])[0-9a-f]{32,}+(?![0-9A-Za-z])")
#: Where an instance can start inside a word: after one of these.
SPLIT = np.isin(np.arange(256), np.frombuffer(b"=:\"'(<[", np.uint8))
DIGIT = np.array([48 <= b < 58 for b in range(256)])
LETTER = np.array([b >= 128 or chr(b).isalpha() for b in range(256)])
#: Digit groups joined by blank, hyphen, dot or brackets, as in accounts (which start with letters), cards and phones.
RUN = re.compile(r"[+(\[]{0,2}[A-Za-z]{0,2}[0-9]++(?![A-Za-z])(?:[\x20.()\[\]-]{1,3}(?:[0-9]++(?![A-Za-z])|[A-Z]{4}(?=[\x20-][0-9])))+")
SPELLED = re.compile(r"[\w.%+-]+\x20?[\[({<]?\x20?at\x20?[\])}>]?\x20?[\w-]+(?:\x20?[\[({<]?\x20?dot\x20?[\])}>]?\x20?[\w-]+)+", re.IGNORECASE)


def emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL_CHAR:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def passes_luhn(digits: str) -> bool:
    double = [int(c) for c in reversed(digits)]
    double[1::2] = [2 * d - 9 * (d > 4) for d in double[1::2]]
    return sum(double) % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) by kind, then start; code points, end exclusive."""
    out = [(0, s, e) for s, e in emails(text)]
    if not DIGITS.search(text):
        return out
    out += [(1, *m.span()) for m in IP.finditer(text) if all(len(p) <= 3 and int(p) <= 255 or len(p) > 3 and int(p[-3:]) <= 255 and not p[:-3].strip("0") for p in m.groups())]
    for kind, pattern, least, most in ((2, CARD, 16, 19), (3, PHONE, 8, 15)):
        for m in pattern.finditer(text):
            if m.end() - m.start() < least:
                continue
            digits = "".join(filter("0123456789".__contains__, m.group()))
            if least <= len(digits) <= most and (kind == 3 or passes_luhn(digits)):
                out.append((kind, *m.span()))
    return out


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in spans)


def seed_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    return base + [(N_BASE, *m.span()) for m in SECRET.finditer(text)]


def joined(spans: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Where the spans are, overlaps joined, so that ends ascend as starts do."""
    taken: list[tuple[int, int]] = []
    for s, e in sorted((s, e) for _, s, e in spans):
        if taken and s < taken[-1][1]:
            s, e = taken[-1][0], max(taken.pop()[1], e)
        taken.append((s, e))
    return taken


def instance(text: str, start: int, word: int, taken: list[tuple[int, int]]) -> int | None:
    """Where the instance at ``start`` in a word that ends at ``word`` ends: a spelled address, a run of digit groups or a word; none where a fixed pattern has a part of it."""
    while word > start and text[word - 1] in ".,;:!?\"')>]":
        word -= 1
    spelled, run = SPELLED.match(text, start), RUN.match(text, start)
    if run and sum(c.isdigit() for c in run.group()) < SHORTEST:
        run = None
    for end in (spelled and spelled.end(), run and max(run.end(), word), word):
        if end and end > start:
            at = bisect.bisect_left(taken, (end, 0))
            if not at or taken[at - 1][1] <= start:
                return end
    return None


class Page:
    """Some texts with each place where an instance can start, a word or what follows a sign in it, and the patterns before it."""

    FORMS = 4

    def __init__(self, texts: list[str], raw: np.ndarray, offsets: np.ndarray):
        self.texts, self.raw, self.offsets = texts, raw, offsets
        owner, starts, ends = words(raw, offsets)
        own = word_hashes(raw, starts, ends)
        n = len(starts)
        last, earlier = np.zeros(n, U), np.zeros(n, U)
        last[1:] = np.where(owner[1:] == owner[:-1], own[:-1], U(0))
        earlier[2:] = np.where(owner[2:] == owner[:-2], own[:-2], U(0))
        signs = np.flatnonzero(SPLIT[raw])
        at = np.searchsorted(starts, signs, "right") - 1
        inside = (at >= 0) & (signs + 1 < ends[at]) if n else np.zeros(0, bool)
        at, signs = at[inside], signs[inside]
        order = np.argsort(np.concatenate([starts, signs + 1]), kind="stable")
        self.word = np.concatenate([np.arange(n), at])[order]
        self.start = np.concatenate([starts, signs + 1])[order]
        self.stop, self.text = ends[self.word], owner[self.word]
        glued = np.concatenate([np.zeros(n, U), word_hashes(raw, starts[at], signs + 1)])[order]
        letters = np.concatenate([[0], np.cumsum(LETTER[raw])])
        lettered = letters[self.start] > letters[starts[self.word]]
        a, b = earlier[self.word], last[self.word]
        some = b != 0
        forms = [(some, mix(mix(a * U(BASE) + b) ^ glued)), (some, mix(mix(b + U(1)) ^ glued)), (a != 0, mix(mix(a + U(2)) ^ glued)), (lettered, mix(glued + U(3)))]
        #: Hash of the pattern of each form at each place; 0 where there is none.
        self.patterns = np.stack([np.where(there, p, U(0)) for there, p in forms]).view(np.int64)

    def point(self, text: int, at: int) -> int:
        """The code point of a text at a byte of all."""
        begin = int(self.offsets[text])
        if len(self.texts[text]) == self.offsets[text + 1] - begin:
            return at - begin
        return int(np.count_nonzero(self.raw[begin:at] & 0xC0 != 0x80))

    def place(self, text: int, point: int) -> int | None:
        """The place that starts at a code point of a text, if there is one."""
        at = int(self.offsets[text]) + len(self.texts[text][:point].encode())
        k = int(np.searchsorted(self.start, at))
        return k if k < len(self.start) and self.start[k] == at else None

    def contexts(self, k: int) -> list[tuple[int, int]]:
        """(form, pattern) at a place."""
        return [(form, p) for form, p in enumerate(self.patterns[:, k].tolist()) if p]

    def marked(self, marks: np.ndarray) -> np.ndarray:
        """Whether each pattern is marked."""
        return marks[places(pa.array(self.patterns.ravel()), len(marks))].reshape(self.patterns.shape) & (self.patterns != 0)

    def instance(self, k: int, taken: list[tuple[int, int]]) -> tuple[int, int] | None:
        text = int(self.text[k])
        start = self.point(text, int(self.start[k]))
        stop = instance(self.texts[text], start, self.point(text, int(self.stop[k])), taken)
        return None if stop is None else (start, stop)


def pages(batch: pa.RecordBatch) -> Iterator[tuple[int, Page]]:
    """Pages of the batch's texts, in its third column, and where they begin."""
    raw, offsets = text_bytes(batch.column(2))
    for lo, hi in pieces(offsets):
        yield lo, Page(batch.column(2).slice(lo, hi - lo).to_pylist(), raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])


def hashed(text: str) -> str:
    return hashlib.blake2b(text.encode(), digest_size=12).hexdigest()


SPAN = [("kind", pa.int32()), ("start", pa.int32()), ("stop", pa.int32())]
CONTEXT = [("form", pa.int32()), ("pattern", pa.int64()), ("kind", pa.int32()), ("instance", pa.string())]
SPANS = "array<struct<kind:int,start:int,stop:int>>"
ENTRY = f"doc_id long, row long, base {SPANS}, fixed {SPANS}, contexts array<struct<form:int,pattern:long,kind:int,instance:string>>"


def look(keyed: DataFrame) -> DataFrame:
    """The spans of the fixed patterns of each text, and the patterns before them and before other words that hold two digits or more (kind -1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bases, fixed, contexts = [], [], []
            for _, page in pages(batch):
                digits = np.concatenate([[0], np.cumsum(DIGIT[page.raw])])
                odd = np.flatnonzero((digits[page.stop] - digits[page.start] >= 2) & (page.stop - page.start >= SHORTEST))
                bounds = np.searchsorted(page.text[odd], np.arange(len(page.texts) + 1))
                for i, text in enumerate(page.texts):
                    base = base_spans(text)
                    seeds = seed_spans(text, base)
                    own = [(k, text[s:e], page.place(i, s)) for k, s, e in seeds]
                    taken = joined(seeds)
                    for k in odd[bounds[i] : bounds[i + 1]].tolist():
                        if (span := page.instance(k, taken)) is not None:
                            own.append((-1, text[span[0] : span[1]], k))
                    bases.append([{"kind": k, "start": s, "stop": e} for k, s, e in base])
                    fixed.append([{"kind": k, "start": s, "stop": e} for k, s, e in seeds])
                    contexts.append([{"form": f, "pattern": p, "kind": k, "instance": hashed(what)} for k, what, at in own if at is not None for f, p in page.contexts(at)])
            columns = [batch.column(0), batch.column(1), *(pa.array(x, pa.list_(pa.struct(SPAN))) for x in (bases, fixed)), pa.array(contexts, pa.list_(pa.struct(CONTEXT)))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "row", "base", "fixed", "contexts"])

    return saved(map_batches(keyed, run, ENTRY), "entities")


def marked(patterns: DataFrame):
    """Hashed marks of patterns, of fixed size, for all tasks."""
    return patterns.sparkSession.sparkContext.broadcast(np.packbits(hashed_marks(patterns.select("pattern"), MARKS)).tobytes())


def unpacked(sent) -> np.ndarray:
    return np.unpackbits(np.frombuffer(sent.value, np.uint8)).astype(bool)


def able_patterns(told: DataFrame, keyed: DataFrame) -> DataFrame:
    """Those of the patterns (with ``times``, how often something known follows) of whose followers LEAST_SHARE or more are known.

    All that follows a pattern is counted, so the rows that the others would have cost are never made.
    """
    sent = marked(told)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks, known, times = unpacked(sent), np.zeros(0, np.int64), np.zeros(0, np.int64)
        rows = lambda: pa.RecordBatch.from_arrays([pa.array(known), pa.array(times)], names=["pattern", "followers"])
        for batch in batches:  # a row for each pattern and task
            for _, page in pages(batch):
                some, n = np.unique(page.patterns[page.marked(marks)], return_counts=True)
                known, at = np.unique(np.concatenate([known, some]), return_inverse=True)
                times = np.bincount(at, weights=np.concatenate([times, n]), minlength=len(known)).astype(np.int64)
            if len(known) > 1 << 20:
                yield rows()
                known, times = known[:0], times[:0]
        yield rows()

    followers = map_batches(keyed, count, "pattern long, followers long").groupBy("pattern").agg(F.sum("followers").alias("followers"))
    return saved(told.join(followers, "pattern").where(F.col("times") >= LEAST_SHARE * F.col("followers")).select("pattern", "form", "as_kind"), "able")


def follow(able: DataFrame, keyed: DataFrame) -> DataFrame:
    """(doc_id, row, start, stop, pattern, instance) of whatever follows the patterns beyond the fixed spans."""
    sent = marked(able)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = unpacked(sent)
        for batch in batches:
            out, docs, rows = [], batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lo, page in pages(batch):
                good = page.marked(marks)
                taken, last = [], None
                for k in np.flatnonzero(good.any(axis=0)).tolist():
                    i = int(page.text[k])
                    text = page.texts[i]
                    if i != last:
                        taken, last = joined(seed_spans(text, base_spans(text))), i
                    if (span := page.instance(k, taken)) is not None:
                        what = hashed(text[span[0] : span[1]])
                        out += [(docs[lo + i], rows[lo + i], *span, int(page.patterns[form, k]), what) for form in np.flatnonzero(good[:, k])]
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.string()]
            columns = zip(*out, strict=True) if out else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names="doc_id row start stop pattern instance".split())

    found = map_batches(keyed, run, "doc_id long, row long, start int, stop int, pattern long, instance string")
    return saved(found.join(able.select("pattern"), "pattern", "left_semi"), "followers")


def confident_patterns(able: DataFrame, edges: DataFrame, known: DataFrame) -> DataFrame:
    """(pattern, told) whose instances are mostly known entities of that kind, or are marked by other such patterns.

    An instance is believed for the sake of other patterns of the same form only: what a pattern says of its own
    instances, or another one at the same place, tells nothing new.
    """
    sizes = edges.groupBy("pattern").agg(F.count("*").alias("n")).where(F.col("n") >= MIN_INSTANCES)
    graph = saved(edges.join(sizes, "pattern").join(able, "pattern").join(known.select("instance", "belief"), "instance", "left"), "graph")
    belief = F.col("belief")
    patterns = graph.groupBy("pattern", "as_kind").agg((F.sum(F.coalesce(belief, F.lit(0.0))) / (F.max("n") + 1)).alias("confidence"))
    for _ in range(TURNS):
        told = graph.join(patterns.select("pattern", F.log1p(-F.least(F.col("confidence"), F.lit(0.99))).alias("doubt")), "pattern")
        instances = told.groupBy("instance", "form").agg(F.sum("doubt").alias("doubts"))
        others = F.greatest(1 - F.exp(F.col("doubts") - F.col("doubt")), F.lit(0.0))
        patterns = saved(
            told.join(instances, ["instance", "form"]).groupBy("pattern", "as_kind").agg((F.sum(F.coalesce(belief, others)) / (F.max("n") + 1)).alias("confidence")),
            "patterns",
        )
    return patterns.where(F.col("confidence") >= CONFIDENT).select("pattern", F.col("as_kind").alias("told"))


def discovered(table: DataFrame, keyed: DataFrame, rounds: int) -> DataFrame | None:
    """(doc_id, row, start, stop, told) of what the patterns find beyond the fixed spans; None where nothing makes a pattern."""
    contexts = saved(table.select(F.explode("contexts").alias("c")).select("c.*"), "contexts")
    seeds = saved(contexts.where("kind >= 0").groupBy("instance").agg(F.max("kind").alias("kind"), F.lit(1.0).alias("belief")), "seeds")
    known, able, found, marks, tried = seeds, None, None, None, None
    for _ in range(rounds):
        told = contexts.drop("kind").join(known, "instance").groupBy("form", "pattern").agg(F.count("*").alias("times"), F.countDistinct("instance").alias("n_seeds"), F.mode("kind", True).alias("as_kind"))
        told = told.where(F.col("n_seeds") >= MIN_SEEDS).drop("n_seeds")
        if tried is not None:  # a pattern is tried again only where more is known of it
            told = told.join(tried, "pattern", "left").where("before IS NULL OR times > before").drop("before")
            told = told if able is None else told.join(able, "pattern", "left_anti")
        told = saved(told, "told")
        if told.isEmpty():
            break
        before = told.select("pattern", F.col("times").alias("before"))
        tried = before if tried is None else tried.unionByName(before).groupBy("pattern").agg(F.max("before").alias("before"))
        more = able_patterns(told, keyed)
        if more.isEmpty():
            break
        able = more if able is None else able.unionByName(more)
        new = follow(more, keyed)
        found = new if found is None else found.unionByName(new)
        edges = contexts.select("pattern", "instance").unionByName(found.select("pattern", "instance")).join(able.select("pattern"), "pattern", "left_semi").distinct()
        marks = saved(found.where(F.col("stop") - F.col("start") >= SHORTEST).join(confident_patterns(able, edges, known), "pattern").select("doc_id", "row", "start", "stop", "told", "instance"), "marks")
        learned = marks.join(seeds, "instance", "left_anti").groupBy("instance").agg(F.max("told").alias("kind"), F.lit(LEARNED).alias("belief"))
        known = saved(seeds.unionByName(learned), "known")
    return marks


def find(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, row, base, n_fixed, spans) of each row: fixed spans, how many these are with secrets, and all with what the patterns add."""
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    keyed = keyed.select("doc_id", F.xxhash64("text").alias("row"), "text")
    table = look(keyed)
    marks = discovered(table, keyed, rounds)
    if marks is None:
        return table.select("doc_id", "row", F.array_sort("base").alias("base"), F.size("fixed").alias("n_fixed"), F.array_sort("fixed").alias("spans"))
    added = marks.groupBy("doc_id", "row").agg(F.collect_set(F.struct(F.col("told").alias("kind"), "start", "stop")).alias("more"))
    both = table.alias("t").join(added.alias("a"), (F.col("t.row") == F.col("a.row")) & F.col("t.doc_id").eqNullSafe(F.col("a.doc_id")), "left")
    spans = F.array_sort(F.concat("fixed", F.coalesce("more", F.array().cast(SPANS))))
    return both.select("t.doc_id", "t.row", F.array_sort("base").alias("base"), F.size("fixed").alias("n_fixed"), spans.alias("spans"))


def as_text(spans: str):
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s.kind + 1), s.start.cast("string"), s.stop.cast("string"))), ",")


def n_of_kind(spans: str, kind: int) -> Column:
    return F.size(F.filter(spans, lambda s: s.kind == F.lit(kind))).cast("long")


def find_private(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_secret, n_added, n_spans) of each row, over whole texts.

    The counts and the hash are of the fixed patterns' spans of these four kinds; spans, n_added and n_spans have
    those of secrets and of what the patterns found (n_added), too. A null or empty text has none; null ids and
    repeated rows are kept; other columns are ignored; no rows give no rows.
    """
    counts = [n_of_kind("base", k).alias(f"n_{name}") for k, name in enumerate(KINDS[:N_BASE])]
    secrets = (F.col("n_fixed") - F.size("base")).cast("long").alias("n_secret")
    added = (F.size("spans") - F.col("n_fixed")).cast("long").alias("n_added")
    return find(docs).select("doc_id", *counts, F.sha2(as_text("base"), 256).alias("base_sha256"), as_text("spans").alias("spans"), secrets, added, F.size("spans").cast("long").alias("n_spans"))


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with each span of a text replaced by its kind in brackets, and n_chars (where it exists) counted anew."""
    names = docs.columns
    spans = find(docs).select("doc_id", "row", "spans").where(F.size("spans") > 0).dropDuplicates(["doc_id", "row"])
    keyed = docs.withColumn("__row", F.xxhash64(F.coalesce(F.col("text"), F.lit("")))).alias("d")
    joined = keyed.join(spans.alias("s"), (F.col("__row") == F.col("s.row")) & F.col("d.doc_id").cast("long").eqNullSafe(F.col("s.doc_id")), "left")
    ordered = F.array_sort(F.transform("s.spans", lambda s: F.struct(s.start.alias("start"), s.stop.alias("stop"), s.kind.alias("kind"))))
    kinds = F.array(*[F.lit(f"[{name.upper()}]") for name in KINDS])
    # Left to right; a span that begins inside the one before only makes that one longer.
    step = lambda a, s: F.struct(
        F.concat(a.out, F.when(s.start >= a.at, F.concat(F.substr("d.text", a.at + 1, s.start - a.at), F.element_at(kinds, s.kind + 1))).otherwise(F.lit(""))).alias("out"),
        F.greatest(a.at, s.stop).alias("at"),
    )
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    text = F.aggregate(ordered, start, step, lambda a: F.concat(a.out, F.substr("d.text", a.at + 1)))
    out = joined.select(*[F.col(f"d.{n}") for n in names if n != "text"], F.when(F.col("s.spans").isNull(), F.col("d.text")).otherwise(text).alias("text"))
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*names)


def op7_private(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_private(documents(spark, sf_dir))
