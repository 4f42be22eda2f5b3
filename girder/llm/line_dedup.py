"""Lines that repeat across documents, kept only in the first document that holds them.

Two Bloom filters, of the hashes seen once and of those seen again, find the lines that may repeat (screening).
Only those are shuffled, as 128 bits of a cryptographic hash of the whole line, to confirm that they do and to
choose the smallest document; the lines of a batch of documents go as one row, so that a line that a third of all
documents hold has as many rows as there are batches. What to drop then meets the texts, which are exchanged once
for both steps.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, map_batches, pieces, text_bytes
from .hashing import U, word_hashes
from .lines import line_spans, n_chars, stripped
from .screening import BloomPair, asked, may_repeat

#: Bytes of text whose repeats a task settles by itself.
GROUP_BYTES = 4 << 20
#: Null ids are one document, the last; a real id of this value counts as the same.
LAST_ID = (1 << 63) - 1
SUSPECTS = "high long, low long, holders array<struct<owner: long, row: long, line: long>>"
RESULT = "doc_id long, n_lines long, n_dropped long, kept_sha256 string, kept string"


def keys_of(raw: np.ndarray, offsets: np.ndarray, least: int) -> tuple[np.ndarray, ...]:
    """(text, number in the text, hash) of the first line of each key of ``least`` code points or more, per text."""
    text, starts, ends = line_spans(raw, offsets)
    number = np.arange(len(text)) - np.searchsorted(text, text)
    starts, ends = stripped(raw, starts, ends)
    long = np.flatnonzero(n_chars(raw, starts, ends) >= least)
    text, number, hashes = text[long], number[long], word_hashes(raw, starts[long], ends[long])
    order = np.lexsort((number, hashes, text))
    text, number, hashes = text[order], number[order], hashes[order]
    new = np.append(True, (text[1:] != text[:-1]) | (hashes[1:] != hashes[:-1]))[: len(text)]
    return text[new], number[new], hashes[new]


def key_at(line: bytes) -> bytes:
    return line.strip(b" \t\n\v\f\r").lower()  # of bytes, lower() changes A-Z alone


def drop_repeated_lines(docs: DataFrame, least: int = 10) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_sha256, kept) of each row.

    A line's key is the line without blanks and the bytes 9 to 13 at both ends, A-Z in lower case. Keys of
    ``least`` code points or more that several documents hold lose all their lines but those in the smallest
    document. A null or empty text is one empty line. Rows with one id are one document; null ids are one document,
    the last. Repeated rows each give a row; other columns are ignored; no rows give no rows.
    """
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    owner = F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID))
    keyed = docs.select(owner.alias("owner"), F.xxhash64(text).alias("row"), text.alias("text"), F.col("doc_id").cast("long").alias("id"))
    breaks = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1
    n_lines = docs.agg(F.coalesce(F.sum(F.coalesce(breaks, F.lit(1))), F.lit(0))).first()[0]

    def ask(batches: Iterator[pa.RecordBatch], slices: int) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = text_bytes(batch.column(2))
            owners, rows = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for lo, hi in pieces(offsets, GROUP_BYTES):
                t, number, hashes = keys_of(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], least)
                yield from asked(owners[lo + t], rows[lo + t], hashes, number, slices)

    suspects = may_repeat(keyed.drop("id"), ask, n_lines, BloomPair, "lines")

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[bytes, list[tuple]] = defaultdict(list)
            for o, r, raw, tags in zip(*(batch.column(k).to_pylist() for k in (0, 1, 2, 4)), strict=True):
                lines = raw.split(b"\n")
                for k in tags:
                    found[hashlib.blake2b(key_at(lines[k]), digest_size=16).digest()].append((o, r, k))
            high, low = np.frombuffer(b"".join(found), "<i8").reshape(-1, 2).T
            holders = [[{"owner": o, "row": r, "line": k} for o, r, k in hs] for hs in found.values()]
            kind = pa.list_(pa.struct([("owner", pa.int64()), ("row", pa.int64()), ("line", pa.int64())]))
            yield pa.RecordBatch.from_arrays([pa.array(high), pa.array(low), pa.array(holders, kind)], names=["high", "low", "holders"])

    # Both joins with the texts read one exchange of them, and both uses of the lines one of theirs (hence explode_outer and whole
    # structs: a filter or a part of them would go below one of the two). Merge joins: the same plan at every size.
    texts = keyed.join(suspects.hint("merge"), ["owner", "row"]).select("owner", "row", "text", "id", "tags")
    lines = map_batches(texts, confirm, SUSPECTS).repartition("high", "low")
    repeated = lines.groupBy("high", "low").agg(F.min(F.array_min("holders")).alias("a"), F.max(F.array_max("holders")).alias("z"))
    repeated = repeated.where("a.owner < z.owner").select("high", "low", F.col("a.owner").alias("keeper"))
    gone = lines.join(repeated.hint("merge"), ["high", "low"]).select("keeper", F.explode_outer("holders").alias("h")).where("h.owner > keeper")
    drops = gone.groupBy("h.owner", "h.row").agg(F.collect_list("h.line").alias("lines"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for raw, doc_id, numbers in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4)), strict=True):
                own = raw.split(b"\n")
                keys = {key_at(own[k]) for k in numbers or ()}
                kept = [line for line in own if key_at(line) not in keys] if keys else own
                data = b"\n".join(kept)
                rows.append((doc_id, len(own), len(own) - len(kept), hashlib.sha256(data).hexdigest(), data.decode()))
            kinds = [pa.int64()] * 3 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [()] * 5, kinds, strict=True)], names=[c.split()[0] for c in RESULT.split(", ")])

    return map_batches(keyed.join(drops.hint("merge"), ["owner", "row"], "left").select("owner", "row", "text", "id", "lines"), cut, RESULT)


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_repeated_lines(documents(spark, sf_dir)).drop("kept")


SQL = r"""
WITH split AS (
  SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS k FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents)
),
keyed AS (
  SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM split
),
repeated AS (SELECT key, min(doc_id) AS keeper FROM keyed WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1),
told AS (SELECT keyed.*, keeper IS NOT NULL AND doc_id > keeper AS gone FROM keyed LEFT JOIN repeated USING (key))
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (NOT gone), '')) AS kept_sha256
FROM told GROUP BY doc_id
"""
