"""Token counts of a unigram vocabulary without making the tokens.

An Aho-Corasick automaton lists every vocabulary piece that ends at each character; dynamic programming keeps
the best score and the number of pieces on its path. Tie rules are those of the tokenizers library's Unigram
model: among equal scores the longest piece that ends there stays; an unknown character costs the lowest score
less 10, only where no piece of that one character exists, runs of unknown characters are one piece, and with
byte fallback such a run counts one token for each UTF-8 byte.

No piece of the vocabulary holds the word mark after another character, so a best path passes every
boundary before a run of blanks, and a text's count is the sum over its units, remembered by each worker.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import documents, id_and_text, map_batches
from .tokenizing import Remembered, vocabulary

MARK = "▁"
UNK_PENALTY = 10.0


class Unigram:
    """Pieces and scores of a SentencePiece file, used as a unigram vocabulary."""

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.vocab = [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())]
        self.unk = model.unk_id()
        self.automaton = ahocorasick.Automaton()
        for i, (piece, score) in enumerate(self.vocab):
            if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)):
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min(score for _, score in self.vocab) - UNK_PENALTY
        self.splits = not any(MARK in piece.lstrip(MARK) for piece, _ in self.vocab)
        self.known = Remembered(self.viterbi, 500_000)

    def viterbi(self, unit: str) -> int:
        """Tokens of a string whose blanks are already marks: with the best score that ends at a character goes the count of its pieces."""
        n = len(unit)
        best, count, single, at = [0.0] + [None] * n, [0] * (n + 1), [False] * (n + 1), 0

        def unknown_at(end: int) -> None:
            if not single[end]:
                score = best[end - 1] + self.unknown
                if best[end] is None or score > best[end]:
                    best[end], count[end] = score, count[end - 1] + len(unit[end - 1].encode())

        for last, (size, score) in self.automaton.iter(unit):
            end = last + 1
            while at < end - 1:  # what ends before is settled by now
                at += 1
                unknown_at(at)
            if size == 1:
                single[end] = True
            total = best[end - size] + score
            if best[end] is None or total > best[end]:
                best[end], count[end] = total, count[end - size] + 1
        while at < n:
            at += 1
            unknown_at(at)
        return count[n]

    def tokens(self, text: str) -> int:
        """Blanks become marks, and a text that isn't empty gets one in front."""
        if not text:
            return 0
        marked = MARK + text.replace(" ", MARK)
        if not self.splits:
            return self.viterbi(marked)
        parts = marked.replace(MARK, " " + MARK).split(" ")[1:]
        if MARK in parts:  # several blanks side by side belong to one unit
            units, run = [], ""
            for part in parts:
                run += part
                if part != MARK:
                    units.append(run)
                    run = ""
            parts = units + [run] * bool(run)
        return sum(map(self.known.__getitem__, parts))


@functools.cache
def unigram(path: str) -> Unigram:
    return Unigram(path)


def count_tokens(docs: DataFrame, model: str) -> DataFrame:
    """(doc_id, n_chars, n_tokens) of each row, over whole texts.

    A null or empty text has 0 tokens; rows with null ids and repeated rows are kept; other columns are
    ignored; no rows give no rows.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = unigram(model).tokens
        for batch in batches:
            texts = batch.column(1).to_pylist()
            columns = [batch.column(0), pa.array(map(len, texts), pa.int64()), pa.array(map(tokens, texts), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_chars", "n_tokens"])

    return map_batches(id_and_text(docs), counted, "doc_id long, n_chars long, n_tokens long")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(documents(spark, sf_dir), vocabulary("piece_bpe_32k.model"))
