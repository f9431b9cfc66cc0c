"""Exact piece counts under a unigram vocabulary, without keeping pieces.

An Aho-Corasick automaton finds every vocabulary piece in a word; dynamic programming over positions carries the best
score and the number of pieces of the best path, so no path is kept or walked back. Ties are settled as the tokenizer settles them: a path replaces
another that ends at the same position only if its score is higher, and paths are tried by their last piece's start,
earliest first. A character that is no piece by itself may be an unknown piece (score: the least of the vocabulary less
10); adjacent unknown pieces are one, or count by their UTF-8 bytes where the vocabulary has all byte pieces.

Words are what the tokenizer splits at spaces, each begun by U+2581; pieces never cross words, so each process keeps
the results of a bounded number of words.

Defined cases: a null or empty text has no pieces; repeated rows are counted each; extra columns are ignored; an empty
table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.scratch import map_batches

SPACE = "▁"
UNKNOWN_PENALTY = 10.0
CACHE_WORDS = 250_000


class PieceCounter:
    _open: dict[tuple, PieceCounter] = {}

    def __init__(self, vocabulary: list[tuple[str, float]], unknown: int, byte_fallback: bool):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        last = {piece: score for piece, score in vocabulary}
        for piece, score in last.items():
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown_score = min(s for _, s in vocabulary) - UNKNOWN_PENALTY
        self.pieces = last
        self.by_bytes = byte_fallback and all(f"<0x{b:02X}>" in last for b in range(256))
        self.known: dict[str, tuple[int, float]] = {}

    @classmethod
    def of_sentencepiece(cls, path: str) -> PieceCounter:
        key = (path,)
        if key not in cls._open:
            cls._open[key] = cls(*unigram_vocabulary(path))
        return cls._open[key]

    def count(self, word: str) -> tuple[int, float]:
        """(pieces, score) of the best path: each position carries the score and the pieces of the best path to it.

        ``open_at`` is where the run of unknown pieces at the end of that path begins (-1: there is none); ``pieces``
        counts what comes before the run, which is counted as a whole once a known piece or the end closes it.
        """
        n = len(word)
        score = [-math.inf] * (n + 1)
        score[0] = 0.0
        pieces, open_at = [0] * (n + 1), [-1] * (n + 1)
        ends: list[list[tuple[int, float]] | None] = [None] * n  # by start: (end, score), shortest first
        for end, (length, s) in self.automaton.iter(word):
            start = end + 1 - length
            if ends[start] is None:
                ends[start] = []
            ends[start].append((end + 1, s))
        for i in range(n):
            here, run = score[i], open_at[i]
            single = False
            if ends[i]:
                closed = pieces[i] + 1 + (self.unknown_pieces(word[run:i]) if run >= 0 else 0)
                for e, s in ends[i]:
                    if here + s > score[e]:
                        score[e], pieces[e], open_at[e] = here + s, closed, -1
                    if e == i + 1:
                        single = True
            if not single and here + self.unknown_score > score[i + 1]:
                score[i + 1], pieces[i + 1], open_at[i + 1] = here + self.unknown_score, pieces[i], i if run < 0 else run
        last = open_at[n]
        return pieces[n] + (self.unknown_pieces(word[last:n]) if last >= 0 else 0), score[n]

    def unknown_pieces(self, run: str) -> int:
        """Adjacent unknown pieces are one, or as many as their bytes."""
        return 1 if run in self.pieces or not self.by_bytes else len(run.encode("utf-8", "replace"))

    def counts(self, texts: list[str | None]) -> list[tuple[int, float]]:
        out = []
        known = self.known
        for text in texts:
            pieces, total = 0, 0.0
            plain = (text or "").replace(SPACE, " ")
            # a text that begins with a space needs no space put before it
            for word in plain.removeprefix(" ").split(" ") if plain else ():
                got = known.get(word)
                if got is None:
                    got = self.count(SPACE + word)
                    if len(known) >= CACHE_WORDS:
                        known.clear()
                    known[word] = got
                pieces += got[0]
                total += got[1]
            out.append((pieces, total))
        return out


def unigram_vocabulary(path: str) -> tuple[list[tuple[str, float]], int, bool]:
    """(pieces with scores, id of the unknown piece, byte fallback) of a sentencepiece file, for a unigram model.

    Scores of a unigram model are kept. A file of merges has ranks for scores (0, -1, ...); there the piece of rank r
    gets the log probability of Zipf's law, -log(r + 1), less a constant; other pieces (control, bytes) get the least.
    """
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    raw = [m.get_score(i) for i in range(m.get_piece_size())]
    plain = [not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i)) for i in range(len(raw))]
    ranks = sorted((-s for s, p in zip(raw, plain) if p))
    if ranks and ranks[0] == 0 and all(r == int(r) for r in ranks):
        whole = math.log(sum(1 / (r + 1) for r in ranks))
        least = -math.log(ranks[-1] + 1) - whole
        raw = [-math.log(1 - s) - whole if p else least for s, p in zip(raw, plain)]
    return [(m.id_to_piece(i), s) for i, s in enumerate(raw)], m.unk_id(), any(m.is_byte(i) for i in range(len(raw)))


def count_pieces(docs: DataFrame, model: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Returns (doc_id long, n_pieces long, path_score double) for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = PieceCounter.of_sentencepiece(model)
        for batch in batches:
            got = np.array(counter.counts(batch.column(1).to_pylist()), float).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got[:, 0].astype(np.int64)), pa.array(got[:, 1].copy())], ["doc_id", "n_pieces", "path_score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return map_batches(rows, run, "doc_id long, n_pieces long, path_score double")


def piece_model() -> str:
    """The public vocabulary that the query uses; the operator takes any path."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")
