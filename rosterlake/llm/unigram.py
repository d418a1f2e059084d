"""Count-only Viterbi over a unigram vocabulary.

An Aho-Corasick automaton enumerates the vocabulary pieces in a word; dynamic programming carries the
best score and the number of pieces to each place, without back pointers. The rules are those of the
unigram tokenizer of the ``tokenizers`` library: words are cut at Unicode white space and get the word
mark in front; of equally good ways the one whose last piece is longest stays; where no single
character matches, that character is unknown at the lowest score less 10, and unknown neighbours make
one piece. Words do not influence each other, so words are counted once for each task and cache.

Defined results: null and empty texts have no tokens; repeated rows are counted each; an empty table
gives an empty result. No text is cut: a word of any length is one automaton pass.
"""

from __future__ import annotations

import functools
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import holding, map_batches, text_rows

MARK = "\u2581"
#: Unicode White_Space; Python's own split also takes U+001C to U+001F.
SPACE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
ODD = re.compile("[\x1c-\x1f]")
UNKNOWN_PENALTY = 10.0


class Counter:
    """pieces: (piece, score), in the vocabulary's order; of pieces listed twice the last counts."""

    def __init__(self, pieces: list[tuple[str, float]], limit: int = 500_000):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min(s for _, s in pieces) - UNKNOWN_PENALTY
        self.single = {piece for piece, _ in pieces if len(piece) == 1}
        self.limit, self.counts = limit, {}

    def word(self, word: str) -> int:
        """Number of pieces of one word, its mark included."""
        n = len(word)
        if self.single.issuperset(word):  # nothing is unknown: matches come by end, the longest first
            top, least = [0.0] + [float("-inf")] * n, [0] * (n + 1)
            for last, (size, score) in self.automaton.iter(word):
                start = last + 1 - size
                total = top[start] + score
                if total > top[last + 1]:
                    top[last + 1], least[last + 1] = total, least[start] + 1
            return least[n]
        ends: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]
        for last, (size, score) in self.automaton.iter(word):
            ends[last + 1].append((size, score))
        best, count, loose = [0.0] * (n + 1), [0] * (n + 1), [False] * (n + 1)  # loose: the last piece is unknown
        for end in range(1, n + 1):
            top, pieces, open_ = None, 0, False
            single = False
            for size, score in sorted(ends[end], reverse=True):  # longest first: the earliest start wins ties
                total = best[end - size] + score
                single = single or size == 1
                if top is None or total > top:
                    top, pieces, open_ = total, count[end - size] + 1, False
            if not single:
                total = best[end - 1] + self.unknown
                if top is None or total > top:
                    top, pieces, open_ = total, count[end - 1] + (not loose[end - 1]), True
            best[end], count[end], loose[end] = top, pieces, open_
        return count[n]

    def text(self, text: str) -> tuple[int, int]:
        """(words, tokens)."""
        words = [w for w in SPACE.split(text) if w] if ODD.search(text) else text.split()
        counts = self.counts
        try:
            return len(words), sum(map(counts.__getitem__, words))
        except KeyError:
            if len(counts) > self.limit:
                counts.clear()
            for w in set(words).difference(counts):
                counts[w] = self.word(MARK + w)
            return len(words), sum(map(counts.__getitem__, words))


def vocabulary(model: str) -> list[tuple[str, float]]:
    """Pieces and scores of a ``sentencepiece`` model file; control pieces are left out of matching by name."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=model)
    return [(m.id_to_piece(k), m.get_score(k)) for k in range(m.get_piece_size()) if not (m.is_unknown(k) or m.is_control(k) or m.is_byte(k))]


@functools.lru_cache(maxsize=2)
def counter(model: str) -> Counter:
    """One automaton for each Python worker."""
    return Counter(vocabulary(model))


def token_counts(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_words, n_tokens)`` for every whole text."""
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("n_words", T.LongType()), T.StructField("n_tokens", T.LongType())])

    def count(batch: pa.RecordBatch) -> list:
        holding("pieces", counter.cache_clear)
        own = counter(model)
        got = [own.text(t) for t in batch.column(1).to_pylist()]
        return [batch.column(0), [w for w, _ in got], [n for _, n in got]]

    return map_batches(text_rows(docs, id_col, text_col), count, schema)
