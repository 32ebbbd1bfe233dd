"""Token counts by a linear longest-match automaton (operator 3).

Greedy longest match takes the longest vocabulary entry at each point of a word. The trie of the vocabulary is given failure links, and each link the
number of pieces that it pops, so one pass over the characters gives the number of pieces, and no piece is ever built or looked at twice.

A word is a run of bytes other than space and the controls 9-13. The marker stands before it, so entries with the marker match at its start and the others
after it. A word that the vocabulary cannot cover is one unknown piece. Defined results: null or blank texts have no words and no pieces;
repeated rows are counted as often as they occur; only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from specledger.llm.words import words

MARKER = "▁"
REMEMBERED = 300_000
COUNTS = StructType([StructField(n, LongType()) for n in ("n_words", "n_pieces", "n_unknown")])


class Automaton:
    """``next[node]`` by character; ``link`` of a node (-1: none) and ``popped``, the pieces that the link gives up."""

    def __init__(self, vocabulary: Iterable[str]):
        self.next: list[dict[str, int]] = [{}]
        ends = [False]
        for entry in vocabulary:
            node = 0
            for char in entry:
                child = self.next[node].get(char)
                if child is None:
                    child = self.next[node][char] = len(self.next)
                    self.next.append({})
                    ends.append(False)
                node = child
            ends[node] = node != 0
        self.link = [-1] * len(self.next)
        self.popped = [0] * len(self.next)
        level = [0]
        while level:
            below = []
            for node in level:
                for char, child in self.next[node].items():
                    below.append(child)
                    if ends[child]:
                        self.link[child], self.popped[child] = 0, 1
                        continue
                    # What the parent's link leaves must go on with this character; else more is given up.
                    at, given = self.link[node], self.popped[node]
                    while at >= 0 and char not in self.next[at]:
                        at, given = self.link[at], given + self.popped[at]
                    if at >= 0:
                        self.link[child], self.popped[child] = self.next[at][char], given
            level = below

    def pieces(self, word: str) -> int:
        """Number of pieces of the greedy longest match, 0 if there is none."""
        node = count = 0
        for char in word:
            child = self.next[node].get(char)
            while child is None:
                link = self.link[node]
                if link < 0:
                    return 0
                count += self.popped[node]
                node = link
                child = self.next[node].get(char)
            node = child
        while node > 0:
            count += self.popped[node]
            node = self.link[node]
        return count if node == 0 else 0


class WordLengths(dict):
    """Pieces per word (0: unknown), remembered for frequent words; a full memory starts anew."""

    def __init__(self, automaton: Automaton):
        super().__init__()
        self.automaton = automaton

    def __missing__(self, word: bytes) -> int:
        found = self.automaton.pieces(MARKER + word.decode("utf-8", "surrogatepass"))
        if len(word) <= 64:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = found
        return found


@lru_cache(maxsize=2)
def word_lengths(path: str) -> WordLengths:
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    normal = [model.id_to_piece(i) for i in range(model.get_piece_size())
              if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    return WordLengths(Automaton(normal))


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def count_pieces(text: str | None, lengths: WordLengths) -> tuple[int, int, int]:
    found = list(map(lengths.__getitem__, words(text)))
    unknown = found.count(0)
    return len(found), sum(found) + unknown, unknown


def token_counts(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """``doc_id``, ``n_words``, ``n_pieces`` and ``n_unknown`` of every row.

    ``vocabulary`` is the path of a vocabulary file on the executors; without it they look up the installed public one.
    """

    @F.pandas_udf(COUNTS)
    def counts(texts: pd.Series) -> pd.DataFrame:
        lengths = word_lengths(vocabulary or default_vocabulary())
        return pd.DataFrame([count_pieces(t, lengths) for t in texts], columns=COUNTS.names)

    return docs.select("doc_id", counts("text").alias("c")).select("doc_id", "c.*")
