"""Token counts by a linear longest-match automaton.

Greedy longest-match word pieces are counted without building them: a trie of the vocabulary carries, for every
node, a failure link to the node reached after the pieces it stands for are popped, and the number of those pieces.
A word is read once; each failure adds the precomputed count. A word that the vocabulary cannot spell is one token.

The vocabulary marks word ends; words are lower-cased runs of letters, single digits, or runs of other signs, spelled
in the visible stand-ins of UTF-8 bytes. Defined cases: a null text has no words and no tokens; repeated rows are
counted each on their own; extra columns are ignored.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardspark.llm.common import arrow_map, table

WORD = re.compile(r"[^\W\d_]+|\d|(?:[^\w\s]|_)+")
WORD_END = "</w>"
_END = "￿"
#: Counts of this many words are remembered by each Python worker; then it starts anew.
REMEMBERED = 300_000


def byte_letters() -> dict[int, str]:
    """Visible stand-ins of bytes: printable Latin-1 characters stand for themselves, the others follow from 256 on."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(kept)]
    return {b: chr(b) for b in kept} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Automaton:
    """pieces: vocabulary; each ends inside a word or, with ``end`` appended, at the end of one."""

    def __init__(self, pieces: list[str], end: str = WORD_END):
        self.next: list[dict[str, int]] = [{}]
        piece_at = [False]
        for piece in pieces:
            if piece.endswith(end) and len(piece) > len(end):
                piece = piece[: -len(end)] + _END
            node = 0
            for c in piece:
                if c not in self.next[node]:
                    self.next[node][c] = len(self.next)
                    self.next.append({})
                    piece_at.append(False)
                node = self.next[node][c]
            piece_at[node] = piece != ""
        self.fail: list[int] = [-1] * len(self.next)  # -1: the text read so far cannot be spelled
        self.popped: list[int] = [0] * len(self.next)
        level = [0]
        while level:
            below = []
            for parent in level:
                for c, node in self.next[parent].items():
                    below.append(node)
                    if piece_at[node]:
                        self.fail[node], self.popped[node] = 0, 1
                        continue
                    n, at = self.popped[parent], self.fail[parent]
                    while at >= 0 and c not in self.next[at]:
                        n, at = n + self.popped[at], self.fail[at]
                    if at >= 0:
                        self.fail[node], self.popped[node] = self.next[at][c], n
            level = below

    def count(self, word: str) -> int:
        """Pieces of a word (1 if it cannot be spelled), in time linear in its length."""
        node, n = 0, 0
        for c in word + _END:
            while c not in self.next[node]:
                if self.fail[node] < 0:
                    return 1
                n, node = n + self.popped[node], self.fail[node]
            node = self.next[node][c]
        while node:
            if self.fail[node] < 0:
                return 1
            n, node = n + self.popped[node], self.fail[node]
        return n


class Counts(dict):
    """Remembered counts by word; a missing word is run through the automaton."""

    def __init__(self, automaton: Automaton):
        super().__init__()
        self.automaton, self.letters = automaton, byte_letters()

    def __missing__(self, word: str) -> int:
        n = self.automaton.count("".join(map(self.letters.__getitem__, word.encode())))
        if len(word) <= 64:
            self[word] = n
        return n

    def of(self, text: str | None) -> tuple[int, int]:
        words = WORD.findall((text or "").lower())
        if len(self) > REMEMBERED:
            self.clear()
        return len(words), sum(map(self.__getitem__, words))


def vocabulary_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def load(path: str) -> Counts:
    with open(path, encoding="utf-8") as f:
        model = json.load(f)
    special = {t["content"] for t in model.get("added_tokens", ())}
    return Counts(Automaton([p for p in model["model"]["vocab"] if p not in special]))


def count_tokens(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id, number of words and of greedy word pieces of every whole text; no shuffle."""
    vocabulary = vocabulary or vocabulary_file()
    kept: dict[str, Counts] = {}

    def rows(x: dict) -> dict:
        counts = kept["counts"] if kept else kept.setdefault("counts", load(vocabulary))
        found = [counts.of(t) for t in x["text"]]
        return {"doc_id": x["doc_id"], "n_words": [f[0] for f in found], "n_tokens": [f[1] for f in found]}

    return arrow_map(docs.select(F.col("doc_id").cast("long"), "text"), "doc_id long, n_words long, n_tokens long", rows)


def op5_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents", "doc_id", "text"))
