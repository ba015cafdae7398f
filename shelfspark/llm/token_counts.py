"""Word-piece counts by a linear longest-match automaton.

The vocabulary is a trie whose nodes carry a failure link and the number of tokens popped on
following it. Greedy longest-match pieces of a word are then counted in one pass over its
symbols, without building any piece.
"""

from __future__ import annotations

from collections import deque

from pyspark.sql import DataFrame

from .bpe import Bpe, read_spec
from .common import Remembered, kept, map_rows, own_columns


class PieceCounter:
    """Counts greedy longest-match pieces over sequences of symbols; all arrays are indexed by node."""

    def __init__(self, pieces: list[tuple[str, ...]]):
        self.next: list[dict[str, int]] = [{}]
        ends = [False]
        for piece in pieces:
            at = 0
            for s in piece:
                to = self.next[at].get(s)
                if to is None:
                    to = self.next[at][s] = len(self.next)
                    self.next.append({})
                    ends.append(False)
                at = to
            ends[at] = at != 0
        self.fail = [-1] * len(self.next)
        self.popped = [0] * len(self.next)
        queue = deque([0])
        while queue:
            u = queue.popleft()
            for s, v in self.next[u].items():
                queue.append(v)
                if ends[v]:
                    self.fail[v], self.popped[v] = 0, 1
                    continue
                n, z = self.popped[u], self.fail[u]
                while z >= 0 and s not in self.next[z]:
                    n, z = n + self.popped[z], self.fail[z]
                if z >= 0:
                    self.fail[v], self.popped[v] = self.next[z][s], n

    def count(self, symbols) -> int:
        """Pieces of one word; a word with a symbol that no piece sequence covers is one unknown token."""
        u = n = 0
        for s in symbols:
            while s not in self.next[u]:
                if self.fail[u] < 0:
                    return 1
                n += self.popped[u]
                u = self.fail[u]
            u = self.next[u][s]
        while u:
            if self.fail[u] < 0:
                return 1
            n += self.popped[u]
            u = self.fail[u]
        return n


class TextCounter:
    """Piece counts of texts; words are normalized and split as the vocabulary's tokenizer does."""

    def __init__(self, spec: str, most: int = 300_000):
        self.bpe = Bpe(spec)
        self.pieces = PieceCounter([tuple(self.bpe._symbols(t)) for t in self.bpe.vocab])
        self.counts = Remembered(self._word, most)

    def symbols(self, word: str) -> list[str]:
        s = [self.bpe.letters[b] for b in word.encode()]
        s[-1] += self.bpe.end
        return s

    def _word(self, word: str) -> int:
        return self.pieces.count(self.symbols(word))

    def text(self, text: str | None) -> tuple[int, int]:
        """(tokens, words); a special token is one token."""
        n = words = 0
        parts = self.bpe.cut.split(text or "") if self.bpe.cut else [text or ""]
        for part in parts:
            if part in self.bpe.special:
                n += 1
            elif part:
                found = self.bpe.split(part)
                words += len(found)
                n += sum(map(self.counts.__getitem__, found))
        return n, words


def count_tokens(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_words, n_tokens for every row; null and empty texts count 0; rows repeat as they come."""
    spec = docs.sparkSession.sparkContext.broadcast(read_spec(path))

    def factory():
        counter = kept(TextCounter, spec.value)

        def run(rows):
            got = [counter.text(t) for t in rows["text"]]
            return {"doc_id": rows["doc_id"], "n_words": [x[1] for x in got], "n_tokens": [x[0] for x in got]}

        return run

    d = own_columns(docs, "doc_id", "text")
    return map_rows(d.select(d.doc_id.cast("long"), "text"), factory, "doc_id long, n_words long, n_tokens long")
