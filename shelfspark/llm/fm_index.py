"""FM-index over word sequences: a wavelet matrix under the Burrows-Wheeler transform, searched backwards for many patterns at once, and one over the documents of the suffixes."""

from __future__ import annotations

import numpy as np

ONE = np.uint64(1)


class WaveletMatrix:
    """Ranks and least symbols in a sequence: per level one bit a symbol, in 64-bit words with a running count a word."""

    def __init__(self, s: np.ndarray, top: int):
        self.n, self.levels = len(s), max(1, int(top).bit_length())
        self.words, self.counts, self.zeros = [], [], []
        for level in range(self.levels - 1, -1, -1):
            bit = (s >> level) & 1
            padded = np.zeros((len(s) // 64 + 1) * 64, dtype=np.uint8)
            padded[: len(s)] = bit
            words = np.packbits(padded, bitorder="little").view(np.uint64)
            self.words.append(words)
            self.counts.append(np.concatenate(([0], np.cumsum(np.bitwise_count(words), dtype=np.int64)))[:-1].astype(np.int32))
            s = np.concatenate((s[bit == 0], s[bit == 1]))
            self.zeros.append(int((bit == 0).sum()))

    def ones(self, level: int, i: np.ndarray) -> np.ndarray:
        w = i >> 6
        mask = (ONE << (i & 63).astype(np.uint64)) - ONE
        return self.counts[level][w] + np.bitwise_count(self.words[level][w] & mask)

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often c occurs before i, for arrays of both."""
        start = np.zeros(len(c), dtype=np.int64)
        for k in range(self.levels):
            bit = ((c >> (self.levels - 1 - k)) & 1).astype(bool)
            a, b = self.ones(k, start), self.ones(k, i)
            start = np.where(bit, self.zeros[k] + a, start - a)
            i = np.where(bit, self.zeros[k] + b, i - b)
        return i - start

    def least(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The least symbol in each interval; none may be empty."""
        out = np.zeros(len(low), dtype=np.int64)
        for k in range(self.levels):
            a, b = self.ones(k, low), self.ones(k, high)
            bit = high - b == low - a  # no zero in the interval
            low = np.where(bit, self.zeros[k] + a, low - a)
            high = np.where(bit, self.zeros[k] + b, high - b)
            out = out << 1 | bit
        return out


class FmIndex:
    """Of several word sequences, each of one document; matches never cross a sequence's ends.

    It holds the two wavelet matrices, the counts of words before each word, and the words' hashes;
    neither the text nor suffix positions. Suffixes are sorted by their first ``depth`` words or
    more, which is all that patterns of up to that length need.
    """

    def __init__(self, sequences: list[np.ndarray], docs: np.ndarray, depth: int):
        """docs: a number of each sequence's document, in the documents' order, from 0."""
        lens = np.array([len(x) for x in sequences], dtype=np.int64)
        start = np.concatenate(([0], np.cumsum(lens + 1)))[:-1]
        self.vocab, codes = np.unique(np.concatenate(sequences), return_inverse=True)
        n = int(lens.sum() + len(lens))
        text = np.zeros(n, dtype=np.int64)  # 0 ends a sequence
        inside = np.ones(n, dtype=bool)
        inside[start + lens] = False
        text[inside] = codes.ravel() + 1
        rank, k = text, 1
        order = np.argsort(rank, kind="stable")
        while k < depth:
            after = np.zeros(n, dtype=np.int64)
            after[:-k] = rank[k:] + 1 if n > k else 0
            both = rank * (n + 2) + after
            order = np.argsort(both, kind="stable")
            s = both[order]
            rank = np.empty(n, dtype=np.int64)
            rank[order] = np.cumsum(np.concatenate(([0], s[1:] != s[:-1])))
            k *= 2
        self.n, self.depth = n, depth
        self.bwt = WaveletMatrix(text[order - 1], len(self.vocab))  # position -1 is the last end
        self.docs = WaveletMatrix(np.repeat(docs, lens + 1)[order], int(docs.max(initial=0)))
        self.first = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=len(self.vocab) + 1))))

    def codes(self, words: np.ndarray) -> np.ndarray:
        """Numbers of words in the index; 0, which no word has, for those that it doesn't hold."""
        at = np.minimum(np.searchsorted(self.vocab, words), len(self.vocab) - 1)
        return np.where(self.vocab[at] == words, at + 1, 0)

    def earliest(self, codes: np.ndarray, ends: np.ndarray, length: int, before: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Matching statistics of streamed codes at these ends (exclusive), up to ``length``: how many words up to there
        occur together in a document of the index, and the least document with that match; 0 and -1 without one.

        ``before``: for each end the number of its own document; only documents with smaller numbers count then, so a text that
        is in the index itself is held against the texts before it, not against itself."""
        size, doc = np.zeros(len(ends), dtype=np.int64), np.full(len(ends), -1, dtype=np.int64)
        alive = np.arange(len(ends))
        low, high = np.zeros(len(ends), dtype=np.int64), np.full(len(ends), self.n, dtype=np.int64)
        for j in range(1, length + 1):
            c = codes[ends[alive] - j]
            a = self.first[c] + self.bwt.rank(c, low[alive])
            b = self.first[c] + self.bwt.rank(c, high[alive])
            on = (b > a) & (c > 0)
            # as many places as without the new word are the same places, in the same documents
            fewer = np.flatnonzero(on & (b - a < high[alive] - low[alive]))
            least = doc[alive]
            least[fewer] = self.docs.least(a[fewer], b[fewer])
            if before is not None:
                on &= least < before[alive]
            alive = alive[on]
            low[alive], high[alive], size[alive], doc[alive] = a[on], b[on], j, least[on]
        return size, doc
