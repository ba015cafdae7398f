"""BPE encoding and decoding with forced-boundary splitting.

Two symbols that are never neighbours inside any vocabulary token can never be merged over,
so a cut between them is certain. Fragments between such cuts are encoded independently (and
remembered), then concatenated. Pre-tokenization, special tokens and normalization follow the
tokenizer file: NFC, runs of white space to one space, lower case, then its split pattern.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from array import array
from collections.abc import Iterable

import regex
from pyspark.sql import DataFrame

from .common import Remembered, kept, map_rows, own_columns

#: The White_Space property, which the tokenizer's \s means.
SPACE = r"\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def byte_letters() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: itself where it prints, else the next free code point from 256."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    free = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(free)) for b in range(256)]


class Bpe:
    """A byte-level BPE with word ends, from the JSON of a tokenizer file."""

    def __init__(self, spec: str, most_cached: int = 300_000):
        j = json.loads(spec)
        model = j["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.end = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in j["added_tokens"]}
        self.token_bytes = {i: t.encode() for t, i in (self.vocab | self.special).items()}
        self.pairs: dict[tuple[str, str], int] = {}
        for rank, m in enumerate(model["merges"]):
            self.pairs.setdefault(tuple(m if not isinstance(m, str) else m.split(" ")), rank)
        self.near = self._neighbours()
        self.letters = byte_letters()
        pattern = next(p["pattern"]["Regex"] for p in j["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(pattern.replace(r"\s", SPACE), regex.V1 if "&&" in pattern else regex.V0)
        self.ascii_words = re.compile(pattern.replace(r"\s", r"\t-\r ").replace(r"\p{L}", "a-zA-Z").replace(r"\p{N}", "0-9"))
        self.cut = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.cache = Remembered(self._word, most_cached)

    def _symbols(self, token: str) -> list[str]:
        if self.end and token.endswith(self.end) and len(token) > len(self.end):
            return [*token[: -len(self.end) - 1], token[-len(self.end) - 1] + self.end]
        return list(token)

    def _neighbours(self) -> set[tuple[str, str]]:
        """All pairs of neighbouring symbols inside vocabulary tokens; any other pair is a forced boundary."""
        out = set()
        for t in self.vocab:
            s = self._symbols(t)
            out.update(zip(s, s[1:]))
        return out

    def fragments(self, word: str) -> list[list[str]]:
        """A pre-token as lists of symbols, cut at every forced boundary."""
        s = [self.letters[b] for b in word.encode()]
        s[-1] += self.end
        cuts = [0, *[i for i in range(1, len(s)) if (s[i - 1], s[i]) not in self.near], len(s)]
        return [s[a:b] for a, b in zip(cuts, cuts[1:])]

    def merge(self, s: list[str]) -> list[str]:
        """Lowest rank first, leftmost on ties, all through; O(n log n) by a heap over a linked list."""
        if len(s) < 48:
            get, none = self.pairs.get, len(self.pairs)
            s = list(s)
            ranks = [get(p, none) for p in zip(s, s[1:])]
            while ranks and (best := min(ranks)) < none:
                i = ranks.index(best)
                s[i : i + 2] = [s[i] + s[i + 1]]
                del ranks[i]
                if i:
                    ranks[i - 1] = get((s[i - 1], s[i]), none)
                if i < len(ranks):
                    ranks[i] = get((s[i], s[i + 1]), none)
            return s
        s, right, left = list(s), [*range(1, len(s)), -1], [-1, *range(len(s) - 1)]
        heap = [(self.pairs[p], i, p) for i, p in enumerate(zip(s, s[1:])) if p in self.pairs]
        heapq.heapify(heap)
        while heap:
            _, i, p = heapq.heappop(heap)
            j = right[i]
            if s[i] is None or j < 0 or (s[i], s[j]) != p:
                continue
            s[i], s[j] = s[i] + s[j], None
            right[i] = right[j]
            if right[j] >= 0:
                left[right[j]] = i
            for k in (left[i], i):
                if k >= 0 and right[k] >= 0 and (q := (s[k], s[right[k]])) in self.pairs:
                    heapq.heappush(heap, (self.pairs[q], k, q))
        return [x for x in s if x is not None]

    def _word(self, word: str) -> bytes:
        return array("I", [self.vocab[t] for f in self.fragments(word) for t in self.merge(f)]).tobytes()

    def split(self, text: str) -> list[str]:
        """Pre-tokens of a text without special tokens. White space only separates, so its runs need no collapsing."""
        if text.isascii():
            return self.ascii_words.findall(text.lower())
        return self.words.findall(unicodedata.normalize("NFC", text).replace("Σ", "σ").lower())

    def _plain(self, text: str) -> bytes:
        return b"".join(map(self.cache.__getitem__, self.split(text)))

    def encode(self, text: str) -> array:
        """Ids as unsigned 32-bit integers."""
        if self.cut is None or not self.cut.search(text):
            out = self._plain(text)
        else:
            ids = lambda part: array("I", [self.special[part]]).tobytes() if part in self.special else self._plain(part)
            out = b"".join(map(ids, self.cut.split(text)))
        return array("I", out)

    def decode_bytes(self, ids: Iterable[int]) -> bytes:
        """Without a decoder in the file, tokens joined by spaces, in UTF-8; ids that name no token are left out."""
        try:
            return b" ".join(map(self.token_bytes.__getitem__, ids))
        except KeyError:
            return b" ".join(self.token_bytes[i] for i in ids if i in self.token_bytes)

    def decode(self, ids: Iterable[int]) -> str:
        return self.decode_bytes(ids).decode()


def read_spec(path: str) -> str:
    """The tokenizer file, on the driver; its size bounds what goes to the executors."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def encode_documents(docs: DataFrame, path: str, ids: bool = False, decoded: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256; the ids and the text decoded from them where asked.

    A null text is the empty text: no ids, the hashes of nothing. Each row is encoded alone,
    so repeated rows and ids repeat; further columns are ignored.
    """
    spec = docs.sparkSession.sparkContext.broadcast(read_spec(path))
    more = [c for c, wanted in (("ids", ids), ("decoded", decoded)) if wanted]

    def factory():
        bpe = kept(Bpe, spec.value)

        def run(rows):
            out: dict[str, list] = {"n_tokens": [], "ids_sha256": [], "decoded_sha256": []} | {c: [] for c in more}
            for text in rows["text"]:
                got = bpe.encode(text or "")
                back = bpe.decode_bytes(got)
                out["n_tokens"].append(len(got))
                out["ids_sha256"].append(hashlib.sha256(got).hexdigest())
                out["decoded_sha256"].append(hashlib.sha256(back).hexdigest())
                if ids:
                    out["ids"].append(got.tolist())
                if decoded:
                    out["decoded"].append(back.decode())
            return {"doc_id": rows["doc_id"]} | out

        return run

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if ids else "") + (", decoded string" if decoded else "")
    d = own_columns(docs, "doc_id", "text")
    return map_rows(d.select(d.doc_id.cast("long"), "text"), factory, schema)
