"""Language ID with hyperdimensional profiles.

Every letter has a random bipolar vector of its own, made from its code point. A trigram is the product of its letters' vectors,
permuted by their place; a text is the sum of its trigrams; a language is the sum of its
training texts, each counted once whatever its length. Texts and languages, both less the mean of
all languages, are compared by cosine.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, own_columns, stage

DIM = 512
SEED = 7
#: A table with more languages is refused, so that the model is bounded: 4 KB each.
MOST_LANGUAGES = 10_000
#: Letters whose vectors a task remembers, DIM bytes each.
MOST_LETTERS = 20_000
#: Training sums are whole numbers in these units, so that any order of summing gives the same bits.
UNIT = float(1 << 30)
SHARPNESS = 12.0
#: Trigrams whose vectors are held at a time, 4 * DIM bytes each.
TOGETHER = 4096


class Space:
    """Letters, trigrams and bundles of one dimension and seed. A letter's number is its code point; 0 is a boundary."""

    def __init__(self, dim: int = DIM, seed: int = SEED):
        self.dim, self.seed = dim, seed
        self.letters: dict[int, np.ndarray] = {}
        self.alpha = np.array([chr(c).isalpha() for c in range(1 << 16)])

    def letter(self, c: int) -> np.ndarray:
        v = self.letters.get(c)
        if v is None:
            if len(self.letters) >= MOST_LETTERS:
                self.letters.clear()
            v = self.letters[c] = np.random.default_rng((self.seed, c)).choice(np.array([-1, 1], dtype=np.int8), self.dim)
        return v

    def trigrams(self, text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
        """Distinct trigram codes and their counts; None for a text without letters. Words are padded by one boundary on either side."""
        cp = np.frombuffer((text or "").lower().encode("utf-32-le", "replace"), dtype=np.uint32)
        is_letter = self.alpha[np.minimum(cp, 0xFFFF)]
        for i in np.flatnonzero(cp > 0xFFFF):
            is_letter[i] = chr(int(cp[i])).isalpha()
        if not is_letter.any():
            return None
        ids = np.concatenate(([0], np.where(is_letter, cp, 0), [0])).astype(np.int64)
        ids = ids[np.concatenate(([True], (ids[1:] != 0) | (ids[:-1] != 0)))]
        return np.unique(ids[:-2] << 42 | ids[1:-1] << 21 | ids[2:], return_counts=True)

    def vectors(self, codes: np.ndarray) -> np.ndarray:
        mask = (1 << 21) - 1
        abc = np.stack([codes >> 42, codes >> 21 & mask, codes & mask])
        own, at = np.unique(abc, return_inverse=True)
        at = at.reshape(abc.shape)
        v = np.array([self.letter(c) for c in own.tolist()])
        return (np.roll(v, 2, axis=1)[at[0]] * np.roll(v, 1, axis=1)[at[1]] * v[at[2]]).astype(np.float32)

    def bundles(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """One row a text, divided by its number of trigrams; and which texts have letters."""
        grams = [self.trigrams(t) for t in texts]
        has = np.array([g is not None for g in grams])
        out = np.zeros((len(texts), self.dim), dtype=np.float32)
        if has.any():
            codes, at = np.unique(np.concatenate([g[0] for g in grams if g]), return_inverse=True)
            row = np.repeat(np.flatnonzero(has), [len(g[0]) for g in grams if g])
            part = np.concatenate([g[1] / g[1].sum() for g in grams if g]).astype(np.float32)
            # vectors of TOGETHER trigrams at a time, however many a text of many letters has
            order = np.argsort(at, kind="stable")
            ends = np.searchsorted(at[order], np.arange(TOGETHER, len(codes) + TOGETHER, TOGETHER))
            for first, own in zip(range(0, len(codes), TOGETHER), np.split(order, ends[:-1])):
                some = codes[first : first + TOGETHER]
                counts = np.zeros((len(texts), len(some)), dtype=np.float32)
                counts[row[own], at[own] - first] = part[own]
                out += counts @ self.vectors(some)
        return out, has


def train(docs: DataFrame, dim: int = DIM, seed: int = SEED) -> tuple[list[str], np.ndarray]:
    """Languages and their bundles, from all rows of docs with text and lang. Each task sums its own
    texts; what is shuffled is one vector a task and language."""

    def factory():
        space, sums = Space(dim, seed), {}

        def run(rows):
            b, has = space.bundles(rows["text"])
            langs = np.array(rows["lang"], dtype=object)
            for lang in set(langs[has]):
                own = has & (langs == lang)
                s = np.rint(b[own].astype(np.float64) * UNIT).astype(np.int64).sum(axis=0)
                old = sums.get(lang)
                sums[lang] = (s, int(own.sum())) if old is None else (old[0] + s, old[1] + int(own.sum()))

        def finish():
            if sums:
                return {"lang": list(sums), "n": [x[1] for x in sums.values()], "v": [x[0].tolist() for x in sums.values()]}

        run.finish = finish
        return run

    rows = own_columns(docs, "text", "lang").where("text is not null and lang is not null")
    parts = stage(map_rows(rows, factory, "lang string, n long, v array<long>"), "lang-profiles")
    n = parts.select("lang").distinct().count()
    if n > MOST_LANGUAGES:
        raise ValueError(f"{n} languages; profiles are made for {MOST_LANGUAGES} at most")
    each = parts.select("lang", "n", F.posexplode("v").alias("i", "x"))
    # averages in units fit a long at any number of texts
    got = each.groupBy("lang", "i").agg((F.sum(F.col("x").cast("decimal(38,0)")) / F.sum("n")).cast("double").alias("x"))
    whole = got.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("v")).select("lang", "v.x")
    found = {r.lang: np.array(r.x) / UNIT for r in whole.collect()}
    langs = sorted(found)
    return langs, np.array([found[x] for x in langs]).reshape(len(langs), dim)


def predictor(langs: list[str], prototypes: np.ndarray, dim: int = DIM, seed: int = SEED):
    """A factory: texts -> lang_pred and score."""
    mean = prototypes.mean(axis=0) if len(langs) > 1 else np.zeros(dim)
    p = prototypes - mean
    p = p / np.maximum(np.linalg.norm(p, axis=1, keepdims=True), 1e-30)

    def factory():
        space = Space(dim, seed)

        def run(texts):
            b, has = space.bundles(texts)
            if not langs:
                return {"lang_pred": ["und"] * len(texts), "score": [0.0] * len(texts)}
            c = b.astype(np.float64) - mean
            cos = (c @ p.T) / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-30)
            e = np.exp(SHARPNESS * (cos - cos.max(axis=1, keepdims=True)))
            best = cos.argmax(axis=1)
            score = np.clip(e[np.arange(len(best)), best] / e.sum(axis=1), 0, 1)
            return {"lang_pred": [langs[i] if h else "und" for i, h in zip(best, has)], "score": [float(s) if h else 0.0 for s, h in zip(score, has)]}

        return run

    return factory


def identify(docs: DataFrame, modulus: int = 5, dim: int = DIM, seed: int = SEED) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row.

    Profiles come from all rows with text and lang whose crc32(doc_id as text) mod ``modulus``
    is not 0. A null text, or one without a letter, is ``und`` with score 0, as is everything when
    no row can be learned from. A null doc_id is neither held out nor learned from.
    """
    d = own_columns(docs, "doc_id", "text", "lang").select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus
    langs, prototypes = train(d.where(fold != 0), dim, seed)
    make = predictor(langs, prototypes, dim, seed)

    def factory():
        f = make()
        return lambda rows: {"doc_id": rows["doc_id"], "held_out": rows["held_out"]} | f(rows["text"])

    rows = d.select("doc_id", F.coalesce(fold == 0, F.lit(False)).alias("held_out"), "text")
    return map_rows(rows, factory, "doc_id long, held_out boolean, lang_pred string, score double")
