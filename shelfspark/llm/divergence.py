"""Source divergence audit: how far each source's words are from those of its language and of its other sources.

Terms are counted a task at a time before they are shuffled, once, by (language, term). A group's p of
a term that it lacks is the same for all such terms, its baseline; so the sum of differences of two
groups is that of their baselines over all terms, corrected where one of them has the term, and again
where both have. Only terms that occur are looked at, and pairs leave a task as sums, not term by
term. The highest terms of a group come from radix selection (``radix``).
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import broadcast_if, map_rows, own_columns, stage
from .radix import MOST_GROUPS, top_of_groups

LEAST_DOCS, PRIOR, UNIT, TOP = 30, 5, 1_000_000_000, 50
#: Bytes as terms have them: A-Z lower, a-z and all beyond ASCII as they are, a space for all others.
LETTERS = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
#: A task's counts go out when it holds so many, or has read so many bytes.
MOST_COUNTS, MOST_BYTES = 200_000, 64 << 20
#: A long text is split so many bytes at a time; sums of so many pairs are held by a task.
PIECE, MOST_PAIRS = 1 << 20, 1 << 20


def terms(text: str | None) -> Iterator[list[bytes]]:
    """The terms of a text in order, some lists of them."""
    raw = (text or "").encode().translate(LETTERS)
    at = 0
    while at < len(raw):
        end = raw.find(b" ", at + PIECE)
        end = len(raw) if end < 0 else end
        yield raw[at:end].split()
        at = end


def count_terms(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), docs (documents with it); a term has several rows, to be summed."""

    class Counts:
        def __init__(self):
            self.n, self.docs, self.read = defaultdict(Counter), defaultdict(Counter), 0

        def __call__(self, rows):
            for lang, source, text in zip(rows["lang"], rows["source"], rows["text"]):
                seen = set()
                for some in terms(text):
                    self.n[lang, source].update(some)
                    seen.update(some)
                self.docs[lang, source].update(seen)
                self.read += len(text or "")
            return self.finish() if self.read > MOST_BYTES or sum(map(len, self.n.values())) > MOST_COUNTS else None

        def finish(self):
            out = [(lang, source, t.decode(), n, self.docs[lang, source][t]) for (lang, source), c in self.n.items() for t, n in c.items()]
            self.__init__()
            return dict(zip(("lang", "source", "term", "n", "docs"), map(list, zip(*out)))) if out else None

    return map_rows(docs, Counts, "lang string, source string, term string, n long, docs long")


def _probability(n: str, of: str) -> F.Column:
    """1 + floor(UNIT * (n + PRIOR) / (of + PRIOR * terms)); null without terms. Decimals, for the product may be beyond a long."""
    wide = lambda x: f"CAST({x} AS DECIMAL(20, 0))"
    return F.expr(f"1 + ({UNIT}BD * ({wide(n)} + {PRIOR})) DIV nullif({wide(of)} + {PRIOR} * {wide('terms')}, 0)")


def _both(stacked: tuple[np.ndarray, np.ndarray, np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Terms by sources that hold them (sid, p, baseline) -> (pair, correction for both): a row of a term's sources at a time, the later ones against it."""
    sid, p, b = stacked
    for i in range(sid.shape[1] - 1):
        pi, bi, pj, bj = p[:, i, None], b[:, i, None], p[:, i + 1 :], b[:, i + 1 :]
        v = np.abs(pi - pj) - np.abs(pi - bj) - np.abs(pj - bi) + np.abs(bi - bj)
        yield (sid[:, i, None] << 32 | sid[:, i + 1 :]).ravel(), v.ravel()


class _Pairs:
    """Sums of (lang, pair), which go out when they are many."""

    def __init__(self):
        self.held, self.size = defaultdict(list), 0

    def add(self, lang, pair, value):
        self.held[lang].append((pair, value))
        self.size += len(pair)
        return self.summed() if self.size > 4 * MOST_PAIRS else None

    def summed(self):
        self.size = 0
        for lang, parts in self.held.items():
            pair, at = np.unique(np.concatenate([x for x, _ in parts]), return_inverse=True)
            value = np.zeros(len(pair), dtype=np.int64)
            np.add.at(value, at, np.concatenate([v for _, v in parts]))
            self.held[lang] = [(pair, value)]
            self.size += len(pair)
        return self.finish() if self.size > MOST_PAIRS else None

    def finish(self):
        out = {"lang": [], "low": [], "high": [], "value": []}
        for lang, parts in self.held.items():
            for pair, value in parts:
                out["lang"] += [lang] * len(pair)
                out["low"] += (pair >> 32).tolist()
                out["high"] += (pair & 0xFFFFFFFF).tolist()
                out["value"] += value.tolist()
        self.held, self.size = defaultdict(list), 0
        return out


PAIRS = "lang string, low long, high long, value long"


def _shared(scored: DataFrame) -> DataFrame:
    """Corrections of pairs for the terms that both hold."""
    held = scored.groupBy("lang", "term").agg(F.sort_array(F.collect_list(F.struct("sid", "p", "b"))).alias("held")).where(F.size("held") > 1)

    def factory():
        pairs = _Pairs()

        def run(rows):
            stacks, out = defaultdict(list), []
            for lang, its in zip(rows["lang"], rows["held"]):
                stacks[lang, len(its)].append([(x["sid"], x["p"], x["b"]) for x in its])
            for (lang, _), its in stacks.items():
                for pair, value in _both(tuple(np.moveaxis(np.array(its, dtype=np.int64), 2, 0))):
                    out.append(pairs.add(lang, pair, value))
            out = [o for o in out if o]
            return {k: [v for o in out for v in o[k]] for k in out[0]} if out else None

        run.finish = pairs.finish
        return run

    return map_rows(held.select("lang", "held"), factory, PAIRS)


def _own(groups: DataFrame, scored: DataFrame) -> DataFrame:
    """For each group and each other one of its language: the baselines' difference over all terms (by the first of the two), and the corrections for the terms that the group holds."""
    several = scored.groupBy("lang", "sid", "p").agg(F.count("*").alias("n")).groupBy("lang", "sid").agg(F.collect_list(F.struct("p", "n")).alias("held"))
    others = groups.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("sid", "b"))).alias("others"))
    rows = groups.select("lang", "sid", "b", "terms").join(several, ["lang", "sid"], "left").join(others, "lang").where(F.size("others") > 1)

    def factory():
        def run(rows):
            out = {"lang": [], "low": [], "high": [], "value": []}
            for lang, sid, b, v, held, others in zip(*[rows[k] for k in ("lang", "sid", "b", "terms", "held", "others")]):
                other, base = np.array([(x["sid"], x["b"]) for x in others if x["sid"] != sid], dtype=np.int64).T
                value = np.where(sid < other, v * np.abs(b - base), 0)
                if held:
                    p, n = np.array(sorted((x["p"], x["n"]) for x in held), dtype=np.int64).T
                    # sums of |p - base| by what lies below the base and what above it
                    below = np.searchsorted(p, base)
                    count, total = np.concatenate(([0], np.cumsum(n))), np.concatenate(([0], np.cumsum(p * n)))
                    value = value + (2 * (base * count[below] - total[below]) + total[-1] - base * count[-1]) - np.abs(b - base) * count[-1]
                out["lang"] += [lang] * len(other)
                out["low"] += np.minimum(sid, other).tolist()
                out["high"] += np.maximum(sid, other).tolist()
                out["value"] += value.tolist()
            return out

        return run

    return map_rows(rows, factory, PAIRS)


def audit_sources(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank: how each (lang, source) group of docs differs.

    Part ``pair``: all other sources of the language, by the sum of |p - p'| over its kept terms.
    Part ``term``: the group's ``top`` terms whose p is above the language's, by the difference. Null
    lang, source and text are empty ones. Each row of docs is a document, equal rows too. A language
    without kept terms has pairs of value 0 and no terms, and a language with one source no pairs. An
    empty table gives an empty table; further columns are ignored.
    """
    own = own_columns(docs, "lang", "source", "text")
    own = own.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in own.columns])
    # both sums are by the one shuffle
    summed = count_terms(own).repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    kept = summed.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("lang_n"), F.collect_list(F.struct("source", "n")).alias("held"))
    kept = stage(kept.where(F.col("docs") >= least_docs).select("lang", "term", "lang_n", "held"), "kept-terms")
    langs = kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("lang_n").alias("lang_all"))
    each = kept.select("lang", "term", "lang_n", F.inline("held"))
    groups = own.select("lang", "source").distinct().join(each.groupBy("lang", "source").agg(F.sum("n").alias("all")), ["lang", "source"], "left").join(langs, "lang", "left")
    groups = groups.select("lang", "source", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("all", "terms", "lang_all")])
    sid = F.row_number().over(W.partitionBy("lang").orderBy("source")).cast("long")
    groups = stage(groups.withColumn("sid", sid).withColumn("b", F.coalesce(_probability("0", "all"), F.lit(0)).cast("long")), "groups")
    scored = each.join(broadcast_if(groups, MOST_GROUPS), ["lang", "source"])
    scored = scored.select("lang", "source", "sid", "term", "b", _probability("n", "all").cast("long").alias("p"), _probability("lang_n", "lang_all").cast("long").alias("q"))
    scored = stage(scored, "scored-terms")

    pairs = _own(groups, scored).unionByName(_shared(scored)).groupBy("lang", "low", "high").agg(F.sum("value").alias("value"))
    pairs = pairs.select("lang", F.inline(F.array(F.struct(F.col("low").alias("sid"), F.col("high").alias("other")), F.struct(F.col("high").alias("sid"), F.col("low").alias("other")))), "value")
    names = broadcast_if(groups.select("lang", "sid", "source"), MOST_GROUPS)
    pairs = pairs.join(names, ["lang", "sid"]).select("lang", "source", F.col("other").alias("sid"), "value")
    pairs = pairs.join(names.withColumnRenamed("source", "item"), ["lang", "sid"])
    order = F.row_number().over(W.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item"))
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", order.alias("rank"))

    above = scored.where("p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    words = top_of_groups(above, ["lang", "source"], top).select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank")
    return pairs.unionByName(words)
