"""Substring dedup: words covered by a window of 13 that also starts in an earlier document.

Every window has an anchor, the 5-gram of least hash inside it, so equal windows have equal anchors.

1. Anchors that occur in one document only are set aside (``repeats``).
2. Around each other anchor, the words of its windows make a segment. A batch of documents sends each
   distinct segment once, with the least doc_id, to the shard that the anchor's hash names; where
   an anchor has very many different surroundings, each window is a segment of its own, and goes where the
   hash of its 13 words says: equal windows still meet, and all others are spread evenly.
3. A shard builds a compressed FM-index over its distinct segments and streams each document's through it, against
   the documents before it only: the backward search gives, for each end of a window, how many words up
   to there an earlier document has together, and the earliest that has them; it ends where none is left.
   Intervals of 13 words are reported with that document.
4. Each batch removes the words under reported windows whose earliest document comes before their own.

No word goes that the index has not reported. A passage that a third of all documents hold is, for
each anchor, one segment a batch.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, grams, mix64, own_columns, stage, total_bytes, word_hashes
from .fm_index import FmIndex
from .repeats import SENT, answers_with_spread, batch_of, batches, buckets, distinct_of_documents, runs, send, unpack_with_spread

WINDOW, GRAM = 13, 5
#: The windows of an anchor with so many different surroundings, counted in each batch, are dealt out one by one.
SPREAD = 4096


def anchors(h: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first window start, number of windows) of each run of windows with one anchor, in order of place; leftmost of equal hashes."""
    m = len(h) - window + 1
    if m <= 0:
        return np.empty(0, dtype=U64), np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    g, places = grams(h, gram), window - gram + 1
    at = np.lib.stride_tricks.sliding_window_view(g, places).argmin(1) + np.arange(m)
    first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    return g[at][first], first, np.diff(np.append(first, m))


def _around(h: np.ndarray, start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """A number for the surroundings of each anchor: the words at either end of its windows."""
    return mix64(h[start] + U64(3) * h[start + n + WINDOW - 2] + n.astype(U64)) if len(start) else np.empty(0, dtype=U64)


def _kinds(anchor: np.ndarray, around: np.ndarray) -> np.ndarray:
    """How many different surroundings each distinct anchor has, in the anchors' order; 65,535 at most."""
    order = np.lexsort((around, anchor))
    a, b = anchor[order], around[order]
    first = np.concatenate(([len(a) > 0], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
    _, n = runs(a[first[: len(a)]])
    return np.minimum(n, 65_535).astype(np.uint16)


class Batch:
    """The documents of a batch, in one order whatever order they come in; those without doc_id last."""

    def __init__(self, rows: pd.DataFrame):
        ids = [None if pd.isna(i) else int(i) for i in rows["doc_id"]]
        docs = sorted(zip(ids, (t or "" for t in rows["text"])), key=lambda x: (x[0] is None, x[0] or 0, x[1]))
        # doc_id or None, text, word hashes, anchors
        self.docs = [(doc_id, text, h, anchors(h)) for (doc_id, text), h in zip(docs, word_hashes([t for _, t in docs]))]

    def segments(self, wanted: np.ndarray, spread: np.ndarray):
        """(document's place, what names its shard, key, start, windows) of each segment of a wanted anchor."""
        if len(wanted) == 0:
            return
        for i, (_, _, h, (hashes, start, n)) in enumerate(self.docs):
            if len(hashes) == 0:
                continue
            at = np.minimum(np.searchsorted(wanted, hashes), len(wanted) - 1)
            hit = wanted[at] == hashes
            wide = hit & spread[at]
            for j in np.flatnonzero(hit & ~wide).tolist():
                s, k = int(start[j]), int(n[j])
                yield i, int(hashes[j]), xxhash.xxh3_64_intdigest(h[s : s + k + WINDOW - 1].tobytes()), s, k
            if wide.any():
                whole = grams(h, WINDOW)
                for j in np.flatnonzero(wide).tolist():
                    for s in range(int(start[j]), int(start[j] + n[j])):
                        yield i, int(whole[s]), xxhash.xxh3_64_intdigest(h[s : s + WINDOW].tobytes()), s, 1


def _send_anchors(buckets: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        docs = Batch(rows).docs
        keys, many = distinct_of_documents([runs(np.sort(d[3][0]))[0] for d in docs])
        anchor = np.concatenate([d[3][0] for d in docs])
        kinds = _kinds(anchor, np.concatenate([_around(d[2], *d[3][1:]) for d in docs]))
        return send(int(rows["batch"].iloc[0]), keys, many, buckets, kinds)

    return run


SEGMENTS = "shard int, batch int, key binary, doc binary, has binary, n binary, words binary"
MARKS = "batch int, shard int, key binary, runs binary, windows binary, doc binary, has binary"
SEGMENTS_COLUMNS = [c.split()[0] for c in SEGMENTS.split(", ")]


def _send_segments(shards: int):
    def run(rows: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(rows) and len(found):
            batch = Batch(rows)
            by_shard: dict[int, dict] = {}
            for i, name, key, s, k in batch.segments(*unpack_with_spread(found)):
                own = by_shard.setdefault(name % shards, {})
                # documents come in order of doc_id: the first has the least
                if key not in own:
                    own[key] = (batch.docs[i][0], k, batch.docs[i][2][s : s + k + WINDOW - 1].tobytes())
            b = int(rows["batch"].iloc[0])
            for shard, own in by_shard.items():
                doc, n, words = zip(*own.values())
                has = np.array([x is not None for x in doc], dtype=np.uint8)
                doc = np.array([x or 0 for x in doc], dtype=np.int64)
                out.append((shard, b, np.array(list(own), dtype=U64).tobytes(), doc.tobytes(), has.tobytes(), np.array(n, dtype=np.uint8).tobytes(), b"".join(words)))
        return pd.DataFrame(out, columns=SEGMENTS_COLUMNS)

    return run


def _search(rows: pd.DataFrame) -> pd.DataFrame:
    """One shard: distinct segments, their index, and for each streamed window of 13 words the earliest document in which it
    occurs, as runs of windows with one document. A document without id is later than all others."""
    cat = lambda c, t: np.concatenate([np.frombuffer(x, dtype=t) for x in rows[c]])
    key, doc, has, n = cat("key", U64), cat("doc", np.int64), cat("has", np.uint8).astype(bool), cat("n", np.uint8).astype(np.int64)
    words = np.frombuffer(b"".join(rows["words"]), dtype=U64)
    ends = np.cumsum(n + WINDOW - 1)
    # order by segment, then doc_id: the first of each is the one with the least
    order = np.lexsort((doc, ~has, key))
    new = np.concatenate(([True], key[order][1:] != key[order][:-1]))
    group = np.empty(len(order), dtype=np.int64)
    group[order] = np.cumsum(new) - 1
    heads = order[new]
    ids = np.unique(doc[heads[has[heads]]])
    number = np.where(has[heads], np.searchsorted(ids, doc[heads]), len(ids))
    pieces = [words[ends[i] - n[i] - WINDOW + 1 : ends[i]] for i in heads.tolist()]
    index = FmIndex(pieces, number, WINDOW)
    count = n[heads]
    base = np.cumsum(count + WINDOW - 1) - (count + WINDOW - 1)
    last = np.cumsum(count)
    offset = np.arange(int(last[-1])) - np.repeat(last - count, count)
    own = np.repeat(number, count)
    size, earlier = index.earliest(index.codes(np.concatenate(pieces)), np.repeat(base, count) + offset + WINDOW, WINDOW, before=own)
    found = np.where(size >= WINDOW, earlier, own)  # below the threshold a window is first in its own document
    # runs of windows of one segment with one earliest document
    turn = np.flatnonzero(np.concatenate(([True], (found[1:] != found[:-1]) | (offset[1:] == 0))))
    length = np.diff(np.append(turn, len(found))).astype(np.uint8)
    known = found[turn] < len(ids)
    first = np.where(known, ids[np.minimum(found[turn], len(ids) - 1)] if len(ids) else 0, 0).astype(np.int64)
    runs_to = np.searchsorted(turn, last)
    runs_from = np.concatenate(([0], runs_to[:-1]))
    out, i = [], 0
    for b, shard, x in zip(rows["batch"], rows["shard"], rows["key"]):
        own = group[i : i + len(x) // 8]
        i += len(own)
        k = runs_to[own] - runs_from[own]
        at = np.repeat(runs_from[own] - np.concatenate(([0], np.cumsum(k)[:-1])), k) + np.arange(int(k.sum()))
        out.append((b, shard, bytes(x), k.astype(np.uint8).tobytes(), length[at].tobytes(), first[at].tobytes(), known[at].astype(np.uint8).tobytes()))
    return pd.DataFrame(out, columns=["batch", "shard", "key", "runs", "windows", "doc", "has"])


def _reported(found: pd.DataFrame) -> dict[tuple[int, int], list[tuple[int, int | None]]]:
    """(shard, key) -> runs of windows: (number, earliest document or None)."""
    out = {}
    for shard, key, runs, windows, doc, has in zip(*(found[c] for c in ("shard", "key", "runs", "windows", "doc", "has"))):
        run = list(zip(windows, [d if h else None for d, h in zip(np.frombuffer(doc, dtype=np.int64).tolist(), has)]))
        i = 0
        for x, k in zip(np.frombuffer(key, dtype=U64).tolist(), runs):
            out[shard, x] = run[i : i + k]
            i += k
    return out


def _close(shards: int):
    def run(rows: pd.DataFrame, sent: pd.DataFrame) -> pd.DataFrame:
        """sent: the batch's repeated anchors and what shards have reported."""
        batch = Batch(rows)
        cover: dict[int, np.ndarray] = {}
        reported = _reported(sent[sent["keys"].isna()])
        for i, name, key, s, k in batch.segments(*unpack_with_spread(sent[sent["keys"].notna()])) if reported else ():
            own = batch.docs[i][0]
            for windows, first in reported.get((name % shards, key), ()):
                if first is not None and (own is None or first < own):
                    c = cover.setdefault(i, np.zeros(len(batch.docs[i][2]) + 1, dtype=np.int64))
                    c[s] += 1
                    c[s + windows + WINDOW - 1] -= 1
                s += windows
        out: dict[str, list] = {c: [] for c in ("doc_id", "n_words", "n_removed", "kept_sha256", "kept")}
        for i, (doc_id, text, h, _) in enumerate(batch.docs):
            words = text.encode().split()
            if i in cover:
                keep = np.cumsum(cover[i][:-1]) == 0
                words = [words[j] for j in np.flatnonzero(keep).tolist()]
            kept = b" ".join(words)
            for c, v in zip(out, (doc_id, len(h), len(h) - len(words), hashlib.sha256(kept).hexdigest(), kept.decode())):
                out[c].append(v)
        return pd.DataFrame(out | {"doc_id": pd.array(out["doc_id"], dtype="Int64")})

    return run


def remove_repeats(docs: DataFrame, full: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row; with ``full`` also kept, the words left.

    Documents of fewer than 13 words lose nothing. Rows with one doc_id don't count as earlier than each other; a
    null doc_id is later than all others; a null text has no words. Windows are judged on the
    input. Words are compared by 64-bit hashes, 13 in a row.
    """
    spark = docs.sparkSession
    d = own_columns(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    n, into = batches(spark, 4 * total_bytes(d)), buckets(spark)  # words and their hashes take some three times the text
    d = d.withColumn("batch", batch_of(n, "doc_id", "text"))
    rows = d.groupBy("batch")
    found = stage(answers_with_spread(rows.applyInPandas(_send_anchors(into), SENT + ", kinds binary"), SPREAD), "substring-anchors")
    segments = rows.cogroup(found.groupBy("batch")).applyInPandas(_send_segments(into), SEGMENTS)
    marks = segments.groupBy("shard").applyInPandas(_search, MARKS)
    close = _close(into)

    def last(own: pd.DataFrame, sent: pd.DataFrame) -> pd.DataFrame:
        out = close(own, sent)
        return out if full else out.drop(columns="kept")

    sent = found.unionByName(marks, allowMissingColumns=True)
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + (", kept string" if full else "")
    return rows.cogroup(sent.groupBy("batch")).applyInPandas(last, schema)
