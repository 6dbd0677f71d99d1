"""Evaluation passages leaking into documents.

Every item gets windows of its own size (rounded down to a multiple of ``GRID`` words, one for each start) and, as an item
may leak in part, of ``least`` words and its doublings. Each window has a 64-bit SimHash of its words. A document's windows of the
same sizes meet them through a multi-index: the fingerprint is cut into radius + 1 blocks, and two fingerprints within the
radius agree in at least one, so no pair within it is lost. Pairs within the radius are verified by the exact
weighted similarity of their five-word shingles, as multisets: the share of the item window's weight found in the document's.

A document's window is only fingerprinted if the shingles it has from any item weigh enough for the similarity asked
for: a bound, so nothing is lost by it, and most windows of most documents end there. Documents are only mapped, never
shuffled; the items, a stated query set, are sent in blocks of bounded size.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words fingerprinted and shingles verified at a time; bounds a worker's memory whatever a document's length.
SLICE = 100_000
#: Item-sized windows are a multiple of so many words.
GRID = 8

_INLINE = re.compile(r"</?(?:b|i|u|s|em|strong|span|a|code|sub|sup|font|small|mark|tt|q|abbr)\b[^<>]*>", re.I)
_BLOCK = re.compile(r"<!--.*?-->|</?[a-zA-Z][^<>]*>", re.S)
_LINK = re.compile(r"!?\[([^\]\n]*)\]\([^)\s]*\)")
_EMPHASIS = re.compile(r"\*\*|__|`|(?<![^\W_])[*_](?=[^\W_])|(?<=[^\W_])[*_](?![^\W_])|~~")
_SOFT = re.compile(r"­[ \t]*\r?\n[ \t]*(?:>[ \t]*)*")
_BREAK = re.compile(r"([^\W_]+)[-‐‑][ \t]*(?:\r\n|\r|\n)[ \t]*(?:>[ \t]*)*([^\W_]+)")
_FORMAT = re.compile("[­͏؜᠎​-‏‪-‮⁠-⁤︀-️﻿]")
_WORD = re.compile(r"[^\W_]+")
_MARK = re.compile(r"[*_`~]")
_LINE_END = re.compile(r"[-‐‑][ \t]*[\r\n]")


def reader_words(text: str, vocabulary: frozenset[str] | None = None) -> list[str]:
    """Runs of letters and digits as a reader sees them, case folded.

    Markup, entities, invisible characters and compatibility variants are undone. A word broken by a hyphen at a line's end is
    one word, unless its two parts, but not the whole, are words of the vocabulary.
    """
    if "<" in text:
        text = _BLOCK.sub(" ", _INLINE.sub("", text))
    if "&" in text:
        text = html.unescape(text)
    if not text.isascii():
        text = unicodedata.normalize("NFKC", _FORMAT.sub("", _SOFT.sub("", text)))
    if "](" in text:
        text = _LINK.sub(r"\1", text)
    if _MARK.search(text):
        text = _EMPHASIS.sub("", text)
    text = text.casefold()
    if not _LINE_END.search(text):
        return _WORD.findall(text)

    def mend(m: re.Match) -> str:
        a, b = m.group(1), m.group(2)
        split = vocabulary is not None and a + b not in vocabulary and a in vocabulary and b in vocabulary
        return f"{a} {b}" if split else a + b

    return _WORD.findall(_BREAK.sub(mend, text))


def simhash(h: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """SimHash of the ``size`` word hashes from each start, in slices; words in no window cost nothing."""
    out = np.empty(len(starts), dtype=np.uint64)
    order = np.argsort(starts, kind="stable")
    edge = np.zeros(len(h) + 1, dtype=np.int32)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + size, -1)
    used = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
    h, at = h[used], np.searchsorted(used, starts[order])
    a = 0
    while a < len(at):
        b = int(np.searchsorted(at, at[a] + SLICE))
        part = h[at[a] : at[b - 1] + size]
        bits = np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        cum = np.zeros((len(part) + 1, 64), dtype=np.int32)
        np.cumsum(bits, axis=0, out=cum[1:])
        k = at[a:b] - at[a]
        out[order[a:b]] = np.packbits(2 * (cum[k + size] - cum[k]) > size, axis=1, bitorder="little").view("<u8").reshape(-1)
        a = b
    return out


class MultiIndex:
    """Fingerprints found again within a Hamming radius: one sorted table a block."""

    def __init__(self, fp: np.ndarray, radius: int):
        self.fp, self.radius = fp, radius
        edges = [64 * k // (radius + 1) for k in range(radius + 2)]
        self.blocks = []
        for a, b in zip(edges, edges[1:], strict=False):
            mask = np.uint64(((1 << (b - a)) - 1) << a)
            key = fp & mask
            order = np.argsort(key, kind="stable").astype(np.int32)
            self.blocks.append((mask, key[order], order))

    def pairs(self, fp: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query, indexed) positions within the radius, in parts; a pair comes once, from the first block it agrees in."""
        for e, (mask, keys, order) in enumerate(self.blocks):
            k = fp & mask
            lo, hi = np.searchsorted(keys, k, "left"), np.searchsorted(keys, k, "right")
            n = hi - lo
            live = np.flatnonzero(n)
            if not len(live):
                continue
            for part in np.array_split(live, int(n[live].sum()) // 2_000_000 + 1):
                m = n[part]
                w = np.repeat(part, m)
                c = order[np.repeat(lo[part] - np.concatenate([[0], np.cumsum(m)[:-1]]), m) + np.arange(m.sum())]
                differ = fp[w] ^ self.fp[c]
                near = np.bitwise_count(differ) <= self.radius
                for earlier, _, _ in self.blocks[:e]:
                    near &= (differ & earlier) != 0
                if near.any():
                    yield w[near], c[near]


class Index:
    """The items' windows by size, with the weights of their shingles."""

    def __init__(self, items: list[tuple[object, str]], least: int, shingle: int, radius: int, whole: bool = False):
        self.least, self.shingle = least, shingle
        known = [(i, ws) for i, t in items if t and len(ws := reader_words(t)) >= least]
        self.items = [i for i, _ in known]
        self.ids = {w: k + 1 for k, w in enumerate(dict.fromkeys(w for _, ws in known for w in ws))}
        self.vocabulary = frozenset(self.ids)
        self.hashes = np.array([0, *map(xxhash.xxh64_intdigest, self.ids)], dtype=np.uint64)
        self.flat = np.array([self.ids[w] for _, ws in known for w in ws], dtype=np.int64)
        length = np.array([len(ws) for _, ws in known], dtype=np.int64)
        self.own = np.repeat(np.arange(len(known)), length)
        keys, ok = self.shingles(self.flat, self.own)
        self.keys, inverse = np.unique(keys[ok], return_inverse=True)
        df = np.zeros(len(self.keys))
        if len(self.keys):
            df += np.bincount(np.unique(np.stack([inverse, self.own[: len(ok)][ok]]), axis=1)[0], minlength=len(self.keys))
        self.weight = np.log(1 + len(known) / np.maximum(df, 1))
        self.sid = np.full(len(self.flat), -1, dtype=np.int64)
        self.sid[: len(ok)][ok] = inverse
        first = np.concatenate([[0], np.cumsum(length)[:-1]]) if len(length) else length
        total = np.concatenate([[0.0], np.cumsum(np.where(self.sid >= 0, self.weight[self.sid] if len(self.weight) else 0.0, 0.0))])
        starts: dict[int, list] = {}
        for f, n in zip(first.tolist(), length.tolist(), strict=True):
            sizes = {max(least, n - n % GRID)}
            size = least
            while size <= n and not whole:
                sizes.add(size)
                size *= 2
            for size in sizes:
                starts.setdefault(size, []).append(np.arange(f, f + n - size + 1))
        self.sizes = []
        for size in sorted(starts):
            at = np.concatenate(starts[size])
            w = total[at + size - shingle + 1] - total[at]
            self.sizes.append((size, at, w, MultiIndex(simhash(self.hashes[self.flat], at, size), radius)))

    def shingles(self, ids: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(64-bit key of the shingle from each word, whether it has only items' words and lies in one text)."""
        n, k = len(ids) - self.shingle + 1, self.shingle
        if n <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, bool)
        key = np.zeros(n, dtype=np.uint64)
        none = np.concatenate([[0], np.cumsum(ids == 0)])
        for j in range(k):
            key = (key ^ self.hashes[ids[j : j + n]]) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(29)
        return key, (none[k:] == none[:-k]) & (own[:n] == own[k - 1 :])

    def similarity(self, size: int, doc: np.ndarray, item: np.ndarray, total: np.ndarray) -> np.ndarray:
        """Share of each item window's shingle weight that the document's window has, both multisets: rows of shingle numbers, -1 for none."""
        m, top = size - self.shingle + 1, len(self.keys)
        out = np.zeros(len(total))
        row = np.arange(len(total))[:, None]

        def counted(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Each shingle with the number of its like before it in its row, as one sorted number."""
            x = np.sort(x, axis=1)
            new = np.ones(x.shape, dtype=bool)
            new[:, 1:] = x[:, 1:] != x[:, :-1]
            col = np.arange(m)[None, :]
            nth = col - np.maximum.accumulate(np.where(new, col, 0), axis=1)
            return ((row * top + x) * m + nth).ravel(), x

        a, x = counted(doc)
        b, _ = counted(item)
        at = np.minimum(np.searchsorted(b, a), b.size - 1)
        both = (b[at] == a).reshape(x.shape) & (x >= 0)
        np.divide(np.where(both, self.weight[x], 0.0).sum(1), total, out=out, where=total > 0)
        return out


def search(index: Index, docs: list[list[str]], least_similarity: float) -> Iterator[tuple[int, object, int, float, bool]]:
    """(document position, item, windows, best similarity, whether ``least`` consecutive words are the item's) for documents given as words."""
    size_of = [len(ws) for ws in docs]
    if not index.items or not sum(size_of):
        return
    ids = np.concatenate([np.fromiter(map(index.ids.get, ws, repeat(0)), np.int64, len(ws)) for ws in docs])
    own = np.repeat(np.arange(len(docs)), size_of)
    keys, ok = index.shingles(ids, own)
    sid = np.full(len(ids), -1, dtype=np.int64)
    live = np.flatnonzero(ok)
    at = np.minimum(np.searchsorted(index.keys, keys[live]), len(index.keys) - 1)
    known = index.keys[at] == keys[live]
    if not known.any():
        return
    sid[live[known]] = at[known]
    # texts without shingles enough for any window end here
    value = np.bincount(own, np.where(sid >= 0, index.weight[sid], 0.0), len(docs))
    stay = (value >= least_similarity * min(w.min() for _, _, w, _ in index.sizes) - 1e-9)[own]
    place = (np.arange(len(ids)) - np.concatenate([[0], np.cumsum(size_of)[:-1]])[own])[stay]
    ids, own, sid = ids[stay], own[stay], sid[stay]
    gain = np.concatenate([[0.0], np.cumsum(np.where(sid >= 0, index.weight[sid], 0.0))])
    hashes, hashed = index.hashes[ids], ids > 0
    n_items = len(index.items)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for size, starts, weight, table in index.sizes:
        m = size - index.shingle + 1
        n = len(ids) - size + 1
        if n <= 0:
            break
        hot = np.flatnonzero((gain[m : m + n] - gain[:n] >= least_similarity * weight.min() - 1e-9) & (own[:n] == own[size - 1 :]))
        if not len(hot):
            continue
        # words no item has are hashed where a window needs them
        cover = np.zeros(len(ids) + 1, dtype=np.int64)
        np.add.at(cover, hot, 1)
        np.add.at(cover, hot + size, -1)
        for p in np.flatnonzero((np.cumsum(cover[:-1]) > 0) & ~hashed).tolist():
            hashes[p] = xxhash.xxh64_intdigest(docs[own[p]][place[p]])
            hashed[p] = True
        shingles = np.lib.stride_tricks.sliding_window_view(sid, m)
        theirs = np.lib.stride_tricks.sliding_window_view(index.sid, m)
        words = np.lib.stride_tricks.sliding_window_view(ids, size)
        item_words = np.lib.stride_tricks.sliding_window_view(index.flat, size)
        for w, k in table.pairs(simhash(hashes, hot, size)):
            step = max(1, 10 * SLICE // m)
            for a in range(0, len(w), step):
                p, q, t = hot[w[a : a + step]], starts[k[a : a + step]], weight[k[a : a + step]]
                sim = index.similarity(size, shingles[p], theirs[q], t)
                good = sim >= least_similarity - 1e-9
                p, q, sim = p[good], q[good], sim[good]
                exact = (words[p] == item_words[q]).all(1)
                found.append((own[p] * n_items + index.own[q], sim, exact))
    if not found:
        return
    pair, sim, exact = (np.concatenate([f[i] for f in found]) for i in range(3))
    which, inverse, count = np.unique(pair, return_inverse=True, return_counts=True)
    best, run = np.zeros(len(which)), np.zeros(len(which), dtype=bool)
    np.maximum.at(best, inverse, sim)
    np.logical_or.at(run, inverse, exact)
    for d, c, s, e in zip(which.tolist(), count.tolist(), best.tolist(), run.tolist(), strict=True):
        yield d // n_items, index.items[d % n_items], c, min(s, 1.0), e


def find_leaks(
    docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text",
    least: int = 12, radius: int = 7, min_similarity: float = 0.8, shingle: int = 5, block_chars: int = 1_000_000, whole: bool = False,
) -> DataFrame:
    """(item_id, doc_id, windows, similarity, exact): documents with windows of at least ``least`` words like an item's.

    A window counts when its SimHash lies within ``radius`` of that of an item's window of its size and the share of that window's weighted
    shingles it holds is at least min_similarity; with ``whole`` only windows of the items' own sizes count. exact tells whether one of the windows is the item's word by word, which one of
    ``least`` words is where so many consecutive words are. Items are sent in blocks of about ``block_chars`` characters, each searched against all documents; an item belongs
    to one block by the hash of its id. Null and empty texts, and texts of fewer words than ``least``, hold nothing. Repeated document rows
    come out each; items of one text come out each. Whole texts are searched.
    """
    spark = docs.sparkSession
    src = docs.select(F.col(doc_id).alias("d"), F.col(text).alias("t"))
    ddl = f"{item_id} {items.schema[item_id].dataType.simpleString()}, {doc_id} {src.schema['d'].dataType.simpleString()}, windows bigint, similarity double, exact boolean"
    query = items.select(F.col(item_id).alias("i"), F.col(item_text).alias("t"))
    total = query.agg(F.sum(F.length("t"))).first()[0] or 0
    parts = max(1, -(-total // block_chars))
    out = None
    for b in range(parts):
        chosen = query if parts == 1 else query.where(F.pmod(F.xxhash64("i"), F.lit(parts)) == b)
        shared = spark.sparkContext.broadcast([(r.i, r.t) for r in chosen.collect()])

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = Index(shared.value, least, shingle, radius, whole)
            for batch in batches:
                ids, texts = batch.column(0), batch.column(1)
                rows, pending, place, words = [], [], [], 0
                for j in range(len(texts)):
                    t = texts[j].as_py()
                    if t:
                        pending.append(reader_words(t, index.vocabulary))
                        place.append(j)
                        words += len(pending[-1])
                    if words > SLICE or j == len(texts) - 1:
                        rows += [(place[r[0]], *r[1:]) for r in search(index, pending, min_similarity)]
                        pending, place, words = [], [], 0
                if rows:
                    cols = list(zip(*rows, strict=True))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(cols[1]), ids.take(pa.array(cols[0])), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.float64()), pa.array(cols[4], pa.bool_())],
                        names=[item_id, doc_id, "windows", "similarity", "exact"],
                    )

        one = src.mapInArrow(run, schema=ddl)
        out = one if out is None else out.unionByName(one)
    return out
