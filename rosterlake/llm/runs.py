"""Periodic runs of words, found with suffix trees of a text and of its reversal.

A run is a stretch of consecutive words whose smallest period is q (words q apart are equal), of at least
``least`` words and ``times`` periods, that no neighbouring word extends. Each text goes through four steps.

Stretches: a run's words stand in groups of ``GRAM`` words that all stood at most q words before, and for
many places in a row. Places without that are passed over, again and again until nothing changes, so trees
are built only over stretches that may hold runs; ordinary prose has none. No run is lost: the bound follows
from the definition, and hashes that collide only make a stretch longer.

Trees: Ukkonen's construction gives the suffix trees of a stretch and of its reversal. An Euler tour of each
lists the leaves with the depth of the lowest node passed in between; the least depth between two leaves, by
tables of block minima in constant time, is the depth of their lowest common ancestor, and so the length of
the common extension of two places.

Candidates: for both orders of the words, the longest Lyndon word from each place ends where the next
smaller suffix begins; the tour with its children turned round gives the order of the second kind. Every run
has such a word as its root.

Extension: a root of p words goes right as far as the suffixes p apart agree, and left as far as the
reversed prefixes do. What is long enough is a run.

Work is dealt by rows; a task holds a few texts and the trees of one stretch, and nothing is shuffled.
Defined results: null, empty and blank texts have no words and no run; repeated rows and rows of one id have
a result each; a null id is kept; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_schema, text_rows

LEAST, TIMES, GRAM, BLOCK = 6, 4, 4, 16


def suffix_tree(s: list[int], sigma: int) -> tuple[dict[int, int], list[int], list[int], list[int]]:
    """Ukkonen's suffix tree of ``s``, whose last item occurs nowhere else; items are below ``sigma``.

    Returns the edges (node * sigma + first item to child) and for each node where its label begins and ends
    in ``s`` and, for a leaf, its suffix (else -1). Node 0 is the root.
    """
    n = len(s)
    begin, end, link, suffix = [0], [0], [0], [-1]
    edges: dict[int, int] = {}
    node = at = length = rest = 0

    def add(b: int, e: int, of: int) -> int:
        begin.append(b)
        end.append(e)
        link.append(0)
        suffix.append(of)
        return len(begin) - 1

    for i, c in enumerate(s):
        rest += 1
        made = 0
        while rest:
            if not length:
                at = i
            key = node * sigma + s[at]
            child = edges.get(key)
            if child is None:
                edges[key] = add(i, n, i - rest + 1)
                below = node
            else:
                b = begin[child]
                size = end[child] - b
                if length >= size:
                    at += size
                    length -= size
                    node = child
                    continue
                if s[b + length] == c:
                    length += 1
                    if made:
                        link[made] = node
                    break
                below = add(b, b + length, -1)
                edges[key] = below
                edges[below * sigma + c] = add(i, n, i - rest + 1)
                begin[child] = b + length
                edges[below * sigma + s[b + length]] = child
            if made:
                link[made] = below
            made = below
            rest -= 1
            if node:
                node = link[node]
            elif length:
                length -= 1
                at = i - rest + 1
    return edges, begin, end, suffix


class Tour:
    """Euler tours of a suffix tree: the order of its leaves and the depths between them."""

    def __init__(self, s: list[int], sigma: int):
        edges, begin, end, suffix = suffix_tree(s, sigma)
        keys = np.fromiter(edges.keys(), np.int64, len(edges))
        order = np.argsort(keys)  # by parent, then first item
        self.child = np.fromiter(edges.values(), np.int64, len(edges))[order].tolist()
        self.at = np.searchsorted(keys[order] // sigma, np.arange(len(begin) + 1)).tolist()
        self.size, self.suffix, self.n = (np.array(end) - np.array(begin)).tolist(), suffix, len(s)
        leaves, depths = self.walk(False)
        self.rank = np.empty(self.n, np.int64)
        self.rank[leaves] = np.arange(self.n)
        self.least = Least(np.array(depths, np.int64))

    def walk(self, turned: bool) -> tuple[list[int], list[int]]:
        """Leaves in order, and for each the depth of the lowest node since the leaf before. turned: greater items first, ends still before all."""
        child, at, size, suffix = self.child, self.at, self.size, self.suffix
        leaves, depths, depth, low = [], [], [0] * len(size), 0
        stack = [0]
        while stack:
            node = stack.pop()
            if node < 0:  # between two children
                low = depth[~node]
                continue
            b, e = at[node], at[node + 1]
            if b == e:
                leaves.append(suffix[node])
                depths.append(low)
                continue
            kids = child[b:e]
            if turned:
                # the end of the text is the least item, alone on its edge
                kids = [kids[0], *kids[:0:-1]] if suffix[kids[0]] >= 0 and size[kids[0]] == 1 and suffix[kids[0]] + depth[node] == self.n - 1 else kids[::-1]
            d = depth[node]
            for kid in reversed(kids[1:]):
                depth[kid] = d + size[kid]
                stack.append(kid)
                stack.append(~node)
            depth[kids[0]] = d + size[kids[0]]
            stack.append(kids[0])
        return leaves, depths

    def turned_rank(self) -> np.ndarray:
        """Places of the suffixes where greater items come first."""
        rank = np.empty(self.n, np.int64)
        rank[self.walk(True)[0]] = np.arange(self.n)
        return rank

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many items the suffixes at unequal places i and j share."""
        a, b = self.rank[i], self.rank[j]
        return self.least(np.minimum(a, b) + 1, np.maximum(a, b))


class Least:
    """Least values of ranges in constant time: a table over blocks, and least values inside them."""

    def __init__(self, values: np.ndarray):
        top = np.iinfo(np.int64).max
        blocks = np.full(-(-max(1, len(values)) // BLOCK) * BLOCK, top)
        blocks[: len(values)] = values
        self.inside = blocks.reshape(-1, BLOCK)
        self.front = np.minimum.accumulate(self.inside, axis=1).ravel()
        self.back = np.minimum.accumulate(self.inside[:, ::-1], axis=1)[:, ::-1].ravel()
        self.table = [self.inside.min(axis=1)]
        while 2 << (len(self.table) - 1) <= len(self.table[0]):
            t, step = self.table[-1], 1 << (len(self.table) - 1)
            self.table.append(np.minimum(t[:-step], t[step:]))

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """From a to b, both included, a not above b."""
        first, last = a // BLOCK, b // BLOCK
        out = np.minimum(self.back[a], self.front[b])
        same = np.flatnonzero(first == last)
        if len(same):
            places = np.arange(BLOCK)
            held = np.where((places >= (a[same] % BLOCK)[:, None]) & (places <= (b[same] % BLOCK)[:, None]), self.inside[first[same]], np.iinfo(np.int64).max)
            out[same] = held.min(axis=1)
        far = np.flatnonzero(last - first > 1)
        if len(far):
            low, high = first[far] + 1, last[far]
            level = np.frexp((high - low).astype(float))[1] - 1
            for k in np.unique(level).tolist():
                at, t = level == k, self.table[k]
                out[far[at]] = np.minimum(out[far[at]], np.minimum(t[low[at]], t[high[at] - (1 << k)]))
        return out


def next_smaller(rank: np.ndarray) -> np.ndarray:
    """Where the next smaller suffix begins, the end of the text if none does."""
    n = len(rank)
    ranks, out = rank.tolist(), [n] * n
    for i in range(n - 2, -1, -1):
        j, r = i + 1, ranks[i]
        while j < n and ranks[j] > r:
            j = out[j]
        out[i] = j
    return np.array(out, np.int64)


def runs_of(ids: np.ndarray, least: int = LEAST, times: int = TIMES) -> np.ndarray:
    """Rows (start, length, period) of the runs of a sequence of numbers, by start and period."""
    n = len(ids)
    if n < least:
        return np.zeros((0, 3), np.int64)
    _, inner = np.unique(ids, return_inverse=True)
    s = (inner + 1).tolist()  # 0 is the end of the text
    sigma = int(inner.max()) + 2
    ahead, behind = Tour([*s, 0], sigma), Tour([*s[::-1], 0], sigma)
    roots = [next_smaller(rank[:n]) for rank in (ahead.rank, ahead.turned_rank())]
    i, j = np.tile(np.arange(n), 2), np.concatenate(roots)
    i, j = np.unique(np.stack([i, j]), axis=1)
    right = np.where(j < n, ahead.common(i, j), 0)  # place n is the end alone, which agrees with nothing
    left = behind.common(np.minimum(n - i, n), np.minimum(n - j, n - 1)) * (i > 0)
    start, end, period = i - left, j + right, j - i
    long_ = end - start >= np.maximum(least, times * period)
    return np.unique(np.stack([start, end - start, period], axis=1)[long_], axis=0)


def stretches(ids: np.ndarray, least: int = LEAST, times: int = TIMES) -> list[tuple[int, int]]:
    """Stretches (from, to) that hold all runs, apart from each other."""
    n, gram = len(ids), max(1, min(GRAM, least - 2))
    if n < least or times < 2:
        return [(0, n)] if n >= least else []
    h = np.zeros(n - gram + 1, np.uint64)
    for k in range(gram):
        h = (h ^ ids[k : n - gram + 1 + k].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    order = np.argsort(h, kind="stable")
    same = h[order[1:]] == h[order[:-1]]
    back = np.full(len(h), n + 1)
    back[order[1:][same]] = (order[1:] - order[:-1])[same]  # words since the group stood before
    # a run of q words, repeated, has (times - 1) * q - gram + 1 such places in a row at least
    places = np.flatnonzero(back <= n)
    while len(places):
        cut = np.flatnonzero(np.diff(places) > 1) + 1
        sizes = np.diff(np.concatenate([[0], cut, [len(places)]]))
        good = back[places] <= (np.repeat(sizes, sizes) + gram - 1) // (times - 1)
        if good.all():
            begin, end = places[np.concatenate([[0], cut])], places[np.concatenate([cut - 1, [len(places) - 1]])] + 1
            begin, end = np.maximum(0, begin - (sizes + gram - 1) // (times - 1)), np.minimum(n, end + gram - 1)
            out: list[tuple[int, int]] = []
            for b, e in sorted(zip(begin.tolist(), end.tolist(), strict=True)):
                if out and b <= out[-1][1]:
                    out[-1] = (out[-1][0], max(e, out[-1][1]))
                else:
                    out.append((b, e))
            return [(b, e) for b, e in out if e - b >= least]
        places = places[good]
    return []


def numbered(words: list[bytes]) -> np.ndarray:
    known: dict[bytes, int] = {}
    return np.array([known.setdefault(w, len(known)) for w in words], np.int64)


def text_runs(ids: np.ndarray, least: int = LEAST, times: int = TIMES) -> np.ndarray:
    """Rows (start, length, period) of a text's runs, by start and period."""
    found = []
    for b, e in stretches(ids, least, times):
        runs = runs_of(ids[b:e], least, times)
        runs[:, 0] += b
        found.append(runs)
    return np.concatenate(found) if found else np.zeros((0, 3), np.int64)


def repeated_words(n: int, runs: np.ndarray) -> np.ndarray:
    """Which of n words some run holds behind its first period."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(edge)[:n] > 0


RESULT = T.StructType(
    [T.StructField("id", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")])))]
    + [T.StructField(c, T.StringType()) for c in ("runs_sha256", "collapsed_sha256")]
)


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, times: int = TIMES, changed: Callable[[int | None, int], np.ndarray | None] | None = None) -> DataFrame:
    """``(id, n_words, runs array<struct<start, length, period>>, runs_sha256, collapsed_sha256)`` of every row.

    The digests are those of one line for each run, and of the words that no run repeats, joined by blanks.
    changed: from an id and a number of words to the places of the words that are looked at in their stead
    (None: as they are).
    """
    rows = text_rows(docs, id_col, text_col)

    def row(doc: int | None, text: str) -> tuple:
        words = text.encode("utf-8", "surrogatepass").split()
        ids, places = numbered(words), changed(doc, len(words)) if changed and words else None
        if places is not None:
            ids, words = ids[places], [words[k] for k in places.tolist()]
        runs = text_runs(ids, least, times)
        if len(runs):
            words = [words[k] for k in np.flatnonzero(~repeated_words(len(words), runs)).tolist()]
        lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs.tolist())
        listed = [dict(zip(("start", "length", "period"), r, strict=True)) for r in runs.tolist()]
        return doc, len(ids), listed, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(b" ".join(words)).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to = arrow_schema(RESULT)
        for batch in batches:
            found, held = [], 0
            for doc, text in zip(batch.column("id"), batch.column("text"), strict=True):
                found.append(row(doc.as_py(), text.as_py()))
                held += 1 + len(found[-1][2])
                if held >= 10_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found, strict=True), to, strict=True)], schema=to)
                    found, held = [], 0
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found, strict=True), to, strict=True)], schema=to)

    return rows.select(F.col("id").cast("long").alias("id"), "text").mapInArrow(run, RESULT)


def longest(runs: str = "runs") -> Column:
    """The longest run, of equal ones that with the smallest start, then period; null without any."""
    placed = F.transform(runs, lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period")))
    best = F.array_min(placed)
    return F.when(best.isNotNull(), F.struct(best["start"].alias("start"), (-best["less"]).alias("length"), best["period"].alias("period")))
