"""Benchmark decontamination by greedy string tiling.

Texts become runs of lower-cased words. Karp-Rabin hashes of every MIN_MATCH words of the benchmark are the seeds; a document
that shares none is done after one look. For a shared seed the matches of document and item are grown along their diagonal,
and the longest is marked again and again, each word of either side at most once, until no unmarked match of MIN_MATCH words
is left. Marked tiles need no order, so a passage whose sentences were moved is still covered. A document is contaminated
by an item if its tiles cover ``coverage`` of the item's words.

A passage that repeats itself against one that does, too, has seeds in every pair of places. From SEED_PAIRS pairs on none are listed:
the longest unmarked match is found by halving its length, with a look-up of all hashes of one length each time, so that memory stays in
proportion to both texts. Both ways give the same tiles.

The benchmark is the query side. Its different texts are sent to tasks in blocks of about BLOCK_BYTES, chosen by a hash of the text,
and every block meets all documents in a pass of its own; one block is enough until the benchmark exceeds that size. A join
then gives each text's finds to all items that have it.

Null texts are never contaminated and never contaminate, nor do items of fewer than MIN_MATCH words. Repeated rows of either
side each give their rows; empty tables none. A kept column that is named like a result comes back with underscores before
its name. Ties of equally long matches go to the first place in the item, then in the document.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import apart, arrow_map, small_batches, text_or_empty

MIN_MATCH, COVERAGE, BLOCK_BYTES, SEED_PAIRS = 4, 0.6, 16 << 20, 1 << 20
WORD = re.compile(r"\w+")
_BASE = np.uint64(0x9E3779B97F4A7C15)


def rolling(ids: np.ndarray, k: int) -> np.ndarray:
    """Karp-Rabin hashes of every k numbers in a row, modulo 2**64."""
    n = len(ids) - k + 1
    out = np.zeros(max(n, 0), dtype=np.uint64)
    if n > 0:
        x = ids.astype(np.uint64) + np.uint64(1)
        for j in range(k):
            out *= _BASE
            out += x[j : j + n]
    return out


def _free_run(marked: list[np.ndarray], p: int, t: int, length: int) -> list[tuple[int, int, int]]:
    """The stretches of a match that are unmarked on both sides, if long enough."""
    free = ~(marked[0][p : p + length] | marked[1][t : t + length])
    edges = np.flatnonzero(np.diff(np.concatenate(([0], free.view(np.int8), [0]))))
    return [(p + a, t + a, b - a) for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()) if b - a >= MIN_MATCH]


class _Windows:
    """Hashes of all runs of a length, from running sums; modulo 2**64."""

    def __init__(self, ids: np.ndarray):
        one = np.ones(1, dtype=np.uint64)
        self.powers = np.concatenate((one, np.cumprod(np.full(len(ids), _BASE))))
        # a run's sum of x[i] * B**i comes down to one power by the inverse of B, which is odd
        self.back = np.concatenate((one, np.cumprod(np.full(len(ids), np.uint64(pow(int(_BASE), -1, 1 << 64))))))
        x = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(31)
        self.sums = np.concatenate((one - one, np.cumsum(x * self.powers[:-1])))

    def free(self, marked: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and hashes of the runs without a marked word."""
        n = len(marked) - length + 1
        used = np.concatenate(([0], np.cumsum(marked)))
        at = np.flatnonzero(used[length:] == used[:n]) if n > 0 else np.array([], dtype=np.int64)
        return at, (self.sums[at + length] - self.sums[at]) * self.back[at]


def _longest(item: np.ndarray, doc: np.ndarray, windows: tuple[_Windows, _Windows], marked: list[np.ndarray], most: int) -> tuple[int, int, int] | None:
    """The longest unmarked match of MIN_MATCH to ``most`` words, first in the item, then in the document."""

    def shared(length: int) -> tuple:
        (p, x), (t, y) = (w.free(m, length) for w, m in zip(windows, marked))
        hit = np.isin(x, y)
        return p[hit], x[hit], t, y

    low, high = MIN_MATCH - 1, most  # none of over high words; of low words there is one, or low is the start
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if len(shared(mid)[0]) else (low, mid - 1)
    for length in range(low, MIN_MATCH - 1, -1):  # but for equal hashes of unlike words, the first length has a match
        p, x, t, y = shared(length)
        for a, h in zip(p.tolist(), x):
            for b in t[y == h].tolist():
                if (item[a : a + length] == doc[b : b + length]).all():
                    return a, b, length
    return None


def tiles_by_length(item: np.ndarray, doc: np.ndarray) -> list[tuple[int, int, int]]:
    """Greedy tiles as tiles() gives them, in memory that grows with the sum of both lengths. Numbers below 0 fit nothing."""
    windows = _Windows(item), _Windows(doc)
    marked, out, most = [np.zeros(len(item), dtype=bool), doc < 0], [], min(len(item), len(doc))
    while got := _longest(item, doc, windows, marked, most):
        a, b, most = got
        out.append(got)
        marked[0][a : a + most] = True
        marked[1][b : b + most] = True
    return sorted(out)


def tiles(item: np.ndarray, doc: np.ndarray, item_hash: np.ndarray, doc_at: np.ndarray, doc_hash: np.ndarray) -> list[tuple[int, int, int]]:
    """Greedy tiles (place in item, place in doc, length). doc_at, doc_hash: where the document has seeds of the item."""
    order = np.argsort(item_hash, kind="stable")
    low = np.searchsorted(item_hash[order], doc_hash, "left")
    high = np.searchsorted(item_hash[order], doc_hash, "right")
    n = high - low
    if n.sum() > SEED_PAIRS:
        return tiles_by_length(item, doc)
    t = np.repeat(doc_at, n)
    p = order[np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
    same = np.ones(len(p), dtype=bool)
    for j in range(MIN_MATCH):
        same &= item[p + j] == doc[t + j]
    p, t = p[same], t[same]
    by = np.lexsort((p, t - p))
    p, t = p[by], t[by]
    first = np.flatnonzero(np.concatenate(([True], (np.diff(p) != 1) | (np.diff(t) != 1)))) if len(p) else np.array([], dtype=int)
    length = np.diff(np.append(first, len(p))) + MIN_MATCH - 1
    heap = list(zip((-length).tolist(), p[first].tolist(), t[first].tolist()))
    heapify(heap)
    marked = [np.zeros(len(item), dtype=bool), np.zeros(len(doc), dtype=bool)]
    out = []
    while heap:
        size, a, b = heappop(heap)
        left = _free_run(marked, a, b, -size)
        if len(left) == 1 and left[0][2] == -size:
            out.append((a, b, -size))
            marked[0][a : a - size] = True
            marked[1][b : b - size] = True
        else:
            for a, b, size in left:
                heappush(heap, (-size, a, b))
    return sorted(out)


class Matcher:
    """A block of benchmark items."""

    def __init__(self, items: list[tuple[int | None, str | None]], coverage: float = COVERAGE):
        self.coverage = coverage
        words = [(i, WORD.findall((t or "").lower())) for i, t in items]
        words = [(i, w) for i, w in words if len(w) >= MIN_MATCH]
        self.known = {w: k for k, w in enumerate(dict.fromkeys(w for _, ws in words for w in ws))}
        self.items = [(i, np.array([self.known[w] for w in ws], dtype=np.int64)) for i, ws in words]
        self.hashes = [rolling(a, MIN_MATCH) for _, a in self.items]
        holders: dict[int, list[int]] = defaultdict(list)
        for k, h in enumerate(self.hashes):
            for x in np.unique(h).tolist():
                holders[x].append(k)
        self.holders = dict(holders)
        self.seeds = np.array(sorted(self.holders), dtype=np.uint64)

    def matches(self, text: str) -> list[tuple[int | None, float, list[tuple[int, int, int]]]]:
        """(item id, coverage, tiles) of the items that contaminate the text."""
        words = WORD.findall(text.lower())
        if len(words) < MIN_MATCH or not len(self.seeds):
            return []
        doc = np.fromiter(map(self.known.get, words, repeat(-1)), dtype=np.int64, count=len(words))
        strange = np.concatenate(([0], np.cumsum(doc < 0)))
        at = np.flatnonzero(strange[MIN_MATCH:] == strange[:-MIN_MATCH])
        if not len(at):
            return []
        h = rolling(doc, MIN_MATCH)[at]
        slot = np.searchsorted(self.seeds, h)
        slot[slot == len(self.seeds)] = 0
        hit = self.seeds[slot] == h
        at, h = at[hit], h[hit]
        if not len(at):
            return []
        out = []
        for k in sorted({k for x in np.unique(h).tolist() for k in self.holders[x]}):
            item_id, item = self.items[k]
            mine = np.isin(h, self.hashes[k])
            if self._most(k, h[mine]) < self.coverage:
                continue
            found = tiles(item, doc, self.hashes[k], at[mine], h[mine])
            covered = sum(n for _, _, n in found) / len(item)
            if covered >= self.coverage:
                out.append((item_id, covered, found))
        return out

    def _most(self, k: int, shared: np.ndarray) -> float:
        """The share of an item's words that stand in any shared seed: no tiling covers more."""
        size = len(self.items[k][1])
        begin = np.flatnonzero(np.isin(self.hashes[k], shared))
        cover = np.zeros(size, dtype=bool)
        for j in range(MIN_MATCH):
            cover[begin + j] = True
        return cover.sum() / size


def _blocks(benchmark: DataFrame, item_id: str, text: str) -> Iterator[list[tuple]]:
    """The benchmark's different texts with their keys, about BLOCK_BYTES of text at once, more only if one text is longer."""
    items = _named(benchmark, item_id, text).groupBy("key").agg(F.first("t").alias("t"))
    size = items.agg(F.sum(F.octet_length("t") + 64)).first()[0] or 0
    n = int(-(-size // BLOCK_BYTES))
    n = 2 * n if n > 1 else n  # hashes do not deal out evenly
    for k in range(n):
        part = items if n == 1 else items.where(F.pmod(F.xxhash64("t", F.lit(1)), F.lit(n)) == k)
        yield [(r["key"], r["t"]) for r in part.collect()]


def _named(benchmark: DataFrame, item_id: str, text: str) -> DataFrame:
    """key (of the text), t and item_id of the items that have a text."""
    t = F.col(f"`{text}`").cast("string")
    return benchmark.where(t.isNotNull()).select(F.sha2(t, 256).alias("key"), t.alias("t"), F.col(f"`{item_id}`").alias("item_id"))


def contaminated(df: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, keep: tuple[str, ...] = ("doc_id",), item_id: str = "item_id", text: str = "text") -> DataFrame:
    """A row for each document and item that contaminates it: keep, item_id, coverage and tiles (item_at, doc_at, words)."""
    columns, keep = apart(df, keep, "item_id", "coverage", "tiles", "item_key", "key", "text")
    docs = df.select(*columns, text_or_empty(text).alias("text"))
    types = dict(docs.dtypes)
    schema = ", ".join([f"`{c}` {types[c]}" for c in keep] + ["item_key string, coverage double, tiles array<struct<item_at:int,doc_at:int,words:int>>"])
    out = df.sparkSession.createDataFrame([], schema)
    for k, block in enumerate(_blocks(benchmark, item_id, text)):
        items = df.sparkSession.sparkContext.broadcast(block)

        def make(items=items):
            matcher = Matcher(items.value, coverage)

            def work(*columns):
                rows = [(*kept, i, c, [dict(zip(("item_at", "doc_at", "words"), x)) for x in found]) for *kept, t in zip(*columns) for i, c, found in matcher.matches(t)]
                return list(zip(*rows)) or [[] for _ in range(len(keep) + 3)]

            return work

        found = arrow_map(docs, docs.columns, schema, make)
        out = found if k == 0 else out.unionByName(found)
    names = _named(benchmark, item_id, text).select("key", "item_id")
    return out.join(names, out["item_key"] == names["key"]).select(*keep, "item_id", "coverage", "tiles")


def clean(df: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """The rows of df, all columns, that no item contaminates."""
    small_batches(df.sparkSession)
    schema, column = df.schema, df.columns.index(text)
    for block in _blocks(benchmark, item_id, text):
        items = df.sparkSession.sparkContext.broadcast(block)

        def run(batches, items=items) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(items.value, coverage)
            for b in batches:
                yield b.filter(pa.array([not (t and matcher.matches(t)) for t in b.column(column).to_pylist()], pa.bool_()))

        df = df.mapInArrow(run, schema)
    return df
