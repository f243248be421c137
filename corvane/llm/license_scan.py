"""Licence scans: winnowed fingerprints pick candidates, banded alignment reports coverage and spans.

Templates become runs of lower-cased words. Of every WINDOW hashes of GRAM words in a row the least is a fingerprint (the last
of equal ones), filed with its places in an inverted index; a template of one window or less files its least hash. A document
looks up all its hashes. Hits of one template that lie on nearly one diagonal (BAND) and close together are a candidate, and
the template is aligned with the words around them: a word that fits gives 1, a word left out or put in or changed costs 1,
within BAND of the hits' diagonals. Coverage is the share of the template's words that fit, less those put in. Spans are places in the
text.

A find is reported if it covers ``coverage`` of its template, one of up to WHOLE words whole, and if its span has the template's telling words and versions, no
others and none less: "Lesser" or "3" is one word of many, but another licence. Of finds that overlap in the text the one with more
fitting words stays, then the one that covers more of its template, then the first template. A stretch that lacks too many of a template's
words, in whatever order, is not aligned. "Not" or the like within three words before a notice takes it back. Templates go to tasks in blocks of
BLOCK_LETTERS, each with one pass over the texts; finds of all blocks are compared. The given ones cover the licences that license_texts.py lists. Null text counts as empty and has no
finds, nor has an empty table. Repeated rows give repeated finds; very long texts are taken whole. A kept column that is named like a
result comes back with underscores before its name.
"""

from __future__ import annotations

import re
from collections import defaultdict
from itertools import repeat

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import apart, arrow_map, text_or_empty
from .license_texts import BEFORE_VERSION, DENIALS, SHORT, TELLING, TEMPLATES
from .tiling import rolling

GRAM, WINDOW, BAND, COVERAGE, BLOCK_LETTERS = 3, 3, 8, 0.8, 16 << 20
#: Words up to which a template must fit whole: one word of so few is the licence's name.
WHOLE = 7
WORD = re.compile(r"\w+")


def winnow(hashes: np.ndarray, window: int = WINDOW) -> list[int]:
    """Places of the fingerprints: the least hash of every window, the last one of equals."""
    n = len(hashes)
    if n <= window:
        return [] if n == 0 else [n - 1 - int(np.argmin(hashes[::-1]))]
    views = np.lib.stride_tricks.sliding_window_view(hashes, window)[:, ::-1]
    return sorted(set((np.arange(len(views)) + window - 1 - np.argmin(views, axis=1)).tolist()))


def telling(words: list[str]) -> frozenset[str]:
    """The words of a stretch that tell licences apart, and its versions (2.0 counts as 2)."""
    found, number = set(), False
    for k, w in enumerate(words):
        short = len(w) > 1 and w[0] == "v" and w[1:].isdigit()
        w = w[1:] if short else SHORT.get(w, w)
        number = short or w.isdigit() and (number or k > 0 and words[k - 1] in BEFORE_VERSION)
        if w in TELLING or number and w != "0":
            found.add(w)
    return frozenset(found)


def align(template: np.ndarray, words: np.ndarray, low: int, high: int) -> tuple[int, int, int, int]:
    """The best alignment of a whole template with a stretch of words, on diagonals (word - template word) low to high:
    its score, words that fit, first word, end."""
    width = high - low + 1
    worst = -(1 << 30)
    score = [0] * width  # free to begin at any word
    state = [(0, -1, -1)] * width  # words that fit, first, last word of them
    n = len(words)
    for p, want in enumerate(template.tolist()):
        new, kept = [worst] * width, [(0, -1, -1)] * width
        for c in range(width):
            t = p + low + c
            if 0 <= t < n:
                fits = words[t] == want
                new[c] = score[c] + (1 if fits else -1)
                fit, first, last = state[c]
                kept[c] = (fit + 1, t if first < 0 else first, t) if fits else state[c]
            if c + 1 < width and score[c + 1] - 1 > new[c]:  # the template's word is left out
                new[c], kept[c] = score[c + 1] - 1, state[c + 1]
            if c and new[c - 1] - 1 > new[c]:  # a word is put in
                new[c], kept[c] = new[c - 1] - 1, kept[c - 1]
        score, state = new, kept
    best = max(range(width), key=lambda c: (score[c], state[c][0], -c))
    fit, first, last = state[best]
    return score[best], fit, first, last + 1


class Scanner:
    def __init__(self, templates: list[tuple[str, str]], coverage: float = COVERAGE):
        self.coverage = coverage
        words = [WORD.findall(t.lower()) for _, t in templates]
        self.names = [n for n, _ in templates]
        self.known = {w: k for k, w in enumerate(dict.fromkeys(w for ws in words for w in ws))}
        self.templates = [np.array([self.known[w] for w in ws], dtype=np.int64) for ws in words]
        self.telling = [telling(ws) for ws in words]
        self.least = [1.0 if len(ws) <= WHOLE else coverage for ws in words]
        self.bags = [np.unique(ids, return_counts=True) for ids in self.templates]
        index: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for k, ids in enumerate(self.templates):
            h = rolling(ids, GRAM)
            for p in winnow(h):
                index[int(h[p])].append((k, p))
        self.index = dict(index)
        self.prints = np.array(sorted(self.index), dtype=np.uint64)

    def candidates(self, ids: np.ndarray) -> list[tuple[int, int, int]]:
        """(template, least and greatest diagonal) of each group of hits."""
        strange = np.concatenate(([0], np.cumsum(ids < 0)))
        at = np.flatnonzero(strange[GRAM:] == strange[:-GRAM])
        h = rolling(ids, GRAM)[at]
        slot = np.searchsorted(self.prints, h)
        slot[slot == len(self.prints)] = 0
        hit = self.prints[slot] == h
        by: dict[int, list[int]] = defaultdict(list)
        for t, x in zip(at[hit].tolist(), h[hit].tolist()):
            for k, p in self.index[x]:
                by[k].append(t - p)
        out = []
        for k, diagonals in by.items():
            diagonals.sort()
            first = last = diagonals[0]
            for d in diagonals[1:]:
                if d - last > BAND or d - first > 4 * BAND:
                    out.append((k, first, last))
                    first = d
                last = d
            out.append((k, first, last))
        return out

    def _may_cover(self, k: int, ids: np.ndarray) -> bool:
        """Whether a stretch has enough of the template's words in any order: what it lacks cannot fit."""
        kinds, counts = self.bags[k]
        slot = np.minimum(np.searchsorted(kinds, ids), len(kinds) - 1)
        there = np.bincount(slot[kinds[slot] == ids], minlength=len(kinds))
        return np.minimum(there, counts).sum() >= self.least[k] * len(self.templates[k]) - 1e-9

    def finds(self, text: str) -> list[tuple[str, float, int, int, int]]:
        """(licence, coverage, words that fit, begin, end) in order of the text."""
        lower = text.lower()
        words = WORD.findall(lower) if len(lower) == len(text) else [w.lower() for w in WORD.findall(text)]
        best: list[tuple] = []
        for f in sorted(self.raw_finds(words)):
            if all(f[4] <= b[3] or f[3] >= b[4] for b in best):
                best.append(f)
        if not best:
            return []
        places = [m.span() for m in WORD.finditer(text)]
        return [(self.names[k], -c, -fit, places[a][0], places[b - 1][1]) for fit, c, k, a, b in sorted(best, key=lambda f: f[3])]

    def raw_finds(self, words: list[str]) -> list[tuple[int, float, int, int, int]]:
        """(minus words that fit, minus coverage, template, first word, end) of all finds, overlapping ones too."""
        if len(words) < GRAM or not len(self.prints):
            return []
        ids = np.fromiter(map(self.known.get, words, repeat(-1)), dtype=np.int64, count=len(words))
        found = []
        for k, low, high in self.candidates(ids):
            template = self.templates[k]
            begin, end = max(0, low - BAND), min(len(ids), high + len(template) + BAND)
            if not self._may_cover(k, ids[begin:end]):
                continue
            _, fit, first, stop = align(template, ids[begin:end], low - BAND - begin, high + BAND - begin)
            covered = (fit - max(0, stop - first - len(template))) / len(template)
            if first >= 0 and covered >= self.least[k] and self._same_version(k, words, begin + first, begin + stop):
                found.append((-fit, -covered, k, begin + first, begin + stop))
        return found

    def _same_version(self, k: int, words: list[str], begin: int, end: int) -> bool:
        """Whether the span tells the same licence as the template and no word before it takes it back; a version that goes on behind the span belongs to it."""
        if any(w in DENIALS for w in words[max(0, begin - 3) : begin]):
            return False
        if words[end - 1].isdigit() and end < len(words) and len(words[end]) == 1:
            end += words[end].isdigit()
        return telling(words[max(0, begin - 1) : end]) - telling(words[max(0, begin - 1) : begin]) == self.telling[k]


def scan(df: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, coverage: float = COVERAGE, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """A row for each find: keep, license, coverage, words, span_start, span_end."""
    columns, keep = apart(df, keep, "license", "coverage", "words", "span_start", "span_end", "text", "raw")
    df = df.select(*columns, text_or_empty(text).alias("text"))
    types = dict(df.dtypes)
    kept = [f"`{c}` {types[c]}" for c in keep]
    found = "license string, coverage double, words int, span_start int, span_end int"
    blocks = _blocks(templates)
    if len(blocks) == 1:
        sent = df.sparkSession.sparkContext.broadcast(blocks[0])

        def make():
            scanner = Scanner(sent.value, coverage)

            def work(*columns):
                rows = [(*k, *f) for *k, t in zip(*columns) for f in scanner.finds(t)]
                return list(zip(*rows)) or [[] for _ in range(len(keep) + 5)]

            return work

        return arrow_map(df, df.columns, ", ".join([*kept, found]), make)
    raw = "raw array<struct<fit: int, covered: double, template: int, begin: int, end: int, license: string, span_start: int, span_end: int>>"
    rows, first = df.withColumn("raw", F.array().cast(raw[4:])), 0
    for block in blocks:
        rows = _one_block(rows, kept, raw, block, first, coverage)
        first += len(block)

    def make_best():
        def work(*columns):
            out = []
            for *k, finds in zip(*columns):
                best: list[dict] = []
                for f in sorted(finds, key=lambda f: (f["fit"], f["covered"], f["template"])):
                    if all(f["end"] <= b["begin"] or f["begin"] >= b["end"] for b in best):
                        best.append(f)
                out += [(*k, f["license"], -f["covered"], -f["fit"], f["span_start"], f["span_end"]) for f in sorted(best, key=lambda f: f["begin"])]
            return list(zip(*out)) or [[] for _ in range(len(keep) + 5)]

        return work

    return arrow_map(rows, [*keep, "raw"], ", ".join([*kept, found]), make_best)


def _blocks(templates: list[tuple[str, str]]) -> list[list[tuple[str, str]]]:
    blocks, size = [[]], 0
    for t in templates:
        if blocks[-1] and size + len(t[1]) > BLOCK_LETTERS:
            blocks.append([])
            size = 0
        blocks[-1].append(t)
        size += len(t[1])
    return blocks


def _one_block(rows: DataFrame, kept: list[str], raw: str, block: list[tuple[str, str]], first: int, coverage: float) -> DataFrame:
    """rows with a block's finds added to ``raw``."""
    sent = rows.sparkSession.sparkContext.broadcast(block)

    def make():
        scanner = Scanner(sent.value, coverage)

        def work(*columns):
            *others, texts, before = columns
            out = []
            for text, known in zip(texts, before):
                found = scanner.raw_finds([w.lower() for w in WORD.findall(text)])
                places = [m.span() for m in WORD.finditer(text)] if found else []
                out.append([*known, *({"fit": f, "covered": c, "template": first + k, "begin": a, "end": b, "license": scanner.names[k], "span_start": places[a][0], "span_end": places[b - 1][1]} for f, c, k, a, b in found)])
            return [*others, texts, out]

        return work

    return arrow_map(rows, rows.columns, ", ".join([*kept, "text string", raw]), make)
