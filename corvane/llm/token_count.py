"""Token counts of whole texts; huge ones by overlap resynchronisation.

A text of more than CHUNK letters is encoded in chunks that overlap, with offsets. Two neighbours are spliced at a place
where both have a token end, a visible letter stands before and white space after. The pre-tokenizer always cuts there,
whatever stands further left or right, so the tokens on either side are those of the whole text. If an overlap has no
such place, it is widened, at last to the whole rest of the text.

Shorter texts are cut at the same kind of place into units, whose counts a worker keeps in a bounded cache.

Null text counts as empty (0 tokens). Repeated rows give repeated rows. Other columns are dropped unless named in ``keep``; a kept
one that is named like a result comes back with underscores before its name. An empty table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_right

import regex
from pyspark.sql import DataFrame

from .common import apart, arrow_map, text_or_empty

#: Letters in a chunk, letters of overlap to begin with, units whose counts a worker keeps.
CHUNK, OVERLAP, CACHE_UNITS = 16_384, 512, 1_000_000

#: Unicode's white space, as tokenizer files see it (Python's isspace() has four letters more).
SPACES = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
RUNS = regex.compile(f"[{SPACES}]{{2}}")
UNITS = regex.compile(f"[{SPACES}]*[^{SPACES}]+|[{SPACES}]+")
STABLE = regex.compile(f"(?<=[^{SPACES}])(?=[{SPACES}])")

_LOADED: dict[str, Counter] = {}


class Counter:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.cache: dict[str, int] = {}

    def lengths(self, texts: list[str]) -> list[int]:
        return [len(e.ids) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    @staticmethod
    def units(text: str) -> list[str]:
        if not text or RUNS.search(text):
            return UNITS.findall(text)
        first, *rest = text.split(" ")
        if not first:  # the text begins with a space
            return [" " + x for x in rest]
        return [first, *[" " + x for x in rest]]

    def count_batch(self, texts: list[str], chunk: int = CHUNK, overlap: int = OVERLAP) -> list[int]:
        split = [self.units(t) if len(t) <= chunk else None for t in texts]
        wanted = set().union(*(u for u in split if u is not None))
        missing = list(wanted.difference(self.cache))
        if len(self.cache) + len(missing) > CACHE_UNITS:
            self.cache.clear()
            missing = list(wanted)
        self.cache.update(zip(missing, self.lengths(missing), strict=True))
        one = self.cache.__getitem__
        return [self.count_huge(t, chunk, overlap) if u is None else sum(map(one, u)) for t, u in zip(texts, split, strict=True)]

    def ends(self, text: str, start: int, stop: int) -> list[int]:
        """Where the tokens of text[start:stop] end, as offsets of the whole text."""
        return [start + b for _, b in self.tokenizer.encode(text[start:stop], add_special_tokens=False).offsets]

    def count_huge(self, text: str, chunk: int, overlap: int) -> int:
        start, cut, total = 0, 0, 0  # this chunk's start; tokens that end at or before cut are counted
        stop = min(len(text), chunk)
        ends = self.ends(text, start, stop)
        while stop < len(text):
            wide, found = overlap, None
            while found is None:
                nxt = max(cut, stop - wide)
                if nxt == cut and wide > overlap:  # nothing to splice at: encode further from the last cut
                    stop = min(len(text), stop + wide)
                    ends = self.ends(text, cut, stop)
                    if stop == len(text):
                        return total + len(ends)
                    start, wide = cut, overlap
                    continue
                right_stop = min(len(text), stop + chunk - overlap)
                right = self.ends(text, nxt, right_stop)
                known = set(right)
                for m in STABLE.finditer(text, nxt + 1, stop):
                    p = m.start()
                    if p > cut and p in known and (i := bisect_right(ends, p)) and ends[i - 1] == p:
                        found = p
                        break
                wide *= 4
            total += bisect_right(ends, found) - (bisect_right(ends, cut) if start < cut else 0)
            start, stop, ends, cut = nxt, right_stop, right, found
        return total + len(ends) - (bisect_right(ends, cut) if start < cut else 0)


def load(path: str) -> Counter:
    if path not in _LOADED:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _LOADED[path] = Counter(path)
    return _LOADED[path]


def count_tokens(df: DataFrame, path: str, limit: int = 1024, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """The columns of ``keep`` with n_bytes, n_tokens and over_limit (n_tokens > limit)."""
    columns, keep = apart(df, keep, "n_bytes", "n_tokens", "over_limit", "text")
    df = df.select(*columns, text_or_empty(text).alias("text"))
    types = dict(df.dtypes)
    schema = ", ".join([f"`{c}` {types[c]}" for c in keep] + ["n_bytes long, n_tokens long, over_limit boolean"])

    def make():
        counter = load(path)

        def work(*columns):
            n = counter.count_batch(columns[-1])
            return [*columns[:-1], [len(t.encode()) for t in columns[-1]], n, [x > limit for x in n]]

        return work

    return arrow_map(df, df.columns, schema, make)
