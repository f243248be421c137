"""BPE encoding and decoding by a pair occurrence index.

A task gathers the distinct words of a batch that it has not met yet, lays their symbols end to end, and maps each
mergeable pair to all its positions. Ranks that have positions are applied in ascending order; each merge updates the
lists of the pairs beside it. Results of words are kept in a bounded cache per worker.

Null text counts as empty; an empty text has no tokens. Repeated rows give repeated rows. Other columns are dropped
unless named in ``keep``; a kept one that is named like a result comes back with underscores before its name.
"""

from __future__ import annotations

import hashlib
import json
from heapq import heapify, heappop, heappush

import regex
from pyspark.sql import DataFrame

from .common import apart, arrow_map, text_or_empty

#: Words whose results a worker keeps.
CACHE_WORDS = 500_000
#: Stand for the end of a word and for a symbol that a merge has taken in; no vocabulary reaches them.
WALL, GONE = (1 << 20) - 1, (1 << 20) - 2
#: Python takes these for white space, tokenizer files do not.
SEPARATORS = "\x1c\x1d\x1e\x1f"

_LOADED: dict[str, WordBpe] = {}


def byte_letters() -> list[str]:
    """The printable letter that byte-level vocabularies use for each byte: itself if visible, else one from 256 on."""
    visible = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    others = [b for b in range(256) if b not in set(visible)]
    letters = {b: chr(b) for b in visible} | {b: chr(256 + i) for i, b in enumerate(others)}
    return [letters[b] for b in range(256)]

WHITE = regex.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")


class WordBpe:
    """A tokenizer file with word ends (``</w>``), lower case and white space dropped."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model.get("dropout") or model.get("continuing_subword_prefix") or not model.get("end_of_word_suffix"):
            raise ValueError("a BPE file with word ends and without dropout is needed")
        from tokenizers import Tokenizer

        self.normalizer = Tokenizer.from_file(path).normalizer
        self.suffix = model["end_of_word_suffix"]
        self.vocab: dict[str, int] = model["vocab"]
        self.tokens = {i: t for t, i in self.vocab.items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_split = regex.compile("(" + "|".join(regex.escape(s) for s in self.special) + ")") if self.special else None
        self.words = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.letter_id = [self.vocab[x] for x in byte_letters()]
        self.last_id = [self.vocab[x + self.suffix] for x in byte_letters()]
        born: dict[int, int] = {}
        self.merges: dict[int, int] = {}  # rank of a pair, its ids in 20 bits each
        self.pair_of_rank: dict[int, tuple[int, int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            ids = self.vocab[a], self.vocab[b]
            if max(born.get(i, -1) for i in ids) >= rank:
                raise ValueError("a merge uses a token that a later rank makes")
            born.setdefault(self.vocab[a + b], rank)
            if self.merges.setdefault(ids[0] << 20 | ids[1], rank) == rank:
                self.pair_of_rank[rank] = (*ids, self.vocab[a + b])
        self.cache: dict[str, tuple[str, str, int]] = {}

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """Ids of each word (not empty), all words at once through the index."""
        letter_id, last_id, merges, pair_of_rank = self.letter_id, self.last_id, self.merges, self.pair_of_rank
        symbol: list[int] = []
        ends = []
        for word in words:
            raw = word.encode()
            symbol += [letter_id[x] for x in raw]
            symbol[-1] = last_id[raw[-1]]
            ends.append(len(symbol))
            symbol.append(WALL)
        n = len(symbol)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        find = merges.get
        where: dict[int, list[int]] = {}
        for p, rank in enumerate(map(find, [a << 20 | b for a, b in zip(symbol, symbol[1:])])):
            if rank is not None:
                if rank in where:
                    where[rank].append(p)
                else:
                    where[rank] = [p]
        active = list(where)
        heapify(active)
        while active:
            rank = heappop(active)
            places = where.pop(rank)
            places.sort()
            a, b, new = pair_of_rank[rank]
            high = new << 20
            for p in places:
                if symbol[p] != a:
                    continue
                q = after[p]
                if symbol[q] != b:
                    continue
                symbol[p], symbol[q] = new, GONE
                r = after[p] = after[q]
                before[r] = p
                left = before[p]
                m = find(symbol[left] << 20 | new)
                if m is not None:
                    if m in where:
                        where[m].append(left)
                    else:
                        where[m] = [left]
                        heappush(active, m)
                m = find(high | symbol[r])
                if m is not None:
                    if m in where:
                        where[m].append(p)
                    else:
                        where[m] = [p]
                        heappush(active, m)
        out, start = [], 0
        for end in ends:
            out.append([s for s in symbol[start:end] if s != GONE])
            start = end + 1
        return out

    def normal(self, text: str) -> str:
        try:
            text.encode("latin-1")  # no letter of it is composed or has a case that depends on its place
        except UnicodeEncodeError:
            return self.normalizer.normalize_str(text)
        return text.lower()

    def chunks(self, text: str) -> list[str]:
        """Pieces between white space; a special token is a piece of its own, marked by a leading space."""
        if self.special_split is None or not any(s in text for s in self.special):
            return self.pieces(self.normal(text))
        out = []
        for part in self.special_split.split(text):
            out += [" " + part] if part in self.special else self.pieces(self.normal(part))
        return out

    @staticmethod
    def pieces(text: str) -> list[str]:
        if any(c in text for c in SEPARATORS):
            return [x for x in WHITE.split(text) if x]
        return text.split()

    def learn(self, missing: list[str]) -> None:
        """Fill the cache: ids and tokens of each chunk and of its words, joined by one space."""
        split, cache, wanted = [], self.cache, set()
        for chunk in missing:
            if chunk[0] == " ":
                cache[chunk] = (str(self.special[chunk[1:]]), chunk[1:], 1)
                continue
            if chunk.isalpha():
                words = [chunk]
            elif chunk[-1] in ".," and chunk[:-1].isalpha():
                words = [chunk[:-1], chunk[-1]]
            else:
                words = self.words.findall(chunk)
            split.append((chunk, words))
            wanted.update(words)
        new = [w for w in wanted if w not in cache]
        tokens = self.tokens
        for word, ids in zip(new, self.encode_words(new), strict=True):
            cache[word] = (" ".join(map(str, ids)), " ".join([tokens[i] for i in ids]), len(ids))
        for chunk, words in split:
            if len(words) != 1 or words[0] != chunk:
                parts = [cache[w] for w in words]
                cache[chunk] = (" ".join([x[0] for x in parts]), " ".join([x[1] for x in parts]), sum([x[2] for x in parts]))

    def encode_batch(self, texts: list[str]) -> list[tuple[str, str, int]]:
        """For each text its ids and its decoded form, as the library joins tokens where no decoder is set."""
        split = [self.chunks(t) for t in texts]
        missing = list(set().union(*split).difference(self.cache))
        if len(self.cache) + len(missing) > CACHE_WORDS:
            self.cache.clear()
            missing = list(set().union(*split))
        self.learn(missing)
        out = []
        for chunks in split:
            got = [g for g in map(self.cache.__getitem__, chunks) if g[2]]
            out.append((" ".join([g[0] for g in got]), " ".join([g[1] for g in got]), sum([g[2] for g in got])))
        return out


def load(path: str) -> WordBpe:
    if path not in _LOADED:
        _LOADED[path] = WordBpe(path)
    return _LOADED[path]


def encode(df: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id",), text: str = "text", full: bool = True) -> DataFrame:
    """The columns of ``keep`` with n_tokens, ids_sha256, decoded_sha256 and, if ``full``, ids (array) and decoded."""
    columns, keep = apart(df, keep, "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded", "text")
    df = df.select(*columns, text_or_empty(text).alias("text"))
    types = dict(df.dtypes)
    schema = ", ".join([f"`{c}` {types[c]}" for c in keep] + ["n_tokens long, ids_sha256 string, decoded_sha256 string"] + ["ids array<int>, decoded string"] * full)

    def make():
        bpe = load(path)

        def work(*columns):
            rows = bpe.encode_batch(columns[-1])
            sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
            out = [*columns[:-1], [r[2] for r in rows], [sha(r[0]) for r in rows], [sha(r[1]) for r in rows]]
            return out + ([[[int(i) for i in r[0].split()] for r in rows], [r[1] for r in rows]] if full else [])

        return work

    return arrow_map(df, df.columns, schema, make)
