"""Packing of examples into training sequences by vector bin packing.

An example is a vector of tokens, one segment and loss-bearing tokens (its last ``loss`` tokens; a prompt before them bears none).
A sequence is a bin with a limit on each of the three. Bins are filled one at a time by the dot-product heuristic: of the waiting
examples that fit into what all three limits leave, the one enters whose vector has the largest dot product with the remaining
capacities, each counted as a share of its limit. If none fits, one is cut where the bin is full (``cut``); the rest of it waits on. An example
that no empty sequence takes is cut in any case, at the start of a sequence, before its rest is placed.

Every task packs its own rows as they come, with POOL examples waiting, so nothing is shuffled and memory does not grow with the input.
A task's last sequence, and one that the limit on segments or loss ends early, is short of tokens: with ``cut`` it becomes sequences whose
lengths are powers of two, which need no padding; without, it is padded.

Null texts count as empty; an example without tokens has no piece, an empty text with an end id has one. Very long texts are tokenised in
slices cut at white space. Repeated rows are packed each by itself; of equal dot products the longer waiting one is taken. A kept
column that is named like a result comes back with underscores before its name. An empty table gives an empty result.
"""

from __future__ import annotations

import uuid
import zlib
from array import array
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .bpe import byte_letters, load
from .common import apart, small_batches, text_or_empty

#: Examples that wait in a task, and chunks whose ids a worker keeps.
POOL, CACHE_CHUNKS = 512, 1_500_000
#: Signs that are one word of the tokenizer, however many stand behind letters.
SIGNS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: Letters of the longest chunk whose ids are kept, so that what is kept is bounded whatever the texts hold.
LONGEST = 40
#: Letters of a text that are tokenised at a time, about.
SLICE = 1 << 20
#: Bits of a sequence's number within its task.
TASK_BITS = 36


class Limits(NamedTuple):
    """What a sequence may hold."""

    tokens: int = 4096
    segments: int = 256
    loss: int = 4096


class Piece(NamedTuple):
    example: int
    start: int
    length: int
    loss: int
    sequence: int
    offset: int


class Packer:
    """Packs one stream of examples. add() and finish() give the sequences that have become full, as lists of pieces."""

    def __init__(self, limits: Limits, cut: bool = True):
        if min(limits) < 1:
            raise ValueError("limits start at 1")
        self.limits, self.cut, self.sequences, self.examples = limits, cut, 0, 0
        self.start, self.end, self.bears, self.name = (np.zeros(POOL, dtype=np.int64) for _ in range(4))
        self.waiting = 0

    def add(self, tokens: int, loss: int) -> Iterator[list[Piece]]:
        """The next example, numbered from 0."""
        if not 0 <= loss <= tokens:
            raise ValueError("an example has from 0 to all of its tokens in the loss")
        k = int(np.argmax(self.end == self.start))
        self.start[k], self.end[k], self.bears[k], self.name[k] = 0, tokens, tokens - loss, self.examples
        self.examples += 1
        self.waiting += tokens > 0
        while self.waiting == POOL:
            yield from self._fill()

    def finish(self) -> Iterator[list[Piece]]:
        while self.waiting:
            yield from self._fill()

    def _take(self, k: int, length: int, bin_: list) -> int:
        """Cut the first ``length`` tokens of waiting example k into the bin; their loss."""
        at = int(self.start[k])
        loss = max(0, at + length - max(at, int(self.bears[k])))
        bin_.append((int(self.name[k]), at, length, int(self.bears[k])))
        self.start[k] += length
        self.waiting -= self.start[k] == self.end[k]
        return loss

    def _fill(self) -> Iterator[list[Piece]]:
        most, bin_ = self.limits, []
        tokens, segments, loss = most
        while tokens and segments and self.waiting:
            left = self.end - self.start
            bearing = self.end - np.maximum(self.start, self.bears)
            fits = (left > 0) & (left <= tokens) & (bearing <= loss)
            too_large = (left > tokens) | (bearing > loss)
            if (not bin_ and too_large.any()) or (self.cut and not fits.any()):
                room = np.minimum(left, np.minimum(tokens, np.maximum(self.bears - self.start, 0) + loss))
                k = self._first_best(np.where(too_large, room, 0))
                length = int(room[k])
                if length < 1:
                    break
            elif fits.any():
                score = left * (tokens / most.tokens**2) + bearing * (loss / most.loss**2) + segments / most.segments**2
                k = self._first_best(np.where(fits, score, -1.0))
                length = int(left[k])
            else:
                break
            loss -= self._take(k, length, bin_)
            tokens, segments = tokens - length, segments - 1
        yield from self._sequences(bin_, most.tokens - tokens)

    def _first_best(self, score: np.ndarray) -> int:
        best = np.flatnonzero(score == score.max())
        return int(best[np.argmin(self.name[best])])

    def _sequences(self, bin_: list, used: int) -> Iterator[list[Piece]]:
        """A full bin is one sequence; one short of tokens is cut into lengths that are powers of two, the longest first."""
        lengths = [used] if used == self.limits.tokens or not self.cut else [1 << b for b in reversed(range(used.bit_length())) if used >> b & 1]
        rest = iter(bin_)
        example, at, left, bears = next(rest)
        for room in lengths:
            offset, out = 0, []
            while offset < room:
                if not left:
                    example, at, left, bears = next(rest)
                length = min(left, room - offset)
                out.append(Piece(example, at, length, max(0, at + length - max(at, bears)), self.sequences, offset))
                at, left, offset = at + length, left - length, offset + length
            self.sequences += 1
            yield out


class TextIds:
    """Token ids of texts as little-endian unsigned 32-bit numbers, by a tokenizer file whose words end at white space. A batch's texts are
    normalised, cut at white space and reduced to their different chunks by Arrow. A chunk's words go to the BPE model of the tokenizers
    library as bytes' letters, each once: before them the library would only repeat what has been done. Words are known by themselves, so
    that a chunk with other punctuation is put together from what is known."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.words, self.cache = load(path), {}
        library = Tokenizer.from_file(path)
        self.tokenize, self.cut = library.model.tokenize, library.pre_tokenizer.pre_tokenize_str
        self.letters = dict(enumerate(byte_letters()))

    @staticmethod
    def _slices(text: str) -> Iterator[str]:
        at = 0
        while len(text) - at > SLICE:
            end = text.rfind(" ", at + 1, at + SLICE)
            end = end if end > 0 else text.find(" ", at + SLICE)
            if end < 0:
                break
            yield text[at:end]
            at = end
        yield text[at:]

    def _keep(self, chunk: str, ids: bytes) -> bytes:
        if len(chunk) <= LONGEST:
            if len(self.cache) >= CACHE_CHUNKS:
                self.cache.clear()
            self.cache[chunk] = ids
        return ids

    def _ids(self, letters: str) -> bytes:
        return array("I", [t.id for t in self.tokenize(letters)]).tobytes()

    def _word(self, word: str) -> bytes:
        ids = self.cache.get(word)
        if ids is not None:
            return ids
        plain = word.isascii() and word.isprintable()
        return self._keep(word, self._ids(word if plain else word.encode().decode("latin-1").translate(self.letters)))

    def _learn(self, chunk: str) -> bytes:
        if chunk.isalpha():
            return self._word(chunk)
        if chunk.startswith(" "):
            return array("I", [self.words.special[chunk[1:]]]).tobytes()
        head = chunk.rstrip(SIGNS)
        if head.isalpha() and len(head) < len(chunk):
            ids = self._word(head) + self._word(chunk[len(head) :])
        elif chunk.isascii():
            ids = b"".join(map(self._word, self.words.words.findall(chunk)))
        else:  # the library may count letters that are newer than Python's tables
            ids = b"".join([self._ids(letters) for letters, _ in self.cut(chunk)])
        return self._keep(chunk, ids)

    def _short(self, texts: list[str]) -> list[bytes]:
        """Texts with special tokens come last, as their chunks are not cut by Arrow."""
        special, normal, out = self.words.special, self.words.normal, [b""] * len(texts)
        marked = [any(s in t for s in special) for t in texts]
        order = sorted(range(len(texts)), key=marked.__getitem__)
        plain = pc.ascii_split_whitespace(pa.array([normal(t) for t, m in zip(texts, marked) if not m], pa.string()))
        split = pa.concat_arrays([plain, pa.array([self.words.chunks(t) for t, m in zip(texts, marked) if m], plain.type)])
        chunks = split.flatten().dictionary_encode()
        if not len(chunks):
            return out
        different = chunks.dictionary.to_pylist()
        known = [self._learn(c) if ids is None else ids for c, ids in zip(different, list(map(self.cache.get, different)))]
        ids = pa.array(known, pa.binary()).take(chunks.indices)
        _, offsets, raw = ids.buffers()
        ends, raw = np.frombuffer(offsets, np.int32)[split.offsets.to_numpy()].tolist(), memoryview(raw or b"")
        for k, a, b in zip(order, ends, ends[1:]):
            out[k] = raw[a:b].tobytes()
        return out

    def encode(self, texts: list[str], end_id: int | None = None) -> list[bytes]:
        end = b"" if end_id is None else array("I", [end_id]).tobytes()
        short = iter(self._short([t for t in texts if len(t) <= SLICE]))
        return [(next(short) if len(t) <= SLICE else b"".join([self._short([s])[0] for s in self._slices(t)])) + end for t in texts]


_KNOWN: dict[tuple[str, str], TextIds] = {}


def text_ids(path: str, call: str) -> TextIds:
    """What this worker knows of a tokenizer file, kept from one task of a call of pack_texts() to the next; another call starts anew."""
    if (path, call) not in _KNOWN:
        _KNOWN.clear()
        _KNOWN[path, call] = TextIds(path)
    return _KNOWN[path, call]


def _packed(df: DataFrame, keep: list[str], limits: Limits, cut: bool, full: bool, make) -> DataFrame:
    """df: the columns of ``keep`` and others that make()'s result turns into (ids as bytes, number of loss-bearing tokens) rows."""
    types = dict(df.dtypes)
    results = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, loss long" + ", ids array<int>" * full
    schema = df.sparkSession.createDataFrame([], ", ".join([f"`{c}` {types[c]}" for c in keep] + [results])).schema
    arrow = to_arrow_schema(schema)
    small_batches(df.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        examples, packer, rows = make(), Packer(limits, cut), []
        base, live = TaskContext.get().partitionId() << TASK_BITS, {}

        def emit(sequences: Iterable[list[Piece]]) -> None:
            for sequence in sequences:
                for p in sequence:
                    kept, ids = live[p.example]
                    part = ids[4 * p.start : 4 * (p.start + p.length)]
                    row = (*kept, p.start, p.length, zlib.crc32(part), len(ids) // 4, base + p.sequence, p.offset, p.loss)
                    rows.append((*row, array("I", part).tolist()) if full else row)
                    if p.start + p.length == len(ids) // 4:
                        del live[p.example]

        def batch() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows), arrow.types, strict=True)], schema=arrow)
            rows.clear()
            return out

        for b in batches:
            columns = [c.to_pylist() for c in b.columns]
            for *kept, (ids, loss) in zip(*columns[: len(keep)], examples(*columns[len(keep) :])):
                if ids:
                    live[packer.examples] = kept, ids
                emit(packer.add(len(ids) // 4, loss))
                if len(rows) >= 5000:
                    yield batch()
        emit(packer.finish())
        if rows:
            yield batch()

    return df.mapInArrow(run, schema)


RESULTS = ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "loss", "ids")


def pack_texts(df: DataFrame, path: str, limits: Limits = Limits(), keep: tuple[str, ...] = ("doc_id",), text: str = "text", end_id: int | None = 2, cut: bool = True, full: bool = True) -> DataFrame:
    """A row for each piece: keep, start (tokens of its text before it), length, ids_crc32, doc_tokens, sequence_id, offset (in the sequence),
    loss (its loss-bearing tokens: all of a text's but the first) and, if ``full``, ids."""
    columns, names = apart(df, keep, *RESULTS, "text")
    call = uuid.uuid4().hex

    def make():
        tokenizer = text_ids(path, call)

        def examples(texts):
            return [(ids, max(0, len(ids) // 4 - 1)) for ids in tokenizer.encode(texts, end_id)]

        return examples

    return _packed(df.select(*columns, text_or_empty(text).alias("text")), names, limits, cut, full, make)


def pack_ids(df: DataFrame, limits: Limits = Limits(), keep: tuple[str, ...] = ("doc_id",), ids: str = "ids", loss: str | None = None, cut: bool = False, full: bool = True) -> DataFrame:
    """As pack_texts(), for token ids (array of int; null: none) of instruction data; loss names the column with the number of tokens at an
    example's end that bear loss (null: none); without it all do."""
    columns, names = apart(df, keep, *RESULTS, "bearing")
    bearing = F.coalesce(F.col(loss).cast("long"), F.lit(0)) if loss else F.size(F.coalesce(F.col(ids), F.array().cast("array<int>")))

    def make():
        def examples(lists, bearing):
            return [(array("I", x or []).tobytes(), n) for x, n in zip(lists, bearing)]

        return examples

    return _packed(df.select(*columns, F.col(ids).cast("array<int>").alias("ids"), bearing.alias("bearing")), names, limits, cut, full, make)
