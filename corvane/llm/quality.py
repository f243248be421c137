"""Quality classification by importance resampling.

Two bag models over hashed n-grams (words and pairs of words, BUCKETS buckets): one of target text, one of the raw text. A
document's log-weight is the log-ratio of both likelihoods in its worst window of WINDOW words: the lowest mean over the words and
pairs of any window of the whole text, times the 2 * WINDOW features of one, so texts of all lengths have one scale. Documents are drawn without replacement by their
weights: the k largest of log-weight plus Gumbel noise. The noise is a function of seed and text hash, so a rerun draws the same. It has a
deviation of 1.3 where weights lie tens and hundreds apart, and k comes from a cut on the weights: the draw decides about rows near that cut
only, which is thus a cut with a soft edge.

The raw model counts all documents. The target model counts the rows labelled good, at most FIT_ROWS of them (the least hashes
of their ids), which bounds the list of ids that tasks get. Every other of them is held out of the model; with at most FIT_ROWS of
the rows labelled otherwise, which the target model never counts, they set the cut: of the log-weights that all but a share of DROP
of the good reach (interpolated), the one that parts both groups best, the smallest share among equals. Without rows labelled
otherwise it is the first share. k is the number of documents, of all, whose log-weight is at least the cut.

The k-th largest key is found by counting keys in ever finer histograms of 4096 bins; no task sorts all keys. Rows that tie
with it are all kept. Null text counts as empty and has log-weight 0. Without labelled rows every row is kept.
"""

from __future__ import annotations

import re
import zlib
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, free_names, small_batches, staged, text_or_empty, unstage

BUCKETS, FIT_ROWS, DROP, SEED, WINDOW = 10_000, 20_000, (0.001, 0.002, 0.005, 0.01, 0.02), 17, 50
TOKEN = re.compile(r"\w+|[^\w\s]+")
CACHE_CHUNKS = 150_000


class _Hashes(dict):
    """Hashes of the tokens in a piece between white space, kept for the pieces met so far."""

    def __missing__(self, piece: str) -> tuple[int, ...]:
        if len(self) >= CACHE_CHUNKS:
            self.clear()
        found = self[piece] = tuple([zlib.crc32(w.encode()) for w in TOKEN.findall(piece)])
        return found


_HASHES = _Hashes()


def features(text: str, buckets: int) -> np.ndarray:
    """The buckets of all words, then of all pairs of neighbours, repeats included."""
    h = np.fromiter(chain.from_iterable(map(_HASHES.__getitem__, text.split())), dtype=np.uint64)
    return np.concatenate((h, h[:-1] * np.uint64(2654435761) + h[1:])) % np.uint64(buckets)


def worst_window(text: str, ratio: np.ndarray) -> float:
    """The log-weight of a text. A pair belongs to the window of its first word; a text shorter than a window is one."""
    r = ratio[features(text, len(ratio)).astype(np.int64)]
    n = (len(r) + 1) // 2
    if not n:
        return 0.0
    words = r[:n].copy()
    words[:-1] += r[n:]
    if n <= WINDOW:
        return float(words.sum() / (2 * n - 1) * 2 * WINDOW)
    sums = np.concatenate(([0.0], words.cumsum()))
    sums = sums[WINDOW:] - sums[:-WINDOW]
    sums[-1] *= 2 * WINDOW / (2 * WINDOW - 1)
    return float(sums.min())


def _target_ids(labels: DataFrame, good, id_column: str) -> list:
    ids = labels.where(good).select(id_column).where(F.col(id_column).isNotNull()).distinct()
    return [r[0] for r in ids.orderBy(F.xxhash64(id_column), id_column).limit(FIT_ROWS).collect()]


def fit(df: DataFrame, labels: DataFrame, good, buckets: int = BUCKETS, id_column: str = "doc_id", text: str = "text") -> tuple[np.ndarray, list]:
    """The log-ratio of each bucket (raw model over all of df), and the ids of the labelled rows held out."""
    ids = _target_ids(labels, good, id_column)
    sent = df.sparkSession.sparkContext.broadcast(frozenset(ids[::2]))

    def counted(batches):
        import pyarrow as pa

        counts = np.zeros((2, buckets), dtype=np.int64)
        for b in batches:
            for i, t in zip(*(c.to_pylist() for c in b.columns)):
                n = np.bincount(features(t, buckets).astype(np.int64), minlength=buckets)
                counts[0] += n
                if i in sent.value:
                    counts[1] += n
        k = np.flatnonzero(counts[0])
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(k, pa.int32()), "raw": pa.array(counts[0][k], pa.int64()), "target": pa.array(counts[1][k], pa.int64())})

    small_batches(df.sparkSession)
    parts = df.select(id_column, text_or_empty(text)).mapInArrow(counted, "bucket int, raw long, target long")
    model = np.zeros((2, buckets))
    for r in parts.groupBy("bucket").agg(F.sum("raw"), F.sum("target")).collect():
        model[:, r[0]] = r[1], r[2]
    log = [np.log(m + 1) - np.log(m.sum() + buckets) for m in model]
    return log[1] - log[0], ids[1::2] or ids


def score(df: DataFrame, ratio: np.ndarray, keep: tuple[str, ...] = ("doc_id",), id_column: str = "doc_id", text: str = "text", seed: int = SEED, names: tuple[str, str] = ("log_weight", "draw_key")) -> DataFrame:
    """The columns of ``keep`` (the text may be one) with log_weight and draw_key (log_weight plus Gumbel noise), named by ``names``."""
    types = dict(df.dtypes)
    sent = df.sparkSession.sparkContext.broadcast(ratio)

    def make():
        def work(*columns):
            weights = [worst_window(t, sent.value) for t in columns[-2]]
            return [*columns[:-2], weights, columns[-1]]

        return work

    whole, (body, noise) = text_or_empty(text), free_names(df, "__text", "__noise")
    uniform = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(id_column), whole), 11).cast("double") + 0.5) / float(1 << 53)
    base = df.select(*keep, whole.alias(body), uniform.alias(noise))
    schema = ", ".join([f"`{c}` {types[c]}" for c in keep] + [f"`{n}` double" for n in names])
    out = arrow_map(base, base.columns, schema, make)
    return out.withColumn(names[1], F.col(names[0]) - F.log(-F.log(names[1])))


def kth_largest(values: DataFrame, k: int) -> float:
    """The k-th largest of a column ``x`` without nulls, by counting; exact."""
    low, high = values.agg(F.min("x"), F.max("x")).first()
    above = 0  # values over high
    while low < high:
        step = (high - low) / 4096
        if step == 0 or low + step == low or high - step == high:
            rows = values.where(F.col("x").between(low, high)).groupBy("x").count().collect()
            for x, n in sorted(((r["x"], r["count"]) for r in rows), reverse=True):
                above += n
                if above >= k:
                    return x
        bins = values.where(F.col("x").between(low, high)).groupBy(F.least(F.floor((F.col("x") - low) / step), F.lit(4095)).alias("b"))
        rows = bins.agg(F.count("*").alias("n"), F.min("x").alias("low"), F.max("x").alias("high")).collect()
        for r in sorted(rows, key=lambda r: -r["b"]):
            if above + r["n"] >= k:
                low, high = r["low"], r["high"]
                break
            above += r["n"]
    return low


def best_cut(good: np.ndarray, bad: np.ndarray) -> float:
    """The quantile of the good, at a share of DROP, that rejects most of the bad less what it rejects of the good."""
    cuts = np.quantile(good, DROP if len(bad) else DROP[:1])
    gains = [(bad < c).mean() - (good < c).mean() if len(bad) else 0.0 for c in cuts]
    return float(cuts[int(np.argmax(gains))])


def _drawn(df: DataFrame, labels: DataFrame, good, buckets: int, id_column: str, text: str, keep: tuple[str, ...], names: tuple[str, str]) -> tuple[DataFrame, float | None]:
    """The columns of ``keep`` with log_weight and draw_key, called ``names``, of df's rows, written once; the least draw_key that is
    selected (null: all are)."""
    good = (F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0) if good is None else good
    ratio, ids = fit(df, labels, good, buckets, id_column, text)
    scored = staged(score(df, ratio, keep, id_column, text, names=names), "scores")
    weight, key = names

    def weights(chosen: list) -> np.ndarray:
        target = df.sparkSession.createDataFrame([(i,) for i in chosen], scored.select(id_column).schema)
        known = scored.select(id_column, weight).join(F.broadcast(target), id_column, "left_semi").groupBy(id_column).agg(F.min(weight))
        return np.array([r[1] for r in known.collect()])

    held = weights(ids)
    if not len(held):
        return scored, None
    cut = best_cut(held, weights(_target_ids(labels, ~good, id_column)))
    k = scored.where(F.col(weight) >= cut).count()
    return scored, kth_largest(scored.select(F.col(key).alias("x")), k)


def classify(df: DataFrame, labels: DataFrame, good=None, buckets: int = BUCKETS, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """id, log_weight, draw_key and selected for each row of df. good: a condition on labels (quality 1 and not toxic)."""
    scored, least = _drawn(df, labels, good, buckets, id_column, text, (id_column,), ("log_weight", "draw_key"))
    return scored.withColumn("selected", F.lit(True) if least is None else F.col("draw_key") >= F.lit(least))


def keep_selected(df: DataFrame, labels: DataFrame, good=None, buckets: int = BUCKETS, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of df, all columns, that classify() selects."""
    weight, draw, one, two, gone_one, gone_two = free_names(df, "log_weight", "draw_key", "__one", "__two", "__gone_one", "__gone_two")
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    # two hashes of id and text stand for a row: rows of one id and text have one draw
    keys = {one: F.xxhash64(F.col(id_column), body), two: F.xxhash64(F.lit(1), body, F.col(id_column))}
    scored, least = _drawn(df.withColumns(keys), labels, good, buckets, id_column, text, (id_column, one, two), (weight, draw))
    if least is None:
        return df
    gone = staged(scored.where(F.col(draw) < F.lit(least)).select(F.col(one).alias(gone_one), F.col(two).alias(gone_two)).distinct(), "rejected")
    unstage(scored)
    # hashed at every size: a table that grows with the input is not broadcast, and texts need no sort
    return df.join(gone.hint("shuffle_hash"), (keys[one] == F.col(gone_one)) & (keys[two] == F.col(gone_two)), "left_anti")
