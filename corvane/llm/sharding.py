"""Sharding by best-fit-decreasing bin packing of indivisible groups.

Groups are equal keys (equal texts). The driver never sees groups: Spark counts them by size class (exact up to 256 bytes and from
EXACT of a shard on, between them 256 classes for each power of two), a histogram of a few thousand classes and at most 1 / EXACT for
each shard. Groups that decide whether another one fits thus count with their own size; of the small ones a class has one size, its
largest in ``pack`` (0.4 % too much at most) and its mean in ``pack_into``.
Groups of one class are interchangeable, so best-fit-decreasing over the histogram is best-fit-decreasing over the groups:
a class enters the bin with the tightest remaining capacity that takes it, as many of its groups as fit, then the next.
The bins stand in a balanced tree by remaining capacity. The plan is a short list of runs (class, first rank, last rank,
bin); a group's rank in its class comes from counts of hash parts, never from one sorted task.

``pack`` minimises shards of a fixed capacity (a group larger than that has a shard of its own). ``pack_into`` fills a given
number of shards nearly equally: groups larger than an equal share get a shard of their own, the rest the least capacity
at which best-fit-decreasing needs no more shards than there are.

Null texts count as empty; a very long text is a large group. Repeated rows are rows of the same group. Of equally large groups the
less hash comes first, of equally full bins the older one. A kept column that is named like a result comes back with underscores before its
name. An empty table gives an empty result.
"""

from __future__ import annotations

from random import Random

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import apart, staged, work_path

#: Groups in one hash part, within which ranks are counted by a window.
PART_GROUPS = 50_000
#: Groups of at least this share of a shard count with their exact size.
EXACT = 1 / 16


class CapacityTree:
    """A treap of (remaining capacity, bin): insert, and take the tightest bin that has room."""

    def __init__(self):
        self.root, self.random = None, Random(1)

    def _split(self, node, key):
        if node is None:
            return None, None
        if node[0] < key:
            node[2], high = self._split(node[2], key)
            return node, high
        low, node[1] = self._split(node[1], key)
        return low, node

    def _join(self, low, high):
        if low is None or high is None:
            return low or high
        if low[3] > high[3]:
            low[2] = self._join(low[2], high)
            return low
        high[1] = self._join(low, high[1])
        return high

    def insert(self, remaining: float, bin_no: int) -> None:
        low, high = self._split(self.root, (remaining, bin_no))
        self.root = self._join(self._join(low, [(remaining, bin_no), None, None, self.random.random()]), high)

    def take(self, room: float):
        """Remove and return the (remaining, bin) with the least remaining capacity of at least room; None if there is none."""
        low, high = self._split(self.root, (room, -1))
        if high is None:
            self.root = low
            return None
        path, node = None, high
        while node[1] is not None:
            path, node = node, node[1]
        if path is None:
            high = node[2]
        else:
            path[1] = node[2]
        self.root = self._join(low, high)
        return node[0]


def best_fit_decreasing(classes: list[tuple[int, float, int]], capacity: float, bins: int | None = None):
    """classes: (class, size, groups), any order. Runs (class, first rank, last rank, bin) and the number of bins; None if it
    needs more than ``bins``."""
    tree, runs, used = CapacityTree(), [], 0
    for c, size, n in sorted(classes, key=lambda x: (-x[1], x[0])):
        first = 0
        while first < n:
            got = tree.take(size)
            if got is None:
                if bins is not None and used >= bins:
                    return None
                got, used = (max(capacity, size), used), used + 1
            remaining, b = got
            k = min(n - first, max(1, int(remaining // size)))
            runs.append((c, first, first + k - 1, b))
            first += k
            tree.insert(remaining - k * size, b)
    return runs, used


def fill_bins(classes: list[tuple[int, float, int]], bins: int):
    """Runs over exactly ``bins`` bins, filled as equally as best-fit-decreasing can."""
    runs, free = [], bins
    left = sorted(([c, s, n, 0] for c, s, n in classes), key=lambda x: (-x[1], x[0]))
    total = sum(s * n for _, s, n, _ in left)
    while left and free > 1 and left[0][1] > total / free:
        top = left[0]
        runs.append((top[0], top[3], top[3], bins - free))
        total, free, top[3] = total - top[1], free - 1, top[3] + 1
        if top[3] == top[2]:
            left.pop(0)
    shift = {c: f for c, _, _, f in left}
    rest = [(c, s, n - f) for c, s, n, f in left]
    if not rest:
        return runs
    low, high = total / free, total / free + rest[0][1]
    best = best_fit_decreasing(rest, high, free)
    while best is None:
        high *= 1.1
        best = best_fit_decreasing(rest, high, free)
    while high - low > 1e-5 * high + 0.5:
        mid = (low + high) / 2
        tried = best_fit_decreasing(rest, mid, free)
        low, high, best = (mid, high, best) if tried is None else (low, mid, tried)
    return runs + [(c, shift[c] + a, shift[c] + b, bins - free + k) for c, a, b, k in best[0]]


def _size_class(exact_from: int):
    """Below 0: an exact size of at least exact_from."""
    power = F.greatest(F.floor(F.log2(F.col("size"))) - 8, F.lit(0)).cast("int")
    return F.when(F.col("size") >= exact_from, -F.col("size")).when(F.col("size") < 256, F.col("size")).otherwise(power.cast("long") * 1024 + F.expr("shiftright(size, cast(greatest(floor(log2(size)) - 8, 0) as int))")).alias("class")


def _assign(rows: DataFrame, plan, largest: bool, exact_from: int) -> DataFrame:
    """rows: (key, size, ...), read from storage. The rows with shard; plan: from the classes' list to runs."""
    spark = rows.sparkSession
    groups = rows.groupBy("key").agg(F.sum("size").alias("size")).select("key", "size", _size_class(exact_from))
    groups = staged(groups, "groups")
    n_groups = groups.count()
    parts = max(1, -(-n_groups // PART_GROUPS))
    groups = groups.withColumn("part", F.pmod(F.xxhash64("key"), F.lit(parts)))
    counts = groups.groupBy("class", "part").agg(F.count("*").alias("n"), F.sum("size").alias("total"), F.max("size").alias("most"))
    counts = staged(counts, "counts")
    histogram = counts.groupBy("class").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.max("most").alias("most")).collect()
    runs = plan([(r["class"], r["most"] if largest else r["total"] / r["n"], r["n"]) for r in histogram])
    offsets = counts.select("class", "part", (F.sum("n").over(W.partitionBy("class").orderBy("part")) - F.col("n")).alias("offset"))
    local = F.row_number().over(W.partitionBy("class", "part").orderBy("key")) - 1
    ranked = groups.withColumn("local", local).join(offsets, ["class", "part"]).select("key", "class", (F.col("local") + F.col("offset")).alias("rank"))
    table = spark.createDataFrame(runs, "class long, first long, last long, shard int")
    shard = staged(ranked.join(table, (ranked["class"] == table["class"]) & F.col("rank").between(F.col("first"), F.col("last"))).select("key", "shard"), "shards")
    return rows.join(shard, "key")


def _with_slots(rows: DataFrame) -> DataFrame:
    """Adds slot, gapless from 0 in each shard: the rows of earlier files of the shard and the place in the file."""
    path = work_path(rows.sparkSession, "sharded")
    rows.write.partitionBy("shard").parquet(path)
    schema = rows.drop("shard").schema.add("shard", "integer")
    back = rows.sparkSession.read.schema(schema).parquet(path).select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at"))
    files = back.groupBy("shard", "file").agg(F.count("*").alias("n"))
    before = files.select("file", (F.sum("n").over(W.partitionBy("shard").orderBy("file")) - F.col("n")).alias("before"))
    return back.join(staged(before, "files"), "file").withColumn("slot", F.col("before") + F.col("at")).drop("file", "at", "before")


def keyed(df: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """The columns of ``keep`` with size (UTF-8 bytes and 1), text_crc32 and key, a hash of the text. Two texts of one hash
    would be one group, which keeps every promise made for groups."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    columns, _ = apart(df, keep, "size", "text_crc32", "key", "shard", "slot", "file", "at", "before")
    return df.select(*columns, (F.octet_length(t).cast("long") + 1).alias("size"), F.crc32(t).alias("text_crc32"), F.xxhash64(t).alias("key"))


def pack(df: DataFrame, capacity: int, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """As few shards of ``capacity`` bytes as best-fit-decreasing finds: keep, size, text_crc32, shard, slot."""
    rows = staged(keyed(df, keep, text), "rows")
    return _with_slots(_assign(rows, lambda c: best_fit_decreasing(c, capacity)[0], True, max(1, int(capacity * EXACT)))).drop("key")


def pack_into(df: DataFrame, shards: int, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """``shards`` shards of nearly equal bytes: keep, size, text_crc32, shard, slot."""
    rows = staged(keyed(df, keep, text), "rows")
    total = rows.agg(F.sum("size")).first()[0] or 0
    return _with_slots(_assign(rows, lambda c: fill_bins(c, shards), False, max(1, int(total / shards * EXACT)))).drop("key")
