"""A trie of conversation prefixes in hashed node tables.

A node is a distinct sequence of first turns. Its name is a digest of 128 bits, the exclusive or of one digest for each turn at its
place, so the digest of the prefix before is the same without its last turn, and running digests can be made in parts.

Rows of rebuilt conversations are dealt to shards by (conversation, band of BAND depths), so a shard holds whole prefixes within a band.
1. Each shard enumerates its distinct digests, gives them slots by a minimal perfect hash (levels of bit sets; a key has a slot where no
   other key of the level falls), and compares the key that stands in a slot with the key asked for before it trusts a slot.
   Members are counted into a flat array by slot; parents are found by the same hash. One row a slot and shard leaves it.
2. Sums over shards give a node's members, smallest member and children, whatever the share of rows that one prefix has: a shard sends a
   row for it, not its members. Nodes of one digest that differ in parent, depth, or length stop the job.
3. Back in the shards, a node's own weight enters the array of one shard that has it, and arrays are added up through the parent slots in
   depth order. Sums over shards give the totals of subtrees. Bands go from the deepest that two conversations share to the first.

Turns of one conversation go by turn, nulls first, then role and text. Null roles and texts are empty; rows without a conv_id are left out.
Conversations of one turn or of many millions are split alike; identical conversations are members of the same nodes. An empty table
has no conversations and no nodes. Other columns are dropped.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.ranking import with_rank
from .common import small_batches, staged, unstage

#: Rows of a shard, about, and depths of a band.
SHARD_ROWS, BAND = 100_000, 4096
#: Bits for each key in a level of the minimal perfect hash.
SPREAD = 2
#: Conversation numbers that are joined to one text at a time.
ENDS = 1 << 14


class SlotTable:
    """A minimal perfect hash of distinct keys (two columns of unsigned 64-bit numbers): key to slot 0 .. n - 1."""

    def __init__(self, keys: np.ndarray):
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []  # bits that hold a key, and keys before each place
        placed, rest = 0, np.arange(len(keys))
        slot = np.empty(len(keys), dtype=np.int64)
        while len(rest):
            if len(self.levels) == 64:
                raise ValueError("keys are not distinct")
            size = SPREAD * len(rest) + 1
            at = self._place(keys[rest], len(self.levels), size)
            bits = np.bincount(at, minlength=size) == 1
            before = placed + np.cumsum(bits) - bits
            alone = bits[at]
            slot[rest[alone]] = before[at[alone]]
            self.levels.append((bits, before))
            placed, rest = placed + int(bits.sum()), rest[~alone]
        self.keys = np.empty_like(keys)
        self.keys[slot] = keys

    @staticmethod
    def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        x = (keys[:, 0] + np.uint64(level)) * np.uint64(0x9E3779B97F4A7C15) ^ keys[:, 1]
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return ((x ^ (x >> np.uint64(32))) % np.uint64(size)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key; -1 where the slot's own key is another one."""
        slot, rest = np.full(len(keys), -1, dtype=np.int64), np.arange(len(keys))
        for level, (bits, before) in enumerate(self.levels):
            at = self._place(keys[rest], level, len(bits))
            here = bits[at]
            slot[rest[here]] = before[at[here]]
            rest = rest[~here]
        known = slot >= 0
        known[known] = (self.keys[slot[known]] == keys[known]).all(axis=1)
        return np.where(known, slot, -1)


def add_up(values: np.ndarray, parent: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """Sums over subtrees: each row's values are added to its parent's, the deepest rows first. parent: slots, -1 for none."""
    total, order = values.copy(), np.argsort(-depth, kind="stable")
    cuts = np.flatnonzero(np.diff(depth[order])) + 1
    for rows in np.split(order, cuts):
        rows = rows[parent[rows] >= 0]
        np.add.at(total, parent[rows], total[rows])
    return total


def _halves(digest: Column) -> list[Column]:
    """Two numbers of 64 bits from hex text."""
    return [F.conv(F.substring(digest, 1 + 16 * k, 16), 16, -10).cast("long") for k in range(2)]


def rebuilt(turns: DataFrame, group: int, heads: Callable[[Column], Column], most: int) -> tuple[DataFrame, DataFrame]:
    """Conversations of which the first ``heads(conv_id)`` turns, ``most`` at most, are those of conv_id - conv_id % group. Gives (conv_id, length)
    of all conversations, turnless ones too, and (conv_id, depth from 1, role, text)."""
    body = turns.where(F.col("conv_id").isNotNull()).select("conv_id", "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    tables = []

    def stage(table: DataFrame) -> DataFrame:
        tables.append(staged(table, "ranked"))
        return tables[-1]

    placed = staged(with_rank(body, ("conv_id",), [F.col("turn").asc_nulls_first(), "role", "text"], "place", stage=stage).drop("turn"), "turns")
    for table in tables:
        unstage(table)
    own = placed.groupBy("conv_id").agg(F.count("*").alias("own"))
    own = own.select("conv_id", "own", heads(F.col("conv_id")).cast("long").alias("h"), (F.col("conv_id") - F.col("conv_id") % group).alias("base"))
    of_base = own.select(F.col("conv_id").alias("base"), F.col("own").alias("of_base"))
    convs = own.join(of_base, "base", "left").withColumn("taken", F.least("h", F.coalesce("of_base", F.lit(0).cast("long"))))
    convs = staged(convs.select("conv_id", "base", "h", "taken", (F.col("taken") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("length")), "conversations")
    first = placed.where(F.col("place") < most).withColumnRenamed("conv_id", "base").join(convs.select("conv_id", "base", "h"), "base").where("place < h")
    later = placed.join(convs.select("conv_id", "h", "taken"), "conv_id").where("place >= h")
    rows = first.select("conv_id", (F.col("place") + 1).alias("depth"), "role", "text").unionByName(later.select("conv_id", (F.col("taken") + F.col("place") - F.col("h") + 1).alias("depth"), "role", "text"))
    return convs.select("conv_id", "length"), rows


def prefixes(convs: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The written table that the result is read from, and the result. A row for each prefix of each conversation, the empty one too: conv_id, depth, a, b (digest), pa, pb (of the prefix before; null for the
    empty one), bytes (of the last text), last (the prefix is the whole conversation)."""
    turn = F.sha2(F.concat(F.col("depth").cast("string"), F.lit(":"), F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    band = F.floor((F.col("depth") - 1) / BAND).cast("long")
    hashed = staged(rows.select("conv_id", "depth", band.alias("band"), *[h.alias(n) for h, n in zip(_halves(turn), ("x", "y"))], F.octet_length("text").cast("long").alias("bytes")), "hashed")
    until = W.partitionBy("conv_id", "band").orderBy("depth")
    inside = hashed.withColumns({"a": F.expr("bit_xor(x)").over(until), "b": F.expr("bit_xor(y)").over(until)})
    bands = hashed.groupBy("conv_id", "band").agg(F.expr("bit_xor(x)").alias("bx"), F.expr("bit_xor(y)").alias("by"))
    earlier = W.partitionBy("conv_id").orderBy("band").rowsBetween(W.unboundedPreceding, -1)
    carried = bands.withColumns({"ca": F.expr("bit_xor(bx)").over(earlier), "cb": F.expr("bit_xor(by)").over(earlier)}).where("band > 0").select("conv_id", "band", "ca", "cb")
    zero = F.lit(0).cast("long")
    whole = inside.join(carried, ["conv_id", "band"], "left").withColumns({n: F.col(n).bitwiseXOR(F.coalesce("c" + n, zero)) for n in ("a", "b")})
    before = [F.col(n).bitwiseXOR(F.col(x)).alias("p" + n) for n, x in (("a", "x"), ("b", "y"))]
    some = whole.select("conv_id", "depth", "a", "b", *before, "bytes")
    null = F.lit(None).cast("long")
    root = convs.select("conv_id", zero.alias("depth"), zero.alias("a"), zero.alias("b"), null.alias("pa"), null.alias("pb"), zero.alias("bytes"))
    met = some.unionByName(root).join(convs, "conv_id").withColumn("last", F.col("depth") == F.col("length")).drop("length")
    return hashed, met.withColumn("conv_id", F.col("conv_id").cast("long"))


def _shard(conv: Column, band: Column, shards: int) -> Column:
    return F.pmod(F.xxhash64(conv, band), F.lit(shards)).cast("int")


def _job(spark, schema: str, work):
    """applyInArrow by lists: work(columns of a group as numpy arrays) gives the columns of the result."""
    from pyspark.sql.pandas.types import to_arrow_schema

    kind = spark.createDataFrame([], schema).schema
    arrow = to_arrow_schema(kind)

    def job(table: pa.Table) -> pa.Table:
        found = work({c: table.column(c).to_numpy() for c in table.column_names})
        return pa.Table.from_arrays([pa.array(found[f.name], f.type, from_pandas=True) for f in arrow], schema=arrow)

    return job, kind


def local_tables(dealt: DataFrame) -> DataFrame:
    """dealt: (shard, conv_id, depth, a, b, pa, pb, bytes, counts), counts 0 for a row that stands in its band for its children only. A row
    for each slot of each shard: shard, slot, parent (slot, -1 if there is none), depth, a, b, pa, pb, bytes, n, least."""

    def work(t: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        keys = np.stack([t["a"], t["b"]], axis=1).view(np.uint64)
        distinct, first = np.unique(keys, axis=0, return_index=True)
        table = SlotTable(distinct)
        slot, n = table.find(keys), len(distinct)
        row = np.empty(n, dtype=np.int64)
        row[table.find(distinct)] = first
        orphan = t["orphan"][row]
        parent = table.find(np.stack([t["pa"][row], t["pb"][row]], axis=1).view(np.uint64))
        least = np.full(n, np.iinfo(np.int64).max)
        np.minimum.at(least, slot, t["conv_id"])
        out = {c: t[c][row] for c in ("shard", "depth", "a", "b", "pa", "pb", "bytes")}
        return out | {"slot": np.arange(n), "parent": np.where(orphan, -1, parent), "n": np.bincount(slot, weights=t["counts"], minlength=n).astype(np.int64), "least": least}

    whole = dealt.withColumns({"orphan": F.col("pa").isNull(), "pa": F.coalesce("pa", F.lit(0).cast("long")), "pb": F.coalesce("pb", F.lit(0).cast("long"))})
    job, kind = _job(dealt.sparkSession, "shard int, slot long, parent long, depth long, a long, b long, pa long, pb long, bytes long, n long, least long", work)
    return whole.groupBy("shard").applyInArrow(job, kind)


def node_table(local: DataFrame) -> DataFrame:
    """Nodes from the shards' rows: a, b, pa, pb, depth, bytes, n_convs, conv_id, n_children."""
    same = ("depth", "bytes", "pa", "pb")
    summed = local.groupBy("a", "b").agg(F.sum("n").alias("n_convs"), F.min("least").alias("conv_id"), *[F.min(c).alias(c) for c in same], *[F.max(c).alias(f"max_{c}") for c in same])
    one = F.lit(True)
    for c in same:
        one = one & (F.col(c) == F.col(f"max_{c}"))
    checked = summed.withColumn("n_convs", F.when(one, F.col("n_convs")).otherwise(F.raise_error(F.lit("two prefixes have one digest")).cast("long")))
    nodes = staged(checked.select("a", "b", *same, "n_convs", "conv_id"), "nodes")
    children = nodes.where("depth > 0").groupBy(F.col("pa").alias("a"), F.col("pb").alias("b")).agg(F.count("*").alias("n_children"))
    out = staged(nodes.join(children, ["a", "b"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))), "nodes")
    unstage(nodes)
    return out


def subtree_sums(local: DataFrame, nodes: DataFrame, shards: int) -> DataFrame:
    """nodes with parent_conv_id, n_leaves and saved_tokens."""
    deepest = nodes.where("n_convs > 1").agg(F.max("depth")).first()[0] or 0
    top = deepest // BAND
    edge = (top + 1) * BAND  # below, every node is of one conversation: one leaf, nothing saved

    def work(t: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        order = np.argsort(t["slot"])
        t = {c: v[order] for c, v in t.items()}
        place = np.full(int(max(t["slot"][-1], t["parent"].max())) + 1, -1, dtype=np.int64)
        place[t["slot"]] = np.arange(len(order))  # slots of one band are some of the shard's
        parent = np.where(t["parent"] < 0, -1, place[t["parent"]])
        mine, up = t["mine"].astype(bool), parent >= 0
        sums = add_up(np.stack([t["leaves"], t["saved"]], axis=1), parent, t["depth"])
        over = np.where(up, t["conv_id"][np.maximum(parent, 0)], -1)
        rows = mine | (sums != 0).any(axis=1)
        out = {c: t[c][rows] for c in ("a", "b")}
        return out | {"n_leaves": sums[rows, 0], "saved_tokens": sums[rows, 1], "parent_conv_id": np.ma.masked_array(over, ~(mine & up))[rows]}

    job, kind = _job(local.sparkSession, "a long, b long, n_leaves long, saved_tokens long, parent_conv_id long", work)
    owner = _shard(F.col("conv_id"), F.greatest(F.floor((F.col("depth") - 1) / BAND), F.lit(0)).cast("long"), shards)
    band = F.greatest(F.floor((F.col("depth") - 1) / BAND), F.lit(0))
    known = nodes.select("a", "b", "n_convs", "conv_id", "n_children")
    slots = local.select("shard", "slot", "parent", "depth", "a", "b", "bytes").join(known, ["a", "b"])
    slots = staged(slots, "slots")
    done, carried = None, None
    for k in range(top, -1, -1):
        # the row above a band stands in it for its children, and is added up in the band before
        here = slots.where((F.col("depth") <= (k + 1) * BAND) & (F.col("depth") >= k * BAND) & ((band == k) | (F.col("depth") == k * BAND)))
        inside = (band == k) & (F.col("shard") == owner)
        own_leaf = (F.col("n_children") == 0) | ((F.col("n_convs") == 1) & (F.col("depth") == edge))
        here = here.withColumns({"mine": inside, "leaves": F.when(inside & own_leaf, 1).otherwise(0).cast("long"), "saved": F.when(inside, (F.col("n_convs") - 1) * F.col("bytes")).otherwise(0).cast("long")})
        if carried is not None:
            more = carried.select("a", "b", F.col("n_leaves").alias("more_leaves"), F.col("saved_tokens").alias("more_saved"))
            here = here.join(more, ["a", "b"], "left").withColumns({"leaves": F.col("leaves") + F.when(inside, F.coalesce("more_leaves", F.lit(0))).otherwise(0), "saved": F.col("saved") + F.when(inside, F.coalesce("more_saved", F.lit(0))).otherwise(0)})
        part = here.select("shard", "slot", "parent", "depth", "a", "b", "conv_id", "mine", "leaves", "saved").groupBy("shard").applyInArrow(job, kind)
        sums = staged(part.groupBy("a", "b").agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"), F.max("parent_conv_id").alias("parent_conv_id")), "sums")
        met = nodes.where(band == k).join(sums, ["a", "b"])
        done = met if done is None else done.unionByName(met)
        carried = sums.join(nodes.where(F.col("depth") == k * BAND).select("a", "b"), ["a", "b"], "left_semi")
    alone = nodes.where(band > top).withColumns({"n_leaves": F.lit(1).cast("long"), "saved_tokens": F.lit(0).cast("long"), "parent_conv_id": F.col("conv_id")})
    unstage(slots)
    return done.unionByName(alone)


def ends(last: DataFrame) -> DataFrame:
    """last: (a, b, conv_id). A row for each (a, b) with ends_sha256, of its conv_ids in order, joined by commas. ENDS neighbouring numbers at a time
    become one text; texts of a node go through one hash in order, none is kept."""
    parts = last.groupBy("a", "b", F.floor(F.col("conv_id") / ENDS).cast("long").alias("part")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda x: x.cast("string")), ",").alias("ids"))
    small_batches(last.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, state = None, None
        for batch in batches:
            rows = []
            for a, b, ids in zip(*(c.to_pylist() for c in batch.columns)):
                if (a, b) == name:
                    state.update(b"," + ids.encode())
                    continue
                if name is not None:
                    rows.append((*name, state.hexdigest()))
                name, state = (a, b), hashlib.sha256(ids.encode())
            if rows:
                yield record(rows)
        if name is not None:
            yield record([(*name, state.hexdigest())])

    def record(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.string()))], names=["a", "b", "ends_sha256"])

    dealt = parts.repartition("a", "b").sortWithinPartitions("a", "b", "part").select("a", "b", "ids")
    return dealt.mapInArrow(run, "a long, b long, ends_sha256 string")


def trie(convs: DataFrame, rows: DataFrame) -> DataFrame:
    """convs: (conv_id, length), rows: (conv_id, depth 1 .. length, role, text). A row for each node: conv_id, depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256, and digest."""
    hashed, met = prefixes(convs, rows)
    steps = staged(met, "prefixes")
    unstage(hashed)
    shards = max(1, -(-steps.count() // SHARD_ROWS))
    band = F.greatest(F.floor((F.col("depth") - 1) / BAND), F.lit(0)).cast("long")
    own = steps.withColumns({"counts": F.lit(1), "shard": _shard(F.col("conv_id"), band, shards)})
    starts = steps.where((F.col("depth") > 0) & (F.col("depth") % BAND == 0) & ~F.col("last"))  # stand in the next band for their children
    null = F.lit(None).cast("long")
    above = starts.withColumns({"counts": F.lit(0), "shard": _shard(F.col("conv_id"), band + 1, shards)})
    local = staged(local_tables(own.unionByName(above).drop("last")), "local")
    nodes = node_table(local)
    found = subtree_sums(local, nodes, shards)
    unstage(local)
    empty = F.lit(hashlib.sha256(b"").hexdigest())
    met = found.join(ends(steps.where("last").select("a", "b", "conv_id")), ["a", "b"], "left")
    digest = F.concat(*[F.lower(F.lpad(F.hex(c), 16, "0")) for c in ("a", "b")])
    return met.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", empty).alias("ends_sha256"), digest.alias("digest"))
