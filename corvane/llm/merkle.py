"""A Merkle manifest of a dataset, with a proof for every row made by pointer jumping.

A row is a leaf; leaves of one group (``lang``) form a tree in the order of their ids, the roots of all groups form the tree above.
Each run of ``FAN`` (2) nodes in a row has as parent the hash of their hashes; a last run may have one node.

build(): leaves get their place by ranges and prefix counts (with_rank), blocks of BLOCK leaves are hashed LEVELS levels up, each in a
task of its own, and so on with the blocks' tops. Every node then holds a segment, the sibling towards its parent.

proofs(): in round k a node whose level is a multiple of 2^(k+1) joins the node 2^k levels above, which it points to, appends that
one's segment to its own and points twice as far. Nodes at other levels are not pointed to again and are left out, so a round has little more
rows than there are leaves. After as many rounds as the height has bits every leaf points to its root. Proofs of groups are appended
to those of their leaves.

A null group is a group and comes first, a null id comes first in its group; equal ids follow by leaf hash, and equal rows are leaves each. An
empty table has an empty manifest. Long texts are hashed where they are read and are not shuffled. Other columns are dropped.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..operators.ranking import with_rank
from .common import staged, unstage

LEVELS = 10
#: Leaves of a block.
BLOCK = 1 << LEVELS
#: First byte of a segment's entry: the sibling stands left, right, or there is none.
LEFT, RIGHT, NONE = b"L", b"R", b"N"


def encoded(c: Column) -> Column:
    """A field: - for null, else its length in UTF-8 bytes, a colon and itself."""
    s = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def leaf(fields: list[Column]) -> Column:
    """Lower-case hex SHA-256 of the fields, one after the other."""
    return F.sha2(F.concat(*[encoded(c) for c in fields]), 256)


def _digest(*parts: bytes) -> bytes:
    """Hash of hashes as hex text, as bytes."""
    return hashlib.sha256(b"".join([p.hex().encode() for p in parts])).digest()


def _climb(digests: list[bytes], levels: int) -> tuple[list[list[bytes]], bytes]:
    """For each of some levels the segment entry of each node, and the digest at the top."""
    entries = []
    for _ in range(levels):
        n, out, above = len(digests), [], []
        for k in range(0, n - 1, 2):
            a, b = digests[k], digests[k + 1]
            out += [RIGHT + b, LEFT + a]
            above.append(_digest(a, b))
        if n % 2:
            out.append(NONE)
            above.append(_digest(digests[-1]))
        entries.append(out)
        digests = above
    return entries, digests[0]


def build(leaves: DataFrame, payload: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """leaves: (tree, idx, n, digest binary, payload), idx gapless from 0, n the leaves of the tree; read from storage. Gives the nodes (tree,
    level, idx, height, seg array<binary>, payload of leaves) below the roots, leaves always; the roots (tree, digest); and the written
    tables that both are read from."""
    types = dict(leaves.dtypes)
    schema = leaves.sparkSession.createDataFrame([], "tree string, level int, idx long, height int, n long, seg array<binary>, digest binary" + "".join(f", `{c}` {types[c]}" for c in payload)).schema
    arrow = to_arrow_schema(schema)

    def job_at(base: int):
        def job(key: tuple, table: pa.Table) -> pa.Table:
            table = table.sort_by("idx")
            tree, block, n = key[0].as_py(), key[1].as_py(), table.column("n")[0].as_py()
            height = (n - 1).bit_length()
            up = min(LEVELS, height - base)
            entries, top = _climb(table.column("digest").to_pylist(), up)
            entries = [[[x] for x in found] for found in entries] or [[[]]]  # a tree of one leaf has it as root
            columns = {c: [] for c in arrow.names}
            for level, found in enumerate(entries):
                first = block * BLOCK >> level
                columns["level"] += [base + level] * len(found)
                columns["idx"] += range(first, first + len(found))
                columns["seg"] += found
                for c in payload:
                    columns[c] += [None] * len(found) if level or base else table.column(c).to_pylist()
            rows = len(columns["idx"])
            columns["digest"] = [None] * rows + [top]
            for c, v in (("level", base + up), ("idx", block), ("seg", None), *[(c, None) for c in payload]):
                columns[c].append(v)
            columns |= {"tree": [tree] * (rows + 1), "height": [height] * (rows + 1), "n": [n] * (rows + 1)}
            return pa.Table.from_arrays([pa.array(columns[f.name], f.type) for f in arrow], schema=arrow)

        return job

    now, base, nodes, roots, used = leaves, 0, None, None, []
    most = leaves.agg(F.max("n")).first()[0] or 1
    while True:
        grouped = now.select("tree", F.shiftright("idx", LEVELS).alias("at"), "idx", "n", "digest", *payload)
        made = staged(grouped.groupBy("tree", "at").applyInArrow(job_at(base), schema), "merkle")
        used.append(made)
        below = made.where("seg is not null").select("tree", "level", "idx", "height", "seg", *payload)
        tops = made.where("seg is null and level >= height").select("tree", "digest")
        nodes, roots = (below, tops) if nodes is None else (nodes.unionByName(below), roots.unionByName(tops))
        base += LEVELS
        if most <= 1 << base:
            return nodes, roots, used
        now = made.where((F.col("seg").isNull()) & (F.col("level") == base) & (F.col("level") < F.col("height")))


def proofs(nodes: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """The leaves of nodes, with the whole segment towards their root; and the written table that they are read from, if there is one."""
    height, step, before = nodes.agg(F.max("height")).first()[0] or 0, 1, None
    payload = [c for c in nodes.columns if c not in ("tree", "level", "idx", "height", "seg")]
    while step < height:
        left = nodes.where(F.col("level") % (2 * step) == 0)
        right = nodes.where(F.col("level") % (2 * step) == step).select("tree", F.col("level").alias("to"), F.col("idx").alias("above"), F.col("seg").alias("more"))
        on_way = left.where(F.col("level") + step < F.col("height")).withColumns({"to": F.col("level") + step, "above": F.shiftright("idx", step)})
        longer = on_way.join(right, ["tree", "to", "above"]).select("tree", "level", "idx", "height", F.concat("seg", "more").alias("seg"), *payload)
        nodes = staged(longer.unionByName(left.where(F.col("level") + step >= F.col("height"))), "jump")
        if before is not None:
            unstage(before)
        before, step = nodes, 2 * step
    return nodes.where("level = 0"), before


def proof_text(seg: Column) -> Column:
    """The siblings of a segment as hex text, left to right, level by level."""
    return F.array_join(F.transform(F.filter(seg, lambda x: F.octet_length(x) > 1), lambda x: F.lower(F.hex(F.substring(x, 2, 32)))), "")


def fold(start: Column, seg: Column) -> Column:
    """The root (hex) that a leaf (hex) and a segment give."""

    def step(now: Column, entry: Column) -> Column:
        side, sibling = F.substring(entry, 1, 1), F.lower(F.hex(F.substring(entry, 2, 32)))
        return F.sha2(F.when(side == F.lit(LEFT), F.concat(sibling, now)).when(side == F.lit(RIGHT), F.concat(now, sibling)).otherwise(now), 256)

    return F.aggregate(seg, start, step)


def manifest(df: DataFrame, fields: list[Column], tampered: list[Column] | None = None, id_column: str = "doc_id", group: str = "lang") -> DataFrame:
    """A row for each row of df: its id, leaf, subroot, root, proof (array of siblings with their side), and tampered, the leaf hash of the
    fields ``tampered`` (without them, the leaf)."""
    tree = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))
    of = leaf(fields)
    rows = df.select(F.col(id_column).alias("id"), tree.alias("tree"), F.unhex(of).alias("digest"), F.unhex(leaf(tampered) if tampered else of).alias("other"))
    rows, tables = staged(rows, "leaves"), []

    def stage(table: DataFrame) -> DataFrame:
        tables.append(staged(table, "ranked"))
        return tables[-1]

    ranked = with_rank(rows, ("tree",), [F.col("id").asc_nulls_first(), "digest", "other"], "idx", "n", stage)
    leaves = staged(ranked.withColumn("mine", F.col("digest")), "leaves")
    nodes, roots, made = build(leaves, ("id", "mine", "other"))
    groups = with_rank(roots, (), ["tree"], "idx", "n", stage)
    groups = staged(groups.select(F.lit("").alias("tree"), "idx", "n", "digest", F.col("tree").alias("of"), F.col("digest").alias("subroot")), "groups")
    for table in (rows, leaves, *tables):
        unstage(table)
    proven, own = proofs(nodes)
    if own is not None:
        for table in made:
            unstage(table)
    above, root, _ = build(groups, ("of", "subroot"))
    tops, _ = proofs(above)
    tops = tops.select(F.col("of").alias("tree"), "subroot", F.col("seg").alias("top"))
    head = root.select(F.lower(F.hex("digest")).alias("root"), F.lit(1).alias("one"))
    found = proven.join(tops, "tree").withColumn("one", F.lit(1)).join(head, "one")
    hexed = lambda c: F.lower(F.hex(c))
    return found.select(F.col("id").alias(id_column), hexed("mine").alias("leaf"), hexed("subroot").alias("subroot"), "root", F.concat("seg", "top").alias("proof"), hexed("other").alias("tampered"))
