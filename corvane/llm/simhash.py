"""SimHash near-duplicates by pigeonring filtering.

A fingerprint has 64 bits in SEGMENTS segments on a ring. If two fingerprints differ in at most BITS bits, then at some
segment a chain starts whose cumulative differences over 1, 2, 3 ... segments never exceed their share of BITS (BITS /
SEGMENTS for each). With 4 bits over 5 segments the shares are 0, 1, 2, 3 and 4: the first segment is equal and the second
differs in one bit at most. A join finds such starts: one side has a row for each start, the other one for each start and
each value of the second segment within one bit. Longer chains and the full distance are checked in the join's condition,
on 64-bit integers, and a pair comes out at the first of its starts only.

Equal fingerprints are one class and enter the join once, so copies are never paired. Nor are dense groups of unlike ones: of
the nodes that share a start the least is a pivot, each other one is held against the pivot alone, and what that links shares
a label. The full join then gives pairs of unlike labels only; others could not change a component. It leaves no link out.

near_duplicates() links fingerprints of a text's shingles. similar_components() links texts by the Jaccard similarity of their
shingle sets: pigeonring joins over TABLES fingerprints of the set of words find the candidates, for words are what an edit changes
least: it changes one word, but five shingles of five words. The joins' last check is the Hamming distance of fingerprints of the
shingle set, WIDE times 64 bits; then shingle sets decide. A pair of similarity 0.8 or more is missed if it differs in over BITS bits in
each of the tables, or in wide fingerprints by two standard deviations more than its similarity lets expect (README: measured share). No
pair of less similarity is linked.

Null text counts as empty; a text without words has fingerprint 0 and is linked like any other. Equal rows share a class. Very long
texts are taken whole, one at a time. Columns of any name may stand beside id and text: inside, columns have names of their own.
A null id stays, and is never a component's name unless all ids of the component are null. Among equal ids either may lead.
Empty tables give empty results.
"""

from __future__ import annotations

from functools import reduce
from itertools import accumulate
from math import acos, pi, sqrt

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, free_names, staged, text_or_empty, unstage
from .components import components

#: First bit and width of each segment on the ring.
SEGMENTS = [(0, 13), (13, 13), (26, 13), (39, 13), (52, 12)]
BITS = 4
#: Fingerprints of the word set, and of 64 bits of the shingle set, in similar_components().
TABLES, WIDE = 4, 8
#: For each start in the second turn of similar_components(): a group of which few pairs are similar becomes one component by links with these.
PIVOTS = 16
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def hashes(text: str, shingle: int) -> list[int]:
    """XXH64 (seed 42) of each run of ``shingle`` words, repeats included; of all words if there are fewer."""
    words = text.encode().translate(LOWER).split()
    if not words:
        return []
    line, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return [digest(line, 42)]
    starts = [0, *accumulate([len(w) + 1 for w in words])]
    return [digest(line[a : b - 1], 42) for a, b in zip(starts, starts[shingle:])]


def fingerprint(h: list[int] | np.ndarray) -> int:
    """The bits that are set in over half of the hashes, as a signed number."""
    if not len(h):
        return 0
    bits = np.unpackbits(np.asarray(h, dtype=">u8").view(np.uint8)).reshape(-1, 64)
    return int(np.packbits(np.add.reduce(bits, axis=0, dtype=np.int64) * 2 > len(h)).view(">i8")[0])


def word_fingerprints(text: str) -> list[int]:
    """TABLES fingerprints of the set of a text's words."""
    words = set(text.encode().translate(LOWER).split())
    return fingerprints_of(np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words)), TABLES)


def fingerprints_of(h: np.ndarray, n: int) -> list[int]:
    """n fingerprints of hashes, each by a hash function of its own."""
    out = []
    for k in range(n):
        x = (h + np.uint64(k)) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        out.append(fingerprint(x ^ (x >> np.uint64(32))))
    return out


def shingle_set(text: str, shingle: int) -> np.ndarray:
    """The distinct shingle hashes of a text, ascending, as signed numbers."""
    return np.unique(np.array(hashes(text, shingle), dtype=np.uint64).view(np.int64))


def fingerprints(df: DataFrame, keep: tuple[str, ...] = ("doc_id",), shingle: int = 5, text: str = "text") -> DataFrame:
    """The columns of ``keep`` with fp (long)."""
    types = dict(df.dtypes)

    def make():
        def work(*columns):
            return [*columns[:-1], [fingerprint(hashes(t, shingle)) for t in columns[-1]]]

        return work

    return arrow_map(df.select(*keep, text_or_empty(text)), [*keep, text], ", ".join([f"`{c}` {types[c]}" for c in keep] + ["fp long"]), make)


def _segment(fp: Column, k: int) -> Column:
    start, width = SEGMENTS[k % len(SEGMENTS)]
    return F.shiftrightunsigned(fp, start).bitwiseAND(F.lit((1 << width) - 1))


def _starts(nodes: DataFrame, near: bool = False) -> DataFrame:
    """nodes (node, table, fp, ...) with ``at``: a row for each start of a chain; near: also for those whose second segment differs in a bit."""
    n, out = len(SEGMENTS), []

    def flipped(start: Column, width: int) -> Column:
        flips = F.array(*[F.lit(x).cast("long") for x in (0, *(1 << b for b in range(width) if near))])
        return F.transform(flips, lambda x: start.bitwiseXOR(x))

    for k in range(n):
        start = F.shiftleft(F.col("table").cast("long"), 29).bitwiseOR(F.lit(k << 26)).bitwiseOR(F.shiftleft(_segment(F.col("fp"), k), 13)).bitwiseOR(_segment(F.col("fp"), k + 1))
        out.append(flipped(start, SEGMENTS[(k + 1) % n][1]))
    return nodes.withColumn("at", F.explode(F.flatten(F.array(*out))))


def _first_start(differ: Column) -> Column:
    """The first segment at which a chain within its budgets starts; null if there is none."""
    n, found = len(SEGMENTS), None
    for k in range(n):
        sums = list(accumulate([F.bit_count(_segment(differ, k + i)) for i in range(n - 1)]))
        fits = sums[0] == 0
        for i in range(1, n - 1):
            fits = fits & (sums[i] <= (i + 1) * BITS // n)
        found = F.when(fits, k) if found is None else found.when(fits, k)
    return found


def near_pairs(nodes: DataFrame, also=None) -> DataFrame:
    """nodes: (node long, table int, fp long, label long, ...), each node once a table. Pairs (u, v), u < v, of nodes that differ in
    at most BITS bits of a table and whose labels differ; once for each such table. also: a further condition on columns of both
    sides, named a_... and b_... ."""
    a, b = ([F.col(c).alias(f"{p}_{c}") for c in nodes.columns] for p in "ab")
    left, right = _starts(nodes).select(*a, "at"), _starts(nodes, near=True).select(*b, "at")
    differ = F.col("a_fp").bitwiseXOR(F.col("b_fp"))
    fits = (F.col("a_node") < F.col("b_node")) & (F.col("a_label") != F.col("b_label")) & (F.bit_count(differ) <= BITS)
    fits = fits & (_first_start(differ) == F.shiftright("at", 26).bitwiseAND(F.lit(7)))
    return left.join(right, "at").where(fits if also is None else fits & also).select(F.col("a_node").alias("u"), F.col("b_node").alias("v"))


def with_neighbour(nodes: DataFrame) -> DataFrame:
    """The nodes (column node, each once) that differ from another one in at most BITS bits of a table."""
    prints = nodes.groupBy("table", "fp").agg(F.count("*").alias("n"))
    right = _starts(prints, near=True).select(F.col("fp").alias("y"), F.col("at").alias("to"))
    left, differ = _starts(prints.where("n = 1")).select("fp", "table", "at"), F.col("fp").bitwiseXOR(F.col("y"))
    near = (F.col("at") == F.col("to")) & (differ != 0) & (F.bit_count(differ) <= BITS) & _first_start(differ).isNotNull()
    found = left.join(right, near, "left_semi").select("table", "fp").unionByName(prints.where("n > 1").select("table", "fp"))
    return nodes.join(found.distinct(), ["table", "fp"], "left_semi").select("node").distinct()


def pivot_pairs(nodes: DataFrame, turn: int = 0, also=None, pivots: int = 1) -> DataFrame:
    """Pairs (u, v) as near_pairs(), of nodes with the pivots of those that share a start with them, at most ``pivots`` for each start: fewer
    than the rows of nodes times the segments times pivots. turn: which nodes are the pivots."""
    starts = _starts(nodes)
    spans = F.min("label").alias("low"), F.max("label").alias("high")
    slot = F.lit(0)
    if pivots > 1:  # what shares its starts with its own label alone goes no further
        starts = starts.join(starts.groupBy("at").agg(*spans).where("low < high").select("at"), "at", "left_semi")
        slot = F.pmod(F.xxhash64("node", F.lit(turn), F.lit(pivots)), F.lit(pivots))
    pivot = F.min(F.struct(F.xxhash64("node", F.lit(turn)).alias("h"), *[F.col(c).alias(f"b_{c}") for c in nodes.columns])).alias("p")
    firsts = starts.groupBy("at", slot.alias("slot")).agg(pivot, *spans)
    firsts = (firsts if pivots > 1 else firsts.where("low < high")).select("at", "p.*")
    met = starts.select(*[F.col(c).alias(f"a_{c}") for c in nodes.columns], "at").join(firsts, "at")
    fits = (F.col("a_label") != F.col("b_label")) & (F.bit_count(F.col("a_fp").bitwiseXOR(F.col("b_fp"))) <= BITS)
    met = met.where(fits if also is None else fits & also)
    return met.select(F.least("a_node", "b_node").alias("u"), F.greatest("a_node", "b_node").alias("v"))


def _labelled(nodes: DataFrame, labels: DataFrame | None) -> DataFrame:
    if labels is None:
        return nodes.withColumn("label", F.col("node"))
    return nodes.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))


def _joined(links: DataFrame, labels: DataFrame | None) -> DataFrame:
    """(node, label) by links and by what labels has joined before."""
    if labels is not None:
        links = links.unionByName(labels.select(F.col("node").alias("u"), F.col("label").alias("v")))
    out = staged(components(links), "labels")
    if labels is not None:
        unstage(labels)
    return out


def near_components(nodes: DataFrame) -> DataFrame:
    """(node, label) of the nodes (node, table, fp) that have links, in the components of all pairs that near_pairs() would give."""
    labels = _joined(pivot_pairs(_labelled(nodes, None)), None)
    return _joined(near_pairs(_labelled(nodes, labels)), labels)


def classes_of(rows: DataFrame, *columns: str) -> DataFrame:
    """One row for each node: rep, the least of its rows (those with an id before those without) as (none, id, keys if there are any), and
    ``columns``, which are the same in all rows of a node."""
    rep = F.struct(F.col("id").isNull().alias("none"), *[c for c in ("id", "key", "other_key") if c in rows.columns])
    return rows.groupBy("node").agg(F.min(rep).alias("rep"), *[F.first(c).alias(c) for c in columns])


def with_firsts(rows: DataFrame, classes: DataFrame, labels: DataFrame) -> DataFrame:
    """rows with first: the least rep in the component of their node. rows, classes and labels (node, label of the nodes that have
    links) are read from storage."""
    found = labels.join(classes.select("node", "rep"), "node")
    least = found.groupBy("label").agg(F.min("rep").alias("first"))
    named = labels.join(least, "label").select("node", "first")
    table = staged(classes.join(named, "node", "left").select("node", F.coalesce("first", "rep").alias("first")), "components")
    return rows.join(table, "node")


def near_duplicates(df: DataFrame, id_column: str = "doc_id", shingle: int = 5, text: str = "text") -> DataFrame:
    """One row for each row of df: its id, fp and component_id, with links at BITS or fewer differing bits."""
    base = df.select(F.col(id_column).alias("id"), F.col(text).alias("text"))
    rows = staged(fingerprints(base, ("id",), shingle).withColumnRenamed("fp", "node"), "fingerprints")
    classes = staged(classes_of(rows), "classes")
    labels = near_components(classes.select("node", F.lit(0).alias("table"), F.col("node").alias("fp")))
    found = with_firsts(rows, classes, labels)
    unstage(classes)
    unstage(labels)
    return found.select(F.col("id").alias(id_column), F.col("node").alias("fp"), F.col("first.id").alias("component_id"))


def _keyed(df: DataFrame, id_column: str, text: str) -> DataFrame:
    """id, text (no nulls) and two hashes of both, which stand for a row: a null id or one id of several texts is no key."""
    base = df.select(F.col(id_column).alias("id"), text_or_empty(text).alias("text"))
    return base.withColumns({"key": F.xxhash64("id", "text"), "other_key": F.xxhash64(F.lit(1), "text", "id")})


def similar_pairs(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (u, v) of nodes whose sets (node, shingles) have this Jaccard similarity: both sets are compared in full."""
    side = lambda u, x: sets.select(F.col("node").alias(u), F.col("shingles").alias(x))
    both = pairs.join(side("u", "x"), "u").join(side("v", "y"), "v")
    shared = F.size(F.array_intersect("x", "y"))
    return both.where(shared * (1 + similarity) >= (F.size("x") + F.size("y")) * similarity - 1e-9).select("u", "v")


def _similar(df: DataFrame, id_column: str, shingle: int, similarity: float, text: str) -> DataFrame:
    """A row for each row of df: id, key, other_key, and first, the least row of its component."""

    def make():
        def work(ids, keys, others, texts):
            sets = [shingle_set(t, shingle) for t in texts]
            nodes = [xxhash.xxh64_intdigest(s.tobytes(), 42) for s in sets]
            return [ids, keys, others, [n - (n >> 63 << 64) for n in nodes], [len(s) for s in sets], [word_fingerprints(t) for t in texts]]

        return work

    keyed = _keyed(df, id_column, text)
    kind = dict(keyed.dtypes)["id"]
    rows = staged(arrow_map(keyed, ["id", "key", "other_key", "text"], f"id {kind}, key long, other_key long, node long, n int, fps array<long>", make), "rows")
    classes = staged(classes_of(rows, "n", "fps"), "classes")
    # unlike sets of which both have under four shingles, or one has, are less similar than 3 in 4
    nodes = classes.where("n >= 4" if similarity > 0.75 else "n > 0").select("node", "n", F.posexplode("fps").alias("table", "fp"))
    near = None
    for k in range(TABLES):  # one at a time: bounds what lies on disk at once
        more = staged(with_neighbour(nodes.where(F.col("table") == k)), "near")
        near = more if near is None else near.unionByName(more)
    nears, near = near, staged(near.distinct(), "near")
    unstage(nears)

    def make_sets():
        def work(found, texts):
            sets = [shingle_set(t, shingle) for t in texts]
            return [found, sets, [fingerprints_of(s.view(np.uint64), WIDE) for s in sets]]

        return work

    wanted = classes.join(near, "node", "left_semi").select("node", F.col("rep.key").alias("key"), F.col("rep.other_key").alias("other_key"))
    # hashed at every size: a table that grows with the input is not broadcast, and texts need no sort
    texts = keyed.select("key", "other_key", "text").join(wanted.hint("shuffle_hash"), ["key", "other_key"]).groupBy("node").agg(F.first("text").alias("text"))
    sets = staged(arrow_map(texts, ["node", "text"], "node long, shingles array<long>, wide array<long>", make_sets), "sets")
    nodes = staged(nodes.join(sets.select("node", *[F.col("wide")[k].alias(f"w{k}") for k in range(WIDE)]), "node"), "nodes")
    sets = sets.select("node", "shingles")
    may_fit = F.least("a_n", "b_n") >= F.greatest("a_n", "b_n") * similarity - 1e-9
    may_fit = may_fit & (sum((F.bit_count(F.col(f"a_w{k}").bitwiseXOR(F.col(f"b_w{k}"))) for k in range(WIDE)), F.lit(0)) <= wide_bits(similarity))
    labels, tested = None, None
    for turn, pivots in enumerate((1, PIVOTS)):
        pairs = pivot_pairs(_labelled(nodes, labels), turn, may_fit, pivots).distinct()
        pairs = staged(pairs if tested is None else pairs.join(tested, ["u", "v"], "left_anti"), "pairs")
        tested = pairs if tested is None else tested.unionByName(pairs)
        labels = _joined(similar_pairs(pairs, sets, similarity), labels)
    left = staged(_labelled(nodes, labels), "labelled")
    each = [staged(near_pairs(left.where(F.col("table") == k), may_fit), "pairs") for k in range(TABLES)]
    pairs = staged(reduce(DataFrame.unionByName, each).distinct().join(tested, ["u", "v"], "left_anti"), "pairs")
    labels = _joined(similar_pairs(pairs, sets, similarity), labels)
    found = with_firsts(rows, classes, labels).select("id", "key", "other_key", "first")
    for table in (classes, near, sets, nodes, labels, tested, left, pairs, *each):
        unstage(table)
    return found


def wide_bits(similarity: float) -> int:
    """How many bits of wide fingerprints may differ: the mean at this Jaccard similarity and two standard deviations."""
    bits, share = 64 * WIDE, acos(2 * similarity / (1 + similarity)) / pi
    return int(bits * share + 2 * sqrt(bits * share * (1 - share)))


def similar_components(df: DataFrame, id_column: str = "doc_id", shingle: int = 5, similarity: float = 0.8, text: str = "text") -> DataFrame:
    """One row for each row of df: its id and component_id. Texts with one set of shingles are one node; nodes are linked if their
    sets have a Jaccard similarity of ``similarity`` or more."""
    return _similar(df, id_column, shingle, similarity, text).select(F.col("id").alias(id_column), F.col("first.id").alias("component_id"))


def keep_one(df: DataFrame, id_column: str = "doc_id", shingle: int = 5, similarity: float = 0.8, text: str = "text") -> DataFrame:
    """The rows of df, all columns, that are the first of their component: the one of the least id, rows without an id last. Of rows
    with one id and one text any one stays. One id of unlike texts is as many rows as any."""
    found = staged(_similar(df, id_column, shingle, similarity, text), "similar")
    is_first = F.col("key").eqNullSafe(F.col("first.key")) & F.col("other_key").eqNullSafe(F.col("first.other_key"))
    k, o = free_names(df, "__key", "__other_key")
    gone = staged(found.where(~is_first).select(F.col("key").alias(k), F.col("other_key").alias(o)).distinct(), "gone")
    again = found.where(is_first).groupBy("key", "other_key").count().where("count > 1")
    again = staged(again.select(F.col("key").alias(k), F.col("other_key").alias(o)), "repeated")
    unstage(found)
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    same = (F.xxhash64(F.col(id_column), body) == F.col(k)) & (F.xxhash64(F.lit(1), body, F.col(id_column)) == F.col(o))
    kept = df.join(gone.hint("shuffle_hash"), same, "left_anti")
    if again.isEmpty():
        return kept
    return kept.join(again, same, "left_anti").unionByName(kept.join(again, same, "left_semi").dropDuplicates([id_column, text]))
