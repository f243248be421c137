"""Ranks and running sums over rows that are too many for one task.

A window that orders all rows of a key runs in one task for that key. Here rows are dealt out by ranges of (key, order) instead, so that a
key with many rows spans many partitions; each partition is written in order, counts of (key, partition) are summed up along
the partitions, and a row's place is its place in the partition plus what lies before it. Those sums have a row for each key and
partition that holds it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.scratch import staged

#: Bits that monotonically_increasing_id() gives to a row's number within its partition.
ROW_BITS = 33


def with_rank(df: DataFrame, by: tuple[str, ...], order: list[Column | str], name: str = "rank", count: str | None = None, stage: Callable[[DataFrame], DataFrame] = staged) -> DataFrame:
    """df with ``name``, the place (long, from 0) of each row among the rows of its key ``by`` in the order given, and, if ``count`` names it,
    the number of those rows. Nulls are a key like any other. Rows that the order leaves equal take any places among them. stage
    writes a table and reads it again."""
    if clash := {"__part", "__at"} & set(df.columns):
        raise ValueError(f"columns of the table have names that are used here: {sorted(clash)}")
    keys = [F.col(c).asc_nulls_first() for c in by]
    dealt = df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    at = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << ROW_BITS) - 1))
    placed = stage(dealt.withColumns({"__part": F.spark_partition_id(), "__at": at}))
    spans = placed.groupBy(*by, "__part").agg(F.count("*").alias("__n"), F.min("__at").alias("__first"))
    whole = W.partitionBy(*by)
    before = F.sum("__n").over(whole.orderBy("__part")) - F.col("__n") - F.col("__first")
    totals = [count] if count else []
    names = [f"__by{k}" for k in range(len(by))]
    spans = spans.select(*[F.col(c).alias(n) for c, n in zip(by, names)], F.col("__part").alias("__in"), before.alias("__before"), *[F.sum("__n").over(whole).alias(c) for c in totals])
    same = F.col("__part") == F.col("__in")
    for c, n in zip(by, names):
        same = same & F.col(c).eqNullSafe(F.col(n))
    ranked = placed.join(spans, same)
    return ranked.select(*df.columns, (F.col("__at") + F.col("__before")).alias(name), *totals)
