"""Helpers that every operator of this subpackage shares."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes in one Arrow batch: bound what a Python worker holds at once, however long the texts are.
BATCH_ROWS, BATCH_BYTES = 1000, 32 << 20
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def work_path(spark: SparkSession, name: str) -> str:
    """A new folder in the cluster's shared checkpoint folder; where none is set and Spark runs on this machine alone, one of it."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        jsc = spark.sparkContext._jsc.sc()
        if jsc.getCheckpointDir().isEmpty():
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="spark-"))
        base = jsc.getCheckpointDir().get()
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it again: cuts lineage, survives lost executors."""
    path, spark = work_path(df.sparkSession, name), df.sparkSession
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")  # the table is all that is read again: its shuffle files can go once it stands
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unstage(df: DataFrame) -> None:
    """Delete a table that staged() wrote, once nothing reads it."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def arrow_map(df: DataFrame, columns: Sequence[str], schema: str, make) -> DataFrame:
    """mapInArrow over some columns. make() is called once a task and gives a function of those columns' lists
    that returns the lists of the result."""
    small_batches(df.sparkSession)
    spark_schema = df.sparkSession.createDataFrame([], schema).schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(spark_schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for b in batches:
            if b.num_rows:
                out = work(*(c.to_pylist() for c in b.columns))
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, arrow.types, strict=True)], schema=arrow)

    return df.select(*columns).mapInArrow(run, spark_schema)


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, lengthened until no column of df has them."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n = "_" + n
        out.append(n)
    return out


def apart(df: DataFrame, keep: Sequence[str], *results: str) -> tuple[list[Column], list[str]]:
    """The columns of ``keep``, and their names: one that is named like a result gets underscores before it until it is free."""
    taken, names = {r.lower() for r in results}, []
    for c in keep:
        name = c
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        names.append(name)
    return [F.col(f"`{c}`").alias(n) for c, n in zip(keep, names)], names


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column).cast("string"), F.lit("")).alias(column)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
