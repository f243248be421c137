"""Sources and sinks: correlator tables, packed layouts, matrices, summaries, key/value lists, logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def scan_raw(df: DataFrame, pairs: list[tuple[str, str]] | None = None, by: tuple[str, ...] = ("file",)) -> DataFrame:
    """Rows of the wanted (sink, source) pairs, all if none are named. The filter reaches the scan of a file table."""
    if not pairs:
        return df
    keep = F.lit(False)
    for snk, src in pairs:
        keep = keep | ((F.col("snk") == snk) & (F.col("src") == src))
    return df.where(keep)


def pair_faults(df: DataFrame, pairs: list[tuple[str, str]], nt: int) -> DataFrame:
    """Pairs of a file that are not there exactly once over all times, or hold values that are not finite: file, snk, src, fault."""
    wanted = df.sparkSession.createDataFrame(pairs, "snk string, src string").withColumn("__k", F.lit(1))
    files = df.select("file").distinct().withColumn("__k", F.lit(1))
    need = files.join(wanted, "__k").drop("__k")
    bad = ~((F.abs("re") < float("inf")) & (F.abs("im") < float("inf"))) | F.isnan("re") | F.isnan("im")
    have = df.groupBy("file", "snk", "src").agg(F.count("*").alias("n"), F.count_distinct("t").alias("times"), F.max(bad).alias("bad"))
    met = need.join(have, ["file", "snk", "src"], "left")
    fault = F.when(F.col("n").isNull(), "missing").when(F.col("n") > F.col("times"), "twice").when(F.col("times") != nt, "length").when(F.col("bad"), "not finite")
    return met.select("file", "snk", "src", fault.alias("fault")).where("fault IS NOT NULL")


def import_packed(df: DataFrame, layout: DataFrame, nt: int) -> DataFrame:
    """Packed vectors (sample, values array) by a layout (slot, corr_id, snk, src, parity): value k is time k mod nt of slot k / nt."""
    long = df.select("sample", F.posexplode("values").alias("k", "x"))
    placed = long.select("sample", F.floor(F.col("k") / nt).cast("int").alias("slot"), (F.col("k") % nt).alias("t"), F.col("x").cast("double").alias("x"))
    return placed.join(layout, "slot").drop("slot")


def import_matrix(df: DataFrame) -> DataFrame:
    """Rows (replica, values array) as (replica, t, x), NaN as 0, and the mean of each column as replica -1."""
    long = df.select("replica", F.posexplode("values").alias("t", "x")).withColumn("x", F.nanvl(F.col("x").cast("double"), F.lit(0.0)))
    return long.unionByName(long.groupBy("t").agg(F.avg("x").alias("x")).withColumn("replica", F.lit(-1).cast(dict(df.dtypes)["replica"])))


def write_samples(df: DataFrame, path: str, overwrite: bool = False) -> bool:
    """Write a sample table by corr_id; an existing one stays unless overwritten. Whether it was written."""
    spark = df.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not overwrite and at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return False
    df.write.mode("overwrite").partitionBy("corr_id").parquet(path)
    return True


def load_samples(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    return (spark.read.schema(schema) if schema else spark.read).parquet(path)


FIELDS = ("min", "low", "central", "high", "max", "check")


def write_summary(df: DataFrame, path: str, key: tuple[str, ...] = ("t",), field: str = "corr") -> None:
    """Summary text: a header, key columns, six numbers of a field; one folder a corr_id."""
    names = [F.col(c).cast("double").alias(field + ("" if c == "central" else f"_{c}")) for c in FIELDS]
    df.select("corr_id", *key, *names).sortWithinPartitions("corr_id", *key).write.mode("overwrite").partitionBy("corr_id").option("header", True).option("sep", " ").csv(path)


def read_summary(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("sep", " ").option("comment", "#").csv(path)


def read_field(spark: SparkSession, path: str, field: str, schema: str, order: str = "t") -> DataFrame:
    """Value, low and high of a field from the first row of each series' summary."""
    rows = read_summary(spark, path, schema)
    first = F.min_by(F.struct(F.col(field).alias("value"), F.col(f"{field}_low").alias("low"), F.col(f"{field}_high").alias("high")), order)
    return rows.groupBy("corr_id").agg(first.alias("x")).select("corr_id", "x.*")


def read_kv(spark: SparkSession, path: str, multi: bool = False) -> DataFrame:
    """Lists of a key and an optional value; # begins a comment. A key that comes twice is an error unless multi."""
    line = F.trim(F.regexp_replace("value", "#.*", ""))
    parts = F.split(line, r"\s+", 2)
    rows = spark.read.text(path).where(line != "").select(parts[0].alias("key"), F.when(F.size(parts) > 1, parts[1]).alias("value"))
    if multi:
        return rows
    n = rows.groupBy("key").agg(F.count("*").alias("n"), F.first("value").alias("value"))
    return n.withColumn("n", F.when(F.col("n") == 1, 1).otherwise(F.raise_error(F.concat(F.lit("key comes twice: "), "key")))).where("n = 1").drop("n")


# Logs: lines (file, line_no, value).


def log_iterations(lines: DataFrame, max_inner: int = 5000, max_outer: int = 100, max_inner_light: int = 15000) -> DataFrame:
    """Least and greatest inner, outer and final iterations of each quark, and whether a limit is reached. The quark is the third
    part of the last propagator named above (the fourth of a sequential one)."""
    w = W.partitionBy("file").orderBy("line_no").rowsBetween(W.unboundedPreceding, W.currentRow)
    name = F.split(F.regexp_extract("value", r"Computing quark propagator '([^']*)'", 1), "_")
    quark = F.when(F.col("value").contains("Computing quark propagator"), F.when(name[0] == "SeqProp", name[3]).otherwise(name[2]))
    inner = r"Inner CG iterations (\d+) Outer (\d+) Final (\d+)"
    part = lambda k: F.regexp_extract("value", inner, k).cast("int")
    seen = lines.withColumn("quark", F.last(quark, ignorenulls=True).over(w)).where(F.col("value").rlike(inner) & F.col("quark").isNotNull())
    n = seen.select("file", "quark", part(1).alias("inner"), part(2).alias("outer"), part(3).alias("final"))
    limit = F.when(F.col("quark") == "l", max_inner_light).otherwise(max_inner)
    over = (F.col("inner") >= limit) | (F.col("final") >= limit) | (F.col("outer") >= max_outer)
    span = [f(x).alias(f"{x}_{g}") for x in ("inner", "outer", "final") for f, g in ((F.min, "min"), (F.max, "max"))]
    return n.groupBy("file", "quark").agg(*span, F.max(over).alias("exceeded"))


def log_status(lines: DataFrame, marker: str) -> DataFrame:
    return lines.groupBy("file").agg(F.max(F.col("value").contains(marker)).alias("good"))


def log_io(lines: DataFrame) -> DataFrame:
    """Rates of input and output under the last directory named above: stripe, size and its suffix, kind, direction, rate."""
    w = W.partitionBy("file").orderBy("line_no").rowsBetween(W.unboundedPreceding, W.currentRow)
    here = F.when(F.col("value").contains("-- Directory"), F.regexp_extract("value", r"-- Directory (\S+)", 1))
    seen = lines.withColumn("dir", F.last(here, ignorenulls=True).over(w)).where(F.col("value").contains(" bytes in ") & F.col("dir").isNotNull())
    leaf = F.element_at(F.split("dir", "/"), -1)
    part = lambda p, k: F.regexp_extract(leaf, p, k)
    return seen.select(
        "file", "dir", part(r"^stripe(\d+)_", 1).cast("int").alias("stripe"), part(r"_size(\d+)([A-Za-z])$", 1).cast("int").alias("size"), part(r"_size(\d+)([A-Za-z])$", 2).alias("suffix"),
        F.when(F.col("value").contains("IOobject:"), "C-Lime").otherwise("std-IO").alias("kind"), F.when(F.lower("value").contains("read"), "Read").otherwise("Write").alias("direction"),
        F.regexp_extract("value", r"(\d+(?:\.\d+)?) MB/s", 1).cast("double").alias("rate"),
    )


def count_patterns(lines: DataFrame, patterns: dict[str, str]) -> DataFrame:
    """Lines of each file that match each pattern; one pass for all."""
    return lines.groupBy("file").agg(*[F.sum(F.when(F.col("value").rlike(p), 1).otherwise(0)).alias(n) for n, p in patterns.items()])
