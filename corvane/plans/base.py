"""The driver's tables as series: lineitem stands for raw measurements (corr_id, config, t, re, im) with Nt = 7."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.operators import resample

NT, BINS, REPLICAS, SEED = 7, 100, 24, 17

SAMPLES = """samples AS (
  SELECT l_returnflag AS corr_id, l_linestatus AS status, CAST(l_orderkey % 100 AS INTEGER) AS config, CAST(l_linenumber - 1 AS INTEGER) AS t,
         l_extendedprice AS re, l_quantity AS im, l_orderkey AS o, l_partkey AS pk, l_suppkey AS sk, l_shipdate AS sd FROM lineitem)"""
BINNED = SAMPLES + """, binned AS (
  SELECT corr_id, config AS bin, t, avg(re) AS re, avg(im) AS im, count(*) AS n FROM samples GROUP BY corr_id, config, t)"""
CENTRAL = BINNED + """, central AS (SELECT corr_id, t, avg(re) AS re, avg(im) AS im FROM binned GROUP BY corr_id, t)"""
INDEX = f"""h0 AS (SELECT r, d, (1103515245 * (r + 1) + 69069 * (d + 1) + {SEED}) % 2147483647 AS h
  FROM (SELECT range AS r FROM range({REPLICAS})), (SELECT range AS d FROM range({BINS}))),
h1 AS (SELECT r, d, (h * h + 12345 * (d + 1) + 7) % 2147483647 AS h FROM h0),
h2 AS (SELECT r, d, (h * h + 12345 * (d + 1) + 7) % 2147483647 AS h FROM h1),
h3 AS (SELECT r, d, (h * h + 12345 * (d + 1) + 7) % 2147483647 AS h FROM h2),
boot_index AS (SELECT CAST(r AS INTEGER) AS replica, CAST(d AS INTEGER) AS draw, CAST(h % {BINS} AS INTEGER) AS bin FROM h3)"""
REPLICA = CENTRAL + ", " + INDEX + """, replica AS (
  SELECT corr_id, -1 AS replica, t, re, im FROM central UNION ALL
  SELECT corr_id, replica, t, avg(re) AS re, avg(im) AS im FROM boot_index JOIN binned USING (bin) GROUP BY corr_id, replica, t)"""
#: Two-point-like series, one for each returnflag, that fall with t: the replica's value times a falling exponential.
FALLING = REPLICA + """, falling AS (SELECT corr_id, replica, t, re * exp(-0.4 * t) AS re, im * exp(-0.4 * t) AS im FROM replica)"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("corr_id"), F.col("l_linestatus").alias("status"), (F.col("l_orderkey") % 100).cast("int").alias("config"),
        (F.col("l_linenumber") - 1).cast("int").alias("t"), F.col("l_extendedprice").alias("re"), F.col("l_quantity").alias("im"),
        F.col("l_orderkey").alias("o"), F.col("l_partkey").alias("pk"), F.col("l_suppkey").alias("sk"), F.col("l_shipdate").alias("sd"),
    )


def binned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.bin_auto(samples(spark, sf_dir))


def central(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.mean_t(binned(spark, sf_dir))


def replicas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bootstrap replicas by the exact join path, central in replica -1."""
    return resample.bootstrap_join(binned(spark, sf_dir), resample.boot_index(spark, SEED, BINS, REPLICAS)).drop("seed")


def falling(spark: SparkSession, sf_dir: str) -> DataFrame:
    decay = F.exp(-0.4 * F.col("t"))
    return replicas(spark, sf_dir).withColumns({"re": F.col("re") * decay, "im": F.col("im") * decay})
