"""Binning, jackknife, bootstrap and their statistics.

Raw: (corr_id, config, t, re, im). Binned: (corr_id, bin, t, re, im, n). Replicas: (corr_id, seed, replica, t, re, im) with the
central value in replica -1 and the mean of the replicas, where it is kept, in -2.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .ranking import with_rank

CENTRAL, MEAN = -1, -2
#: Replicas that one group job makes: bounds its matrices to CHUNK x bins.
CHUNK = 1000
ONE_SIGMA = 0.158655


def manifest(raw: DataFrame) -> DataFrame:
    """Measurements and configs of each series, and the counts of its configs in order."""
    per = raw.groupBy("corr_id", "config").agg(F.count("*").alias("n"))
    return per.groupBy("corr_id").agg(
        F.sum("n").alias("measurements"), F.count("*").alias("configs"),
        F.array_sort(F.collect_list(F.struct("config", "n"))).alias("config_count"),
    )


def bin_auto(raw: DataFrame) -> DataFrame:
    """One bin for each config: the mean of its measurements."""
    return raw.groupBy("corr_id", F.col("config").alias("bin"), "t").agg(F.avg("re").alias("re"), F.avg("im").alias("im"), F.count("*").alias("n"))


def bin_size(binned: DataFrame) -> DataFrame:
    """The bin size of each series; 0 if its bins differ."""
    return binned.groupBy("corr_id").agg(F.when(F.min("n") == F.max("n"), F.max("n")).otherwise(0).alias("bin_size"))


def bin_fixed(raw: DataFrame, size: int, order: list[str]) -> DataFrame:
    """Bins of ``size`` measurements in a row; the last may be smaller and is averaged by its own size."""
    placed = with_rank(raw.select("corr_id", "t", "re", "im", *[c for c in order if c not in ("corr_id", "t", "re", "im")]), ("corr_id", "t"), order, "place")
    placed = placed.withColumn("bin", F.floor(F.col("place") / size).cast("int"))
    return placed.groupBy("corr_id", "bin", "t").agg(F.avg("re").alias("re"), F.avg("im").alias("im"), F.count("*").alias("n"))


def sample_order(raw: DataFrame, how: str = "auto") -> DataFrame:
    """Adds ``place`` within a series: auto = config, rows without timeslice first, timeslice, file; old = timeslice, file, config;
    very_old = timeslice, config, file."""
    keys = {"auto": ["config", "src_t", "file"], "old": ["src_t", "file", "config"], "very_old": ["src_t", "config", "file"]}[how]
    return with_rank(raw, ("corr_id",), [F.asc_nulls_first(k) for k in keys], "place").withColumn("place", (F.col("place") + 1).cast("int"))


def per_timeslice(raw: DataFrame) -> DataFrame:
    """The series beside one series for each source timeslice, if it has more than one."""
    many = raw.groupBy("corr_id").agg(F.count_distinct("src_t").alias("k")).where("k > 1").select("corr_id")
    split = raw.join(many, "corr_id").withColumn("corr_id", F.concat_ws("_t_", "corr_id", "src_t"))
    return raw.unionByName(split.select(*raw.columns))


def mean_t(df: DataFrame) -> DataFrame:
    return df.groupBy("corr_id", "t").agg(F.avg("re").alias("re"), F.avg("im").alias("im"))


def jackknife(binned: DataFrame) -> DataFrame:
    """Leave-one-out means, replica = bin, and the central value. Series of one bin are an error."""
    w = W.partitionBy("corr_id", "t")
    n = F.count("*").over(w)
    out = lambda c: ((F.sum(c).over(w) - F.col(c)) / F.when(n > 1, n - 1).otherwise(F.raise_error(F.lit("a jackknife needs two bins")))).alias(c)
    left = binned.select("corr_id", F.col("bin").alias("replica"), "t", out("re"), out("im"))
    return left.unionByName(mean_t(binned).withColumn("replica", F.lit(CENTRAL)))


def boot_index(spark: SparkSession, seed: int, bins: int, replicas: int) -> DataFrame:
    """A portable table of draws: (seed, replica, draw, bin), 0 <= bin < bins, by integer arithmetic alone."""
    p = F.lit(2147483647).cast("long")
    base = spark.range(replicas * bins).select(F.floor(F.col("id") / bins).cast("long").alias("r"), F.pmod("id", F.lit(bins)).alias("d"))
    h = (F.lit(1103515245) * (F.col("r") + 1) + F.lit(69069) * (F.col("d") + 1) + F.lit(seed)) % p
    base = base.withColumn("h", h)
    for _ in range(3):
        base = base.withColumn("h", (F.col("h") * F.col("h") + F.lit(12345) * (F.col("d") + 1) + 7) % p)
    return base.select(F.lit(seed).cast("long").alias("seed"), F.col("r").cast("int").alias("replica"), F.col("d").cast("int").alias("draw"), (F.col("h") % bins).cast("int").alias("bin"))


def draw_means(binned: DataFrame, index: DataFrame) -> DataFrame:
    """The mean over the draws of each replica: an equi-join on the bin, summed on the map side. A bin drawn k times meets once,
    with weight k."""
    weight = index.groupBy("seed", "replica", "bin").agg(F.count("*").alias("k"))
    met = binned.join(weight, "bin")
    mean = lambda c: (F.sum(F.col(c) * F.col("k")) / F.sum("k")).alias(c)
    return met.groupBy("corr_id", "seed", "replica", "t").agg(mean("re"), mean("im"))


def bootstrap_join(binned: DataFrame, index: DataFrame) -> DataFrame:
    """Replicas and central value by the exact join path. The index is external, so published draws can be given."""
    middle = attach(mean_t(binned).withColumn("replica", F.lit(CENTRAL)), index.agg(F.min("seed").alias("seed")))
    return draw_means(binned, index).unionByName(middle)


def attach(df: DataFrame, row: DataFrame) -> DataFrame:
    """df with the columns of a table of one row."""
    return df.withColumn("__one", F.lit(1)).join(F.broadcast(row.withColumn("__one", F.lit(1))), "__one").drop("__one")


def bootstrap(binned: DataFrame, replicas: int, seed: int) -> DataFrame:
    """Replicas in array form (corr_id, seed, replica, re, im arrays by t) at scale: series x chunks of replicas as groups, each a
    product of a matrix of draw counts with the bins. Draws depend on seed, chunk and number of bins alone."""
    chunks = -(-replicas // CHUNK)
    # a series is packed to one row of arrays before it is copied for each chunk
    rows = binned.groupBy("corr_id").agg(F.collect_list(F.struct("bin", "t", F.col("re").cast("double").alias("re"), F.col("im").cast("double").alias("im"))).alias("v"))
    rows = rows.select("corr_id", *[F.col(f"v.{c}").alias(c) for c in ("bin", "t", "re", "im")])
    spread = rows.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1)))).repartition("corr_id", "chunk")
    schema = binned.sparkSession.createDataFrame([], "corr_id string, seed long, replica int, re array<double>, im array<double>").schema
    arrow = to_arrow_schema(schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for one in ({c: batch.column(c)[k] for c in batch.schema.names} for k in range(batch.num_rows)):
                get = lambda c: one[c].values.to_numpy(zero_copy_only=False)  # noqa: E731,B023
                bins, row = np.unique(get("bin"), return_inverse=True)
                times, column = np.unique(get("t"), return_inverse=True)
                n, chunk = len(bins), one["chunk"].as_py()
                first = chunk * CHUNK
                count = min(CHUNK, replicas - first)
                rng = np.random.Generator(np.random.PCG64([seed, n, chunk]))
                draws = rng.integers(0, n, size=(count, n)) + n * np.arange(count)[:, None]
                weights = np.bincount(draws.ravel(), minlength=count * n).reshape(count, n) / n
                made = []
                for c in ("re", "im"):
                    x = np.full((n, len(times)), np.nan)
                    x[row, column] = get(c)
                    made.append(list(weights @ x))
                columns = [[one["corr_id"].as_py()] * count, np.full(count, seed), np.arange(first, first + count), *made]
                yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(columns, arrow)], schema=arrow)

    return spread.select("corr_id", "chunk", "bin", "t", "re", "im").mapInArrow(run, schema)


def bootstrap_poisson(rows: DataFrame, replicas: int, seed: int) -> DataFrame:
    """For series of too many bins to gather: Poisson(1) weights in place of draws (an approximation whose error falls with the
    square root of the number of bins). No group is ever gathered."""
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), "corr_id", "bin", "replica"), 11).cast("double") + 0.5) / float(1 << 53)
    steps, p, total = F.lit(0), np.exp(-1.0), np.exp(-1.0)
    for k in range(1, 12):
        steps = steps + F.when(u > float(total), 1).otherwise(0)
        p /= k
        total += p
    spread = rows.withColumn("replica", F.explode(F.sequence(F.lit(0), F.lit(replicas - 1)))).withColumn("k", steps)
    mean = lambda c: (F.sum(F.col(c) * F.col("k")) / F.sum("k")).alias(c)
    return spread.groupBy("corr_id", "replica", "t").agg(mean("re"), mean("im"))


def to_arrays(replicas: DataFrame) -> DataFrame:
    """Long to array form; t must be 0..Nt-1."""
    packed = replicas.groupBy("corr_id", "replica").agg(F.array_sort(F.collect_list(F.struct("t", "re", "im"))).alias("x"))
    return packed.select("corr_id", "replica", F.col("x.re").alias("re"), F.col("x.im").alias("im"))


def to_long(arrays: DataFrame) -> DataFrame:
    other = [c for c in arrays.columns if c not in ("re", "im")]
    return arrays.select(*other, F.posexplode(F.arrays_zip("re", "im")).alias("t", "x")).select(*other, "t", "x.re", "x.im")


def finite(df: DataFrame, column: str) -> DataFrame:
    return df.where(is_finite(F.col(column)))


def is_finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def stats(replicas: DataFrame, value: str = "re", by: tuple[str, ...] = ("corr_id", "t")) -> DataFrame:
    """min, low, central, high, max, check of the replicas of each group. Low and high are order statistics of the finite
    replicas: with k = floor(0.158655 n + 0.5) the k-th from either end. No replica: bounds are the central value and check 1;
    none finite: NaN and check 0. Only the two ranks wanted are kept, so nothing is collected."""
    x = F.col(value)
    real = F.col("replica") >= 0
    ok = real & is_finite(x)
    flagged = replicas.where(real | (F.col("replica") == CENTRAL)).withColumn("__ok", ok)
    w = W.partitionBy(*by, "__ok")
    n = F.count("*").over(w)
    k = F.floor(n * ONE_SIGMA + 0.5)
    placed = flagged.withColumns({"__i": F.row_number().over(w.orderBy(value)) - 1, "__n": n, "__k": k})
    one = lambda c: F.max(F.when(c, x))
    good = F.col("__ok")
    found = placed.groupBy(*by).agg(
        F.min(F.when(good, x)).alias("min"), one(good & (F.col("__i") == F.col("__k"))).alias("low"),
        one(F.col("replica") == CENTRAL).alias("central"), one(good & (F.col("__i") == F.col("__n") - 1 - F.col("__k"))).alias("high"),
        F.max(F.when(good, x)).alias("max"), F.sum(F.when(good, 1).otherwise(0)).alias("__good"), F.sum(F.when(real, 1).otherwise(0)).alias("__all"),
    )
    bound = lambda c: F.when(F.col("__all") == 0, F.col("central")).when(F.col("__good") == 0, F.lit(float("nan"))).otherwise(F.col(c)).alias(c)
    check = F.when(F.col("__all") == 0, F.lit(1.0)).otherwise(F.col("__good") / F.col("__all")).alias("check")
    return found.select(*by, bound("min"), bound("low"), "central", bound("high"), bound("max"), check)


def stats_jackknife(replicas: DataFrame, value: str = "re", by: tuple[str, ...] = ("corr_id", "t")) -> DataFrame:
    """As stats(), for jackknife replicas: sigma about the central value."""
    x = F.col(value)
    middle = replicas.where(F.col("replica") == CENTRAL).select(*by, x.alias("central"))
    met = replicas.where(F.col("replica") >= 0).join(middle, list(by))
    ok = is_finite(x)
    d = F.when(ok, x - F.col("central"))
    n = F.sum(F.when(ok, 1).otherwise(0))
    found = met.groupBy(*by).agg(
        F.min(F.when(ok, x)).alias("min"), F.max(F.when(ok, x)).alias("max"), F.first("central").alias("central"),
        F.sqrt((n - 1) / n * F.sum(d * d)).alias("sigma"), (n / F.count("*")).alias("check"),
    )
    return found.select(*by, "min", (F.col("central") - F.col("sigma")).alias("low"), "central", (F.col("central") + F.col("sigma")).alias("high"), "max", "check")


def bias(replicas: DataFrame, value: str = "re", by: tuple[str, ...] = ("corr_id", "t")) -> DataFrame:
    """stats() about the mean of the replicas."""
    real = replicas.where("replica >= 0")
    mean = real.groupBy(*by).agg(F.avg(value).alias(value)).withColumn("replica", F.lit(CENTRAL))
    return stats(real.select(*by, value, "replica").unionByName(mean.select(*by, value, "replica")), value, by)


def first_replicas(df: DataFrame, n: int) -> DataFrame:
    return df.where(F.col("replica") < n)


def sample_sizes(df: DataFrame) -> DataFrame:
    """The least and greatest number of bins or replicas over the series."""
    per = df.groupBy("corr_id").agg(F.count_distinct("bin").alias("n"))
    return per.agg(F.min("n").alias("least"), F.max("n").alias("most"))


def parametric_replicas(constants: DataFrame, replicas: int, seed: int) -> DataFrame:
    """Gaussian replicas of (name, value, sigma): replica -1 is the value. Equal seeds and names give equal replicas."""
    spread = constants.withColumn("replica", F.explode(F.sequence(F.lit(CENTRAL), F.lit(replicas - 1))))
    u = lambda k: (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(k), "name", "replica"), 11).cast("double") + 0.5) / float(1 << 53)
    normal = F.sqrt(-2 * F.log(u(1))) * F.cos(2 * float(np.pi) * u(2))
    return spread.select("name", "replica", F.when(F.col("replica") == CENTRAL, F.col("value")).otherwise(F.col("value") + F.col("sigma") * normal).alias("value"))


def rehydrated(stored: DataFrame | None, binned: DataFrame | None, index: DataFrame, replicas: int) -> DataFrame:
    """Stored replicas if they were drawn by the index's seed and are enough, else drawn again from the bins."""
    if stored is not None:
        want = index.select("seed").first()
        have = stored.where("replica >= 0").agg(F.min("seed").alias("a"), F.max("seed").alias("b"), F.max("replica").alias("r")).first()
        if want and have["a"] == have["b"] == want["seed"] and have["r"] is not None and have["r"] + 1 >= replicas:
            return first_replicas(stored, replicas)
    if binned is None:
        raise ValueError("neither enough replicas nor bins are stored")
    return first_replicas(bootstrap_join(binned, index), replicas)


