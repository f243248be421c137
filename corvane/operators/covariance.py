"""Covariance of series over replicas, bins or raw data, and what is made from it.

Pairs: (corr_id, i, j, cov). Sums run over the lower triangle only (j <= i) and are mirrored; a series has Nt * (Nt + 1) / 2
pairs for each replica, which are summed on the map side.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .ranking import with_rank
from .resample import attach, bin_auto, bin_fixed

#: Replicas whose draw counts are one row, and bins of it.
CHUNK, BLOCK = 250, 2048

#: Factor of the sum of products for n rows.
NORMS = {
    "bootstrap": lambda n: 1 / n,
    "jackknife": lambda n: (n - 1) / n,
    "raw_binned": lambda n: 1 / (n * (n - 1)),
    "sample": lambda n: 1 / (n - 1),
}


def pair_product(df: DataFrame, row: str, value: str, by: tuple[str, ...] = ("corr_id",), at: str = "t") -> DataFrame:
    """Products of the deviations ``value`` of every pair j <= i of one row: by, row, i, j, product."""
    left = df.select(*by, row, F.col(at).alias("i"), F.col(value).alias("__a"))
    right = df.select(*by, row, F.col(at).alias("j"), F.col(value).alias("__b"))
    met = left.join(right, [*by, row]).where(F.col("j") <= F.col("i"))
    return met.select(*by, row, "i", "j", (F.col("__a") * F.col("__b")).alias("product"))


def mirrored(lower: DataFrame) -> DataFrame:
    upper = lower.where("i <> j").withColumns({"i": F.col("j"), "j": F.col("i")})
    return lower.unionByName(upper.select(*lower.columns))


def covariance(rows: DataFrame, row: str, norm: str, value: str = "x", by: tuple[str, ...] = ("corr_id",), about: DataFrame | None = None, at: str = "t") -> DataFrame:
    """rows: (by, row, t, x). About their mean, or about the values of ``about`` (by, t, x). Gives by, i, j, cov."""
    center = (rows.groupBy(*by, at).agg(F.avg(value).alias("__m")) if about is None else about.select(*by, at, F.col(value).alias("__m")))
    moved = rows.join(center, [*by, at]).withColumn("__d", F.col(value) - F.col("__m"))
    products = pair_product(moved, row, "__d", by, at)
    lower = products.groupBy(*by, "i", "j").agg((F.sum("product") * NORMS[norm](F.count("*").cast("double"))).alias("cov"))
    return mirrored(lower)


def covariance_complex(rows: DataFrame, row: str, norm: str, by: tuple[str, ...] = ("corr_id",)) -> DataFrame:
    """Covariance of complex rows (re, im), conjugate on the left: cov_re, cov_im for j <= i; the mirror is the conjugate."""
    mean = rows.groupBy(*by, "t").agg(F.avg("re").alias("__r"), F.avg("im").alias("__i"))
    d = rows.join(mean, [*by, "t"]).select(*by, row, "t", (F.col("re") - F.col("__r")).alias("dr"), (F.col("im") - F.col("__i")).alias("di"))
    a = d.select(*by, row, F.col("t").alias("i"), F.col("dr").alias("ar"), F.col("di").alias("ai"))
    b = d.select(*by, row, F.col("t").alias("j"), F.col("dr").alias("br"), F.col("di").alias("bi"))
    met = a.join(b, [*by, row]).where("j <= i")
    k = NORMS[norm](F.count("*").cast("double"))
    return met.groupBy(*by, "i", "j").agg(
        (F.sum(F.col("ar") * F.col("br") + F.col("ai") * F.col("bi")) * k).alias("cov_re"),
        (F.sum(F.col("ar") * F.col("bi") - F.col("ai") * F.col("br")) * k).alias("cov_im"),
    )


def resampled_covariance(binned: DataFrame, index: DataFrame, value: str = "x", chunk: int = CHUNK, block: int = BLOCK) -> DataFrame:
    """For each replica the covariance of its draws about their mean, over n (n - 1): corr_id, replica, i, j, cov. Of a series ``block`` bins
    become one row, the draw counts of ``chunk`` replicas for these bins another; both meet by their numbers, a task makes X^T diag(counts) X
    for a replica at a time, and the blocks of a series are summed. Draws of bins that a series does not have are left out."""
    part = lambda c, n: F.floor(F.col(c) / n).cast("int")
    counts = index.groupBy("replica", "bin").agg(F.count("*").cast("double").alias("k")).select(part("replica", chunk).alias("chunk"), part("bin", block).alias("block"), F.col("replica").cast("int").alias("replica"), F.col("bin").cast("int").alias("bin"), "k")
    drawn = counts.groupBy("chunk", "block").agg(F.collect_list(F.struct("replica", "bin", "k")).alias("d")).select("chunk", "block", *[F.col(f"d.{c}").alias(f"draw_{c}") for c in ("replica", "bin", "k")])
    # a shift by the mean, which a covariance does not see, keeps differences exact
    middle = binned.groupBy("corr_id", "t").agg(F.avg(value).alias("middle"))
    moved = binned.join(middle, ["corr_id", "t"]).select("corr_id", part("bin", block).alias("block"), F.struct(F.col("bin").cast("int").alias("bin"), F.col("t").cast("int").alias("t"), (F.col(value) - F.col("middle")).cast("double").alias("x")).alias("v"))
    series = moved.groupBy("corr_id", "block").agg(F.collect_list("v").alias("v")).select("corr_id", "block", *[F.col(f"v.{c}").alias(c) for c in ("bin", "t", "x")])
    schema = binned.sparkSession.createDataFrame([], f"corr_id {dict(binned.dtypes)['corr_id']}, replica int, i int, j int, product double, a double, b double, n double").schema
    arrow = to_arrow_schema(schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for one in ({c: batch.column(c)[k] for c in batch.schema.names} for k in range(batch.num_rows)):
                yield from _gram(one, arrow)

    sums = series.join(drawn, "block").select("corr_id", "bin", "t", "x", "draw_replica", "draw_bin", "draw_k").mapInArrow(run, schema)
    total = sums.groupBy("corr_id", "replica", "i", "j").agg(*[F.sum(c).alias(c) for c in ("product", "a", "b", "n")])
    return mirrored(total.select("corr_id", "replica", "i", "j", ((F.col("product") - F.col("a") * F.col("b") / F.col("n")) / (F.col("n") * (F.col("n") - 1))).alias("cov")))


def _gram(one: dict, arrow: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Weighted sums of products, of both factors and of the weights, j <= i, a batch for each replica of a chunk."""
    get = lambda c: one[c].values.to_numpy(zero_copy_only=False)
    bins, row = np.unique(get("bin"), return_inverse=True)
    times, column = np.unique(get("t"), return_inverse=True)
    x = np.zeros((len(bins), len(times)))
    x[row, column] = get("x")
    replicas, of = np.unique(get("draw_replica"), return_inverse=True)
    at = np.minimum(np.searchsorted(bins, get("draw_bin")), len(bins) - 1)
    known = bins[at] == get("draw_bin")
    weight = np.zeros((len(replicas), len(bins)))
    weight[of[known], at[known]] = get("draw_k")[known]
    i, j = np.tril_indices(len(times))
    for r, w in zip(replicas, weight):
        product, total = (x * w[:, None]).T @ x, w @ x
        columns = [[one["corr_id"].as_py()] * len(i), np.full(len(i), r), times[i], times[j], product[i, j], total[i], total[j], np.full(len(i), w.sum())]
        yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(columns, arrow)], schema=arrow)


def rebooted_covariance(binned: DataFrame, index: DataFrame, inner: int, seed: int, value: str = "x", chunk: int = CHUNK) -> DataFrame:
    """For each replica a bootstrap of its own: ``inner`` draws from the bins that the replica has drawn, and the covariance of their means
    about their mean (norm of a bootstrap): corr_id, replica, i, j, cov. Draws depend on seed, series, replica and number of bins alone.
    One row holds a series' bins, another the draw counts of ``chunk`` replicas; a series must have all of the index's bins."""
    counts = index.groupBy("replica", "bin").agg(F.count("*").cast("double").alias("k"))
    drawn = counts.groupBy(F.floor(F.col("replica") / chunk).cast("int").alias("chunk")).agg(F.collect_list(F.struct(F.col("replica").cast("int").alias("replica"), F.col("bin").cast("int").alias("bin"), "k")).alias("d"))
    drawn = drawn.select("chunk", *[F.col(f"d.{c}").alias(f"draw_{c}") for c in ("replica", "bin", "k")])
    series = binned.groupBy("corr_id").agg(F.collect_list(F.struct(F.col("bin").cast("int").alias("bin"), F.col("t").cast("int").alias("t"), F.col(value).cast("double").alias("x"))).alias("v"))
    series = series.select("corr_id", F.xxhash64("corr_id").alias("key"), *[F.col(f"v.{c}").alias(c) for c in ("bin", "t", "x")])
    last = attach(series, index.agg(F.max("replica").alias("__most"))).where("__most is not null")
    spread = last.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.floor(F.col("__most") / chunk).cast("int"))))
    schema = binned.sparkSession.createDataFrame([], f"corr_id {dict(binned.dtypes)['corr_id']}, replica int, i int, j int, cov double").schema
    arrow = to_arrow_schema(schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for one in ({c: batch.column(c)[k] for c in batch.schema.names} for k in range(batch.num_rows)):
                get = lambda c: one[c].values.to_numpy(zero_copy_only=False)  # noqa: E731,B023
                bins, row = np.unique(get("bin"), return_inverse=True)
                times, column = np.unique(get("t"), return_inverse=True)
                x = np.zeros((len(bins), len(times)))
                x[row, column] = get("x")
                x -= x.mean(axis=0)
                replicas, of = np.unique(get("draw_replica"), return_inverse=True)
                weight = np.zeros((len(replicas), len(bins)))
                weight[of, np.searchsorted(bins, get("draw_bin"))] = get("draw_k")
                i, j = (v.ravel() for v in np.meshgrid(times, times, indexing="ij"))
                for r, w in zip(replicas, weight):
                    rng = np.random.Generator(np.random.PCG64([seed, int(r), len(bins), one["key"].as_py() & 0xFFFFFFFF]))
                    n = int(w.sum())
                    means = rng.multinomial(n, w / n, inner) @ x / n
                    means -= means.mean(axis=0)
                    columns = [[one["corr_id"].as_py()] * len(i), np.full(len(i), r), i, j, (means.T @ means / inner).ravel()]
                    yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(columns, arrow)], schema=arrow)

    met = spread.join(drawn, "chunk").select("corr_id", "key", "bin", "t", "x", "draw_replica", "draw_bin", "draw_k")
    return met.mapInArrow(run, schema)


def rebinned(raw: DataFrame, sizes: list[int], order: list[str], value: str = "re") -> DataFrame:
    """Covariance with a bin size for each series: the first series (by name) has the first size, and so on, the last size holds for all that
    follow; 0 stands for one bin a config."""
    if not sizes or min(sizes) < 0:
        raise ValueError("bin sizes are 0 or more, and one at least")
    place = with_rank(raw.select("corr_id").distinct(), (), ["corr_id"], "__k").select("corr_id", F.least("__k", F.lit(len(sizes) - 1)).alias("__k"))
    placed, out = raw.join(place, "corr_id"), None
    for k, size in enumerate(sizes):
        own = placed.where(F.col("__k") == k).drop("__k")
        one = covariance(bin_fixed(own, size, order) if size else bin_auto(own), "bin", "raw_binned", value)
        out = one if out is None else out.unionByName(one)
    return out


def given_inverse(inverse: DataFrame, sigma: DataFrame, by: tuple[str, ...] = ("corr_id",)) -> DataFrame:
    """As inverse_cholesky(), for an inverse correlation (by, i, j, inverse) that is given: its lower factor and sigma (by, i, sigma)."""
    types = dict(inverse.dtypes)

    def job(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        m = _square(pdf, "inverse")
        at = np.sort(pdf["i"].unique())
        lower = np.linalg.cholesky((m + m.T) / 2)
        i, j = np.meshgrid(at, at, indexing="ij")
        return pd.DataFrame({**{n: k for n, k in zip(by, key)}, "i": i.ravel(), "j": j.ravel(), "inverse": m.ravel(), "chol": lower.ravel()})

    factor = inverse.groupBy(*by).applyInPandas(job, ", ".join(f"`{c}` {types[c]}" for c in by) + ", i int, j int, inverse double, chol double")
    return factor.join(sigma.select(*by, "i", "sigma"), [*by, "i"])


def correlation(cov: DataFrame, by: tuple[str, ...] = ("corr_id",)) -> DataFrame:
    """cov over the roots of its diagonal; the diagonal itself is 1."""
    diagonal = cov.where("i = j").select(*by, "i", F.col("cov").alias("__v"))
    met = cov.join(diagonal, [*by, "i"]).join(diagonal.select(*by, F.col("i").alias("j"), F.col("__v").alias("__w")), [*by, "j"])
    return met.select(*by, "i", "j", F.when(F.col("i") == F.col("j"), 1.0).otherwise(F.col("cov") / F.sqrt(F.col("__v") * F.col("__w"))).alias("corr"))


def shrink(m: DataFrame, rho: float, value: str = "corr") -> DataFrame:
    """(1 - rho) m + rho 1."""
    return m.withColumn(value, (1 - rho) * F.col(value) + F.when(F.col("i") == F.col("j"), rho).otherwise(0.0))


def block_mask(m: DataFrame, same: Column, value: str = "cov") -> DataFrame:
    """Zero where ``same`` is false: entries of unequal ensembles, or of unequal form factors too."""
    return m.withColumn(value, F.when(same, F.col(value)).otherwise(0.0))


def param_correlation(param: DataFrame) -> DataFrame:
    """param: (fit_id, replica, name, value). Correlation over replicas of each fit's parameters."""
    ranked = param.where("replica >= 0").withColumnRenamed("name", "t")
    return correlation(covariance(ranked, "replica", "bootstrap", "value", ("fit_id",)), ("fit_id",))


def covar_source(raw: DataFrame, replicas: DataFrame, source: str = "bootstrap", rebin: int = 0, order: list[str] | None = None, value: str = "re") -> DataFrame:
    """Covariance of the mean from replicas ('bootstrap', the default), bins of a config ('binned'), raw data ('raw') or bins of
    ``rebin`` measurements ('rebin', 0 for one bin a config)."""
    if source == "bootstrap":
        return covariance(replicas.where("replica >= 0"), "replica", "bootstrap", value)
    if source == "raw":
        return covariance(with_rank(raw, ("corr_id", "t"), order or ["config"], "bin"), "bin", "raw_binned", value)
    bins = bin_auto(raw) if source == "binned" or not rebin else bin_fixed(raw, rebin, order or ["config"])
    return covariance(bins, "bin", "raw_binned", value)


def frozen_modes(cov: DataFrame, resampled: DataFrame, mode: str) -> DataFrame:
    """One covariance for each replica. frozen: the same for all; semi: one correlation, each replica's variances; unfrozen: each
    replica's own."""
    if mode == "unfrozen":
        return resampled
    replicas = resampled.select("corr_id", "replica").distinct()
    if mode == "frozen":
        return replicas.join(cov, "corr_id").select("corr_id", "replica", "i", "j", "cov")
    sigma = resampled.where("i = j").select("corr_id", "replica", "i", F.sqrt("cov").alias("__s"))
    met = correlation(cov).join(sigma, ["corr_id", "i"]).join(sigma.select("corr_id", "replica", F.col("i").alias("j"), F.col("__s").alias("__u")), ["corr_id", "replica", "j"])
    return met.select("corr_id", "replica", "i", "j", (F.col("corr") * F.col("__s") * F.col("__u")).alias("cov"))


def _square(pdf: pd.DataFrame, value: str) -> np.ndarray:
    return pdf.pivot(index="i", columns="j", values=value).fillna(0.0).to_numpy()


def block_condition(m: DataFrame, by: tuple[str, ...] = ("corr_id",), value: str = "cov") -> DataFrame:
    """Condition number and eigenvalues (ascending) of each block; a block is one matrix of fitted points."""

    def job(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        e = np.linalg.eigvalsh(_square(pdf, value))
        return pd.DataFrame({**{c: [k] for c, k in zip(by, key)}, "condition": [float(abs(e).max() / max(abs(e).min(), 1e-300))], "eigenvalues": [e.tolist()]})

    types = dict(m.dtypes)
    return m.groupBy(*by).applyInPandas(job, ", ".join(f"`{c}` {types[c]}" for c in by) + ", condition double, eigenvalues array<double>")


def inverse_cholesky(cov: DataFrame, by: tuple[str, ...] = ("corr_id",)) -> DataFrame:
    """Of each block's correlation: inverse and the lower Cholesky factor of the inverse (inv = L L^T), with sigma of row i. Where the
    matrix is not positive definite, the pseudo-inverse and a factor from its eigenvectors."""

    def job(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        c = _square(pdf, "cov")
        at = np.sort(pdf["i"].unique())
        s = np.sqrt(np.diag(c))
        r = c / np.outer(s, s)
        try:
            np.linalg.cholesky(r)
            inverse = np.linalg.inv(r)
            factor = np.linalg.cholesky((inverse + inverse.T) / 2)
        except np.linalg.LinAlgError:
            e, v = np.linalg.eigh(r)
            root = np.where(e > 1e-12 * e.max(), 1 / np.sqrt(np.where(e > 0, e, 1)), 0.0)
            factor = v * root
            inverse = factor @ factor.T
        i, j = np.meshgrid(at, at, indexing="ij")
        return pd.DataFrame({**{n: k for n, k in zip(by, key)}, "i": i.ravel(), "j": j.ravel(), "inverse": inverse.ravel(), "chol": factor.ravel(), "sigma": np.repeat(s, len(at))})

    types = dict(cov.dtypes)
    return cov.groupBy(*by).applyInPandas(job, ", ".join(f"`{c}` {types[c]}" for c in by) + ", i int, j int, inverse double, chol double, sigma double")


def whiten(residual: DataFrame, chol: DataFrame, by: tuple[str, ...] = ("corr_id",)) -> DataFrame:
    """L^T (residual / sigma): by, replica, j, w. residual: (by, replica, t, r)."""
    met = residual.join(chol.withColumnRenamed("i", "t"), [*by, "t"])
    return met.groupBy(*by, "replica", "j").agg(F.sum(F.col("chol") * F.col("r") / F.col("sigma")).alias("w"))


def write_matrix(pairs: DataFrame, path: str, value: str = "corr", labels: list | None = None) -> DataFrame:
    """Write a square matrix as text, a header and a label for each row, in order of its parts; returns what was written."""
    wide = pairs.groupBy("i").pivot("j", labels).agg(F.first(value)).orderBy("i")
    wide.write.mode("overwrite").option("header", True).option("sep", " ").csv(path)
    return pairs.sparkSession.read.schema(wide.schema).option("header", True).option("sep", " ").csv(path)
