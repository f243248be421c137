"""Sorts, top rows, ranks, pages, runs and set operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .ranking import with_rank


def max_corr(summary: DataFrame) -> DataFrame:
    """The t of the largest central value of each series and its relative error."""
    error = (F.col("high") - F.col("low")) / (2 * F.abs("central"))
    top = F.max_by(F.struct("t", "central", error.alias("relative_error")), "central")
    return summary.groupBy("corr_id").agg(top.alias("x")).select("corr_id", "x.*")


def rank_fits(fits: DataFrame, stat: str = "pvalue_h", ascending: bool = False, by: tuple[str, ...] = ("base",)) -> DataFrame:
    """Adds seq: the place by a statistic, ties by fit times, shorter lists first."""
    order = F.asc(stat) if ascending else F.desc(stat)
    return fits.withColumn("seq", F.row_number().over(W.partitionBy(*by).orderBy(order, "fit_times")))


def pick_fit(fits: DataFrame, by: tuple[str, ...] = ("base",), stat: str = "pvalue_h") -> DataFrame:
    """Of each group the fit with most points, then the best statistic, then the first times."""
    best = F.max_by(F.struct(*fits.columns), F.struct("points", stat, F.transform("fit_times", lambda t: -t)))
    return fits.groupBy(*by).agg(best.alias("x")).select("x.*")


def fit_window(fits: DataFrame, ti: tuple[int, int], tf: tuple[int, int], chi_max: float, n: int, by: tuple[str, ...] = ("base",)) -> DataFrame:
    """Fits whose start, end and chi-square are within limits; the first n of each start by end."""
    inside = fits.where(F.col("ti").between(*ti) & F.col("tf").between(*tf) & (F.col("chi_sq_dof") <= chi_max))
    return inside.withColumn("place", F.row_number().over(W.partitionBy(*by, "ti").orderBy("tf", "fit_id"))).where(F.col("place") <= n)


def with_page(df: DataFrame, rows: int, seq: str = "seq") -> DataFrame:
    return df.withColumn("page", F.floor((F.col(seq) - 1) / rows).cast("int"))


def cap_momentum(df: DataFrame, caps: DataFrame) -> DataFrame:
    """Rows whose n2 is at most their ensemble's cap (ensemble, n2_max); ensembles without a cap stay."""
    met = df.join(caps, "ensemble", "left")
    return met.where(F.col("n2_max").isNull() | (F.col("n2") <= F.col("n2_max"))).drop("n2_max")


def global_order(df: DataFrame, columns: tuple[str, ...] = ("ensemble", "form_factor", "n2")) -> DataFrame:
    return df.orderBy(*columns)


def number_ops(df: DataFrame, column: str) -> DataFrame:
    """Adds idx: the place of the name among the sorted distinct names. Rows without a name are left out."""
    names = with_rank(df.select(column).where(F.col(column).isNotNull()).distinct(), (), [column], "idx")
    return df.join(names.withColumn("idx", F.col("idx").cast("int")), column)


def leave_out(df: DataFrame, ensembles: list[str]) -> DataFrame:
    return df.where(~F.col("ensemble").isin(ensembles))


def time_runs(df: DataFrame, by: tuple[str, ...] = ("fit_id",)) -> DataFrame:
    """Lists of times as runs of one step: by, run, first, last, step, n. A run ends where the step changes."""
    w = W.partitionBy(*by).orderBy("t")
    step = df.withColumn("__d", F.col("t") - F.lag("t").over(w))
    turn = step.withColumn("__new", F.when(F.lag("__d").over(w).isNull() | (F.col("__d") == F.lag("__d").over(w)), 0).otherwise(1))
    runs = turn.withColumn("run", F.sum("__new").over(w))
    return runs.groupBy(*by, "run").agg(F.min("t").alias("first"), F.max("t").alias("last"), F.count("*").alias("n"))


def common_params(a: DataFrame, b: DataFrame) -> DataFrame:
    """Keys of both, with the smaller size."""
    return a.withColumnRenamed("size", "s").join(b, ["object", "name"]).select("object", "name", F.least("s", "size").alias("size"))


def merge_params(a: DataFrame, b: DataFrame) -> DataFrame:
    """Keys of either, with the larger size."""
    return a.unionByName(b).groupBy("object", "name").agg(F.max("size").alias("size"))


def common_stats(a: Column, b: Column) -> Column:
    return F.array_intersect(a, b)


def merge_stats(a: Column, b: Column) -> Column:
    return F.array_union(a, b)


def zipper(a: Column, b: Column) -> Column:
    """Two lists in turn if they are equally long, else one after the other."""
    turn = F.flatten(F.transform(F.arrays_zip(a.alias("a"), b.alias("b")), lambda x: F.array(x["a"], x["b"])))
    return F.when(F.size(a) == F.size(b), turn).otherwise(F.concat(a, b))


def dedupe_files(df: DataFrame, column: str = "file") -> DataFrame:
    return df.dropDuplicates([column])


def assert_unique(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """df's distinct keys; a key that comes twice is an error when the result is read."""
    n = df.groupBy(*columns).count()
    return n.withColumn("count", F.when(F.col("count") == 1, 1).otherwise(F.raise_error(F.concat(F.lit("twice: "), F.concat_ws(",", *columns))))).where("count = 1").drop("count")


def duplicates(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    return df.groupBy(*columns).agg(F.count("*").alias("n")).where("n > 1")


def stack_ensembles(frames: dict[str, DataFrame]) -> DataFrame:
    """Rows of all ensembles, columns that one lacks null."""
    out = None
    for name, df in frames.items():
        one = df.withColumn("ensemble", F.lit(name))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def prefer_seed(catalog: DataFrame, seed: int) -> DataFrame:
    """Of each (base, type) the wanted seed if there is one, else the least."""
    best = F.min_by(F.struct(*catalog.columns), F.struct(F.col("seed") != seed, "seed"))
    return catalog.groupBy("base", "type").agg(best.alias("x")).select("x.*")


def get_columns(param: DataFrame, exact: list[str], partial: list[str]) -> DataFrame:
    """Parameters by name, whatever the case. Exact: a request without a digit also takes name and digits, one with a trailing 0 the
    bare name. Unknown requests give one row with value 0. Adds request."""
    name = F.lower("name")
    digits, none = F.regexp_extract(name, r"^(.*?)(\d+)$", 1), F.lit(None).cast("string")

    def asks(request: str) -> Column:
        want = request.lower()
        fits = name == want
        if not any(ch.isdigit() for ch in want):
            fits = fits | (digits == want)
        elif want[-1] == "0" and len(want) > 1 and not want[-2].isdigit():
            fits = fits | (name == want[:-1])
        return F.when(fits, F.lit(request)).otherwise(none)

    # one pass: the requests that a row answers, and a row for each; few rows answer any
    met = F.array_compact(F.array(none, *[asks(n) for n in exact], *[F.when(F.contains(name, F.lit(n.lower())), F.lit(n)).otherwise(none) for n in partial]))
    found = param.withColumn("__met", met).where(F.size("__met") > 0).select(F.explode("__met").alias("request"), *param.columns)
    requests = param.sparkSession.createDataFrame([(n,) for n in (*exact, *partial)], "request string")
    unknown = requests.join(found.select("request").distinct(), "request", "left_anti").select("request", *[F.lit(0.0 if n == "value" else None).cast(t).alias(n) for n, t in param.dtypes])
    return found.withColumn("value", F.coalesce("value", F.lit(0.0))).unionByName(unknown)


def select_payload(df: DataFrame, columns: tuple[str, ...] = ("corr_id", "t", "re", "im")) -> DataFrame:
    return df.select(*columns)


def select_times(df: DataFrame, fit_times: DataFrame, by: tuple[str, ...] = ("corr_id",)) -> DataFrame:
    """Values at the wanted times (corr_id, t), numbered in order; a time wanted twice or not there is an error."""
    want = assert_unique(fit_times, (*by, "t"))
    times = df.select(*by, "t").distinct().withColumn("__there", F.lit(True))
    known = want.join(times, [*by, "t"], "left")
    fine = known.withColumn("__there", F.when(F.col("__there"), True).otherwise(F.raise_error(F.lit("a time is not in the data")).cast("boolean"))).where("__there")
    placed = fine.withColumn("position", F.row_number().over(W.partitionBy(*by).orderBy("t")) - 1).drop("__there")
    return df.join(placed, [*by, "t"])


def n_points(fit_times: Column) -> Column:
    """Points in a list of lists of times."""
    return F.aggregate(F.transform(fit_times, lambda t: F.size(t)), F.lit(0), lambda a, n: a + n)


def x_domain(df: DataFrame, low: float | None = None, high: float | None = None) -> DataFrame:
    """Least and greatest x over used points; given limits rule."""
    used = df.where("used")
    return used.agg(F.coalesce(F.lit(low), F.min("x")).alias("x_min"), F.coalesce(F.lit(high), F.max("x")).alias("x_max"))


def ensemble_stats(models: DataFrame) -> DataFrame:
    """For each ensemble its models, whether they share one seed, and the bin size (0 if uneven)."""
    same = F.count_distinct("seed") == 1
    return models.groupBy("ensemble").agg(F.count("*").alias("models"), same.alias("one_seed"), F.when(F.min("bin_size") == F.max("bin_size"), F.max("bin_size")).otherwise(0).alias("bin_size"))


def to_physical(summary: DataFrame, ens: DataFrame, power: float = 0.5) -> DataFrame:
    """x times a_inv squared, y with its bounds times a_inv to a power. summary: (ensemble, x, low, central, high); ens: (ensemble, a_inv)."""
    met = summary.join(ens, "ensemble")
    f = F.pow("a_inv", F.lit(power))
    return met.withColumns({"x": F.col("x") * F.col("a_inv") * F.col("a_inv"), **{c: F.col(c) * f for c in ("low", "central", "high")}}).drop("a_inv")


def common_fit_params(params: DataFrame) -> DataFrame:
    """params: (base, fit_id, object, name, size). The parameters that every fit of a base has, with their least size: base, object, name, size."""
    fits = params.groupBy("base").agg(F.count_distinct("fit_id").alias("__fits"))
    held = params.groupBy("base", "object", "name").agg(F.count_distinct("fit_id").alias("__in"), F.min("size").alias("size"))
    return held.join(fits, "base").where("__in = __fits").drop("__in", "__fits")


def merged_fit_params(params: DataFrame) -> DataFrame:
    """As common_fit_params(), the parameters that any fit of a base has, with their largest size."""
    return params.groupBy("base", "object", "name").agg(F.max("size").alias("size"))
