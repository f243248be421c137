"""Fit ranges of several series: dependencies, combinations, and scans of every window from running moments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.scratch import staged


def fit_times(ti: Column, tf: Column, thin: Column) -> Column:
    """The times from ti to tf. thin (array of int; null: all) is read in pairs: a step and how many times to take at it, or 0 and how many to
    skip; a last step alone goes to the end, a last 0 alone leaves the rest out."""
    every = F.sequence(ti, tf)
    none = F.array().cast("array<int>")

    def taken(acc: Column, k: Column) -> Column:
        step, last = F.get(thin, 2 * k), F.size(thin) - 2 * k < 2
        given = F.when(last, tf + 1).otherwise(F.get(thin, 2 * k + 1))
        left = F.floor((tf - acc["t"]) / F.when(step == 0, 1).otherwise(step)).cast("int") + 1
        n = F.greatest(F.when(last, left).otherwise(F.least(given, left)), F.lit(0))
        new = F.when((step == 0) | (n < 1), none).otherwise(F.transform(F.sequence(F.lit(0), n - 1), lambda i: acc["t"] + i * step))
        at = F.when(step == 0, F.when(last, tf + 1).otherwise(acc["t"] + given)).otherwise(acc["t"] + n * step)
        return F.when(acc["t"] > tf, acc).otherwise(F.struct(at.cast("int").alias("t"), F.concat(acc["times"], new).alias("times")))

    start = F.struct(ti.cast("int").alias("t"), none.alias("times"))
    pairs = F.sequence(F.lit(0), F.floor((F.size(thin) + 1) / 2).cast("int") - 1)
    thinned = F.aggregate(pairs, start, taken)["times"]
    return F.when(tf < ti, none).when(thin.isNull() | (F.size(thin) < 1), every).otherwise(thinned)


#: So many ranges are chosen in one stage; then the choices so far are written.
STEPS = 8


def ordered_ranges(ranges: DataFrame) -> DataFrame:
    """ranges: (fit_id, range_id, offset, ti, tf, dti, dtf, thin, min_points); offset null: absolute, else relative to the range range_id + offset
    of the same fit. A row for each fit: fit_id and ``rs``, its ranges by place (parents first), each with up, the place of its parent (null:
    absolute), and until, the place of its last child (-1: none). A fit's ranges are one row's array, so only the given rows are dealt out. Ranges
    that lead to no absolute one, in a cycle or by a range that is not there, are an error."""
    numbers = [F.col(c).cast("int").alias(c) for c in ("range_id", "ti", "tf", "dti", "dtf")]
    one = F.struct(*numbers, F.col("offset").cast("int").alias("offset"), F.col("thin").cast("array<int>").alias("thin"), F.greatest("min_points", F.lit(1)).cast("int").alias("least"))
    fits = ranges.groupBy("fit_id").agg(F.array_sort(F.collect_list(one)).alias("rs"))
    ids, n = F.transform("rs", lambda r: r["range_id"]), F.size("rs")
    # -1: absolute; -2: no or more than one such range
    above = lambda r: F.when(r["offset"].isNull(), -1).when(F.size(F.filter("ids", lambda x: x == r["range_id"] + r["offset"])) == 1, F.array_position("ids", r["range_id"] + r["offset"]).cast("int") - 1).otherwise(-2)
    fits = fits.withColumn("ids", ids).withColumn("up", F.transform("rs", above))
    # level by level: null until the parent has one; as many turns as the longest chain can need, none beyond roots where all are absolute
    roots = F.transform("up", lambda u: F.when(u == -1, 0))
    deeper = lambda ls: F.transform("up", lambda u, i: F.coalesce(F.get(ls, i), F.when(u >= 0, F.get(ls, u) + 1)))
    level = F.aggregate(F.sequence(F.lit(1), n), roots, lambda ls, _: F.when(F.exists(ls, lambda x: x.isNull()), deeper(ls)).otherwise(ls))
    order = F.array_sort(F.transform(level, lambda x, i: F.struct(x.alias("level"), i.alias("at"))))
    fits = fits.withColumn("level", level).withColumn("order", F.transform(order, lambda o: o["at"]))
    placed = F.transform("order", lambda i: F.when(F.get("up", i) >= 0, F.array_position("order", F.get("up", i)).cast("int") - 1))
    fits = fits.withColumn("ups", placed)
    until = lambda k: F.coalesce(F.array_max(F.transform("ups", lambda u, j: F.when(u == k, j))), F.lit(-1))
    fields = ("range_id", "ti", "tf", "dti", "dtf", "thin", "least")
    by_place = F.transform("order", lambda i, k: F.struct(*[F.get("rs", i)[c].alias(c) for c in fields], F.get("ups", k).alias("up"), until(k).alias("until")))
    return fits.select("fit_id", by_place.alias("rs"), F.exists("level", lambda x: x.isNull()).alias("loose"))


def range_combinations(ranges: DataFrame) -> DataFrame:
    """Every choice of one time list for each range of a fit: fit_id, ranges array<struct<range_id, ti, tf, fit_times>> by range_id.

    ranges: (fit_id, range_id, offset, ti, tf, dti, dtf, thin array<int>, min_points): starts from ti to ti + dti - 1 with every end from tf to tf +
    dtf - 1, counted from the start and end that the parent has in the same choice if the range is relative. A choice in which a range has fewer
    than min_points is given up where that range is chosen, before others are combined with it. Repeated lists of a range count once.

    A fit's choices come out of its row one by one, without a join. A row stands for one choice of lists; if several starts and ends give these lists,
    it holds them all, as far as ranges to come hang on them, so that no two rows are equal and none need be compared afterwards."""
    placed = staged(ordered_ranges(ranges))
    seen = placed.agg(F.max(F.size("rs")).alias("most"), F.max("loose").alias("loose")).first()
    if seen["loose"]:
        raise ValueError("a range depends on itself or on a range that is not there")
    span = "array<struct<ti: int, tf: int>>"
    # ways: starts and ends by place, of one and the same choice of lists
    state = {"lists": F.array().cast("array<array<int>>"), "ways": F.array(F.array().cast(span))}
    chosen, most = placed.select("fit_id", "rs").withColumns(state), seen["most"] or 0
    for k in range(most):
        chosen = _next_range(chosen, k)
        if k % STEPS == STEPS - 1 and k + 1 < most:
            chosen = staged(chosen)
    way = F.get("ways", F.lit(0))
    found = F.transform("rs", lambda r, i: F.struct(r["range_id"].alias("range_id"), F.get(way, i)["ti"].alias("ti"), F.get(way, i)["tf"].alias("tf"), F.get("lists", i).alias("fit_times")))
    return chosen.select("fit_id", F.array_sort(found).alias("ranges"))


def _next_range(chosen: DataFrame, k: int) -> DataFrame:
    """chosen (fit_id, rs, lists, ways) with a list for the range of place k; fits of fewer ranges stay as they are."""
    names = chosen.columns
    r = F.get("rs", F.lit(k))
    given = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    base = lambda way, c: r[c] + F.when(r["up"].isNull(), 0).otherwise(F.get(way, r["up"])[c])
    spans = lambda way: F.flatten(F.transform(given(r["dti"]), lambda i: F.transform(given(r["dtf"]), lambda j: F.struct((base(way, "ti") + i).alias("ti"), (base(way, "tf") + j).alias("tf")))))
    tried = F.flatten(F.transform("ways", lambda way: F.transform(spans(way), lambda x: F.struct(fit_times(x["ti"], x["tf"], r["thin"]).alias("times"), F.concat(way, F.array(x)).alias("way")))))
    fit = F.filter(tried, lambda x: F.size(x["times"]) >= r["least"])
    more = chosen.withColumn("__tried", F.when(F.size("rs") > k, fit)).withColumn("__past", F.size("rs") <= k)
    none = F.array(F.lit(None).cast("array<int>"))
    more = more.withColumn("__times", F.explode(F.when(F.col("__past"), none).otherwise(F.array_distinct(F.transform("__tried", lambda x: x["times"])))))
    same = F.transform(F.filter("__tried", lambda x: x["times"] == F.col("__times")), lambda x: x["way"])
    more = more.withColumn("__ways", F.when(~F.col("__past"), same))
    # of ways that agree at every place with children to come one is enough
    open_ = lambda way: F.filter(way, lambda _, i: F.get("rs", i)["until"] > k)
    alone = F.filter("__ways", lambda way, i: ~F.exists(F.slice("__ways", F.lit(1), i), lambda w: open_(w) == open_(way)))
    ways = F.when(F.col("__past"), F.col("ways")).when(F.size("__ways") == 1, F.col("__ways")).otherwise(alone)
    lists = F.when(F.col("__past"), F.col("lists")).otherwise(F.concat("lists", F.array("__times")))
    return more.withColumns({"ways": ways, "lists": lists}).select(*names)


MOMENTS = ("s", "sx", "sxx", "sy", "sxy", "syy", "n")


def windows(points: DataFrame, least: int, series: str = "corr_id", at: str = "t") -> DataFrame:
    """Every window (ti, tf) of at least ``least`` consecutive times of a series: series, range_id, ti, tf."""
    times = points.select(series, at).distinct().groupBy(series).agg(F.array_sort(F.collect_list(at)).alias("ts"))
    first = times.select(series, "ts", F.posexplode("ts").alias("a", "ti"))
    pairs = first.where(F.col("a") + least <= F.size("ts")).select(series, "ti", F.explode(F.slice("ts", F.col("a") + least, F.size("ts"))).alias("tf"))
    return pairs.select(series, F.concat_ws("_", "ti", "tf").alias("range_id"), "ti", "tf")


def scan_lines(points: DataFrame, ranges: DataFrame, by: tuple[str, ...] = ("corr_id", "replica"), at: str = "t") -> DataFrame:
    """The weighted constant and straight line of every range, from running sums: a range is the difference of two rows, whatever its length.
    points: (by, t, x, sigma), the same times in every replica; ranges: (corr_id, range_id, ti, tf). Gives by, range_id, ti, tf, mean,
    mean_chi_sq, intercept, slope, chi_sq, dof (of the line). Ranges of no point are left out; of one point, they have a mean only."""
    series = by[0]
    w, x, y = 1 / (F.col("sigma") * F.col("sigma")), F.col(at), F.col("x")
    # times from the middle of the series and values from its mean: sums of like size lose less in differences
    ends = points.groupBy(series).agg(((F.min(at) + F.max(at)) / 2).alias("__mid"), F.array_sort(F.collect_set(at)).alias("ts"))
    moved = points.join(ends.select(series, "__mid"), series).withColumn("__u", x - F.col("__mid"))
    u = F.col("__u")
    upto = W.partitionBy(*by).orderBy(at)
    terms = dict(zip(MOMENTS, (w, w * u, w * u * u, w * y, w * u * y, w * y * y, F.lit(1.0))))
    sums = moved.select(*by, at, "__mid", *[F.sum(e).over(upto).alias(n) for n, e in terms.items()])
    packed = sums.groupBy(*by).agg(F.first("__mid").alias("mid"), F.array_sort(F.collect_list(F.struct(at, *MOMENTS))).alias("m"))
    near = ranges.join(ends.select(series, "ts"), series)
    near = near.select(series, "range_id", "ti", "tf", F.size(F.filter("ts", lambda t: t < F.col("ti"))).alias("__lo"), F.size(F.filter("ts", lambda t: t <= F.col("tf"))).alias("__hi")).where("__hi > __lo")
    met = packed.join(near, series)
    met = met.select(*by, "range_id", "ti", "tf", "mid", F.get("m", F.col("__hi") - 1).alias("__b"), F.get("m", F.col("__lo") - 1).alias("__a"))
    met = met.select(*by, "range_id", "ti", "tf", "mid", *[(F.col(f"__b.{n}") - F.coalesce(F.col(f"__a.{n}"), F.lit(0.0))).alias(n) for n in MOMENTS])
    c = F.col
    det = c("s") * c("sxx") - c("sx") * c("sx")
    line = met.withColumns({"slope": F.when(c("n") > 1, (c("s") * c("sxy") - c("sx") * c("sy")) / F.when(c("n") > 1, det)), "mean": c("sy") / c("s")})
    line = line.withColumn("__at_mid", (c("sy") - c("slope") * c("sx")) / c("s"))
    return line.select(*by, "range_id", "ti", "tf", "mean", (c("syy") - c("mean") * c("sy")).alias("mean_chi_sq"), (c("__at_mid") - c("slope") * c("mid")).alias("intercept"), "slope", (c("syy") - c("__at_mid") * c("sy") - c("slope") * c("sxy")).alias("chi_sq"), (c("n") - 2).cast("long").alias("dof"))
