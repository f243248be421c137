"""Ratios of three- and two-point series, constants and their look-up, form factors."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .resample import attach


def _required(c: Column, what: str) -> Column:
    ok = c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    return F.when(ok, c).otherwise(F.raise_error(F.lit(f"{what} is not finite")).cast("double"))


def zv_ratio(c3: DataFrame, c2: DataFrame, const: DataFrame, dt: int, nt: int) -> DataFrame:
    """C2~(dt) / C3(t) for t <= dt. c3, c2: (corr_id, replica, t, x), const: (corr_id, replica, e, a). C2~ has the backward wave
    taken off, at the middle of the lattice it is half of C2."""
    at = c2.where(F.col("t") == dt).select("corr_id", "replica", F.col("x").alias("c2"))
    met = c3.where(F.col("t") <= dt).join(at, ["corr_id", "replica"]).join(const, ["corr_id", "replica"])
    tilde = F.col("c2") / 2 if 2 * dt == nt else F.col("c2") - F.col("a") * F.col("a") * F.exp(-F.col("e") * (nt - dt))
    return met.select("corr_id", "replica", "t", _required(tilde / F.col("x"), "Z_V").alias("x"))


#: What ratios() takes of each replica.
CONSTANTS = ("e0", "e1", "a0", "a1", "z0", "z1")


def ratios(three: dict[str, DataFrame], two: dict[str, DataFrame], const: DataFrame, dt: int, nt: int, subtract: bool = True, alt_r3: bool = False) -> DataFrame:
    """R1, R2, R3 and R3 of the reverse direction by (corr_id, replica, t), t <= dt; each is null where one of its inputs is missing.

    three: fwd, rev, src, snk; two: src, snk, each (corr_id, replica, t, x). const: (corr_id, replica, e0, e1, a0, a1, z0, z1). C2~ at
    dt has half the middle value's backward wave taken off, or with subtract=False is halved at the middle."""
    keys, half = ["corr_id", "replica"], nt // 2
    none = F.lit(None).cast("struct<" + ",".join(f"{n}:double" for n in CONSTANTS) + ">")
    rows = [df.select(*keys, F.lit(role).alias("role"), F.col("t").cast("int").alias("t"), F.col("x").cast("double").alias("x"), none.alias("const")) for role, df in [(f"c3_{k}", v) for k, v in three.items()] + [(f"c2_{k}", two[n]) for k, n in enumerate(("src", "snk"))]]
    rows.append(const.select(*keys, F.lit("const").alias("role"), F.lit(-1).alias("t"), F.lit(None).cast("double").alias("x"), F.struct(*[F.col(n).cast("double").alias(n) for n in CONSTANTS]).alias("const")))
    # all series of a replica meet in one group, each as a map from time to value; turning time round is a look-up
    packed = reduce(lambda a, b: a.unionByName(b), rows).groupBy(*keys).agg(F.collect_list(F.when(F.col("role") != "const", F.struct("role", "t", "x"))).alias("v"), F.first("const", ignorenulls=True).alias("const"))
    roles = ["c3_fwd", "c3_rev", "c3_src", "c3_snk", "c2_0", "c2_1"]
    series = lambda role: F.map_from_entries(F.transform(F.filter("v", lambda r: r["role"] == role), lambda r: F.struct(r["t"], r["x"])))
    times = F.array_distinct(F.transform(F.filter("v", lambda r: r["role"].startswith("c3_") & (r["t"] <= dt)), lambda r: r["t"]))
    base = packed.where("const is not null").select(*keys, "const.*", *[series(r).alias(f"m_{r}") for r in roles], F.explode(times).alias("t"))
    at = lambda role, t: F.col(f"m_{role}")[t]
    base = base.select(
        *keys, *CONSTANTS, "t", *[at(r, F.col("t")).alias(r) for r in roles], *[at(f"c2_{k}", F.lit(dt) - F.col("t")).alias(f"c2_{k}_rev") for k in (0, 1)],
        *[at(f"c2_{k}", F.lit(t)).alias(f"c2_{k}_{n}") for k in (0, 1) for n, t in (("dt", dt), ("mid", half))],
    )
    c = F.col
    if subtract:
        tilde = [c(f"c2_{k}_dt") - 0.5 * c(f"c2_{k}_mid") * F.exp(-c(f"e{k}") * (half - dt)) for k in (0, 1)]
    else:
        tilde = [c(f"c2_{k}_dt") * (0.5 if dt == half else 1.0) for k in (0, 1)]
    n = F.abs(c("e0") * c("e1") * c("c3_fwd") * c("c3_rev"))
    zz = c("z0") * c("z1")
    r1 = 2 * F.sqrt(n / F.abs(tilde[0] * tilde[1]) * zz)
    r2 = 2 * F.sqrt(n / F.abs(c("c3_src") * c("c3_snk")))
    if alt_r3:
        grow = lambda a, b: F.exp((c(a) - c(b)) * c("t") + c(b) * dt)
        r3 = 2 * c("c3_fwd") * F.sqrt(c("e0") * c("e1") * grow("e0", "e1") * zz / (c("c2_0") * c("c2_1_rev")))
        r3r = 2 * c("c3_rev") * F.sqrt(c("e0") * c("e1") * grow("e1", "e0") * zz / (c("c2_1") * c("c2_0_rev")))
    else:
        over = c("a0") * c("a1") * F.sqrt(zz)
        r3 = over * c("c3_fwd") / (c("c2_0") * c("c2_1_rev"))
        r3r = over * c("c3_rev") / (c("c2_1") * c("c2_0_rev"))
    return base.select(*keys, "t", r1.alias("r1"), r2.alias("r2"), r3.alias("r3"), r3r.alias("r3_rev"))


def match_currents(temporal: DataFrame, spatial: DataFrame) -> DataFrame:
    """Each temporal matrix element with every spatial one of the same sink, source and momentum; at momentum 0 it stands alone."""
    s = spatial.select("snk", "src", "p", F.col("x").alias("spatial"))
    return temporal.join(s, ["snk", "src", "p"], "left").where((F.col("p") == 0) | F.col("spatial").isNotNull())


def unmatched_currents(temporal: DataFrame, spatial: DataFrame) -> DataFrame:
    return temporal.where("p <> 0").join(spatial, ["snk", "src", "p"], "left_anti")


def lookup_constants(need: DataFrame, const: DataFrame, single_object: bool = False) -> DataFrame:
    """need: (object array, name), const: (object array, name, replica, value). The key itself, else with the objects reversed, else,
    if the source has a single object, by name alone. Unknown keys give a null replica."""
    one = const.withColumn("__rank", F.lit(0))
    two = const.where(F.size("object") == 2).withColumns({"object": F.reverse("object"), "__rank": F.lit(1)})
    known = one.unionByName(two)
    w = known.groupBy("object", "name", "replica").agg(F.min_by("value", "__rank").alias("value"))
    found = need.join(w, ["object", "name"], "left")
    if not single_object:
        return found
    any_object = const.select("name", F.col("replica").alias("__r"), F.col("value").alias("__v"))
    missing = found.where("replica IS NULL").drop("replica", "value").join(any_object, "name", "left")
    return found.where("replica IS NOT NULL").unionByName(missing.select("object", "name", F.col("__r").alias("replica"), F.col("__v").alias("value")))


def conflicting_constants(const: DataFrame) -> DataFrame:
    """Keys that come with different values."""
    return const.groupBy("object", "name", "replica").agg(F.count_distinct("value").alias("n")).where("n > 1")


def constants_table(listed: DataFrame, loaded: DataFrame | None, freeze: str = "none", default: float = 1.0) -> DataFrame:
    """Constants of a list (key, file): those loaded (key, replica, value), or their central value on every replica ('central'), or a
    constant ('constant', 1 by default); a key that has no value gets the default."""
    if freeze == "constant" or loaded is None:
        return listed.select("key", F.lit(default).alias("value"))
    if freeze == "central":
        middle = loaded.where("replica = -1").select("key", F.col("value").alias("__c"))
        loaded = loaded.join(middle, "key").withColumn("value", F.col("__c")).drop("__c")
    return listed.select("key").join(loaded, "key", "left").withColumn("value", F.coalesce("value", F.lit(default)))


def rotate(series: DataFrame, amps: DataFrame, theta: Column, phi: Column | None = None, per_replica: bool = False) -> DataFrame:
    """Mixed operators at angles in degrees. series: (snk, src, replica, t, x) of operators P and W, amps: (op, replica, a).
    One angle: cos / A_P C_P + sin / A_W C_W over the source for each sink; two: over both. theta, phi: arrays of angles."""
    from corvane.functions.kinematics import sincos_deg

    a = amps if per_replica else amps.where("replica = -1").drop("replica")
    on = ["replica"] if per_replica else []
    wide = a.groupBy(*on).pivot("op", ["P", "W"]).agg(F.first("a"))
    flat = series.groupBy("snk", "replica", "t").pivot("src", ["P", "W"]).agg(F.first("x"))
    named = wide.select(*on, F.col("P").alias("ap"), F.col("W").alias("aw"))
    met = flat.join(named, on) if on else attach(flat, named)
    met = met.withColumn("theta", F.explode(theta))
    s, c = sincos_deg(F.col("theta"))
    mixed = met.withColumn("m", c / F.col("ap") * F.col("P") + s / F.col("aw") * F.col("W"))
    if phi is None:
        return mixed.select("snk", "theta", "replica", "t", F.col("m").alias("x"))
    both = mixed.groupBy("theta", "replica", "t", "ap", "aw").pivot("snk", ["P", "W"]).agg(F.first("m")).withColumn("phi", F.explode(phi))
    s, c = sincos_deg(F.col("phi"))
    return both.select("phi", "theta", "replica", "t", (c / F.col("ap") * F.col("P") + s / F.col("aw") * F.col("W")).alias("x"))


def compare_curves(var: DataFrame, ref: DataFrame) -> DataFrame:
    """var: (variation, x, y), ref: (x, y, y_low, y_high). Relative statistical, systematic and total error, and their squares."""
    r = ref.select("x", F.col("y").alias("ref"), ((F.col("y_high") - F.col("y_low")) / (2 * F.col("y"))).alias("stat"))
    met = var.join(r, "x").withColumn("sys", (F.col("y") - F.col("ref")) / F.col("ref"))
    out = met.withColumns({"stat_sq": F.col("stat") * F.col("stat"), "sys_sq": F.col("sys") * F.col("sys")}).withColumn("total_sq", F.col("stat_sq") + F.col("sys_sq"))
    return out.select("variation", "x", "ref", "stat", "sys", F.sqrt("total_sq").alias("total"), "stat_sq", "sys_sq", "total_sq")


def error_budget(compared: DataFrame, how: str = "max") -> DataFrame:
    """For each x the largest systematic error over variations (or their sum in quadrature) and the total with the statistical."""
    sys = F.abs(F.max_by("sys", "sys_sq")) if how == "max" else F.sqrt(F.sum("sys_sq"))
    out = compared.groupBy("x").agg(F.first("stat").alias("stat"), sys.alias("sys"))
    return out.withColumn("total", F.sqrt(F.col("stat") * F.col("stat") + F.col("sys") * F.col("sys")))


def with_ensemble(df: DataFrame, const: DataFrame) -> DataFrame:
    """Constants of the ensemble (ensemble, name, value) as columns; a few rows for each ensemble."""
    names = [r["name"] for r in const.select("name").distinct().orderBy("name").collect()]
    return df.join(const.groupBy("ensemble").pivot("name", names).agg(F.first("value")), "ensemble")


def physical_mass(df: DataFrame, mass: str = "m_pi", spacing: str = "a_inv", name: str = "m_pi_gev") -> DataFrame:
    """Adds the mass in physical units: the fitted one, in lattice units, times the inverse spacing of its ensemble."""
    return df.withColumn(name, F.col(mass) * F.col(spacing))


def vol_norm(df: DataFrame, factors: DataFrame) -> DataFrame:
    """x times 1 / sqrt(volume) for every operator in ``ops`` that has a volume, in every row, the central one too."""
    f = factors.select(F.col("op"), (1 / F.sqrt("volume")).alias("f")).agg(F.map_from_entries(F.collect_list(F.struct("op", "f"))).alias("m"))
    met = attach(df, f)
    product = F.aggregate("ops", F.lit(1.0), lambda acc, o: acc * F.coalesce(F.element_at("m", o), F.lit(1.0)))
    return met.withColumn("x", F.col("x") * product).drop("m")


def form_factor(df: DataFrame, n_sites: int) -> DataFrame:
    """Columns of form factors. df: mh, ml, el (masses, light energy), nx, ny, nz, zv0, zv1, zv_mixed, mel0 (temporal), meli (spatial
    element, already divided by its component)."""
    from corvane.functions.kinematics import dispersion, p2

    c = F.col
    momentum = p2(c("nx"), c("ny"), c("nz"))
    ap = F.sqrt(momentum.cast("double")) * (2 * 3.141592653589793 / n_sites)
    q2 = lambda e: c("mh") * c("mh") + c("ml") * c("ml") - 2 * c("mh") * e
    out = df.withColumns({
        "q_sq": q2(c("el")), "el_lat": dispersion(c("ml"), n_sites, c("nx"), c("ny"), c("nz"), "lattice"),
        "t_plus": c("mh") + c("ml"), "t_minus": c("mh") - c("ml"), "zv": F.when(c("zv0") == c("zv1"), c("zv0")).otherwise(F.sqrt(c("zv0") * c("zv1"))) * c("zv_mixed"),
        "k_mu": F.when(momentum > 0, ap).otherwise(0.0),
    })
    out = out.withColumns({"q_sq_lat": q2(c("el_lat")), "t_zero": 0.5 * c("t_minus"), "mel_v0": c("mel0") * c("zv"), "mel_vi": F.when(momentum > 0, c("meli") * c("zv")).otherwise(0.0)})
    a, b = c("t_plus") - c("q_sq"), c("t_plus") - c("t_zero")
    root = F.sqrt(F.abs(a))
    right = F.sqrt(b)
    out = out.withColumns({
        "z_re": F.when(a >= 0, (root - right) / (root + right)).otherwise((-a - b) / (b - a)),
        "z_im": F.when(a >= 0, F.lit(0.0)).otherwise(2 * root * right / (b - a)),
        "f_par": c("mel_v0") / F.sqrt(2 * c("mh")), "f_perp": F.when(momentum > 0, c("mel_vi") / F.sqrt(2 * c("mh")) / ap).otherwise(0.0),
    })
    plus = (c("mh") - c("el")) * c("f_perp") + c("f_par")
    zero = (c("el") * c("el") - c("ml") * c("ml")) * c("f_perp") + (c("mh") - c("el")) * c("f_par")
    return out.withColumns({"f_plus": plus / F.sqrt(2 * c("mh")), "f_zero": zero * F.sqrt(2 * c("mh")) / (c("mh") * c("mh") - c("ml") * c("ml"))})
