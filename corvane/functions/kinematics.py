"""Column functions of momenta, labels and dispersion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Short and long names of the gamma matrices, in the order of their codes from 0; each comes with a minus first.
GAMMA_LONG = ["Gamma5", "GammaT", "GammaTGamma5", "GammaX", "GammaXGamma5", "GammaY", "GammaYGamma5", "GammaZ", "GammaZGamma5", "Identity", "SigmaXT", "SigmaXY", "SigmaXZ", "SigmaYT", "SigmaYZ", "SigmaZT"]
GAMMA_SHORT = ["5", "T", "T5", "X", "X5", "Y", "Y5", "Z", "Z5", "I", "sXT", "sXY", "sXZ", "sYT", "sYZ", "sZT"]
GAMMA_SPATIAL = ("gXYZ", -2)


def gamma_table(spark: SparkSession) -> DataFrame:
    """(code, short, long) of all 32 gamma matrices and the spatial one."""
    rows = [(2 * i + k, f"g{'-' * (1 - k)}{s}", f"{'Minus' * (1 - k)}{n}") for i, (s, n) in enumerate(zip(GAMMA_SHORT, GAMMA_LONG)) for k in (0, 1)]
    return spark.createDataFrame([*rows, (GAMMA_SPATIAL[1], GAMMA_SPATIAL[0], "Spatial")], "code int, short string, long string")


def with_gamma(df: DataFrame, column: str) -> DataFrame:
    """Adds code and long name by the short name, whatever its case; 33 rows are broadcast."""
    g = gamma_table(df.sparkSession).withColumn("__k", F.lower("short"))
    return df.join(F.broadcast(g), F.lower(F.col(column)) == F.col("__k"), "left").drop("__k")


def p2(x: Column, y: Column, z: Column) -> Column:
    return x * x + y * y + z * z


def is_negative(x: Column, y: Column, z: Column) -> Column:
    """Whether the first component that is not zero is negative."""
    return F.coalesce(*[F.when(c != 0, c < 0) for c in (x, y, z)], F.lit(False))


def same_momentum(a: Column, b: Column) -> Column:
    """Structs x, y, z, is_p2: by square if either is given as a square."""
    squares = p2(a["x"], a["y"], a["z"]) == p2(b["x"], b["y"], b["z"])
    return F.when(a["is_p2"] | b["is_p2"], squares).otherwise((a["x"] == b["x"]) & (a["y"] == b["y"]) & (a["z"] == b["z"]))


def p2_components(n: Column) -> Column:
    """Struct x, y, z: the largest square first, three times; null if something is left over."""
    x = F.floor(F.sqrt(n.cast("double"))).cast("int")
    y = F.floor(F.sqrt((n - x * x).cast("double"))).cast("int")
    z = F.floor(F.sqrt((n - x * x - y * y).cast("double"))).cast("int")
    return F.when((n >= 0) & (x * x + y * y + z * z == n), F.struct(x.alias("x"), y.alias("y"), z.alias("z")))


def momentum_order(x: Column, y: Column, z: Column) -> list[Column]:
    return [p2(x, y, z), x, y, z]


def fmt_momentum(name: str, x: Column, y: Column, z: Column, square: bool = False) -> Column:
    """_p_1_0_0, or _p2_1 for a square."""
    if square:
        return F.concat(F.lit(f"_{name}2_"), p2(x, y, z).cast("string"))
    return F.concat(F.lit(f"_{name}_"), F.concat_ws("_", x, y, z))


def momentum_of(text: Column, name: str = "p") -> Column:
    """Struct x, y, z, is_p2 from a name; null if it has none. A square gives its components."""
    vector = rf"_{name}_(-?\d+)_(-?\d+)_(-?\d+)(?=_|\.|$)"
    square = F.regexp_extract(text, rf"_{name}2_(\d+)(?=_|\.|$)", 1)
    part = lambda k: F.regexp_extract(text, vector, k)
    whole = F.struct(*[part(k).cast("int").alias(c) for k, c in ((1, "x"), (2, "y"), (3, "z"))], F.lit(False).alias("is_p2"))
    comp = p2_components(F.when(square != "", square).cast("int"))
    as_square = F.struct(comp["x"].alias("x"), comp["y"].alias("y"), comp["z"].alias("z"), F.lit(True).alias("is_p2"))
    return F.when(part(1) != "", whole).when(square != "", as_square)


def replace_momentum(text: Column, name: str, new: str) -> Column:
    return F.regexp_replace(text, rf"_{name}2?(_-?\d+)+(?=_|\.|$)", new)


def dispersion(m: Column, n_sites: int, x: Column, y: Column, z: Column, kind: str = "continuum", inverse: bool = False) -> Column:
    """Energy of a particle of mass m at a momentum; inverse: mass from energy. Kinds: continuum, lattice, lattice_no_sin. The
    inverse is clamped at 0; momentum 0 gives m."""
    pi = 3.141592653589793
    sign = -1 if inverse else 1
    if kind == "continuum":
        step = [(2 * pi / n_sites) * c for c in (x, y, z)]
        out = F.sqrt(F.greatest(m * m + sign * sum((s * s for s in step[1:]), step[0] * step[0]), F.lit(0.0)))
    else:
        step = [F.sin((pi / n_sites) * c) if kind == "lattice" else (pi / n_sites) * c for c in (x, y, z)]
        half = F.sinh(m / 2)
        out = 2 * F.asinh(F.sqrt(F.greatest(half * half + sign * sum((s * s for s in step[1:]), step[0] * step[0]), F.lit(0.0))))
    return F.when(p2(x, y, z) == 0, m).otherwise(out)


def quark_weight(label: Column) -> Column:
    """h<n> gives n, s -1, l -2; anything else is an error."""
    low = F.lower(label)
    number = F.regexp_extract(low, r"^h(\d+)$", 1)
    fault = F.raise_error(F.concat(F.lit("unknown quark "), label)).cast("int")
    return F.when(number != "", number.cast("int")).when(low == "s", -1).when(low == "l", -2).otherwise(fault)


def concat_heavy_first(a: Column, b: Column) -> Column:
    return F.when(quark_weight(a) >= quark_weight(b), F.concat_ws("_", a, b)).otherwise(F.concat_ws("_", b, a))


def meson_name(a: Column, b: Column) -> Column:
    """Ds, D, K, Pi by the heavier and lighter quark; heavy-heavy and s-s keep their pair's name."""
    wa, wb = quark_weight(a), quark_weight(b)
    heavy, light = F.greatest(wa, wb), F.least(wa, wb)
    known = F.when((heavy >= 0) & (light == -1), "Ds").when((heavy >= 0) & (light == -2), "D").when((heavy == -1) & (light == -2), "K").when((heavy == -2) & (light == -2), "Pi")
    return F.coalesce(known, concat_heavy_first(a, b))


def sincos_deg(d: Column) -> tuple[Column, Column]:
    """Sine and cosine of degrees, exact at right angles."""
    q = F.pmod(d, F.lit(360))
    rad = F.radians(d.cast("double"))
    sine = F.when(q.isin(0, 180), 0.0).when(q == 90, 1.0).when(q == 270, -1.0).otherwise(F.sin(rad))
    cosine = F.when(q.isin(90, 270), 0.0).when(q == 0, 1.0).when(q == 180, -1.0).otherwise(F.cos(rad))
    return sine, cosine


def start_stop_step(start: int, stop: int, step: int, always: list[int] | None = None) -> Column:
    """An inclusive range whose step takes its direction from the ends; values of ``always`` that it misses come after it."""
    step = abs(step) if stop >= start else -abs(step)
    hit = F.sequence(F.lit(start), F.lit(stop), F.lit(step)) if step else F.array(F.lit(start))
    extra = F.array(*[F.lit(x) for x in always or []]).cast("array<int>")
    return F.concat(hit, F.array_except(extra, hit))


def strip_tokens(text: Column, momenta: list[str], patterns: list[str]) -> Column:
    """Without the named momenta and the tokens that patterns match."""
    for m in momenta:
        text = replace_momentum(text, m, "")
    for p in patterns:
        text = F.regexp_replace(text, p, "")
    return text


def group_key(name: Column, x: Column, y: Column, z: Column, how: str) -> Column:
    """how: 'none' keeps the vector, 'p2' its square, 'abs' the sizes of its components."""
    if how == "p2":
        return F.concat(name, fmt_momentum("p", x, y, z, square=True))
    if how == "abs":
        x, y, z = F.abs(x), F.abs(y), F.abs(z)
    return F.concat(name, fmt_momentum("p", x, y, z))


def sorted_name(name: Column) -> Column:
    return F.array_join(F.array_sort(F.split(name, "_")), "_")


def extract_sink_source(name: Column, pattern: str) -> tuple[Column, Column, Column]:
    """(sink letter, source letter, name without the match)."""
    return F.regexp_extract(name, pattern, 1), F.regexp_extract(name, pattern, 2), F.regexp_replace(name, pattern, "")


def canonical_pairs(df: DataFrame) -> DataFrame:
    """Rows (q1, q2, p1, p2, ...) so that the heavier quark is first and the momentum is on the lighter one; rows without momentum
    stay in both orders."""
    swapped = df.withColumns({"q1": F.col("q2"), "q2": F.col("q1"), "p1": F.col("p2"), "p2": F.col("p1")})
    both = df.withColumn("swapped", F.lit(False)).unionByName(swapped.withColumn("swapped", F.lit(True)))
    still = (F.col("p1") == 0) & (F.col("p2") == 0)
    fits = (quark_weight(F.col("q1")) >= quark_weight(F.col("q2"))) & (F.col("p1") == 0)
    twice = (F.col("q1") == F.col("q2")) & F.col("swapped")
    return both.where((still | fits) & ~(twice & still))


def with_file_attrs(df: DataFrame, column: str) -> DataFrame:
    """Attributes of dir/base[.extra].op1_op0.type.seed.ext: dir, name, ext, seed, type, op_snk, op_src, extra, base, momentum,
    timeslice, delta_t (all of dt_a_b...; the last rules), gamma, quark_h and spectator."""
    path = F.col(column)
    file = F.element_at(F.split(path, "/"), -1)
    parts = F.split(file, r"\.")
    n = F.size(parts)
    ops = F.split(F.element_at(parts, -4), "_")
    stem = F.element_at(parts, 1)
    dt = F.regexp_extract(stem, r"_dt((?:_\d+)+)(?=_[a-z]|$)", 1)
    steps = F.transform(F.filter(F.split(dt, "_"), lambda x: x != ""), lambda x: x.cast("int"))
    time = F.regexp_extract(stem, r"_t_(\d+)(?=_|$)", 1)
    return df.select(
        "*", F.regexp_extract(path, r"^(.*/)?[^/]*$", 1).alias("dir"), file.alias("file"), F.element_at(parts, -1).alias("ext"), F.element_at(parts, -2).cast("long").alias("seed"),
        F.element_at(parts, -3).alias("type"), F.element_at(ops, 1).alias("op_snk"), F.element_at(ops, 2).alias("op_src"),
        F.array_join(F.slice(parts, 2, F.greatest(n - 5, F.lit(0))), ".").alias("extra"), stem.alias("base"), momentum_of(stem).alias("momentum"),
        F.when(time != "", time.cast("int")).alias("timeslice"), steps.alias("delta_ts"), F.when(F.size(steps) > 0, F.element_at(steps, -1)).alias("delta_t"),
        F.nullif(F.regexp_extract(stem, r"_(g[A-Zs5I-]+[A-Z5]*)(?=_|$)", 1), F.lit("")).alias("gamma"), F.nullif(F.regexp_extract(stem, r"_(h\d+)(?=_|$)", 1), F.lit("")).alias("quark_h"),
        F.nullif(F.regexp_extract(stem, r"^[^_]+_([ls])(?=_)", 1), F.lit("")).alias("spectator"),
    )


