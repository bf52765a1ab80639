"""Ordered rows: isophote windows, plateau search, node clean-up and continuation, ranks and decisions."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import ab_zeropoint, fin
from ..plans.storage import written


def ordered(g: list[str], *by: str) -> Window:
    return Window.partitionBy(*g).orderBy(*by)


def isophote_windows(isophotes: DataFrame, g: list[str], x: str = "sma", size: int = 8, step: int = 2, cols=("x0", "y0", "eps", "pa")) -> DataFrame:
    """Sliding windows of `size` rows, every `step`-th start: first and last x, median geometry, mean gap (WIN1)."""
    w = ordered(g, x)
    span = w.rowsBetween(0, size - 1)
    out = isophotes.withColumn("_i", F.row_number().over(w) - 1).select(*g, "_i", F.first(x).over(span).alias("x_first"), F.last(x).over(span).alias("x_last"), F.count("*").over(span).alias("_n"), *[F.sort_array(F.collect_list(c).over(span)).alias(c) for c in cols])
    middle = lambda c: (F.element_at(c, (size + 1) // 2) + F.element_at(c, size // 2 + 1)) / 2
    out = out.where((F.col("_n") == size) & (F.col("_i") % step == 0)).withColumns({c: middle(c) for c in cols})
    return out.select(*g, (F.col("_i") / step).cast("int").alias("window"), "x_first", "x_last", ((F.col("x_last") - F.col("x_first")) / (size - 1)).alias("mean_gap"), *cols)


def window_zones(windows: DataFrame, pixels: DataFrame, g: list[str], area: float, least: int = 500, least_core: int = 100, masked: str = "masked", value: str = "value", model: str = "model", width: float = 16.0) -> DataFrame:
    """Statistics and fluctuation magnitude of the pixels between each window's first and last ellipse (WIN1).

    windows: g, window, x_first, x_last, x0, y0, eps, pa.  A pixel meets only the windows whose bounding rows hold it: windows
    are dealt to bands of rows, then the elliptical radius decides.  A zone with few usable pixels has no row.
    """
    q = F.greatest(1 - F.col("eps"), F.lit(1e-3))
    band = lambda c: F.floor(c / width).cast("int")
    w = windows.withColumn("_band", F.explode(F.sequence(band(F.col("y0") - F.col("x_last")), band(F.col("y0") + F.col("x_last")))))
    met = pixels.withColumn("_band", band(F.col("y"))).join(w, [*g, "_band"])
    dx, dy = F.col("x") - F.col("x0"), F.col("y") - F.col("y0")
    u, v = dx * F.cos("pa") + dy * F.sin("pa"), (dy * F.cos("pa") - dx * F.sin("pa")) / q
    zone = met.withColumn("_r", F.sqrt(u * u + v * v)).where(F.col("_r").between(F.col("x_first"), F.col("x_last")))
    use = ~F.coalesce(F.col(masked), F.lit(False)) & fin(value).isNotNull() & (fin(model) > 0)
    keys = [*g, "window"]
    vals, light = F.when(use, fin(value)), F.when(use, fin(model))
    s = zone.groupBy(*keys).agg(F.count("*").alias("n_zone"), F.count(vals).alias("n_use"), F.avg(F.col(masked).cast("double")).alias("mask_fraction"), F.avg(light).alias("i_mean"), F.stddev_pop(vals).alias("std"), (F.max(vals) - F.min(vals)).alias("dyn"), F.percentile(vals, F.lit(0.05)).alias("_a"), F.percentile(vals, F.lit(0.95)).alias("_b"))
    core = zone.where(use).join(s.where(F.col("n_use") >= least), keys).where(F.col(value).between(F.col("_a"), F.col("_b")))
    c = core.groupBy(*keys).agg(F.count("*").alias("n_core"), F.var_pop(value).alias("var_core"))
    out = windows.join(s.drop("_a", "_b"), keys).join(c, keys).where((F.col("n_core") >= least_core) & (F.col("i_mean") > 0) & (F.col("var_core") > 0))
    return out.withColumn("mbar", -2.5 * F.log10(F.col("var_core") / F.col("i_mean")) + ab_zeropoint(F.lit(area)))


def _reach(r: DataFrame, g: list[str], widest: float) -> DataFrame:
    """_reach of each row: rows from it on, itself included, before the range passes `widest`.

    Doubling: minimum and maximum of 2^k rows come from two stretches of half the length, so a row meets log(n) others and
    no task holds the rows ahead.  From the longest step down, a row jumps as long as its range allows.
    """
    longest = r.agg(F.max("_i")).first()[0] or 1
    tables, k = [r.select(*g, "_i", F.col("_y").alias("_lo"), F.col("_y").alias("_hi"))], 1
    narrow = (F.col("_hi") - F.col("_lo")) <= widest
    while k < longest:
        t = tables[-1]
        ahead = t.select(*g, (F.col("_i") - k).alias("_i"), F.col("_lo").alias("_lo2"), F.col("_hi").alias("_hi2"))
        nxt = t.join(ahead, [*g, "_i"]).select(*g, "_i", F.least("_lo", "_lo2").alias("_lo"), F.greatest("_hi", "_hi2").alias("_hi")).where(narrow)
        nxt = written(nxt)
        if not nxt.limit(1).count():
            break
        tables.append(nxt)
        k *= 2
    at = r.select(*g, "_i", F.lit(0).alias("_reach"), F.lit(float("inf")).alias("_l"), F.lit(float("-inf")).alias("_h"))
    for j in range(len(tables) - 1, -1, -1):
        t = tables[j].select(*g, F.col("_i").alias("_to"), "_lo", "_hi")
        met = at.withColumn("_to", F.col("_i") + F.col("_reach")).join(t, [*g, "_to"], "left")
        fits = F.col("_lo").isNotNull() & (F.greatest("_h", "_hi") - F.least("_l", "_lo") <= widest)
        at = met.select(*g, "_i", (F.col("_reach") + F.when(fits, 1 << j).otherwise(0)).alias("_reach"), F.when(fits, F.least("_l", "_lo")).otherwise(F.col("_l")).alias("_l"), F.when(fits, F.greatest("_h", "_hi")).otherwise(F.col("_h")).alias("_h"))
    return at.select(*g, "_i", "_reach")


def segments(rows: DataFrame, g: list[str], x: str, y: str, least: int, widest: float) -> DataFrame:
    """Every stretch of at least `least` consecutive rows whose range is `widest` at most, with its line fit.

    A row meets the rows behind it by their number inside the group; sums over a stretch are differences of running sums.
    """
    w = ordered(g, x)
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    r = rows.where(fin(x).isNotNull() & fin(y).isNotNull()).select(*g, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"), F.row_number().over(w).alias("_i"), *[F.sum(e).over(run).alias(n) for n, e in (("_1", F.lit(1.0)), ("_sx", F.col(x)), ("_sy", F.col(y)), ("_sxx", F.col(x) * F.col(x)), ("_sxy", F.col(x) * F.col(y)), ("_syy", F.col(y) * F.col(y)))])
    # how far a stretch from this row reaches: rows ahead are read in growing pieces, until the range is passed
    r = written(r)
    reach = _reach(r, g, widest)
    sums = ["_1", "_sx", "_sy", "_sxx", "_sxy", "_syy"]
    a = r.join(reach, [*g, "_i"]).where(F.col("_reach") >= least).withColumn("_j", F.explode(F.sequence(F.col("_i") + least - 1, F.col("_i") + F.col("_reach") - 1)))
    b = r.select(*g, F.col("_i").alias("_j"), F.col("_x").alias("x_last"), *[F.col(c).alias(f"{c}b") for c in sums])
    d = a.join(b, [*g, "_j"])
    own = {"_1": F.lit(1.0), "_sx": F.col("_x"), "_sy": F.col("_y"), "_sxx": F.col("_x") * F.col("_x"), "_sxy": F.col("_x") * F.col("_y"), "_syy": F.col("_y") * F.col("_y")}
    t = {c: F.col(f"{c}b") - F.col(c) + own[c] for c in sums}
    n, sxx, sxy, syy = t["_1"], t["_sxx"] - t["_sx"] * t["_sx"] / t["_1"], t["_sxy"] - t["_sx"] * t["_sy"] / t["_1"], t["_syy"] - t["_sy"] * t["_sy"] / t["_1"]
    slope = F.when(sxx > 0, sxy / sxx)
    return d.select(*g, F.col("_i").alias("first"), F.col("_j").alias("last"), F.col("_x").alias("x_first"), "x_last", n.cast("int").alias("n"), (t["_sy"] / n).alias("level"), slope.alias("slope"), F.sqrt(F.greatest(syy - F.coalesce(slope, F.lit(0.0)) * sxy, F.lit(0.0)) / n).alias("scatter"), F.sqrt(F.greatest(syy, F.lit(0.0)) / n / n).alias("mean_error"))


def find_plateau(rows: DataFrame, g: list[str], x: str, y: str, least: int = 5, widest: float = 0.15, w_error: float = 0.7, w_length: float = 0.5) -> DataFrame:
    """Best stretch: robustly scaled |slope| + scatter + 0.7 error - 0.5 length is smallest (WIN2)."""
    s = segments(rows, g, x, y, least, widest).withColumns({"_a": F.abs("slope"), "_b": F.col("scatter"), "_c": F.col("mean_error"), "_d": F.col("n").cast("double")})
    cols = ["_a", "_b", "_c", "_d"]
    med = s.groupBy(*g).agg(*[F.median(c).alias(f"{c}m") for c in cols])
    mad = s.join(med, g).groupBy(*g).agg(*[F.median(F.abs(F.col(c) - F.col(f"{c}m"))).alias(f"{c}s") for c in cols])
    z = lambda c: (F.col(c) - F.col(f"{c}m")) / F.when(F.col(f"{c}s") > 0, 1.4826 * F.col(f"{c}s")).otherwise(1.0)
    scored = s.join(med, g).join(mad, g).withColumn("score", z("_a") + z("_b") + w_error * z("_c") - w_length * z("_d"))
    best = scored.withColumn("_r", F.row_number().over(Window.partitionBy(*g).orderBy("score", F.desc("n"), "first"))).where("_r = 1")
    best = best.select(*g, "first", "last", "x_first", "x_last", "n", "level", "slope", "scatter", "score", F.lit("plateau").alias("how"))
    return best.unionByName(_most_robust(rows, best, g, x, y), allowMissingColumns=True)


def _most_robust(rows: DataFrame, best: DataFrame, g: list[str], x: str, y: str) -> DataFrame:
    """Of groups without a plateau the row nearest to the median, as a stretch of its own (WIN2)."""
    ok = rows.where(fin(x).isNotNull() & fin(y).isNotNull()).withColumn("_i", F.row_number().over(ordered(g, x))).join(best.select(*g), g, "left_anti")
    near = ok.join(ok.groupBy(*g).agg(F.median(y).alias("_m")), g)
    first = near.withColumn("_r", F.row_number().over(Window.partitionBy(*g).orderBy(F.abs(F.col(y) - F.col("_m")), "_i"))).where("_r = 1")
    at, level = F.col(x).cast("double"), F.col(y).cast("double")
    return first.select(*g, F.col("_i").alias("first"), F.col("_i").alias("last"), at.alias("x_first"), at.alias("x_last"), F.lit(1).alias("n"), level.alias("level"), F.lit("most_robust").alias("how"))


def pick_window(windows: DataFrame, plateau: DataFrame, g: list[str], y: str, penalties: dict[str, float], unique: tuple[str, ...] = ()) -> DataFrame:
    """The window nearest to the plateau's level, with soft penalties; of equal ones the first by `unique` (WIN3)."""
    cost = F.abs(F.col(y) - F.col("level"))
    for c, weight in penalties.items():
        cost = cost + weight * F.coalesce(fin(c), F.lit(0.0))
    scored = windows.join(plateau.select(*g, "level"), g).withColumn("cost", cost)
    return scored.withColumn("_r", F.row_number().over(Window.partitionBy(*g).orderBy(F.col("cost").asc_nulls_last(), y, *unique))).where("_r = 1").drop("_r")


def ring_plateau(rings: DataFrame, g: list[str], x: str = "r_mid", y: str = "mbar", widest: float = 0.4, least: int = 3) -> DataFrame:
    """Longest run of rings within a range; of equally long ones the inner (WIN4).

    How far a run from each ring reaches is known, so only the longest one of a group is read again.
    """
    ok = rings.where(fin(x).isNotNull() & fin(y).isNotNull())
    r = written(ok.select(*g, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"), F.row_number().over(ordered(g, x)).alias("_i")))
    runs = _reach(r, g, widest).where(F.col("_reach") >= least)
    ends = runs.withColumn("_j", F.col("_i") + F.col("_reach") - 1)
    mid = ends.join(r.select(*g, "_i", F.col("_x").alias("_a")), [*g, "_i"]).join(r.select(*g, F.col("_i").alias("_j"), F.col("_x").alias("_b")), [*g, "_j"])
    best = mid.groupBy(*g).agg(F.min(F.struct(-F.col("_reach"), F.col("_a") + F.col("_b"), "_i", "_j")).alias("_m")).select(*g, F.col("_m._i").alias("_first"), F.col("_m._j").alias("_last"))
    own = r.join(best, g).where("_i between _first and _last")
    out = own.groupBy(*g).agg(F.count("*").cast("int").alias("n"), F.min("_x").alias("x_first"), F.max("_x").alias("x_last"), F.avg("_y").alias("level"))
    return out.select(*g, "n", "x_first", "x_last", ((F.col("x_first") + F.col("x_last")) / 2).alias("r_mid"), "level")


def zero_crossing(profile: DataFrame, g: list[str], x: str, y: str) -> DataFrame:
    """Where the value first changes sign, on the line between the rows; and the first x with a negative value (WIN5)."""
    w = ordered(g, x)
    p = profile.where(fin(y).isNotNull()).withColumns({"_px": F.lag(x).over(w), "_py": F.lag(y).over(w)})
    at = F.when(F.col("_py") * F.col(y) < 0, F.col("_px") - F.col("_py") * (F.col(x) - F.col("_px")) / (F.col(y) - F.col("_py"))).when((F.col(y) == 0) & F.col("_px").isNotNull(), F.col(x))
    return p.withColumn("_at", at).groupBy(*g).agg(F.min_by("_at", F.when(F.col("_at").isNotNull(), F.col(x))).alias("zero_x"), F.min(F.when(F.col(y) < 0, F.col(x))).alias("first_negative_x"))


def isophote_steps(isophotes: DataFrame, g: list[str], x: str, lo: float, hi: float, cols: list[str], least: int = 5) -> DataFrame:
    """Std and largest size of first differences inside a range of x (WIN6)."""
    w = ordered(g, x)
    d = isophotes.where(F.col(x).between(lo, hi)).withColumns({f"_{c}": F.col(c) - F.lag(c).over(w) for c in cols})
    s = d.groupBy(*g).agg(F.count("*").alias("n"), *[f(e).alias(f"{c}_{n}") for c in cols for n, f, e in (("step_std", F.stddev_pop, F.col(f"_{c}")), ("step_max", F.max, F.abs(F.col(f"_{c}"))))])
    return s.where(F.col("n") >= least)


def profile_gradient(nodes: DataFrame, g: list[str], x: str = "sma", y: str = "intens") -> DataFrame:
    """Central differences on uneven steps, one-sided at the ends; a gradient that isn't negative becomes -|I| / x (WIN7)."""
    w = ordered(g, x)
    h0, h1 = F.col(x) - F.lag(x).over(w), F.lead(x).over(w) - F.col(x)
    d0, d1 = (F.col(y) - F.lag(y).over(w)) / h0, (F.lead(y).over(w) - F.col(y)) / h1
    grad = F.coalesce((d0 * h1 + d1 * h0) / (h0 + h1), d0, d1)
    return nodes.withColumn("grad", grad).withColumn("grad", F.when(fin("grad") < 0, F.col("grad")).otherwise(-F.greatest(F.abs(y), F.lit(1e-6)) / F.greatest(F.col(x).cast("double"), F.lit(1.0))))


def unwrap(rows: DataFrame, g: list[str], x: str, angle: str, period: float = 2 * math.pi) -> DataFrame:
    """Angles without jumps of more than half a period: a running sum of whole turns (WIN8)."""
    w = ordered(g, x)
    d = F.col(angle) - F.lag(angle).over(w)
    turn = F.coalesce(-F.floor((d + period / 2) / period), F.lit(0))
    return rows.withColumn("_t", turn).withColumn("unwrapped", F.col(angle) + period * F.sum("_t").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_t")


def clean_nodes(isophotes: DataFrame, g: list[str], order: str, least: int = 8, trusted: float = 0.5) -> DataFrame:
    """Valid nodes, the last of those with equal sma; groups with fewer than `least` go; the trusted edge (WIN9)."""
    ok = isophotes.where((fin("sma") > 0) & fin("intens").isNotNull() & F.coalesce(fin("eps").between(0, 0.99), F.lit(False)))
    one = ok.withColumn("_r", F.row_number().over(Window.partitionBy(*g, "sma").orderBy(F.desc(order)))).where("_r = 1").drop("_r")
    s = one.groupBy(*g).agg(F.count("*").alias("n_nodes"), F.max(F.when(F.col("real_data_frac") >= trusted, F.col("sma"))).alias("trusted_edge"))
    return one.join(s.where(F.col("n_nodes") >= least), g)


#: Fixed values of the continuation: rows of the tail, step and scale in pixels, limits of slopes and ellipticity.
TAIL, STEP, SCALE, PROFILE_LEAST = 20, 10.0, 250.0, 5
SLOPE_LIMITS = {"x0": 1.0e-2, "y0": 1.0e-2, "eps": 3.0e-4, "pa": 3.0e-4}
EPS_MOST, WEIGHT_UNKNOWN, WEIGHT_RANGE = 0.90, 0.25, (0.05, 1.0)


def _weighted_slope(y, x, w):
    """Slope of the least-squares line with residuals multiplied by w, from sums; NULL with fewer than two x."""
    ok = y.isNotNull() & x.isNotNull()
    s = lambda e: F.sum(F.when(ok, w * w * e))
    one = F.lit(1.0)
    det = s(one) * s(x * x) - s(x) * s(x)
    return F.when(F.count_distinct(F.when(ok, x)) > 1, (s(one) * s(x * y) - s(x) * s(y)) / det)


def extend_nodes(nodes: DataFrame, needed: DataFrame, g: list[str], tail: int = TAIL, step: float = STEP, scale: float = SCALE, limits: dict[str, float] = SLOPE_LIMITS) -> DataFrame:
    """Nodes continued every `step` to the needed radius, which is the last one's (WIN10).

    Geometry goes on from the edge along tail slopes, weighted by the share of real data, clipped, and saturating as
    slope * scale * (1 - exp(-distance / scale)); ellipticity stays between 0 and EPS_MOST.  Intensity falls
    exponentially where the tail does and is flat otherwise.  nodes: g, sma, intens, real_data_frac and the columns of
    `limits`; needed: g, r_needed.
    """
    order = Window.partitionBy(*g).orderBy(F.desc("sma"))
    last = nodes.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= tail)
    last = last.withColumn("_w", F.greatest(F.lit(WEIGHT_RANGE[0]), F.least(F.lit(WEIGHT_RANGE[1]), F.coalesce(fin("real_data_frac"), F.lit(WEIGHT_UNKNOWN)))))
    w, x = F.col("_w"), F.col("sma").cast("double")
    log = F.log(F.when(fin("intens") > 0, F.col("intens")))
    enough = (F.count("*") >= PROFILE_LEAST) & (F.count(log) == F.count("*"))
    start = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(EPS_MOST), F.max_by(c, "sma"))) if c == "eps" else F.max_by(c, "sma")
    slopes = [F.greatest(F.lit(-m), F.least(F.lit(m), F.coalesce(fin(_weighted_slope(fin(c), x, w)), F.lit(0.0)))).alias(f"_s_{c}") for c, m in limits.items()]
    fit = last.groupBy(*g).agg(F.max("sma").alias("_edge"), F.max_by("intens", "sma").alias("_i0"), F.when(enough, F.least(F.coalesce(_weighted_slope(log, x, w), F.lit(0.0)), F.lit(0.0))).otherwise(0.0).alias("_li"), *slopes, *[start(c).alias(f"_0_{c}") for c in limits])
    # steps up to half a step beyond the needed radius; that radius itself if they end before it
    far = F.col("r_needed") - F.col("_edge")
    n = F.greatest(F.ceil((far + 0.5 * step) / step).cast("int") - 1, F.lit(0))
    steps = F.transform(F.filter(F.sequence(F.lit(0), n), lambda k: k > 0), lambda k: k * F.lit(float(step)))
    rest = F.when(far > n * F.lit(float(step)), F.array(far)).otherwise(F.array().cast("array<double>"))
    grown = fit.join(needed, g).where((n > 0) | (far > 0.5)).withColumn("_d", F.explode(F.concat(steps, rest)))
    soft = scale * (1 - F.exp(-F.col("_d") / scale))
    moved = {c: F.col(f"_0_{c}") + F.col(f"_s_{c}") * soft for c in limits}
    if "eps" in moved:
        moved["eps"] = F.greatest(F.lit(0.0), F.least(F.lit(EPS_MOST), moved["eps"]))
    new = grown.select(*g, (F.col("_edge") + F.col("_d")).alias("sma"), (F.col("_i0") * F.exp(F.col("_li") * F.col("_d"))).alias("intens"), *[e.alias(c) for c, e in moved.items()], F.lit("synthetic").alias("node_origin"))
    return nodes.select(*g, "sma", "intens", *limits, F.lit("fitted").alias("node_origin")).unionByName(new)


def recommend(summary: DataFrame, g: list[str], prefer_main: bool = True, main: tuple[float, float] = (0.04, 0.25), unique: tuple[str, ...] = ()) -> DataFrame:
    """Row of each group: two annuli first, then the main window, then the smallest sigmas, then by `unique` (WIN11)."""
    is_main = (F.abs(F.col("kmin") - main[0]) < 1e-9) & (F.abs(F.col("kmax") - main[1]) < 1e-9)
    order = [F.desc(F.coalesce("uses_two_annuli", F.lit(False))), *([F.desc(is_main)] if prefer_main else []), F.col("sigma_adopted").asc_nulls_last(), F.col("sigma_weighted_formal").asc_nulls_last(), F.col("kmin"), F.col("kmax"), *unique]
    return summary.withColumn("_r", F.row_number().over(Window.partitionBy(*g).orderBy(*order))).where("_r = 1").drop("_r")


def circular_smooth(ring: DataFrame, g: list[str], bins: int, at: str = "bin", value: str = "value", width: int = 21) -> DataFrame:
    """Empty bins filled by circular interpolation, then a normalised Hann kernel (WIN12): bins meet their neighbours by equality."""
    filled = ring.where(fin(value).isNotNull()).select(*g, F.col(at).cast("int").alias("_b"), F.col(value).alias("_v"))
    twice = filled.withColumn("_b", F.explode(F.array(F.col("_b") - bins, F.col("_b"), F.col("_b") + bins)))
    w = ordered(g, "_b")
    span = twice.withColumns({"_nb": F.lead("_b").over(w), "_nv": F.lead("_v").over(w)}).where("_nb is not null")
    each = span.withColumn("_k", F.explode(F.sequence(F.col("_b"), F.col("_nb") - 1))).where((F.col("_k") >= 0) & (F.col("_k") < bins))
    full = each.select(*g, F.col("_k").alias("_b"), (F.col("_v") + (F.col("_nv") - F.col("_v")) * (F.col("_k") - F.col("_b")) / (F.col("_nb") - F.col("_b"))).alias("_v"))
    half = width // 2
    kernel = [(o, 0.5 - 0.5 * math.cos(2 * math.pi * (o + half + 1) / (width + 1))) for o in range(-half, half + 1)]
    total = sum(k for _, k in kernel)
    pairs = F.array(*[F.struct(F.lit(o).alias("o"), F.lit(k / total).alias("k")) for o, k in kernel])
    return full.withColumn("_p", F.explode(pairs)).groupBy(*g, F.pmod(F.col("_b") + F.col("_p.o"), F.lit(bins)).alias(at)).agg(F.sum(F.col("_v") * F.col("_p.k")).alias("smoothed"))


def best_experiment(metrics: DataFrame, g: list[str], sigma: str = "sigma_adopted", scatter: str = "annulus_scatter", name: str = "experiment") -> DataFrame:
    """Smallest adopted sigma, then scatter, then name (WIN13)."""
    return metrics.withColumn("_r", F.row_number().over(Window.partitionBy(*g).orderBy(F.col(sigma).asc_nulls_last(), F.col(scatter).asc_nulls_last(), name))).where("_r = 1").drop("_r")


def decide(metrics: DataFrame, g: list[str], order: str, sigma: str = "sigma_adopted", better: float = 0.95, worse: float = 1.10, digits: int = 9) -> DataFrame:
    """Keep, reject or neutral against the first experiment of the group (WIN14).  Ratios are rounded, so that a ratio of
    just a threshold is neutral."""
    base = F.first(sigma).over(ordered(g, order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    first = F.row_number().over(ordered(g, order)) == 1
    out = metrics.withColumns({"_base": base, "_first": first})
    ratio = F.round(F.col(sigma) / F.col("_base"), digits)
    return out.withColumn("decision", F.when(F.col("_first"), "baseline").when(ratio < better, "keep").when(ratio > worse, "reject").otherwise("neutral")).withColumn("sigma_ratio", ratio).drop("_base", "_first")


def decide_model(metrics: DataFrame, g: list[str], order: str, score: str = "resid_abs_median_sum", sigma: str = "sigma_adopted", better: float = 0.8, worse: float = 1.2, looser: float = 1.25, digits: int = 9) -> DataFrame:
    """Verdict on a changed model by its residuals against the first experiment's, and the reason (WIN14).

    Clearly weaker residuals are kept unless sigma grew too much; clearly stronger ones are rejected; the rest is kept.
    """
    span = ordered(g, order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ratio = lambda c: F.round(fin(c) / F.first(fin(c)).over(span), digits)
    first = F.row_number().over(ordered(g, order)) == 1
    out = metrics.withColumns({"score_ratio": ratio(score), "sigma_ratio": ratio(sigma), "_first": first})
    loose = F.coalesce(F.col("sigma_ratio") > looser, F.lit(False))
    why = F.when(F.col("_first"), "baseline").when((F.col("score_ratio") < better) & loose, "sigma too poor").when(F.col("score_ratio") < better, "residuals weaker").when(F.col("score_ratio") > worse, "residuals stronger").otherwise("residuals similar")
    return out.withColumns({"reason": why, "decision": F.when(why.isin("sigma too poor", "residuals stronger"), "reject").otherwise("keep")}).drop("_first")
