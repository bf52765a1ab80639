"""Grouped statistics of pixels, sources and measurements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import ab_zeropoint, fin, fin_pos, flux_from_mag, quadrature
from ..plans.storage import discard, written
from .ranks import beside, counted_bits, grouped, medians, quantiles, selected, small

#: Magnitudes that are plausible.
MBAR_RANGE = (10.0, 40.0)
#: Bins, limits and defaults of the luminosity function.
LF_BIN, LF_WIDTH, LF_GAMMA, LF_GAMMA_RANGE, LF_QUANTILE = 0.25, 1.5, 0.30, (0.10, 0.70), 0.80


def _counted(df: DataFrame, g: list[str], value: str) -> DataFrame:
    """Distinct finite values of each group with their counts."""
    v = df.select(*g, fin(value).alias("_v")).where("_v is not null").groupBy(*g, "_v").agg(F.count("*").alias("_n"))
    return counted_bits(v, g)


def _moments(v: DataFrame, g: list[str], most_rows: int, groups: int, *also: Column) -> tuple[DataFrame, list[DataFrame]]:
    """_med, _sd, _mean, _c of counted values, and the stored tables that they are read from."""
    d, n = F.col("_v") - F.col("_ref"), F.col("_n")
    var = F.sum(n * d * d) / F.sum(n) - F.pow(F.sum(n * d) / F.sum(n), 2)
    sums = [F.sqrt(F.greatest(var, F.lit(0.0))).alias("_sd"), (F.first("_ref") + F.sum(n * d) / F.sum(n)).alias("_mean"), F.sum(n).alias("_c")]
    med, stored = selected(v, g, {"_med": (F.col("_v"), 0.5)}, "_n", "_b", most_rows)
    return beside(v.groupBy(*g).agg(*sums, *also), med, g, groups), stored


def _inside(v: DataFrame, bounds: DataFrame, g: list[str], groups: int) -> DataFrame:
    return v.join(small(bounds.drop("_c"), groups), g).where("_v between lo and hi")


def _rounds(v: DataFrame, g: list[str], k: float, iters: int) -> tuple[DataFrame, int, int]:
    """Bounds after `iters` rounds, stored, the number of groups and the most values of one.  Only the bounds, with the group's mean `_ref` for precise
    sums, go from round to round, so each round reads the counted values once; when a round has as many values as the one
    before, all groups have converged."""
    ref = (F.sum(F.col("_v") * F.col("_n")) / F.sum("_n")).alias("_ref")
    bounds, last = written(v.groupBy(*g).agg(F.lit(float("-inf")).alias("lo"), F.lit(float("inf")).alias("hi"), F.count("*").alias("_c"), ref)), None
    groups, most_rows = bounds.agg(F.count("*"), F.max("_c")).first()
    most_rows = most_rows or 0
    for _ in range(iters):
        s, stored = _moments(_inside(v, bounds, g, groups), g, most_rows, groups, *[F.first(c).alias(c) for c in ("lo", "hi", "_ref")])
        new = written(s.select(*g, F.greatest("lo", F.col("_med") - k * F.col("_sd")).alias("lo"), F.least("hi", F.col("_med") + k * F.col("_sd")).alias("hi"), "_c", "_ref"))
        for t in [*stored, bounds]:
            discard(t)
        bounds, n = new, new.agg(F.sum("_c")).first()[0]
        if n == last:
            break
        last = n
    return bounds, groups, most_rows


def clip_bounds(df: DataFrame, g: list[str], value: str, k: float, iters: int) -> DataFrame:
    """Clipping bounds of each group: g, lo, hi.

    A group's values are counted first, so rounds work on distinct values.  A round that drops nothing leaves the bounds of
    a group as they are, so groups that have converged go on without effect.
    """
    v = written(_counted(df, g, value))
    return _rounds(v, g, k, iters)[0].select(*g, "lo", "hi")


def sigma_clip_stats(df: DataFrame, g: list[str], value: str, k: float = 3.0, iters: int = 5) -> DataFrame:
    """Mean, median, standard deviation (ddof 0) and number of each group after clipping at median +- k sigma (AGG1)."""
    v = written(_counted(df, g, value))
    bounds, groups, most_rows = _rounds(v, g, k, iters)
    s, stored = _moments(_inside(v, bounds, g, groups), g, most_rows, groups)
    s = written(s)
    for t in [*stored, v]:
        discard(t)
    return s.select(*g, F.col("_mean").alias("mean"), F.col("_med").alias("median"), F.col("_c").alias("n"), F.col("_sd").alias("std"))


def sigma_cap(df: DataFrame, g: list[str], value: str, k: float = 3.5, iters: int = 5) -> DataFrame:
    """Values capped at median +- k sigma of the clipped statistics; capped, delta and whether it changed (FLT12)."""
    s = sigma_clip_stats(df, g, value, k, iters).select(*g, (F.col("median") - k * F.col("std")).alias("_lo"), (F.col("median") + k * F.col("std")).alias("_hi"))
    out = df.join(s, g).withColumn("capped", F.when(fin(value).isNotNull(), F.greatest(F.col("_lo"), F.least(F.col("_hi"), F.col(value)))))
    return out.withColumns({"delta": F.col("capped") - F.col(value), "changed": F.coalesce(F.col("capped") != F.col(value), F.lit(False))}).drop("_lo", "_hi")


def tile_medians(pixels: DataFrame, box: int, key: str = "image_id", k: float = 3.0, iters: int = 5) -> DataFrame:
    t = pixels.withColumns({"ty": F.expr(f"cast(floor(y / {box}) as int)"), "tx": F.expr(f"cast(floor(x / {box}) as int)")})
    return sigma_clip_stats(t, [key, "ty", "tx"], "value", k, iters).select(key, "ty", "tx", F.col("median").alias("tile"), F.col("n").alias("n_tile"))


def tile_background(pixels: DataFrame, box: int = 256, filt: int = 5, key: str = "image_id") -> DataFrame:
    """Background of each tile: the median of clipped tile medians in a filt x filt neighbourhood; and of the whole image: the
    median of those (`scalar`, AGG2)."""
    tiles, r = tile_medians(pixels, box, key), filt // 2
    near = F.expr(f"sequence(-{r}, {r})")
    spread = tiles.withColumn("dy", F.explode(near)).withColumn("dx", F.explode(near)).select(key, (F.col("ty") + F.col("dy")).alias("ty"), (F.col("tx") + F.col("dx")).alias("tx"), "tile")
    smooth = spread.groupBy(key, "ty", "tx").agg(F.median("tile").alias("background"))  # filt * filt values at most
    out = written(tiles.join(small(smooth, tiles.count()), [key, "ty", "tx"]))
    return out.join(medians(out, [key], {"scalar": F.col("background")}), key)


def corner_check(pixels: DataFrame, frac: float = 0.1, least: int = 100, key: str = "image_id", k: float = 3.0, iters: int = 5) -> DataFrame:
    """Clipped statistics of the four corners together; NULL rows are left out when there are too few pixels (AGG3)."""
    size = pixels.groupBy(key).agg((F.max("x") + 1).alias("nx"), (F.max("y") + 1).alias("ny"))
    edge = lambda c, n: (F.col(c) < F.floor(frac * F.col(n))) | (F.col(c) >= F.col(n) - F.floor(frac * F.col(n)))
    return sigma_clip_stats(pixels.join(size, key).where(edge("x", "nx") & edge("y", "ny")), [key], "value", k, iters).where(F.col("n") > least)


def bkg_delta(stat: Column | str, med="bkg_med", mean="bkg_mean", std="bkg_std", n="bkg_n") -> Column:
    """Sky uncertainty by the chosen statistic: median, mean, max_abs_mean_median or sem (AGG4)."""
    s = F.col(stat) if isinstance(stat, str) else stat
    return F.when(s == "median", F.abs(med)).when(s == "mean", F.abs(mean)).when(s == "max_abs_mean_median", F.greatest(F.abs(med), F.abs(mean))).when(s == "sem", F.col(std) / F.sqrt(F.col(n)))


def radial_profile(pixels: DataFrame, centers: DataFrame, dr: float = 1.0, min_pix: int = 200, least: int = 1000, key: str = "image_id") -> DataFrame:
    """Median of each ring; thin rings, and images with too few valid pixels, have none (AGG5)."""
    r = F.sqrt(F.pow(F.col("x") - F.col("cx"), 2) + F.pow(F.col("y") - F.col("cy"), 2))
    v = pixels.join(centers, key).where(fin("value").isNotNull()).withColumn("ring", F.floor(r / dr).cast("int"))
    rings = grouped(v, [key, "ring"], [F.count("*").alias("n_pix")], {"intensity": (F.col("value"), 0.5)}).select(key, "ring", "intensity", "n_pix")
    whole = v.groupBy(key).agg(F.count("*").alias("_all")).where(F.col("_all") >= least)
    return rings.where(F.col("n_pix") >= min_pix).join(whole.select(key), key).withColumn("r_mid", (F.col("ring") + 0.5) * dr)


def guess_center(smoothed: DataFrame, key: str = "image_id", value: str = "smoothed", q: float = 0.995, least: int = 50) -> DataFrame:
    """Centroid of the brightest pixels weighted by their height; the brightest pixel if they are few, the middle of the
    frame if no pixel has a value (AGG6)."""
    v = smoothed.where(fin(value).isNotNull())
    s = grouped(v, [key], [F.min(value).alias("_lo"), F.max_by("x", F.struct(F.col(value), -F.col("y"), -F.col("x"))).alias("_mx"), F.max_by("y", F.struct(F.col(value), -F.col("y"), -F.col("x"))).alias("_my")], {"_t": (F.col(value), q)})
    w = F.col(value) - F.col("_lo") + 1e-12
    top = v.join(s, key).where(F.col(value) >= F.col("_t")).groupBy(key).agg(F.count("*").alias("n_bright"), (F.sum(w * F.col("x")) / F.sum(w)).alias("_wx"), (F.sum(w * F.col("y")) / F.sum(w)).alias("_wy"))
    frame = smoothed.groupBy(key).agg(*[((F.max(c) + 1) / 2.0).alias(f"_f{c}") for c in ("x", "y")])
    many = F.col("n_bright") >= least
    at = lambda c: F.coalesce(F.when(many, F.col(f"_w{c}")).otherwise(F.col(f"_m{c}")), F.col(f"_f{c}")).alias(f"c{c}")
    return frame.join(s.join(top, key), key, "left").select(key, F.coalesce("n_bright", F.lit(0)).alias("n_bright"), at("x"), at("y"))


def ellipse_moments(pixels: DataFrame, g: list[str], weight: str = "value") -> DataFrame:
    """Centre, ellipticity and position angle from weighted second moments (AGG7)."""
    w = fin_pos(weight)
    s = pixels.where(w.isNotNull()).groupBy(*g).agg(F.sum(w).alias("w"), *[F.sum(w * e).alias(n) for n, e in (("sx", F.col("x")), ("sy", F.col("y")), ("sxx", F.col("x") * F.col("x")), ("syy", F.col("y") * F.col("y")), ("sxy", F.col("x") * F.col("y")))])
    x0, y0 = F.col("sx") / F.col("w"), F.col("sy") / F.col("w")
    vx, vy, vxy = F.col("sxx") / F.col("w") - x0 * x0, F.col("syy") / F.col("w") - y0 * y0, F.col("sxy") / F.col("w") - x0 * y0
    root = F.sqrt(F.pow((vx - vy) / 2, 2) + vxy * vxy)
    major, minor = (vx + vy) / 2 + root, (vx + vy) / 2 - root
    return s.select(*g, x0.alias("x0"), y0.alias("y0"), F.when(major > 0, 1 - F.sqrt(F.greatest(minor, F.lit(0.0)) / major)).alias("eps"), (0.5 * F.atan2(2 * vxy, vx - vy)).alias("pa"))


def median_geometry(isophotes: DataFrame, g: list[str], cols=("x0", "y0", "eps", "pa")) -> DataFrame:
    return isophotes.groupBy(*g).agg(*[F.median(c).alias(c) for c in cols])


def value_stats(df: DataFrame, g: list[str], value: str = "value") -> DataFrame:
    """n, min, median, max, mean, std, p01, p99 of finite values (AGG8, AGG13)."""
    v = fin(value)
    sums = [F.count(v).alias("n"), F.min(v).alias("v_min"), F.max(v).alias("v_max"), F.avg(v).alias("v_mean"), F.stddev_pop(v).alias("v_std")]
    out = grouped(df, g, sums, {"v_median": (v, 0.5), "p01": (v, 0.01), "p99": (v, 0.99)})
    return out.select(*g, "n", "v_min", "v_median", "v_max", "v_mean", "v_std", "p01", "p99")


def quadrant_stats(pixels: DataFrame, centers: DataFrame, key: str = "image_id") -> DataFrame:
    q = F.when(F.col("y") < F.col("cy"), 0).otherwise(2) + F.when(F.col("x") < F.col("cx"), 0).otherwise(1)
    return value_stats(pixels.join(centers, key).withColumn("quadrant", q), [key, "quadrant"])


def bias_profile(pixels: DataFrame, g: list[str], r: str = "r", bins: int = 24, boundary: float = 0.0, least: int = 200, cols=("value",)) -> DataFrame:
    """Median, mean and std in equal radial bins up to max(p99.5 of the radius, boundary) (AGG9)."""
    top = quantiles(pixels, g, {"_q": (F.col(r), 0.995)}).select(*g, F.greatest("_q", F.lit(float(boundary))).alias("_top"))
    b = F.floor(F.col(r) / (F.col("_top") / bins)).cast("int")
    binned = pixels.join(top, g).withColumn("rbin", b).where(F.col("rbin") < bins)
    sums = [F.count("*").alias("n_pix"), F.first("_top").alias("_top"), *[f(fin(c)).alias(f"{c}_{n}") for c in cols for n, f in (("mean", F.avg), ("std", F.stddev_pop))]]
    out = grouped(binned, [*g, "rbin"], sums, {f"{c}_median": (F.col(c), 0.5) for c in cols})
    return out.where(F.col("n_pix") >= least).withColumn("r_mid", (F.col("rbin") + 0.5) * F.col("_top") / bins).drop("_top")


def sign_label(c: Column | str) -> Column:
    c = fin(c)
    return F.when(c > 0, "positive").when(c < 0, "negative").when(c == 0, "zero").otherwise("nan")


def region_bias(pixels: DataFrame, g: list[str], value: str = "value") -> DataFrame:
    """Median and mean of each region, and their signs (AGG10)."""
    v = fin(value)
    s = grouped(pixels, g, [F.count(v).alias("n_use"), F.avg(v).alias("resid_mean")], {"resid_median": (v, 0.5)}).select(*g, "n_use", "resid_median", "resid_mean")
    return s.withColumns({"median_sign": sign_label("resid_median"), "mean_sign": sign_label("resid_mean")})


def coverage(pixels: DataFrame, g: list[str], flags: list[str]) -> DataFrame:
    """Number and share of pixels with each flag (AGG12)."""
    return pixels.groupBy(*g).agg(F.count("*").alias("n"), *[F.count_if(F.col(f)).alias(f"n_{f}") for f in flags], *[(F.count_if(F.col(f)) / F.count("*")).alias(f"frac_{f}") for f in flags])


def zone_stats(df: DataFrame, g: list[str], value: str = "value", k: float = 3.0, iters: int = 5) -> DataFrame:
    """Quantiles, mean and std of raw values, and of values inside the clipping bounds (AGG14)."""
    shares = {f"p{round(100 * p):02d}": p for p in (0.01, 0.05, 0.5, 0.95, 0.99)}

    def stats(v: Column, tag: str) -> list[Column]:
        return [F.count(v).alias(f"{tag}_n"), F.min(v).alias(f"{tag}_min"), F.max(v).alias(f"{tag}_max"), F.avg(v).alias(f"{tag}_mean"), F.stddev_pop(v).alias(f"{tag}_std")]

    b = clip_bounds(df, g, value, k, iters)
    raw, clip = fin(value), F.when(F.col(value).between(F.col("lo"), F.col("hi")), fin(value))
    wanted = {f"{tag}_{n}": (v, p) for tag, v in (("raw", raw), ("clip", clip)) for n, p in shares.items()}
    return grouped(df.join(b, g), g, [*stats(raw, "raw"), *stats(clip, "clip")], wanted)


def variance_sbf(pixels: DataFrame, g: list[str], area: float, value: str = "value", model: str = "model", least: int = 100) -> DataFrame:
    """Variance between the 5th and 95th percentiles over the mean model brightness, as a magnitude (AGG15)."""
    q = grouped(pixels, g, [F.avg(fin(model)).alias("i_mean")], {"_a": (F.col(value), 0.05), "_b": (F.col(value), 0.95)})
    s = pixels.join(q, g).where(F.col(value).between(F.col("_a"), F.col("_b"))).groupBy(*g).agg(F.count("*").alias("n_core"), F.var_pop(value).alias("var_core"), F.first("i_mean").alias("i_mean"))
    pf = F.when((F.col("n_core") >= least) & (F.col("i_mean") > 0) & (F.col("var_core") > 0), F.col("var_core") / F.col("i_mean"))
    out = s.withColumn("pf", pf).withColumn("mbar", -2.5 * F.log10("pf") + ab_zeropoint(F.lit(area)))
    return out.withColumn("warn_mbar", F.coalesce(~F.col("mbar").between(*MBAR_RANGE), F.lit(False)))


#: Ring radii for large frames and others - start, stop, step, width, margin to the corner.
LARGE_FRAME, LARGE_RINGS, SMALL_RINGS, SMALLEST_FRAME = 800.0, (100.0, 800.0, 50.0, 100.0, 50.0), (30.0, 60.0, 20.0, 60.0, 20.0), 60.0


def frame_rings(pixels: DataFrame, centers: DataFrame, key: str = "image_id") -> DataFrame:
    """Ring radii that fit the frame, by the nearest corner's distance from the centre: key, ring, r_in, r_out (AGG16)."""
    size = pixels.groupBy(key).agg(F.max("x").alias("_x"), F.max("y").alias("_y")).join(centers, key)
    corner = F.least(*[F.sqrt(F.pow(F.col("cx") - x, 2) + F.pow(F.col("cy") - y, 2)) for x in (F.lit(0), F.col("_x")) for y in (F.lit(0), F.col("_y"))])
    large = F.col("_c") > LARGE_FRAME
    pick = lambda k: F.when(large, LARGE_RINGS[k]).otherwise(SMALL_RINGS[k])
    stop = F.when(large, F.least(F.lit(LARGE_RINGS[1]), F.col("_c") - LARGE_RINGS[4])).otherwise(F.greatest(F.lit(SMALL_RINGS[1]), F.col("_c") - SMALL_RINGS[4]))
    s = size.withColumn("_c", corner).where(F.col("_c") > SMALLEST_FRAME).select(key, pick(0).alias("_a"), stop.alias("_b"), pick(2).alias("_s"), pick(3).alias("_w")).where("_b > _a")
    # rings begin before the end of the range
    rings = s.withColumn("ring", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil((F.col("_b") - F.col("_a")) / F.col("_s")).cast("int") - 1, F.lit(0)))))
    return rings.select(key, "ring", (F.col("_a") + F.col("ring") * F.col("_s")).alias("r_in"), (F.col("_a") + F.col("ring") * F.col("_s") + F.col("_w")).alias("r_out"))


def scan_frame_rings(pixels: DataFrame, centers: DataFrame, area: float, key: str = "image_id", least: int = 100) -> DataFrame:
    """`variance_sbf` in the rings that fit each frame (AGG16); the few rings of a pixel are a filter of its image's."""
    rings = frame_rings(pixels, centers, key)
    each = rings.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("r_in", "r_out", "ring"))).alias("_rings"))  # at most some dozens
    r = F.sqrt(F.pow(F.col("x") - F.col("cx"), 2) + F.pow(F.col("y") - F.col("cy"), 2))
    p = pixels.join(centers, key).withColumn("r", r).join(each, key)
    inside = p.withColumn("ring", F.explode(F.expr("transform(filter(_rings, q -> r >= q.r_in and r < q.r_out), q -> q.ring)"))).drop("_rings")
    return variance_sbf(inside, [key, "ring"], area, least=least).join(rings, [key, "ring"])


def scan_rings(pixels: DataFrame, centers: DataFrame, start: float, stop: float, step: float, width: float, area: float, key: str = "image_id", least: int = 100) -> DataFrame:
    """`variance_sbf` in overlapping rings (AGG16): a pixel lies in width / step rings, which its radius gives."""
    r = F.sqrt(F.pow(F.col("x") - F.col("cx"), 2) + F.pow(F.col("y") - F.col("cy"), 2))
    hi = F.least(F.floor((F.col("r") - start) / step), F.lit(int((stop - start) / step)))
    lo = F.greatest(F.floor((F.col("r") - start - width) / step) + 1, F.lit(0))
    p = pixels.join(centers, key).withColumn("r", r).where(F.col("r") >= start).withColumns({"_lo": lo.cast("int"), "_hi": hi.cast("int")}).where("_lo <= _hi")
    p = p.withColumn("ring", F.explode(F.sequence("_lo", "_hi")))
    return variance_sbf(p, [key, "ring"], area, least=least).withColumns({"r_in": start + F.col("ring") * step, "r_out": start + F.col("ring") * step + width})


def labelled_sources(pixels: DataFrame, segments: DataFrame, area: float, max_area: int = 625, key: str = "image_id") -> DataFrame:
    """Position, area, signed and positive flux and magnitude of each label, and why it is dropped, if it is (AGG17)."""
    s = segments.join(pixels, [key, "y", "x"]).groupBy(key, "label").agg(F.avg("x").alias("xcentroid"), F.avg("y").alias("ycentroid"), F.count("*").alias("area_pix"), F.sum(fin("value")).alias("flux_signed"), F.sum(F.greatest(fin("value"), F.lit(0.0))).alias("flux_positive"), F.max(fin("value")).alias("peak"))
    flux = F.when(F.col("flux_signed") > 0, F.col("flux_signed")).otherwise(F.col("flux_positive"))
    dropped = F.when(F.col("area_pix") > max_area, "too large").when(~F.coalesce(F.col("flux_adopted") > 0, F.lit(False)), "flux not positive").when(fin("mag_ab").isNull(), "no magnitude").otherwise("")
    return s.withColumn("flux_adopted", flux).withColumn("mag_ab", -2.5 * F.log10(fin_pos("flux_adopted")) + ab_zeropoint(F.lit(area))).withColumn("dropped", dropped)


def source_catalog(pixels: DataFrame, segments: DataFrame, area: float, max_area: int = 625, key: str = "image_id") -> DataFrame:
    """The labels of `labelled_sources` that aren't dropped (AGG17)."""
    return labelled_sources(pixels, segments, area, max_area, key).where("dropped = ''").drop("dropped")


def drop_counters(sources: DataFrame, g: list[str]) -> DataFrame:
    """Numbers of sources kept and dropped, by reason (AGG17)."""
    n = lambda why: F.count_if(F.col("dropped") == why)
    return sources.groupBy(*g).agg(n("").alias("n_kept"), n("too large").alias("n_too_large"), n("flux not positive").alias("n_not_positive"), n("no magnitude").alias("n_no_magnitude"))


def residual_sources(pixels: DataFrame, segments: DataFrame, threshold: float, sigma: float, max_area: int = 3000, key: str = "image_id") -> DataFrame:
    """Small labels whose peak exceeds the threshold, with signal to noise (AGG18)."""
    s = segments.join(pixels, [key, "y", "x"]).groupBy(key, "label").agg(F.count("*").alias("area_pix"), F.max("value").alias("peak"))
    return s.where((F.col("area_pix") <= max_area) & (F.col("peak") > threshold)).withColumn("peak_sn", F.col("peak") / sigma)


def source_summary(sources: DataFrame, g: list[str], mag: str = "mag_ab", flux: str = "flux_adopted") -> DataFrame:
    """Counts and magnitude range of the sources of each region (AGG19)."""
    return sources.groupBy(*g).agg(F.count("*").alias("n_overlap"), F.count(fin(mag)).alias("n_valid"), F.count_if(F.coalesce(F.col(flux) <= 0, F.lit(False))).alias("n_nonpositive"), F.min(fin(mag)).alias("mag_min"), F.median(fin(mag)).alias("mag_med"), F.max(fin(mag)).alias("mag_max"))


def turnover_mag(sources: DataFrame, g: list[str], mag: str = "mag_ab", width: float = LF_BIN, least: int = 3) -> DataFrame:
    """Centre of the first fullest magnitude bin; bins are aligned to multiples of the width (AGG20)."""
    b = sources.where(fin(mag).isNotNull()).groupBy(*g, F.floor(F.col(mag) / width).cast("long").alias("b")).agg(F.count("*").alias("n"))
    s = b.groupBy(*g).agg(F.sum("n").alias("n_sources"), F.max_by("b", F.struct("n", -F.col("b"))).alias("b"))
    return s.select(*g, "n_sources", F.when(F.col("n_sources") >= least, (F.col("b") + 0.5) * width).alias("m_turnover"))


def limit_mag(sources: DataFrame, g: list[str], whole: list[str], mag: str = "mag_ab", override: str | None = None, least_region: int = 6, least_global: int = 20) -> DataFrame:
    """Limiting magnitude and how it was chosen: override, region turnover, global turnover, 0.80 quantile (AGG21)."""
    region = turnover_mag(sources, g, mag)
    total = turnover_mag(sources, whole, mag).select(*whole, F.col("n_sources").alias("_n"), F.col("m_turnover").alias("_m"))
    q = sources.groupBy(*g).agg(F.percentile(fin(mag), F.lit(LF_QUANTILE)).alias("_q"), *([F.first(override).alias("_o")] if override else []))
    o = F.col("_o") if override else F.lit(None).cast("double")
    a, b = (F.col("n_sources") >= least_region) & F.col("m_turnover").isNotNull(), (F.col("_n") >= least_global) & F.col("_m").isNotNull()
    out = region.join(q, g).join(total, whole)
    return out.select(*g, "n_sources", F.when(o.isNotNull(), o).when(a, F.col("m_turnover")).when(b, F.col("_m")).otherwise(F.col("_q")).alias("m_lim"), F.when(o.isNotNull(), "override").when(a, "region_turnover").when(b, "global_turnover").otherwise("quantile_0.80").alias("m_lim_method"))


def fit_lf(sources: DataFrame, limits: DataFrame, g: list[str], areas: DataFrame, mag: str = "mag_ab", least_bins: int = 3) -> DataFrame:
    """Line through log10 of the source density in [m_lim - 1.5, m_lim], weighted by counts, and its plain RMSE (AGG22).

    Outside the allowed slopes, or with too few bins, the slope is fixed and the counts set the height; groups of `areas`
    (g, area) without sources in the range have no height.
    """
    n_bins = int(round(LF_WIDTH / LF_BIN))
    at = F.floor((F.col(mag) - (F.col("m_lim") - LF_WIDTH)) / LF_BIN)
    rows = sources.join(limits, g).where(F.col(mag).between(F.col("m_lim") - LF_WIDTH, F.col("m_lim"))).withColumn("b", F.least(at, F.lit(n_bins - 1)).cast("int"))
    bins = rows.groupBy(*g, "b").agg(F.count("*").alias("n"), F.first("m_lim").alias("m_lim")).join(areas, g)
    x = (F.col("b") + 0.5) * LF_BIN - LF_WIDTH
    y = F.log10(F.col("n") / (F.col("area") * LF_BIN))
    w = F.col("n").cast("double")
    one = F.lit(1.0)
    s = bins.groupBy(*g).agg(F.count("*").alias("lf_n_fit_bins"), *[F.sum(e).alias(c) for c, e in (("ux", x), ("uy", y), ("uxx", x * x), ("uxy", x * y), ("uyy", y * y), ("u", one))], F.sum("n").alias("lf_n_fit_sources"), F.first("area").alias("area"), F.sum(w).alias("s"), F.sum(w * x).alias("sx"), F.sum(w * y).alias("sy"), F.sum(w * x * x).alias("sxx"), F.sum(w * x * y).alias("sxy"))
    det = F.col("s") * F.col("sxx") - F.col("sx") * F.col("sx")
    slope = F.when((F.col("lf_n_fit_bins") >= least_bins) & (det > 0), (F.col("s") * F.col("sxy") - F.col("sx") * F.col("sy")) / det)
    fitted = F.coalesce(slope.between(*LF_GAMMA_RANGE), F.lit(False))
    fixed = F.col("lf_n_fit_sources") * LF_GAMMA * F.log(F.lit(10.0)) / (F.col("area") * (1 - F.pow(F.lit(10.0), F.lit(-LF_GAMMA * LF_WIDTH))))
    height = (F.col("sy") - slope * F.col("sx")) / F.col("s")
    phi = F.when(fitted, F.pow(F.lit(10.0), height)).otherwise(fixed)
    a, b = height, slope
    squares = F.col("uyy") + a * a * F.col("u") + b * b * F.col("uxx") - 2 * a * F.col("uy") - 2 * b * F.col("uxy") + 2 * a * b * F.col("ux")
    rmse = F.when(fitted, F.sqrt(F.greatest(squares / F.col("u"), F.lit(0.0))))
    found = s.select(*g, "lf_n_fit_bins", "lf_n_fit_sources", F.when(fitted, slope).otherwise(F.lit(LF_GAMMA)).alias("lf_gamma"), phi.alias("lf_phi_mlim"), F.when(fitted, "local_histogram").otherwise("local_window_norm_fixed_gamma").alias("lf_fit_method"), rmse.alias("lf_fit_rmse"))
    out = areas.select(*g).join(found, g, "left")
    none = {"lf_n_fit_bins": F.lit(0), "lf_n_fit_sources": F.lit(0), "lf_gamma": F.lit(LF_GAMMA), "lf_fit_method": F.lit("fixed_gamma_no_local_norm")}
    return out.withColumns({c: F.coalesce(c, e) for c, e in none.items()})


def contaminant_power(phi: Column | str, f_lim: Column | str, gamma: Column | str) -> Column:
    """Power of sources fainter than the limit: phi f^2 / ((0.8 - gamma) ln 10); NULL from gamma = 0.8 on (AGG23)."""
    g = fin(gamma)
    return F.when(g < 0.8, fin(phi) * F.pow(fin(f_lim), 2) / ((0.8 - g) * F.log(F.lit(10.0))))


def region_contaminants(regions: DataFrame, whole: DataFrame, keys: list[str], area: float) -> DataFrame:
    """Contaminant power of each region, with what it inherits from the whole image, and notes (AGG23).

    regions: keys, ..., m_lim, lf_gamma, lf_phi_mlim, lf_fit_method, n_detected_sources; whole: keys, lf_phi_mlim, Pr of
    the image.  A region without a height takes the image's; one whose power is still missing takes the image's power.
    """
    ref = whole.select(*keys, fin_pos("lf_phi_mlim").alias("_phi"), fin("Pr").alias("_pr"))
    own, phi = fin_pos("lf_phi_mlim"), F.coalesce(fin_pos("lf_phi_mlim"), F.col("_phi"))
    borrowed = own.isNull() & F.col("_phi").isNotNull()
    local = contaminant_power(phi, flux_from_mag("m_lim", F.lit(area)), "lf_gamma")
    out = regions.join(ref, keys, "left").withColumns({"_borrowed": borrowed, "_local": local}).withColumns({"lf_phi_mlim": phi, "lf_fit_method": F.when(F.col("_borrowed"), F.concat("lf_fit_method", F.lit("+global_phi"))).otherwise(F.col("lf_fit_method"))})
    pr = F.coalesce("_local", "_pr")
    notes = F.array_compact(F.array(
        F.when(F.col("_borrowed"), F.lit("used global LF normalization")),
        F.when(F.col("_local").isNull() & F.col("_pr").isNotNull(), F.lit("used global Pr fallback")),
        F.when(pr.isNotNull() & (F.col("n_detected_sources") == 0), F.lit("no local detected sources; correction inherited from global reference")),
        F.when(pr < 0, F.lit("negative Pr clipped to NaN")),
    ))
    note = F.when(F.size(notes) == 0, F.lit("local combined contaminant LF")).otherwise(F.array_join(notes, "; "))
    return out.withColumns({"pr_note": note, "Pr": F.when(pr >= 0, pr)}).drop("_phi", "_pr", "_borrowed", "_local")


def robust_scatter(meas: DataFrame, g: list[str], value: str = "mbar") -> DataFrame:
    """Scatter across windows: 1.4826 MAD, else std, from three on; std of two, else half their range; with the method (AGG30)."""
    v = meas.where(fin(value).isNotNull())
    med = v.groupBy(*g).agg(F.median(value).alias("_m"), F.count("*").alias("n"), F.stddev_samp(value).alias("_sd"), ((F.max(value) - F.min(value)) / 2).alias("_half"))
    mad = v.join(med.select(*g, "_m"), g).groupBy(*g).agg((1.4826 * F.median(F.abs(F.col(value) - F.col("_m")))).alias("_mad"))
    use_mad, sd = (F.col("n") >= 3) & (F.col("_mad") > 0), F.col("_sd") > 0
    out = med.join(mad, g)
    return out.select(*g, "n", F.when(use_mad, F.col("_mad")).when((F.col("n") >= 2) & sd, F.col("_sd")).when(F.col("n") == 2, F.col("_half")).alias("scatter"), F.when(use_mad, "mad").when((F.col("n") >= 2) & sd, "std").when(F.col("n") == 2, "half_range").otherwise("none").alias("scatter_method"))


def measurement_sigma(scatter="scatter", fit="fit_sigma", proxy="resid_proxy") -> tuple[Column, Column]:
    """The larger of window scatter and fit error, else the residual proxy; and which (AGG31)."""
    s, f, p = fin(scatter), fin(fit), fin(proxy)
    label = F.when(s.isNull() & f.isNull(), F.when(p.isNull(), "none").otherwise("residual_proxy")).when(f.isNull() | (s >= f), "window_scatter").otherwise("fit_covariance")
    return F.coalesce(F.greatest(s, f), p), label


def combine_annuli(meas: DataFrame, keys: list[str], region: str = "region", value: str = "mbar", sigma: str = "sigma", inner: str = "inner", outer: str = "outer", pipeline: str | None = None) -> DataFrame:
    """Inverse-variance mean of the two annuli, formal sigma, half difference, adopted sigma (AGG32).

    The adopted sigma is the larger of formal sigma and half difference, or their quadrature with a pipeline sigma.  One
    annulus alone is taken as it is.
    """
    ok = fin(value).isNotNull() & (fin(sigma) > 0)
    wide = meas.where(ok).groupBy(*keys).pivot(region, [inner, outer]).agg(F.first(value).alias("m"), F.first(sigma).alias("s"))
    mi, si, mo, so = (F.col(f"{r}_{c}") for r in (inner, outer) for c in ("m", "s"))
    both, wi, wo = mi.isNotNull() & mo.isNotNull(), 1 / (si * si), 1 / (so * so)
    out = wide.withColumns({"mbar_weighted": F.when(both, (mi * wi + mo * wo) / (wi + wo)).otherwise(F.coalesce(mi, mo)), "sigma_weighted_formal": F.when(both, 1 / F.sqrt(wi + wo)).otherwise(F.coalesce(si, so)), "annulus_scatter": F.when(both, F.abs(mi - mo) / 2), "uses_two_annuli": both})
    larger = F.greatest("sigma_weighted_formal", "annulus_scatter")
    adopted = larger if pipeline is None else quadrature("sigma_weighted_formal", "annulus_scatter", pipeline)
    return out.withColumns({"sigma_adopted": adopted, "notes": F.when(both, "inner+outer weighted").when(mi.isNotNull(), "inner only").otherwise("outer only")})


def annulus_color(pairs: DataFrame, g: list[str], k: float = 3.0, iters: int = 5, least: int = 100) -> DataFrame:
    """Colour from the medians of pixels that survive clipping in both bands; MAD of pixel colours and SEM (AGG33)."""
    b = None
    for v in ("v150", "v090"):
        c = clip_bounds(pairs, g, v, k, iters).withColumnsRenamed({"lo": f"lo_{v}", "hi": f"hi_{v}"})
        b = c if b is None else b.join(c, g)
    v = pairs.join(b, g).where("v150 between lo_v150 and hi_v150 and v090 between lo_v090 and hi_v090 and v150 > 0 and v090 > 0").withColumn("c", -2.5 * F.log10(F.col("v090") / F.col("v150")))
    s = grouped(v, g, [F.count("*").alias("n_color")], {"_a": (F.col("v090"), 0.5), "_b": (F.col("v150"), 0.5), "_m": (F.col("c"), 0.5)})
    s = s.select(*g, "n_color", (-2.5 * F.log10(F.col("_a") / F.col("_b"))).alias("color"), "_m")
    mad = medians(v.join(s.select(*g, "_m"), g), g, {"_d": F.abs(F.col("c") - F.col("_m"))}).select(*g, (1.4826 * F.col("_d")).alias("color_mad"))
    enough = F.col("n_color") >= least
    return s.join(mad, g).select(*g, "n_color", F.when(enough, F.col("color")).alias("color"), F.when(enough, F.col("color_mad")).alias("color_mad"), F.when(enough, F.col("color_mad") / F.sqrt("n_color")).alias("color_sem"), F.when(enough, "").otherwise("too few pixels").alias("note"))


def coarse_color(pairs: DataFrame, g: list[str]) -> DataFrame:
    """Colour from the medians of all unmasked pixels, without clipping; NULL unless both are positive (AGG33)."""
    s = grouped(pairs, g, [F.count("*").alias("n_color")], {"_a": (F.col("v090"), 0.5), "_b": (F.col("v150"), 0.5)})
    return s.select(*g, "n_color", F.when((F.col("_a") > 0) & (F.col("_b") > 0), -2.5 * F.log10(F.when((F.col("_a") > 0) & (F.col("_b") > 0), F.col("_a") / F.col("_b")))).alias("color"))


def color_summary(colors: DataFrame, g: list[str], color: str = "color", sigma: str = "sigma") -> DataFrame:
    """Weighted and plain mean colour, std and half range (AGG34)."""
    w = 1 / F.pow(fin_pos(sigma), 2)
    return colors.groupBy(*g).agg((F.sum(w * F.col(color)) / F.sum(F.when(fin(color).isNotNull(), w))).alias("color_weighted"), F.avg(fin(color)).alias("color_mean"), F.stddev_samp(fin(color)).alias("color_std"), ((F.max(fin(color)) - F.min(fin(color))) / 2).alias("color_half_range"))


def psf_stats(stars: DataFrame, g: list[str]) -> DataFrame:
    """Shape statistics of stars: area of the half-maximum ellipse, roundness, share rounder than 0.8 (AGG50)."""
    ok = stars.where((fin_pos("fwhm_x").isNotNull()) & (fin_pos("fwhm_y").isNotNull()))
    area = F.pi() * F.col("fwhm_x") * F.col("fwhm_y") / 4
    r = F.least("fwhm_x", "fwhm_y") / F.greatest("fwhm_x", "fwhm_y")
    return ok.groupBy(*g).agg(F.count("*").alias("n_stars"), F.avg(area).alias("area_mean"), F.avg(r).alias("round_mean"), F.median(r).alias("round_median"), F.avg((r > 0.8).cast("double")).alias("share_round"))


def two_sigma_hist(df: DataFrame, g: list[str], value: str, bins: int = 20) -> DataFrame:
    """Histogram of the values within two standard deviations of the mean (AGG50)."""
    s = df.groupBy(*g).agg(F.avg(fin(value)).alias("_m"), F.stddev_samp(fin(value)).alias("_s"))
    lo = F.col("_m") - 2 * F.col("_s")
    b = F.least(F.floor((F.col(value) - lo) / (4 * F.col("_s") / bins)), F.lit(bins - 1)).cast("int")
    return df.join(s, g).where(F.abs(F.col(value) - F.col("_m")) <= 2 * F.col("_s")).groupBy(*g, b.alias("bin")).agg(F.count("*").alias("n"))


def branch_plan(pixels: DataFrame, g: list[str], mask: str = "masked") -> DataFrame:
    """Share of masked pixels of each branch (AGG52)."""
    return pixels.groupBy(*g).agg(F.avg(F.col(mask).cast("double")).alias("masked_fraction"))
