"""Joins: assembly of result tables, fills, work lists, cone search, interpolation, tolerance and range joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import COLOR_PIVOT, fin, quadrature
from ..plans.storage import written
from ..sources.tables import null_if_blank


def assemble_paper(results: DataFrame, errors: DataFrame, targets: DataFrame, key: str = "galaxy") -> DataFrame:
    """Results with their errors, and targets where there are any (JN1).

    Adds the difference of annuli, a quality flag, and, where the columns exist, the weighted share of contaminants.
    """
    both = [c for c in errors.columns if c in results.columns and c != key]
    e = errors.withColumnsRenamed({c: f"{c}_err" for c in both})
    out = results.join(e, key).join(targets, key, "left")
    out = out.withColumns({"inner_outer_delta": F.col("mbar_inner") - F.col("mbar_outer"), "quality_flag": F.coalesce(null_if_blank("warnings"), F.lit("clean"))})
    shares = ["Pr_over_P0_inner", "Pr_over_P0_outer", "weight_inner", "weight_outer"]
    if not set(shares) <= set(out.columns):
        return out
    pi, po, wi, wo = (F.col(c) for c in shares)
    return out.withColumn("Pr_over_P0_weighted", (pi * wi + po * wo) / F.nullif(wi + wo, F.lit(0.0)))


def calibration_input(paper: DataFrame, lit: DataFrame, key: str = "galaxy") -> DataFrame:
    """Absolute magnitudes M = m - mu with quadrature errors; rows fit for the sample are labelled (JN2)."""
    out = paper.join(lit, key, "left").withColumns({"M_abs": F.col("mbar") - F.col("mu_lit"), "sigma_M_abs": quadrature("sigma_mbar", "sigma_mu_lit")})
    return out.withColumn("fit_sample", F.when(F.col("M_abs").isNull(), "none").when(F.col("quality_flag") == "clean", "clean").otherwise("flagged"))


def merge_known(targets: DataFrame, known: DataFrame, key: str, fill: list[str], override: list[str]) -> DataFrame:
    """Curated values fill null or empty fields; `override` fields are taken whenever curated (JN3)."""
    k = known.select(key, *[F.col(c).alias(f"_{c}") for c in [*fill, *override]])
    out = targets.join(k, key, "left")
    return out.withColumns({c: F.coalesce(null_if_blank(c), f"_{c}") for c in fill} | {c: F.coalesce(f"_{c}", c) for c in override}).select(*targets.columns)


def attach_availability(cands: DataFrame, cache: DataFrame, fresh: DataFrame, key: str, cols: list[str], rank: str = "file_rank") -> DataFrame:
    """Cached archive summaries, of the latest file, else freshly computed ones (JN4)."""
    last = Window.partitionBy(key).orderBy(F.desc(rank))
    c = cache.withColumn("_r", F.row_number().over(last)).where("_r = 1").select(key, F.struct(*cols).alias("_c"))
    f = fresh.select(key, F.struct(*cols).alias("_f"))
    out = cands.join(c, key, "left").join(f, key, "left").withColumn("_s", F.coalesce("_c", "_f"))
    return out.select(*cands.columns, "_s.*", F.when(F.col("_c").isNotNull(), "cache").when(F.col("_f").isNotNull(), "fresh").otherwise("none").alias("availability_source"))


def unprocessed(cands: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Candidates with both filters that aren't processed yet (JN5)."""
    return cands.where("has_f150w and has_f090w").join(done.select(key), key, "left_anti")


def cone_join(targets: DataFrame, obs: DataFrame, radius_deg: float) -> DataFrame:
    """Pairs of targets (ra, dec) and observations (ora, odec) within an angular radius (JN6).

    Declination bands as wide as the radius, cut into cells of right ascension: each target meets by equality the cells of
    three bands that its cone may touch, the distance decides.  A cone at declination d reaches asin(sin r / cos d) to either
    side, and all right ascensions if a pole lies in it.  Near the poles a band is one cell.
    """
    step = float(radius_deg)
    wide = step * (1 + 1e-9)  # a cone that ends on a border stays within three bands
    band = lambda dec: F.floor((dec + 90) / wide).cast("long")
    cells = lambda b: F.greatest(F.lit(1), F.floor(360 * F.cos(F.radians(F.least(F.lit(90.0), F.greatest(F.abs(b * wide - 90), F.abs((b + 1) * wide - 90))))) / wide)).cast("long")
    o = obs.withColumn("_b", band(F.col("odec"))).withColumn("_n", cells(F.col("_b"))).withColumn("_c", F.least(F.floor(F.pmod(F.col("ora"), F.lit(360.0)) / 360 * F.col("_n")).cast("long"), F.col("_n") - 1))
    t = targets.withColumn("_b", F.explode(F.array(*[band(F.col("dec")) + k for k in (-1, 0, 1)]))).withColumn("_n", cells(F.col("_b")))
    side = F.degrees(F.asin(F.least(F.lit(1.0), F.sin(F.radians(F.lit(min(wide, 90.0)))) / F.cos(F.radians("dec"))))) + 1e-9
    whole = F.abs("dec") + wide >= 90
    at = lambda ra: F.floor(ra / 360 * F.col("_n")).cast("long")
    ra0 = F.pmod(F.col("ra"), F.lit(360.0))
    first, last = at(ra0 - side), at(ra0 + side)
    first, last = F.when(whole, F.lit(0)).otherwise(first), F.when(whole, F.col("_n") - 1).otherwise(last)
    reached = F.sequence(first, F.least(last, first + F.col("_n") - 1))
    t = t.withColumn("_c", F.explode(reached)).withColumn("_c", F.pmod("_c", F.col("_n")))
    ra, dec, ora, odec = (F.radians(c) for c in ("ra", "dec", "ora", "odec"))
    h = F.pow(F.sin((odec - dec) / 2), 2) + F.cos(dec) * F.cos(odec) * F.pow(F.sin((ora - ra) / 2), 2)
    joined = t.join(o.drop("_n"), ["_b", "_c"]).withColumn("separation", F.degrees(2 * F.asin(F.sqrt(F.least(h, F.lit(1.0))))))
    return joined.where(F.col("separation") <= step).drop("_b", "_c", "_n")


def sources_in_regions(sources: DataFrame, segments: DataFrame, region_pixels: DataFrame, key: str = "image_id") -> DataFrame:
    """Sources of which any pixel lies in a region (JN7).  region_pixels: key, region, y, x.

    In images without any segment a source lies where its centroid does, rounded to a pixel.
    """
    touched = segments.join(region_pixels, [key, "y", "x"]).select(key, "region", "label").distinct()
    known = sources.join(touched, [key, "label"])
    bare = sources.join(segments.select(key).distinct(), key, "left_anti")
    if not {"xcentroid", "ycentroid"} <= set(sources.columns):
        return known
    at = bare.withColumns({"y": F.rint("ycentroid").cast("int"), "x": F.rint("xcentroid").cast("int")}).join(region_pixels, [key, "y", "x"]).drop("y", "x")
    return known.unionByName(at.select(*known.columns))


#: Rows of points and nodes together in a range of the ordering.
RANGE_ROWS = 2_000_000


def interp_join(points: DataFrame, nodes: DataFrame, g: list[str], x: str, nx: str, ny: str, outside: str = "null", rows: int = RANGE_ROWS) -> DataFrame:
    """Value at each x on the line between neighbouring nodes (JN8).

    outside: `null`, or `end` for the end nodes' values.  Points and nodes are ordered together by ranges of (group, x) with
    sampled splitters, so a large group covers many tasks.  Inside a range each point finds the nodes around it; what lies
    before a range's first node of its group, or after the last, takes those of the ranges beside it.
    """
    n = nodes.select(*g, F.col(nx).alias("_x"), F.col(ny).alias("_y"), F.lit(0).alias("_point"))
    names = [c for c in points.columns if c not in g]
    p = points.select(*g, F.col(x).alias("_x"), F.struct(*names).alias("_p"), F.lit(1).alias("_point"))
    all_rows = n.unionByName(p, allowMissingColumns=True)
    stored = written(all_rows.withColumn("_tie", F.monotonically_increasing_id()))
    parts = max(1, -(-stored.count() // rows))
    key = [*g, "_part"]
    if parts > 1:
        placed = stored.repartitionByRange(parts, *g, "_x", "_point", "_tie").withColumn("_part", F.spark_partition_id())
        placed = written(placed)
    else:
        placed = stored.withColumn("_part", F.lit(0))
    node = F.when(F.col("_point") == 0, F.struct("_x", "_y"))
    w = Window.partitionBy(*key).orderBy("_x", "_point")
    back = Window.partitionBy(*key).orderBy(F.desc("_x"), "_point")
    seen = placed.withColumn("_lo", F.last(node, ignorenulls=True).over(w)).withColumn("_hi", F.last(node, ignorenulls=True).over(back)).where("_point = 1")
    if parts > 1:
        # a row for each group and range; a group's rows meet in one task, as many as the ranges that it covers
        ends = placed.groupBy(*key).agg(F.min_by(F.struct("_x", "_y"), F.when(F.col("_point") == 0, F.col("_x"))).alias("_first"), F.max_by(F.struct("_x", "_y"), F.when(F.col("_point") == 0, F.col("_x"))).alias("_last"))
        before = Window.partitionBy(*g).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
        after = Window.partitionBy(*g).orderBy(F.desc("_part")).rowsBetween(Window.unboundedPreceding, -1)
        beside = written(ends.select(*key, F.last("_last", ignorenulls=True).over(before).alias("_before"), F.last("_first", ignorenulls=True).over(after).alias("_after")).where("_before is not null or _after is not null"))
        inner_rows = seen.where("_lo is not null and _hi is not null")
        open_rows = seen.where("_lo is null or _hi is null").alias("a").join(beside.alias("b"), reduce(lambda a, b: a & b, [F.col(f"a.`{c}`").eqNullSafe(F.col(f"b.`{c}`")) for c in key]), "left")
        filled = open_rows.select(*[f"a.`{c}`" for c in g], "a._x", "a._p", F.coalesce("a._lo", "b._before").alias("_lo"), F.coalesce("a._hi", "b._after").alias("_hi"))
        seen = inner_rows.select(*g, "_x", "_p", "_lo", "_hi").unionByName(filled)
    span = F.col("_hi._x") - F.col("_lo._x")
    inner = F.when(span == 0, F.col("_lo._y")).otherwise(F.col("_lo._y") + (F.col("_hi._y") - F.col("_lo._y")) * (F.col("_x") - F.col("_lo._x")) / F.nullif(span, F.lit(0.0)))
    value = F.coalesce(inner, "_lo._y", "_hi._y") if outside == "end" else inner
    return seen.select(*g, "_p.*", value.alias("interpolated"))


def near_join(a: DataFrame, b: DataFrame, on: list[str], keys: list[str], tol: float = 1e-9) -> DataFrame:
    """Rows equal in `on` whose floating keys differ by `tol` at most (JN9): buckets of the tolerance meet their neighbours."""
    width = max(tol * 16, 1e-12)
    k = keys[0]
    left = a.withColumn("_k", F.explode(F.array(*[F.floor(F.col(k) / width) + d for d in (-1, 0, 1)])))
    right = b.select(*on, *[F.col(c).alias(f"_{c}") for c in keys], *[c for c in b.columns if c not in {*on, *keys}]).withColumn("_k", F.floor(F.col(f"_{k}") / width))
    close = F.lit(True)
    for c in keys:
        close &= F.abs(F.col(c) - F.col(f"_{c}")) <= tol
    return left.join(right, [*on, "_k"]).where(close).drop("_k", *[f"_{c}" for c in keys])


def band_join(one: DataFrame, other: DataFrame, key: str = "galaxy") -> DataFrame:
    """Pixels valid in both bands and not masked (JN10): v150, v090."""
    a = one.where(fin("value").isNotNull() & ~F.coalesce("masked", F.lit(False))).select(key, "y", "x", F.col("value").alias("v150"))
    return a.join(other.where(fin("value").isNotNull()).select(key, "y", "x", F.col("value").alias("v090")), [key, "y", "x"])


def psf_branch_sigma(branches: DataFrame, key: str = "galaxy") -> DataFrame:
    """Largest difference from the reference branch among branches that change only the point-spread function (JN11).

    Reference: the first name with `detdist_ref`, else the first row of two annuli, else the first; of equal names the
    smallest magnitude.
    """
    order = Window.partitionBy(key).orderBy(F.when(F.col("branch").contains("detdist_ref"), 0).when(F.col("uses_two_annuli"), 1).otherwise(2), "branch", "mbar")
    ref = branches.withColumn("_r", F.row_number().over(order)).where("_r = 1").select(key, *[F.col(c).alias(f"ref_{c}") for c in ("branch", "resid_source", "model_source", "psf_ext", "opd_path", "mbar")])
    alt = branches.join(ref, key).where("branch != ref_branch and resid_source <=> ref_resid_source and model_source <=> ref_model_source and (not (psf_ext <=> ref_psf_ext) or not (opd_path <=> ref_opd_path))")
    diff = alt.groupBy(key).agg(F.max(F.abs(F.col("mbar") - F.col("ref_mbar"))).alias("sigma_psf"), F.count("*").alias("psf_branch_alt_count"))
    return ref.select(key, F.col("ref_branch").alias("psf_branch_ref")).join(diff, key, "left").withColumn("psf_branch_alt_count", F.coalesce("psf_branch_alt_count", F.lit(0)))


def delta_from_reference(summary: DataFrame, key: str = "galaxy", window: str = "kmin", value: str = "mbar", reference: float = 0.04, tol: float = 1e-9) -> DataFrame:
    """Difference of each window from the adopted one of its galaxy (JN12)."""
    ref = summary.where(F.abs(F.col(window) - reference) <= tol).groupBy(key).agg(F.first(value).alias("_ref"))
    return summary.join(ref, key, "left").withColumn("delta", F.col(value) - F.col("_ref")).drop("_ref")


def reconcile(todo: DataFrame, done: DataFrame, key: str = "data_uri", size: str = "size") -> DataFrame:
    """Manifest rows with their state: done, size_mismatch or failed (JN13)."""
    d = done.select(key, F.col(size).alias("_done"))
    state = F.when(F.col("_done").isNull(), "failed").when(F.col(size).isNull() | (F.col(size) == F.col("_done")), "done").otherwise("size_mismatch")
    return todo.join(d, key, "left").withColumn("state", state).drop("_done")


def compare_external(ours: DataFrame, ext: DataFrame, m0: float, slope: float, sigma_m0: float, sigma_slope: float, pivot: float = COLOR_PIVOT, key: str = "galaxy") -> DataFrame:
    """External magnitudes calibrated by M = m0 + slope (C - pivot), with propagated errors, against our moduli (JN14)."""
    dc = F.col("ext_color") - pivot
    mu = F.col("ext_mag") - (m0 + slope * dc)
    out = ours.join(ext, key).withColumns({"mu_ext": mu, "sigma_mu_ext": F.sqrt(F.pow("ext_mag_sigma", 2) + F.pow(slope * F.col("ext_color_sigma"), 2) + sigma_m0**2 + F.pow(sigma_slope * dc, 2))})
    return out.withColumns({"delta_mu": F.col("mu") - F.col("mu_ext"), "sigma_delta": quadrature("sigma_mu", "sigma_mu_ext"), "distance_ratio": F.pow(F.lit(10.0), (F.col("mu") - F.col("mu_ext")) / 5)})
