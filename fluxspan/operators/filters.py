"""Projections, filters and predicates on observations, products and pixels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import fin


def is_public_mosaic(rights="dataRights", level="calib_level", url="dataURL") -> Column:
    """Public, calibrated to level 3 or higher, a combined image (FLT1)."""
    return (F.upper(F.trim(rights)) == "PUBLIC") & (F.coalesce(F.col(level).cast("string").try_cast("int"), F.lit(-1)) >= 3) & F.coalesce(F.col(url).contains("_i2d"), F.lit(False))


def has_filter(wanted: str, filters="filters") -> Column:
    return F.array_contains(F.split(F.upper(F.col(filters)), "[;,/ ]+"), wanted)


def filter_products(prods: DataFrame, level: int, filters: list[str], name: str = "file_name", columns: tuple[str, str] = ("filters", "obs_id"), science: str = "product_type") -> DataFrame:
    """Science products of a level whose filter is named in either column; candidate (c-numbered) associations go (FLT2)."""
    suffix = {1: "_uncal.fits", 2: "_cal.fits", 3: "_i2d.fits"}[level]
    named = F.exists(F.array(*[F.lower(F.lit(f)) for f in filters]), lambda f: F.contains(F.lower(F.coalesce(F.col(columns[0]), F.lit(""))), f) | F.contains(F.lower(F.coalesce(F.col(columns[1]), F.lit(""))), f))
    return prods.where(F.lower(name).endswith(suffix) & ~F.lower(name).rlike(r"^jw\d{5}-c\d{4}_") & (F.upper(science) == "SCIENCE") & named)


#: What the destination is made of, by scheme.
SCHEMES = {"detector": ["proposal", "object_tag", "detector"], "proposal": ["proposal", "detector"], "object": ["target", "detector"]}


def classify_products(prods: DataFrame, name: str = "file_name", scheme: str = "detector", targets: DataFrame | None = None) -> DataFrame:
    """Detector bucket, proposal and object tags, target, destination path by scheme (FLT3).

    targets: object_tag, target - a small map; objects that it lacks keep their tag.
    """
    low = F.lower(name)
    bucket = F.when(low.contains("nrcalong"), "nrcalong").when(low.contains("nrcblong"), "nrcblong").when(low.rlike(r"nrca[0-9]?"), "nrca").when(low.rlike(r"nrcb[0-9]?"), "nrcb").otherwise("unknown")
    out = prods.withColumns({"detector": bucket, "proposal": F.regexp_extract(low, r"^jw(\d{5})", 1), "object_tag": F.regexp_extract(low, r"^jw\d{5}-(o\d{3})", 1)})
    out = out.withColumn("target", F.col("object_tag")) if targets is None else out.join(targets.select("object_tag", "target"), "object_tag", "left").withColumn("target", F.coalesce("target", "object_tag"))
    empty = {"proposal": "other", "object_tag": "none", "target": "none", "detector": "unknown"}
    return out.withColumn("destination", F.concat_ws("/", *[F.when(F.col(c) != "", F.col(c)).otherwise(empty[c]) for c in SCHEMES[scheme]], name))


def filter_key(filter_col="FILTER", pupil_col="PUPIL") -> Column:
    """The pupil's filter where the pupil holds one, else the filter (FLT4)."""
    pupil = F.nullif(F.upper(F.trim(pupil_col)), F.lit(""))
    return F.coalesce(F.when(pupil.rlike(r"^F\d{3}[WMN]$"), pupil), F.nullif(F.upper(F.trim(filter_col)), F.lit("")), F.lit("UNKNOWN"))


def with_valid(pixels: DataFrame, value: str = "value", weight: str | None = "wht") -> DataFrame:
    """valid: a finite value and, where there are weights, a finite positive one (FLT5)."""
    ok = fin(value).isNotNull()
    if weight and weight in pixels.columns:
        ok &= F.coalesce(fin(weight) > 0, F.lit(False))
    return pixels.withColumn("valid", ok)


#: Pixels on a side of the tiles that cover regions.
COVER_TILE = 32


def tile_cover(pixels: DataFrame, regions: DataFrame, span: tuple[Column, Column], least: Column, most: Column, r_in: Column, r_out: Column, key: str, tile: int = COVER_TILE) -> DataFrame:
    """Tiles that regions touch: the regions' columns, ty, tx, and _whole, where every pixel of the tile lies inside.

    span: half the height and width of a region; least, most: bounds of the radius over the tile whose corners are _x0, _x1,
    _y0, _y1.  Tiles outside, inside the inner border, or beyond the image have no row.
    """
    size = pixels.groupBy(key).agg(F.min("y").alias("_ya"), F.max("y").alias("_yb"), F.min("x").alias("_xa"), F.max("x").alias("_xb"))
    boxes = regions.join(size, key)
    for c, half in zip("yx", span, strict=True):
        boxes = boxes.withColumn(f"_{c}l", F.floor(F.greatest(F.col(f"{c}0") - half, F.col(f"_{c}a")) / tile)).withColumn(f"_{c}h", F.floor(F.least(F.col(f"{c}0") + half, F.col(f"_{c}b")) / tile))
    boxes = boxes.where("_yl <= _yh and _xl <= _xh")
    tiles = boxes.withColumn("ty", F.explode(F.sequence("_yl", "_yh"))).withColumn("tx", F.explode(F.sequence("_xl", "_xh")))
    tiles = tiles.withColumns({"_y0": F.col("ty") * tile - F.col("y0"), "_x0": F.col("tx") * tile - F.col("x0")}).withColumns({"_y1": F.col("_y0") + tile - 1, "_x1": F.col("_x0") + tile - 1})
    tiles = tiles.withColumns({"_least": least, "_most": most}).where((F.col("_least") <= r_out * (1 + 1e-9)) & (F.col("_most") >= r_in * (1 - 1e-9)))
    tiles = tiles.withColumn("_whole", (F.col("_least") >= r_in * (1 + 1e-9)) & (F.col("_most") <= r_out * (1 - 1e-9)))
    return tiles.select(*[f"`{c}`" for c in regions.columns], "ty", "tx", "_whole")


def _tiled(pixels: DataFrame, tile: int = COVER_TILE) -> DataFrame:
    return pixels.withColumns({"ty": F.floor(F.col("y") / tile), "tx": F.floor(F.col("x") / tile)})


def in_circle(pixels: DataFrame, regions: DataFrame, key: str = "image_id") -> DataFrame:
    """Pixels inside circular annuli with closed bounds; radii in arcsec by the pixel area (FLT6).

    regions: key, region, x0, y0, r_in, r_out (arcsec), pix_area (arcsec2).  Regions are covered with tiles: a pixel meets
    only those whose border or inside its tile touches, and those that hold the whole tile need no test.
    """
    scale = F.sqrt("pix_area")
    r_in, r_out = F.greatest(F.col("r_in"), F.lit(0.0)) / scale, F.col("r_out") / scale
    gap = lambda c: F.greatest(F.col(f"_{c}0"), -F.col(f"_{c}1"), F.lit(0.0))
    far = lambda c: F.greatest(F.abs(f"_{c}0"), F.abs(f"_{c}1"))
    cover = tile_cover(pixels, regions, (r_out, r_out), F.sqrt(gap("x") * gap("x") + gap("y") * gap("y")), F.sqrt(far("x") * far("x") + far("y") * far("y")), r_in, r_out, key)
    d2 = F.pow(F.col("x") - F.col("x0"), 2) + F.pow(F.col("y") - F.col("y0"), 2)
    inside = d2.between(F.pow(F.col("r_in") / scale, 2), F.pow(F.col("r_out") / scale, 2))
    return _tiled(pixels).join(cover, [key, "ty", "tx"]).where(F.col("_whole") | inside).drop("ty", "tx", "_whole")


def with_r_ell(pixels: DataFrame, geom: DataFrame, key: str = "image_id") -> DataFrame:
    """Elliptical radius: offsets turned by pa, the minor axis divided by q, which is 1e-3 at least (FLT7)."""
    dx, dy = F.col("x") - F.col("x0"), F.col("y") - F.col("y0")
    u = dx * F.cos("pa") + dy * F.sin("pa")
    v = dy * F.cos("pa") - dx * F.sin("pa")
    return pixels.join(geom, key).withColumn("r_ell", F.sqrt(u * u + F.pow(v / F.greatest(F.col("q"), F.lit(1e-3)), 2)))


def in_ellipse(pixels: DataFrame, geom: DataFrame, key: str = "image_id") -> DataFrame:
    """Pixels inside elliptical annuli with closed bounds, and their elliptical radius (FLT7), by a cover of tiles.

    geom: key, x0, y0, pa, q, r_in, r_out.  The radius is convex: over a tile it is largest at a corner, and differs from that
    at the tile's centre by half the diagonal over the smaller axis ratio at most.
    """
    q = F.greatest(F.col("q"), F.lit(1e-3))

    def radius(x: Column, y: Column) -> Column:
        u, v = x * F.cos("pa") + y * F.sin("pa"), y * F.cos("pa") - x * F.sin("pa")
        return F.sqrt(u * u + F.pow(v / q, 2))

    half = lambda along, across: F.col("r_out") * F.sqrt(along * along + F.pow(q * across, 2))
    mid = radius((F.col("_x0") + F.col("_x1")) / 2, (F.col("_y0") + F.col("_y1")) / 2)
    slack = F.sqrt(F.pow(F.col("_x1") - F.col("_x0"), 2) + F.pow(F.col("_y1") - F.col("_y0"), 2)) / 2 / F.least(q, F.lit(1.0))
    most = F.greatest(*[radius(F.col(x), F.col(y)) for x in ("_x0", "_x1") for y in ("_y0", "_y1")])
    cover = tile_cover(pixels, geom, (half(F.sin("pa"), F.cos("pa")), half(F.cos("pa"), F.sin("pa"))), mid - slack, most, F.col("r_in"), F.col("r_out"), key)
    r_ell = radius(F.col("x") - F.col("x0"), F.col("y") - F.col("y0"))
    joined = _tiled(pixels).join(cover, [key, "ty", "tx"]).withColumn("r_ell", r_ell)
    return joined.where(F.col("_whole") | F.col("r_ell").between(F.col("r_in"), F.col("r_out"))).drop("ty", "tx", "_whole")


def usable(pixels: DataFrame, keys: list[str], masked: str = "masked", residual: str = "residual", model: str = "model") -> tuple[DataFrame, DataFrame]:
    """Usable pixels, and the counts of region and usable pixels with their share (FLT8)."""
    ok = F.coalesce(~F.col(masked) & fin(residual).isNotNull() & (fin(model) > 0), F.lit(False))
    counts = pixels.groupBy(*keys).agg(F.count("*").alias("region_pixels"), F.count_if(ok).alias("usable_pixels"), (F.count_if(ok) / F.count("*")).alias("usable_fraction"))
    return pixels.where(ok), counts


def crop_finite(pixels: DataFrame, pad: int, key: str = "image_id", value: str = "value") -> DataFrame:
    """Pixels in the bounding box of finite values, widened by `pad`, in coordinates of the box (FLT9)."""
    box = pixels.where(fin(value).isNotNull()).groupBy(key).agg(*[f(c).alias(f"{n}{c}") for c in ("x", "y") for f, n in ((F.min, "lo_"), (F.max, "hi_"))])
    size = pixels.groupBy(key).agg(F.min("x").alias("min_x"), F.min("y").alias("min_y"))
    out = pixels.join(box, key).join(size, key)
    for c in ("x", "y"):
        out = out.where(F.col(c).between(F.col(f"lo_{c}") - pad, F.col(f"hi_{c}") + pad))
    shift = {c: F.col(c) - F.greatest(F.col(f"lo_{c}") - pad, F.col(f"min_{c}")) for c in ("x", "y")}
    return out.withColumns(shift).select(*pixels.columns)


def cutout(pixels: DataFrame, centers: DataFrame, half: int, key: str = "image_id") -> DataFrame:
    """Square of 2 * half + 1 pixels about a centre, clamped to the frame; coordinates begin at 0 (FLT10)."""
    frame = pixels.groupBy(key).agg(F.max("x").alias("max_x"), F.max("y").alias("max_y"))
    at = centers.join(frame, key)
    for c in ("x", "y"):
        at = at.withColumns({f"lo_{c}": F.greatest(F.lit(0), F.round(F.col(f"c{c}")).cast("int") - half), f"hi_{c}": F.least(F.col(f"max_{c}"), F.round(F.col(f"c{c}")).cast("int") + half)})
    out = pixels.join(at.select(key, "lo_x", "hi_x", "lo_y", "hi_y"), key).where("x between lo_x and hi_x and y between lo_y and hi_y")
    return out.withColumns({"x": F.expr("x - lo_x"), "y": F.expr("y - lo_y")}).select(*pixels.columns)


def downsample(pixels: DataFrame, n: int) -> DataFrame:
    """Every n-th row and column (FLT11); a plain predicate, so it reaches the scan."""
    return pixels.where((F.pmod("y", F.lit(n)) == 0) & (F.pmod("x", F.lit(n)) == 0)).withColumns({"x": F.expr(f"cast(x / {n} as int)"), "y": F.expr(f"cast(y / {n} as int)")})


def nth_sample(pixels: DataFrame, n: int, key: str = "image_id", value: str = "value") -> DataFrame:
    """Every n-th valid pixel in row order (FLT11).

    Row counts and a running sum over rows number the pixels, so no window spans a whole image's pixels.
    """
    ok = pixels.where(fin(value).isNotNull())
    rows = ok.groupBy(key, "y").agg(F.count("*").alias("c")).withColumn("before", F.sum("c").over(Window.partitionBy(key).orderBy("y")) - F.col("c"))
    rank = F.row_number().over(Window.partitionBy(key, "y").orderBy("x")) - 1
    return ok.withColumn("r", rank).join(rows, [key, "y"]).where((F.col("before") + F.col("r")) % n == 0).select(*pixels.columns)


def mad_quality_cut(windows: DataFrame, g: list[str], cols: list[str], scale: float = 1.5, least: int = 5) -> DataFrame:
    """Rows whose columns are all at most median + scale * MAD; a group with fewer than `least` such rows keeps all (FLT13)."""
    med = windows.groupBy(*g).agg(*[F.median(c).alias(f"med_{c}") for c in cols])
    with_med = windows.join(med, g)
    mad = with_med.groupBy(*g).agg(*[F.median(F.abs(F.col(c) - F.col(f"med_{c}"))).alias(f"mad_{c}") for c in cols])
    ok = F.lit(True)
    for c in cols:
        ok &= F.coalesce(F.col(c) <= F.col(f"med_{c}") + scale * F.col(f"mad_{c}"), F.lit(False))
    marked = with_med.join(mad, g).withColumn("ok", ok)
    alive = marked.groupBy(*g).agg(F.count_if("ok").alias("alive"))
    return marked.join(alive, g).where(F.col("ok") | (F.col("alive") < least)).select(*windows.columns)


def check_region(pixels: DataFrame, g: list[str], value: str = "value", least: int = 5000, widest: float = 0.2, flattest: float = 1e-7) -> DataFrame:
    """Number, range and scatter of each region; whether it passes, and warnings (FLT14)."""
    s = pixels.groupBy(*g).agg(F.count(fin(value)).alias("n"), (F.max(fin(value)) - F.min(fin(value))).alias("value_range"), F.stddev_pop(fin(value)).alias("std"))
    return s.withColumns({"passed": F.col("n") >= least, "warn_range": F.coalesce(F.col("value_range") > widest, F.lit(False)), "warn_flat": F.coalesce(F.col("std") < flattest, F.lit(False))})


def splice_models(fitted="fitted", full="extrapolated") -> Column:
    """The fitted model where it is supported, else the extrapolated one (FLT15)."""
    return F.coalesce(F.when(fin(fitted) > 0, F.col(fitted)), F.col(full))
