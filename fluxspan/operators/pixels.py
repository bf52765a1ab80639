"""Neighbourhood jobs on pixel tables: smoothing, labelling, masks, model rendering, ring unrolling, PSF tables."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import fin
from ..plans.storage import written
from .graph import components
from .joins import interp_join


def gaussian(sigma: float, truncate: float = 4.0) -> list[tuple[int, float]]:
    r = int(truncate * sigma + 0.5)
    w = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-r, r + 1)]
    return [(k, v / sum(w)) for k, v in zip(range(-r, r + 1), w, strict=True)]


#: Pixels on a side of the tiles that are smoothed at once, or four kernel radii if that is more.
SMOOTH_TILE = 256


def smooth(pixels: DataFrame, sigma: float, key: str = "image_id", truncate: float = 4.0) -> DataFrame:
    """Gaussian smoothing that leaves missing pixels out and divides by the weights met (NUM3).

    A tile takes its pixels and those within a kernel's radius of it, so a pixel goes to one tile, near a border to two or
    four; in the tile rows and then columns are convolved.  Pixels outside the frame count as missing.
    """
    weights = np.array([w for _, w in gaussian(sigma, truncate)])
    r = len(weights) // 2
    size = max(SMOOTH_TILE, 4 * r)

    def convolve(tile: pd.DataFrame) -> pd.DataFrame:
        y0, x0 = int(tile["ty"].iloc[0]) * size, int(tile["tx"].iloc[0]) * size
        y, x, v = tile["y"].to_numpy() - y0 + r, tile["x"].to_numpy() - x0 + r, tile["_v"].to_numpy()
        planes = np.zeros((2, size + 2 * r, size + 2 * r))
        planes[0, y, x], planes[1, y, x] = np.nan_to_num(v), ~np.isnan(v)
        for axis in (1, 2):
            n = planes.shape[axis] - 2 * r
            planes = sum(w * np.take(planes, range(k, k + n), axis) for k, w in enumerate(weights))
        own = (y >= r) & (y < size + r) & (x >= r) & (x < size + r)
        total, met = (p[y[own] - r, x[own] - r] for p in planes)
        out = tile.loc[own, ["g", "y", "x"]]
        return out.assign(smoothed=np.where(met > 1e-12, total / np.where(met > 1e-12, met, 1), np.nan))

    tiles = lambda c: F.explode(F.sequence(F.floor((F.col(c) - r) / size).cast("int"), F.floor((F.col(c) + r) / size).cast("int")))
    rows = pixels.select(F.col(key).cast("string").alias("g"), F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), F.coalesce(fin("value"), F.lit(float("nan"))).alias("_v"))
    dealt = rows.withColumn("ty", tiles("y")).withColumn("tx", tiles("x"))
    soft = dealt.groupBy("g", "ty", "tx").applyInPandas(convolve, "g string, y int, x int, smoothed double").select("g", F.col("y").alias("_sy"), F.col("x").alias("_sx"), fin("smoothed").alias("smoothed"))
    same = (F.col(key).cast("string").eqNullSafe(F.col("g"))) & (F.col("y") == F.col("_sy")) & (F.col("x") == F.col("_sx"))
    return pixels.join(soft, same, "left").drop("g", "_sy", "_sx")


def _label_tile(tile: pd.DataFrame) -> pd.DataFrame:
    """8-connected labels inside one tile: the smallest pixel number of each component, by repeated minima."""
    y, x = tile["y"].to_numpy(), tile["x"].to_numpy()
    y0, x0 = y.min(), x.min()
    grid = np.full((y.max() - y0 + 3, x.max() - x0 + 3), np.iinfo(np.int64).max, np.int64)
    at = (y - y0 + 1, x - x0 + 1)
    grid[at] = tile["pix"].to_numpy()
    on = grid != np.iinfo(np.int64).max
    while True:
        best = grid.copy()
        for dy in (-1, 0, 1):
            for dx in (-1, 0, 1):
                np.minimum(best, np.roll(grid, (dy, dx), (0, 1)), out=best)
        best[~on] = np.iinfo(np.int64).max
        if (best == grid).all():
            break
        grid = best
    return tile.assign(label=grid[at])


def detect_sources(pixels: DataFrame, threshold: float, npix: int = 1, tile: int = 256, key: str = "image_id") -> DataFrame:
    """Pixels above the threshold with 8-connected labels of at least `npix` pixels (NUM4).

    Tiles are labelled on their own; labels that touch across tile borders are joined by contraction.
    A label is the number of the component's first pixel, y * 2^24 + x.
    """
    on = pixels.where(fin("value") > threshold).select(key, F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x")).withColumns({"pix": F.expr("y * 16777216 + x"), "ty": F.floor(F.col("y") / tile), "tx": F.floor(F.col("x") / tile)})
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in on.schema) + ", label long"
    local = written(on.groupBy(key, "ty", "tx").applyInPandas(_label_tile, schema))
    edge = local.where((F.pmod("y", F.lit(tile)).isin(0, tile - 1)) | (F.pmod("x", F.lit(tile)).isin(0, tile - 1)))
    near = edge.select(key, F.col("label").alias("a"), F.explode(F.array(*[F.struct((F.col("y") + dy).alias("y"), (F.col("x") + dx).alias("x")) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if dy or dx])).alias("p"))
    links = near.select(key, "a", "p.y", "p.x").join(edge.select(key, "y", "x", F.col("label").alias("b")), [key, "y", "x"]).where("a != b").select(key, "a", "b").distinct()
    roots, _ = components(links, [key])
    out = local.join(roots.withColumnRenamed("node", "label"), [key, "label"], "left").select(key, "y", "x", F.coalesce("root", "label").alias("label"))
    big = out.groupBy(key, "label").agg(F.count("*").alias("n")).where(F.col("n") >= npix).select(key, "label")
    return out.join(big, [key, "label"])


def compact_mask(segments: DataFrame, largest: int = 625, key: str = "image_id") -> DataFrame:
    """Pixels of labels with at most `largest` pixels (NUM5)."""
    small = segments.groupBy(key, "label").agg(F.count("*").alias("n")).where(F.col("n") <= largest).select(key, "label")
    return segments.join(small, [key, "label"], "left_semi")


def drop_big_labels(segments: DataFrame, frames: DataFrame, share: float = 0.005, key: str = "image_id") -> DataFrame:
    """Pixels of labels that cover at most `share` of their frame (NUM5).  frames: key, n_pix."""
    big = segments.groupBy(key, "label").agg(F.count("*").alias("n")).join(frames, key).where(F.col("n") > share * F.col("n_pix"))
    return segments.join(big.select(key, "label"), [key, "label"], "left_anti")


def dilate(mask: DataFrame, support: DataFrame, n: int = 1, shape: str = "cross", key: str = "image_id") -> DataFrame:
    """Mask grown n times by a cross, or once by a square of 2n+1, inside the support (NUM6)."""
    if shape == "cross":
        offsets = [(dy, dx) for dy in range(-n, n + 1) for dx in range(-n, n + 1) if abs(dy) + abs(dx) <= n]
    else:
        offsets = [(dy, dx) for dy in range(-n, n + 1) for dx in range(-n, n + 1)]
    spread = F.explode(F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in offsets]))
    grown = mask.select(key, "y", "x", spread.alias("o")).select(key, (F.col("y") + F.col("o.dy")).alias("y"), (F.col("x") + F.col("o.dx")).alias("x")).distinct()
    return grown.join(support.select(key, "y", "x"), [key, "y", "x"], "left_semi")


def render_model(pixels: DataFrame, nodes: DataFrame, key: str = "image_id", r: str = "r_ell") -> DataFrame:
    """Model brightness of each pixel from the profile at its elliptical radius, residual, and the filled image (NUM7).

    Radii are rounded to hundredths of a pixel first: the profile is interpolated once for each, not once for each pixel.
    """
    q = pixels.withColumn("_rq", F.round(F.col(r), 2))
    radii = interp_join(q.select(key, "_rq").distinct(), nodes, [key], "_rq", "sma", "intens", "end").withColumnRenamed("interpolated", "model")
    out = q.join(radii, [key, "_rq"]).drop("_rq")
    return out.withColumns({"residual": F.col("value") - F.col("model"), "filled": F.coalesce(fin("value"), "model")})


def model_or_smooth(pixels: DataFrame, nodes: DataFrame, least: int = 5, sigma: float = 10.0, key: str = "image_id", r: str = "r_ell") -> DataFrame:
    """`render_model` for images with enough nodes, the smoothed image itself for the others (NUM7)."""
    rich = nodes.where(fin("intens").isNotNull()).groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") >= least).select(key)
    good = render_model(pixels.join(rich, key, "left_semi"), nodes, key, r)
    poor = pixels.join(rich, key, "left_anti")
    soft = smooth(poor, sigma, key=key).select(key, "y", "x", F.col("smoothed").alias("model"))
    rest = poor.join(soft, [key, "y", "x"], "left").withColumns({"residual": F.col("value") - F.col("model"), "filled": F.coalesce(fin("value"), "model")})
    return good.unionByName(rest.select(*good.columns))


def unroll_ring(pixels: DataFrame, geom: DataFrame, r_in: float, r_out: float, subs: int = 6, angles: int = 360, key: str = "image_id", least: int = 10) -> DataFrame:
    """Mean and number of pixels in each cell of sub-annulus and angle, empty cells included (NUM8)."""
    dx, dy = F.col("x") - F.col("x0"), F.col("y") - F.col("y0")
    r = F.sqrt(dx * dx + dy * dy)
    turn = F.pmod(F.atan2(dy, dx) / (2 * math.pi), F.lit(1.0))
    v = pixels.join(geom, key).where(fin("value").isNotNull()).withColumn("_r", r).where((F.col("_r") >= r_in) & (F.col("_r") < r_out))
    cells = v.groupBy(key, F.floor((F.col("_r") - r_in) / ((r_out - r_in) / subs)).cast("int").alias("sub"), F.least(F.floor(turn * angles), F.lit(angles - 1)).cast("int").alias("angle")).agg(F.avg("value").alias("mean"), F.count("*").alias("n"))
    enough = cells.groupBy(key).agg(F.sum("n").alias("_n")).where(F.col("_n") >= least).select(key)
    grid = enough.withColumn("sub", F.explode(F.sequence(F.lit(0), F.lit(subs - 1)))).withColumn("angle", F.explode(F.sequence(F.lit(0), F.lit(angles - 1))))
    return grid.join(cells, [key, "sub", "angle"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def normalise_psf(psf: DataFrame, key: str = "image_id") -> DataFrame:
    """Planes summed, missing as 0, unit sum; images whose sum isn't positive go (NUM9)."""
    flat = psf.groupBy(key, "y", "x").agg(F.sum(F.coalesce(fin("value"), F.lit(0.0))).alias("value"))
    total = F.sum("value").over(Window.partitionBy(key))
    return flat.withColumn("_t", total).where("_t > 0").withColumn("value", F.col("value") / F.col("_t")).drop("_t")


def pad_psf(psf: DataFrame, images: DataFrame, key: str = "image_id") -> DataFrame:
    """PSF moved to the centre of the image's grid; what falls outside is cut (NUM9).  images: key, ny, nx."""
    size = psf.groupBy(key).agg((F.max("y") + 1).alias("_py"), (F.max("x") + 1).alias("_px"))
    out = psf.join(size, key).join(images.select(key, "ny", "nx"), key)
    out = out.withColumns({"y": F.expr("y + cast(floor(ny / 2) - floor(_py / 2) as int)"), "x": F.expr("x + cast(floor(nx / 2) - floor(_px / 2) as int)")})
    return out.where("y between 0 and ny - 1 and x between 0 and nx - 1").select(key, "y", "x", "value")
