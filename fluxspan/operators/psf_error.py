"""Point-spread error by measuring a galaxy's residuals again with both PSF tables (AGG37)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import ab_zeropoint, fin, fin_pos
from ..plans.storage import written
from .fits import spectrum_fit
from .joins import interp_join
from .spectra import expected, frames, image_power
from .transforms import packed

#: The two PSF tables that are compared.
TABLES = ("DET_DIST", "DET_SAMP")


def rerun_psf_sigma(residuals: DataFrame, psfs: DataFrame, science: DataFrame, realisations: int = 4, seed: int = 1, edges: int = 80, least: int = 10, key: str = "galaxy") -> DataFrame:
    """key, mbar_detdist, mbar_detsamp and psf_rerun, their absolute difference, of galaxies that both tables could measure.

    residuals: key, region, y, x, value; psfs: key, psf_ext, dy, dx, value; science: key, region, Pr, Imean, sigma, kmin, kmax,
    pix_area.  The data's spectrum is made once for each annulus; one noise field goes through both tables, so its chance
    cancels in the difference.  Each pair of spectra is fitted in the window, magnitudes of annuli are averaged by the
    inverse variances of their sigmas; an annulus without a fit, or without a positive sigma, doesn't count.
    """
    px = residuals.where(fin("value").isNotNull()).select(F.concat_ws("#", F.col(key).cast("string"), "region").alias("image"), key, "region", "y", "x", F.col("value").cast("double").alias("value"))
    rows = written(packed(px, ["image", key, "region"]))
    images = frames(rows, ["image", key, "region"])
    rows, size = rows.drop(key, "region"), images.drop(key, "region")
    pk = written(image_power(rows, size, "image", edges, least))
    stamps = images.select("image", key).join(psfs.where(F.col("psf_ext").isin(*TABLES)), key).select("image", "psf_ext", "dy", "dx", "value")
    ek = written(expected(rows, size, stamps, realisations, seed, edges, least, "image", "psf_ext"))
    tables = images.select("image", key).join(psfs.select(key, "psf_ext").distinct(), key).select("image", "psf_ext")
    points = pk.join(tables, "image").select("image", "psf_ext", "k", F.col("power").alias("p"))
    points = interp_join(points, ek, ["image", "psf_ext"], "k", "k", "power").withColumnRenamed("interpolated", "e")
    setup = images.select("image", key, "region").join(science, [key, "region"])
    inside = points.join(setup.select("image", "kmin", "kmax"), "image").where("k between kmin and kmax")
    fits = spectrum_fit(inside, ["image", "psf_ext"], least=least)
    left = fin("P0") - fin("Pr")
    mag = F.when(left > 0, -2.5 * F.log10(F.when(left > 0, left) / fin_pos("Imean")) + ab_zeropoint(F.col("pix_area")))
    w = F.when(mag.isNotNull(), 1 / F.pow(fin_pos("sigma"), 2))
    each = fits.join(setup, "image").groupBy(key, "psf_ext").agg((F.sum(w * mag) / F.sum(w)).alias("mbar"))
    one = lambda e: F.max(F.when(F.col("psf_ext") == e, F.col("mbar")))
    both = each.groupBy(key).agg(one(TABLES[0]).alias("mbar_detdist"), one(TABLES[1]).alias("mbar_detsamp"))
    return both.where("mbar_detdist is not null and mbar_detsamp is not null").withColumn("psf_rerun", F.abs(F.col("mbar_detsamp") - F.col("mbar_detdist")))
