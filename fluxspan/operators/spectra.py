"""Power spectra: row-column Fourier transform, radial binning, expectation spectra, low-k diagnostics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import fin
from ..plans.storage import written
from .fits import spectrum_fit
from .joins import interp_join
from .ranks import grouped, packed_medians
from .transforms import block_width, convolved, half_spectra, noise_spectra, packed, power, radial_values, row_spectra, stamp_bytes


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for nx, ps in zip(b.column("nx").to_pylist(), b.column("m").to_pylist(), strict=True):
            row = np.zeros(nx)
            row[[p["x"] for p in ps]] = [p["v"] for p in ps]
            out.append(row.tobytes())
        yield pa.RecordBatch.from_arrays([b.column("g"), b.column("y"), b.column("width"), pa.array(out, pa.binary())], ["g", "y", "width", "v"])


def periodogram(pixels: DataFrame, key: str = "image_id") -> DataFrame:
    """|FFT|^2 / n of the mean-subtracted image, missing pixels 0: key, ky, kx, fy, fx, power (NUM1).

    Rows are transformed one by one, blocks of their columns meet for the second transform: no task holds an image.
    """
    s = pixels.groupBy(key).agg(F.avg(fin("value")).alias("_m"), F.count(fin("value")).alias("_n"), (F.max("x") + 1).cast("int").alias("nx"), (F.max("y") + 1).cast("int").alias("ny"))
    v = pixels.join(s, key).select(key, "y", "x", "nx", F.coalesce(fin("value") - F.col("_m"), F.lit(0.0)).alias("v"))
    rows = v.groupBy(key, "y", "nx").agg(F.collect_list(F.struct("x", "v")).alias("m"))
    every = s.select(key, "nx", block_width("ny").alias("width"), F.explode(F.expr("sequence(0, ny - 1)")).alias("y"))
    rows = every.join(rows.drop("nx"), [key, "y"], "left").select(F.col(key).cast("string").alias("g"), F.col("y").cast("int").alias("y"), "nx", "width", F.coalesce("m", F.array()).alias("m"))
    rows = rows.mapInArrow(_packed, "g string, y int, width int, v binary")
    back = s.select(F.col(key), F.col(key).cast("string").alias("g"), "_n", "nx", "ny")
    return power(row_spectra(rows)).join(back, "g").select(key, "ky", "kx", _frequency("ky", "ny").alias("fy"), _frequency("kx", "nx").alias("fx"), (F.col("power") / F.col("_n")).alias("power"))


def _frequency(k: str, n: str) -> Column:
    return F.when(2 * F.col(k) < F.col(n), F.col(k)).otherwise(F.col(k) - F.col(n)) / F.col(n)


def radial_power(power: DataFrame, g: list[str], edges: int = 80, least: int = 10, top: float | None = None) -> DataFrame:
    """Median power in edges - 1 half-open bins of |k| up to the largest, k > 0, at least `least` values (AGG24)."""
    k = F.sqrt(F.col("fx") * F.col("fx") + F.col("fy") * F.col("fy"))
    p = power.withColumn("k", k)
    p = p.withColumn("_top", F.lit(top)) if top else p.join(p.groupBy(*g).agg(F.max("k").alias("_top")), g)
    width = F.col("_top") / (edges - 1)
    b = p.where("k > 0 and k < _top").withColumn("kbin", F.floor(F.col("k") / width).cast("int"))
    out = grouped(b, [*g, "kbin"], [F.count("*").alias("n"), F.first("_top").alias("_top")], {"power": (F.col("power"), 0.5)})
    return out.where(F.col("n") >= least).withColumn("k", (F.col("kbin") + 0.5) * F.col("_top") / (edges - 1)).drop("_top")


def trapezoid(spectrum: DataFrame, g: list[str], k: str = "k", p: str = "power") -> DataFrame:
    """Integral of each spectrum by trapezoids (AGG24)."""
    w = Window.partitionBy(*g).orderBy(k)
    return spectrum.withColumn("_a", (F.col(k) - F.lag(k).over(w)) * (F.col(p) + F.lag(p).over(w)) / 2).groupBy(*g).agg(F.sum("_a").alias("integral"))


def parseval_power(pixels: DataFrame, g: str, edges: int = 80, least: int = 11) -> DataFrame:
    """Radial power scaled so that the mean of the whole plane is the variance of the pixels (AGG24, older variant)."""
    power = periodogram(pixels, g)
    direct = pixels.groupBy(g).agg(F.var_pop(fin("value")).alias("_var"))
    scale = power.groupBy(g).agg(F.avg("power").alias("_mean")).join(direct, g).select(g, (F.col("_var") / F.nullif(F.col("_mean"), F.lit(0.0))).alias("_scale"))
    out = radial_power(power, [g], edges, least).join(scale, g)
    return out.withColumn("power", F.col("power") * F.col("_scale")).drop("_scale")


def unit_area(spectrum: DataFrame, g: list[str], k: str = "k", p: str = "power") -> DataFrame:
    """Spectra divided by their integral (AGG24, older variant of E(k)); those without a positive integral go."""
    return spectrum.join(trapezoid(spectrum, g, k, p).where("integral > 0"), g).withColumn(p, F.col(p) / F.col("integral")).drop("integral")


def expectation_median(spectra: DataFrame, g: list[str]) -> DataFrame:
    """Median over realisations of each bin: power, k and the number of realisations (AGG25)."""
    return spectra.groupBy(*g, "kbin").agg(F.median("power").alias("power"), F.median("k").alias("k"), F.count("*").alias("n_realisations"))


def frames(rows: DataFrame, names: list[str]) -> DataFrame:
    """names, g, nx, ny, n, mean, width: the images of `packed` rows, stored."""
    size = rows.groupBy(*names).agg((F.max("last") + 1).alias("nx"), (F.max("y") + 1).alias("ny"), F.sum("n").alias("n"), (F.sum("total") / F.sum("n")).alias("mean"))
    return written(size.select(F.col(names[0]).cast("string").alias("g"), *names, "nx", "ny", "n", "mean", block_width("ny").alias("width")))


def image_power(rows: DataFrame, size: DataFrame, key: str, edges: int = 80, least: int = 10) -> DataFrame:
    """`radial_power` of the `periodogram` of images, from their stored `packed` rows and `frames`: key, kbin, n, power, k.

    Bins take the powers of a block as they are made, in one row for each block and bin: no mode is a row of its own.
    """
    parts = half_spectra(rows.where("n > 0").join(size.drop("n"), key))
    return _binned(parts, size, [key], edges, least)


def radial_periodogram(pixels: DataFrame, key: str = "image_id", edges: int = 80, least: int = 10) -> DataFrame:
    """`image_power` of images that come as pixels."""
    rows = written(packed(pixels, [key]))
    return image_power(rows, frames(rows, [key]), key, edges, least)


def _binned(parts: DataFrame, size: DataFrame, names: list[str], edges: int, least: int) -> DataFrame:
    top = F.sqrt(F.pow(F.floor(F.col("nx") / 2) / F.col("nx"), 2) + F.pow(F.floor(F.col("ny") / 2) / F.col("ny"), 2))
    bins = packed_medians(radial_values(parts, edges), ["g", "kbin"]).where(F.col("n") >= least)
    out = bins.join(size.select("g", *names, "nx", "ny", F.col("n").alias("_n")), "g")
    return out.select(*names, "kbin", "n", (F.col("power") / F.col("_n")).alias("power"), ((F.col("kbin") + 0.5) * top / (edges - 1)).alias("k"))


def expectation_spectrum(window: DataFrame, psf: DataFrame, realisations: int, seed: int, edges: int = 80, least: int = 10, key: str = "image_id", by: str | None = None) -> DataFrame:
    """Median over realisations of the radial power of noise seen through the PSF and the window (NUM2, AGG25).

    window: key, y, x of the pixels that count; psf: key, dy, dx, value - a stamp that fits a task, around its centre - and
    `by`, if an image has several: they see the same noise, and each has a spectrum.  Noise and PSF are multiplied as
    transforms, so a realisation moves a few times its pixels, however wide the stamp is.  The mean inside the window goes.
    """
    rows = written(packed(window.withColumn("value", F.lit(0.0)), [key]))
    return expected(rows, frames(rows, [key]), psf, realisations, seed, edges, least, key, by)


def expected(rows: DataFrame, size: DataFrame, psf: DataFrame, realisations: int, seed: int, edges: int, least: int, key: str, by: str | None) -> DataFrame:
    """`expectation_spectrum` in the window of stored `packed` rows, which have these `frames`.

    An image's noise is transformed once, for all its stamps; only rows with a pixel in the window come back.
    """
    names = [key, *([by] if by else [])]
    flat = psf.groupBy(*names).agg(F.array_sort(F.collect_list(F.struct("dy", "dx", F.coalesce(fin("value"), F.lit(0.0)).alias("v")))).alias("s"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            stamps = [stamp_bytes([p["dy"] for p in s], [p["dx"] for p in s], [p["v"] for p in s]) for s in b.column("s").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), pa.array(stamps, pa.binary())], [*names, "stamp"])

    types = dict(flat.dtypes)
    stamps = flat.mapInArrow(pack, ", ".join(f"{n} {types[n]}" for n in names) + ", stamp binary")
    stamps = stamps.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*names[1:], "stamp"))).alias("stamps"))
    run = F.explode(F.sequence(F.lit(0), F.lit(realisations - 1))).alias("r")
    each = written(size.drop("mean").withColumnRenamed("g", "name").join(stamps, key).select("*", run).withColumn("g", F.concat_ws("#", "name", F.col("r").cast("string"))))
    every = each.select("g", key, "name", "r", "nx", "width", "stamps.stamp", F.explode(F.expr("sequence(0, ny - 1)")).alias("y"))
    noise = every.join(rows.where("n > 0").select(key, "y", "mask"), [key, "y"], "left")
    noise = noise.select("g", "name", "r", "y", "nx", "width", "mask", F.when(F.col("y") == 0, F.col("stamp")).alias("stamps"))
    seen = written(convolved(noise_spectra(noise.repartition("g", "y"), seed)))
    mean = seen.groupBy("g", "s").agg((F.sum("total") / F.sum("n")).alias("mean"))
    one = each.select("g", *[c for c in ("name", "r", "nx", "ny", "n", "width", key) if c != "g"], F.posexplode("stamps").alias("s", "_s"))
    one = one.join(mean, ["g", "s"]).withColumn("gs", F.concat_ws("#", "g", F.col("s").cast("string")))
    one = written(one.select("g", "s", "gs", key, *[f"_s.{c}" for c in names[1:]], "r", "nx", "ny", "n", "mean", "width"))
    full = seen.join(one.select("g", "s", "gs", "mean", "nx", "ny", "width"), ["g", "s"]).drop("g").withColumnRenamed("gs", "g")
    binned = _binned(half_spectra(full), one.drop("g").withColumnRenamed("gs", "g"), [*names, "r"], edges, least)
    return expectation_median(binned, names)


def window_fits(pk: DataFrame, ek: DataFrame, g: list[str], windows: list[tuple[float, float]], least: int = 10) -> DataFrame:
    """`spectrum_fit` of P(k) against E(k), interpolated to its k, in each k window (AGG26)."""
    e = interp_join(pk.select(*g, "k", F.col("power").alias("p")), ek, g, "k", "k", "power").withColumnRenamed("interpolated", "e")
    wins = F.explode(F.array(*[F.struct(F.lit(a).alias("kmin"), F.lit(b).alias("kmax")) for a, b in windows]))
    points = e.withColumn("_w", wins).select(*g, "k", "p", "e", "_w.*").where("k between kmin and kmax")
    return spectrum_fit(points, [*g, "kmin", "kmax"], least=least)


def k_diagnostic(pk: DataFrame, ek: DataFrame, fits: DataFrame, g: list[str]) -> DataFrame:
    """Mean and median of P minus fit below each window's kmin (AGG29)."""
    e = interp_join(pk.select(*g, "k", F.col("power").alias("p")), ek, g, "k", "k", "power").withColumnRenamed("interpolated", "e")
    d = F.col("p") - (F.col("P0") * F.col("e") + F.col("P1"))
    low = e.join(fits, g).where("k < kmin and P0 is not null and e is not null").withColumn("d", d)
    return low.groupBy(*g, "kmin", "kmax").agg(F.count("*").alias("n_low_bins"), F.avg("d").alias("low_mean_delta"), F.median("d").alias("low_median_delta"))


def low_k_table(pk: DataFrame, ek: DataFrame, fits: DataFrame, g: list[str], bins: int = 15) -> DataFrame:
    """The first bins of each spectrum with every window's fit and the difference from it (AGG29).

    Also P - P1 beside P0 E, which agree where the model holds.
    """
    e = interp_join(pk.select(*g, "k", F.col("power").alias("p")), ek, g, "k", "k", "power").withColumnRenamed("interpolated", "e")
    first = e.withColumn("bin", F.row_number().over(Window.partitionBy(*g).orderBy("k"))).where(F.col("bin") <= bins)
    rows = first.join(fits.where("P0 is not null").select(*g, "kmin", "kmax", "P0", "P1"), g)
    scaled = F.col("P0") * F.col("e")
    return rows.select(*g, "kmin", "kmax", "bin", "k", "p", "e", (scaled + F.col("P1")).alias("fit"), (F.col("p") - scaled - F.col("P1")).alias("delta"), (F.col("p") - F.col("P1")).alias("p_less_p1"), scaled.alias("p0_e"))
