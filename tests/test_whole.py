"""Queries on whole tables: against SQL where the smallest tables can't show a cut, or against numpy."""

import duckdb
import numpy as np
import pytest

from fluxspan.operators import psf_error, ranks, spectra, transforms
from fluxspan.plans import registry
from fluxspan.plans import views as v

LARGER = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("part", "customer", "orders", "lineitem", "embeddings"):
        con.execute(f"create view {t} as select * from '{LARGER}/{t}.parquet'")
    return con


def same(spark, duck, name):
    df = registry.queries()[name](spark, LARGER)
    rel = duck.execute(registry.oracle_sql()[name])
    names = [c[0] for c in rel.description]
    assert sorted(names) == sorted(df.columns)
    got, want = (sorted((tuple(0.0 if v == 0 else v for v in r) for r in rows), key=repr) for rows in (map(tuple, df.select(*names).collect()), rel.fetchall()))
    assert got == want
    return len(got)


def test_products(spark, duck):
    assert same(spark, duck, "flt2_products") == 1633


@pytest.mark.parametrize("name, table", [("jn14_external_whole", "orders"), ("jn11_psf_branches_whole", "(select distinct l_suppkey from lineitem)"), ("agg23_contaminant_power_whole", "lineitem")])
def test_all_rows(spark, duck, name, table):
    assert same(spark, duck, name) == duck.execute(f"select count(*) from {table}").fetchall()[0][0]


def test_boundary_is_null(spark, duck):
    null = registry.queries()["agg23_contaminant_power_whole"](spark, LARGER).where("pr is null").count()
    assert null == duck.execute("select count(*) from lineitem where l_discount >= 0.08").fetchall()[0][0]


@pytest.fixture(scope="module")
def images():
    rows = duckdb.sql("select label, embedding from '/root/testdata/sf0.001/embeddings.parquet' order by vec_id").fetchall()
    return {g: np.array([e for k, e in rows if k == g], float) for g in {k for k, _ in rows}}


def power_of(image):
    return np.abs(np.fft.fft2(image - image.mean())) ** 2 / image.size


def test_periodogram_of_all_pixels(spark, sf, images):
    got = {g: np.full(i.shape, np.nan) for g, i in images.items()}
    for r in registry.queries()["num1_periodogram_whole"](spark, sf).collect():
        got[r.image_id][r.ky, r.kx] = r.power
    for g, i in images.items():
        assert np.allclose(got[g], power_of(i), atol=1e-5)


def radial_medians(power, edges, least):
    ny, nx = power.shape
    k = np.hypot(np.fft.fftfreq(ny)[:, None], np.fft.fftfreq(nx)[None, :])
    at = np.where((k > 0) & (k < k.max()), np.floor(k / (k.max() / (edges - 1))), -1).astype(int)
    return {b: np.median(power[at == b]) for b in range(edges - 1) if (at == b).sum() >= least}


def seen_noise(name, r, window, stamp, seed):
    """Power of noise through a stamp {(dy, dx): value} and a window."""
    ny, nx = window.shape
    noise = np.vstack([transforms.normals(seed, name, r, y, nx) for y in range(ny)])
    plane = np.zeros((ny, nx))
    for (dy, dx), value in stamp.items():
        plane[dy % ny, dx % nx] += value
    sim = np.fft.ifft2(np.fft.fft2(noise) * np.fft.fft2(plane)).real
    sim = np.where(window, sim - sim[window].mean(), 0)
    return np.abs(np.fft.fft2(sim)) ** 2 / window.sum()


def test_expectation_of_all_pixels(spark, sf, images):
    got = {(int(r.image_id), r.kbin): (r.power, r.n_realisations) for r in registry.queries()["num2_expectation"](spark, sf).collect()}
    stamp = {(a, b): 0.2 if (a, b) == (0, 0) else 0.1 for a in (-1, 0, 1) for b in (-1, 0, 1)}
    bins = {}
    for g, i in images.items():
        for r in range(4):
            for b, p in radial_medians(seen_noise(str(g), r, np.ones(i.shape, bool), stamp, 1489), 12, 5).items():
                bins.setdefault((g, b), []).append(p)
    assert {g for g, _ in got} == set(images) and got.keys() == bins.keys()
    for key, each in bins.items():
        assert got[key][1] == len(each) and np.isclose(got[key][0], np.median(each), atol=2e-6)


def test_expectation_through_a_wide_stamp_and_a_window(spark):
    """A stamp of 41 x 41 on 30 x 150 pixels, which wraps around; a window with holes and an empty row; two stamps, one noise."""
    rng = np.random.default_rng(3)
    window = rng.random((30, 150)) < 0.7
    window[11] = False
    window[29, 149] = True
    stamps = {e: {(a, b): float(np.exp(-(a * a + b * b) / w)) for a in range(-20, 21) for b in range(-20, 21)} for e, w in (("one", 30.0), ("two", 90.0))}
    px = spark.createDataFrame([(4, int(y), int(x)) for y, x in zip(*np.nonzero(window), strict=True)], "image_id int, y int, x int")
    psf = spark.createDataFrame([(4, e, a, b, v) for e, s in stamps.items() for (a, b), v in s.items()], "image_id int, ext string, dy int, dx int, value double")
    got = {(r.ext, r.kbin): r.power for r in spectra.expectation_spectrum(px, psf, 3, 7, 20, 5, by="ext").collect()}
    want = {}
    for e, s in stamps.items():
        each = [radial_medians(seen_noise("4", r, window, s, 7), 20, 5) for r in range(3)]
        want |= {(e, b): np.median([m[b] for m in each]) for b in each[0]}
    assert got.keys() == want.keys() and all(np.isclose(got[k], want[k], rtol=1e-9) for k in want)


def test_psf_error_by_paired_spectra(spark):
    """|difference| of the magnitudes that two PSF tables give for one galaxy's annuli, with common noise, against numpy."""
    rng = np.random.default_rng(8)
    stamps = {"DET_DIST": {(a, b): 0.2 if (a, b) == (0, 0) else 0.1 for a in (-1, 0, 1) for b in (-1, 0, 1)}, "DET_SAMP": {(a, b): float(np.exp(-(a * a + b * b) / 3.0)) / 9 for a in range(-3, 4) for b in range(-3, 4)}}
    setup = {"inner": (0.3, 2.0, 0.05), "outer": (0.2, 1.5, 0.1)}
    residual, mags = {}, {e: [] for e in stamps}
    for region in setup:
        noise = rng.normal(0, 3, (40, 40))
        kernel = np.zeros((40, 40))
        for (a, b), value in stamps["DET_DIST"].items():
            kernel[a, b] = value
        residual[region] = np.fft.ifft2(np.fft.fft2(noise) * np.fft.fft2(kernel)).real + rng.normal(0, 0.1, (40, 40))
    px = spark.createDataFrame([("g", region, y, x, float(im[y, x])) for region, im in residual.items() for y in range(40) for x in range(40)], "galaxy string, region string, y int, x int, value double")
    psf = spark.createDataFrame([("g", e, a, b, v) for e, s in stamps.items() for (a, b), v in s.items()], "galaxy string, psf_ext string, dy int, dx int, value double")
    science = spark.createDataFrame([("g", region, pr, imean, sigma, 0.05, 0.6, 0.004) for region, (pr, imean, sigma) in setup.items()], "galaxy string, region string, Pr double, Imean double, sigma double, kmin double, kmax double, pix_area double")
    got = psf_error.rerun_psf_sigma(px, psf, science, realisations=3, seed=5, edges=30, least=5).first()
    for region, (pr, imean, _) in setup.items():
        p = radial_medians(power_of(residual[region]), 30, 5)
        top = np.hypot(0.5, 0.5)
        k_of = lambda b: (b + 0.5) * top / 29
        for e, s in stamps.items():
            each = [radial_medians(seen_noise(f"g#{region}", r, np.ones((40, 40), bool), s, 5), 30, 5) for r in range(3)]
            ke = np.array([k_of(b) for b in each[0]])
            ek = np.array([np.median([m[b] for m in each]) for b in each[0]])
            use = [b for b in p if 0.05 <= k_of(b) <= 0.6]
            p0 = np.polyfit(np.interp([k_of(b) for b in use], ke, ek), [p[b] for b in use], 1)[0]
            zero = -2.5 * np.log10(2.350443e-5 * 0.004 / 3631)
            mags[e].append(-2.5 * np.log10((p0 - pr) / imean) + zero)
    w = np.array([1 / s**2 for _, _, s in setup.values()])
    m = {e: float(np.average(v, weights=w)) for e, v in mags.items()}
    assert np.isclose(got.mbar_detdist, m["DET_DIST"], atol=1e-6) and np.isclose(got.mbar_detsamp, m["DET_SAMP"], atol=1e-6)
    assert np.isclose(got.psf_rerun, abs(m["DET_DIST"] - m["DET_SAMP"]), atol=1e-6) and got.psf_rerun > 0


def test_modes_of_spectra_are_no_rows(spark, monkeypatch):
    """Of 64 x 64 pixels and 24 x 24 seen through two stamps, no table that is stored has a row for each pixel or mode."""
    rng = np.random.default_rng(9)
    px = spark.createDataFrame([(g, region, y, x, float(rng.normal())) for g, n in (("g", 64), ("h", 24)) for region in ("inner", "outer") for y in range(n) for x in range(n) if (region, y % 5) != ("inner", 1)], "galaxy string, region string, y int, x int, value double")
    psf = spark.createDataFrame([(g, e, 0, dx, 0.5) for g in ("g", "h") for e, n in (("DET_DIST", 1), ("DET_SAMP", 2)) for dx in range(n)], "galaxy string, psf_ext string, dy int, dx int, value double")
    science = spark.createDataFrame([(g, region, -1e3, 1.0, 0.1, 0.05, 0.6, 0.004) for g in ("g", "h") for region in ("inner", "outer")], "galaxy string, region string, Pr double, Imean double, sigma double, kmin double, kmax double, pix_area double")
    stored = []
    for module in (psf_error, spectra, ranks):
        monkeypatch.setattr(module, "written", lambda df, w=module.written: (t := w(df), stored.append(t.count()))[0])
    psf_error.rerun_psf_sigma(px, psf, science, realisations=2, seed=3, edges=12, least=3).collect()
    assert max(stored) < 2 * 64 * 64


def test_power_of_images_with_gaps(spark):
    """Bins filled by blocks are those of the modes one by one, for odd and even sizes, missing rows and values that are NaN."""
    rng = np.random.default_rng(10)
    px = [(g, y, x, float("nan") if rng.random() < 0.1 else float(rng.normal())) for g, ny, nx in ((1, 30, 17), (2, 21, 12), (3, 1, 9), (4, 9, 1)) for y in range(ny) for x in range(nx) if g > 2 or (y != 4 and rng.random() < 0.9)]
    px = spark.createDataFrame([*px, (2, 24, 14, float("nan"))], "image_id int, y int, x int, value double")
    rows = spectra.packed(px, ["image_id"])
    got = {(r.image_id, r.kbin): r for r in spectra.image_power(rows, spectra.frames(rows, ["image_id"]), "image_id", 9, 2).collect()}
    want = {(r.image_id, r.kbin): r for r in spectra.radial_power(spectra.periodogram(px), ["image_id"], 9, 2).collect()}
    assert got.keys() == want.keys() and {g for g, _ in want} == {1, 2, 3, 4}
    for key, r in want.items():
        assert got[key].n == r.n and np.isclose(got[key].power, r.power, rtol=1e-9) and np.isclose(got[key].k, r.k, rtol=1e-12)
