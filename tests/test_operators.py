"""Operators that no SQL expresses, against numpy or brute force on small tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fluxspan.operators import fits, pixels, spectra, stats, transforms, windows
from fluxspan.sources import heads, tables


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(4)
    rows = [("a", int(k), float(x), float(2 + 3 * (x - 0.4) + 0.3 * e), 0.1) for k, (x, e) in enumerate(zip(rng.random(14), rng.standard_normal(14)))]
    return rows, spark.createDataFrame(rows, "g string, k int, x double, y double, sigma double")


@pytest.mark.parametrize("degree", [0, 1, 2])
def test_fit_and_leave_one_out(points, degree):
    rows, df = points
    x, y = (np.array([r[i] for r in rows]) for i in (2, 3))
    fit = fits.weighted_poly_fit(df, ["g"], degree, pivot=0.4).first()
    want = np.polyfit(x - 0.4, y, degree)[::-1]
    assert np.allclose([fit[f"c{i}"] for i in range(degree + 1)], want)
    for r in fits.leave_one_out(df, ["g"], degree, pivot=0.4).collect():
        rest = np.arange(len(x)) != r.k
        c = np.polyfit(x[rest] - 0.4, y[rest], degree)
        assert np.isclose(r.loo_predicted, np.polyval(c, x[r.k] - 0.4))


def test_intrinsic_scatter(points):
    rows, df = points
    s = fits.intrinsic_scatter(df, ["g"], 1, pivot=0.4, rounds=7).first().sigma_int
    x, y = (np.array([r[i] for r in rows]) for i in (2, 3))
    c = np.polyfit(x, y, 1)
    assert abs(((y - np.polyval(c, x)) ** 2 / (0.01 + s * s)).sum() / (len(x) - 2) - 1) < 1e-4


def test_singular_fit_is_null(spark):
    df = spark.createDataFrame([("a", 1.0, 1.0, 0.1), ("a", 1.0, 2.0, 0.1), ("b", 1.0, float("nan"), 0.1)], "g string, x double, y double, sigma double")
    assert fits.weighted_poly_fit(df, ["g"], 1).where("c0 is not null").count() == 0


def test_sigma_clip(spark):
    rng = np.random.default_rng(2)
    v = np.concatenate((rng.standard_normal(200), [50.0, 9.0, -7.0, 4.0]))
    df = spark.createDataFrame([("a", float(a)) for a in v] + [("a", float("nan")), ("a", None), ("b", float("inf"))], "g string, value double")
    for _ in range(5):
        v = v[np.abs(v - np.median(v)) <= 3 * v.std()]
    got = stats.sigma_clip_stats(df, ["g"], "value").collect()
    assert len(got) == 1 and got[0].n == len(v)
    assert np.allclose([got[0]["mean"], got[0]["median"], got[0]["std"]], [v.mean(), np.median(v), v.std()])


def test_plateau_segments(spark):
    y = [1.0, 1.05, 1.1, 1.02, 1.08, 2.0, 2.05, 2.1, 2.02, 2.04, 2.08]
    df = spark.createDataFrame([("a", float(k), v) for k, v in enumerate(y)], "g string, x double, y double")
    got = {(r["first"], r["last"]) for r in windows.segments(df, ["g"], "x", "y", 3, 0.15).collect()}
    want = {(i + 1, j + 1) for i in range(len(y)) for j in range(i + 2, len(y)) if max(y[i : j + 1]) - min(y[i : j + 1]) <= 0.15}
    assert got == want


def test_labels_cross_tiles(spark):
    rng = np.random.default_rng(3)
    grid = (rng.random((24, 24)) < 0.35).astype(float)
    df = spark.createDataFrame([(1, y, x, float(grid[y, x])) for y in range(24) for x in range(24)], "image_id int, y int, x int, value double")
    got = {(r.y, r.x): r.label for r in pixels.detect_sources(df, 0.5, 1, tile=8).collect()}
    seen, want = set(), {}
    for start in zip(*np.nonzero(grid), strict=True):
        start = (int(start[0]), int(start[1]))
        if start in seen:
            continue
        todo, part = [start], set()
        while todo:
            p = todo.pop()
            if p in part:
                continue
            part.add(p)
            todo += [(p[0] + a, p[1] + b) for a in (-1, 0, 1) for b in (-1, 0, 1) if 0 <= p[0] + a < 24 and 0 <= p[1] + b < 24 and grid[p[0] + a, p[1] + b]]
        seen |= part
        want |= {p: min(y * (1 << 24) + x for y, x in part) for p in part}
    assert got == want


def test_periodogram(spark):
    rng = np.random.default_rng(5)
    image = rng.random((12, 80))
    df = spark.createDataFrame([(7, y, x, float(image[y, x])) for y in range(12) for x in range(80)], "image_id int, y int, x int, value double")
    want = np.abs(np.fft.fft2(image - image.mean())) ** 2 / image.size
    got = np.zeros_like(want)
    for r in spectra.periodogram(df).collect():
        got[r.ky, r.kx] = r.power
    assert np.allclose(got, want)


def test_tall_images_have_narrow_blocks(spark, monkeypatch):
    """A block of columns holds about BLOCK_VALUES values however tall the image is; the spectra stay the same."""
    rng = np.random.default_rng(6)
    image = rng.random((12, 9))
    df = spark.createDataFrame([(7, y, x, float(image[y, x])) for y in range(12) for x in range(9)], "image_id int, y int, x int, value double")
    psf = spark.createDataFrame([(7, 0, 0, 0.6), (7, 1, 0, 0.4)], "image_id int, dy int, dx int, value double")
    spectrum = lambda: [tuple(round(v, 9) for v in r) for r in spectra.expectation_spectrum(df, psf, 2, 3, 6, 1).orderBy("kbin").select("kbin", "power", "k").collect()]
    wide = spectrum()
    monkeypatch.setattr(transforms, "BLOCK_VALUES", 24)
    rows = spark.createDataFrame([("a", y, image[y].tobytes(), 12) for y in range(12)], "g string, y int, v binary, ny int").withColumn("width", transforms.block_width("ny"))
    assert {(r.block, r.x0, len(r.part)) for r in transforms.row_spectra(rows).collect()} == {(b, 2 * b, 16 * min(2, 9 - 2 * b)) for b in range(5)}
    want = np.abs(np.fft.fft2(image - image.mean())) ** 2 / image.size
    got = np.zeros_like(want)
    for r in spectra.periodogram(df).collect():
        got[r.ky, r.kx] = r.power
    assert np.allclose(got, want) and spectrum() == wide


def test_header_and_csv(spark, tmp_path):
    cards = ["SIMPLE  =                    T", "TARG_RA =      10.5 / degrees", "OBJECT  = 'NGC 1380'", "CRVAL1  = 1.0", "CRVAL2  = 2.0", "END"]
    (tmp_path / "a.fits").write_bytes("".join(c.ljust(80) for c in cards).encode().ljust(2880))
    (tmp_path / "b.fits").write_bytes(b"junk" * 800)
    got = tables.read_header_cards(spark, f"file://{tmp_path}/*.fits")
    assert {r.key: r.value for r in got.collect()}["OBJECT"] == "NGC 1380"
    assert tuple(tables.target_coord(got).select("ra", "dec", "source").first()) == (1.0, 2.0, "CRVAL1")
    # a file of hundreds of MB is read up to the END of its header
    with open(tmp_path / "big.fits", "wb") as f:
        f.write("".join(c.ljust(80) for c in [*["COMMENT = 'x'"] * 40, *cards]).encode().replace(b"COMMENT", b"SIMPLE ", 1).ljust(3 * 2880))
        f.truncate(400 << 20)
    rows = {r.path.rpartition("/")[2]: r for r in spark.read.format("image_heads").option("path", f"file://{tmp_path}/*.fits").load().collect()}
    assert (rows["big.fits"].length, rows["big.fits"].bytes_read) == (400 << 20, 2 * 2880) and rows["a.fits"].bytes_read == 2880 and rows["b.fits"].bytes_read == 2880
    assert tables.target_coord(tables.read_header_cards(spark, f"file://{tmp_path}/*.fits")).count() == 2
    assert tables.read_header_cards(spark, f"file://{tmp_path}/*.none").count() == 0
    # packed files are unpacked as far as their headers go
    packed = spark.createDataFrame([(f"p{k}.fits.gz", "".join(c.ljust(80) for c in cards).ljust(2880).encode()) for k in range(3)], "name string, head binary")
    heads.write_images(packed, f"file://{tmp_path}/packed", F.lit(200 * 2880))
    assert sum(p.stat().st_size for p in (tmp_path / "packed").glob("*.gz")) < 3 * 2880
    rows = spark.read.format("image_heads").option("path", f"file://{tmp_path}/packed/*.fits.gz").load().collect()
    assert [r.bytes_read for r in rows] == [2880] * 3
    assert {tuple(r)[1:] for r in tables.target_coord(tables.read_header_cards(spark, f"file://{tmp_path}/packed/*.fits.gz")).collect()} == {(1.0, 2.0, "CRVAL1")}
    (tmp_path / "m.csv").write_text("g,v\nx,1.5\ny,nan\nz,inf\n")
    assert [r.v for r in tables.read_csv_table(spark, f"file://{tmp_path}/m.csv", tables.T.StructType([tables.T.StructField("g", tables.T.StringType()), tables.T.StructField("v", tables.T.DoubleType())])).collect()] == [1.5, None, None]
    assert tables.read_csv_table(spark, f"file://{tmp_path}/none.csv", "g string, v double").count() == 0


def test_model_comparison_reads_its_input_once(spark, points):
    """A row without a value has no part in any column, and the input is worked out once for all models and rounds."""
    _, df = points
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    extra = df.limit(1).withColumns({"y": F.lit(None).cast("double"), "sigma": F.lit(0.001)})
    n = df.count() + 1
    got = fits.model_comparison(df.union(extra).coalesce(1).mapInArrow(counted, df.schema), ["g"], pivot=0.4).collect()
    assert seen.value == n
    want = {r.model: r for r in fits.model_comparison(df, ["g"], pivot=0.4).collect()}
    assert len(got) == 3
    for r in got:
        assert np.allclose([r.n, r.chi2, r.wrms_in, r.wrms_loo, r.rms_loo], [want[r.model][c] for c in ("n", "chi2", "wrms_in", "wrms_loo", "rms_loo")])


def test_model_comparison(points):
    """Every column against numpy, the leave-one-out weights with the intrinsic scatter of the whole sample."""
    rows, df = points
    x, y, sigma = (np.array([r[i] for r in rows]) for i in (2, 3, 4))
    n, got = len(x), {r.model: r for r in fits.model_comparison(df, ["g"], pivot=0.4).collect()}

    def fitted(keep, degree, si=0.0):
        w = 1 / np.sqrt(sigma[keep] ** 2 + si**2)
        design = np.vander(x[keep] - 0.4, degree + 1) * w[:, None]
        c, *_ = np.linalg.lstsq(design, y[keep] * w, rcond=None)
        return c, float((((y[keep] - np.polyval(c, x[keep] - 0.4)) * w) ** 2).sum()), np.linalg.inv(design.T @ design)

    def scatter(r, s):
        w = 1 / s**2
        return np.sqrt(np.average((r - np.average(r, weights=w)) ** 2, weights=w))

    every = np.ones(n, bool)
    for degree, name in enumerate(("constant", "linear", "quadratic")):
        c, chi2, _ = fitted(every, degree)
        k = degree + 1
        lo, hi = 0.0, 0.64
        for _ in range(60):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if fitted(every, degree, mid)[1] / (n - k) > 1 else (lo, mid)
        bracketed = fitted(every, degree, 0.64)[1] / (n - k) <= 1
        si = hi if bracketed else 0.0
        r = got[name]
        assert (r.sigma_int is None) if not bracketed else np.isclose(r.sigma_int, si, atol=1e-6)
        assert np.allclose([r.chi2, r.chi2_red, r.aic, r.bic], [chi2, chi2 / (n - k), chi2 + 2 * k, chi2 + k * np.log(n)])
        assert np.isclose(r.wrms_in, scatter(y - np.polyval(c, x - 0.4), sigma))
        res, sig = [], []
        for i in range(n):
            keep = np.arange(n) != i
            c, _, cov = fitted(keep, degree)
            v = np.vander([x[i] - 0.4], degree + 1)[0]
            res.append(y[i] - v @ c)
            sig.append(np.sqrt(sigma[i] ** 2 + v @ cov @ v + si**2))
        assert np.isclose(r.wrms_loo, scatter(np.array(res), np.array(sig)), rtol=1e-5)
        assert np.isclose(r.rms_loo, np.std(res, ddof=1))


def test_scatter_beyond_the_bracket_is_null(spark):
    df = spark.createDataFrame([("a", float(k), float(y), 0.1) for k, y in enumerate((0, 5, 1, 6, 0, 7))], "g string, x double, y double, sigma double")
    assert fits.intrinsic_scatter(df, ["g"], 1).first().sigma_int is None
    assert fits.intrinsic_scatter(df.withColumn("sigma", df.sigma * 100), ["g"], 1).first().sigma_int == 0


def stretches(y, least, widest):
    return [(i, j) for i in range(len(y)) for j in range(i + least - 1, len(y)) if max(y[i : j + 1]) - min(y[i : j + 1]) <= widest]


def test_plateau_choice(spark):
    """Score of all stretches by brute force; a group without a plateau falls back to the row nearest its median."""
    rng = np.random.default_rng(6)
    x, y = np.arange(14.0), np.round(np.where(np.arange(14) < 7, 1.0, 2.0) + 0.05 * rng.standard_normal(14), 4)
    rough = [0.0, 9.0, 3.0, 8.0, 1.0]
    df = spark.createDataFrame([("a", a, float(b)) for a, b in zip(x.tolist(), y, strict=True)] + [("b", float(k), v) for k, v in enumerate(rough)], "g string, x double, y double")
    got = {r.g: r for r in windows.find_plateau(df, ["g"], "x", "y", 3, 0.25).collect()}
    parts = stretches(y.tolist(), 3, 0.25)
    terms = []
    for i, j in parts:
        p, q = x[i : j + 1], y[i : j + 1]
        c = np.polyfit(p, q, 1)
        terms.append((abs(c[0]), np.sqrt(np.mean((q - np.polyval(c, p)) ** 2)), q.std() / np.sqrt(len(q)), len(q)))
    t = np.array(terms, float)
    mad = np.median(np.abs(t - np.median(t, 0)), 0)
    z = (t - np.median(t, 0)) / np.where(mad > 0, 1.4826 * mad, 1)
    best = int(np.argmin(z @ np.array([1, 1, 0.7, -0.5])))
    assert (got["a"]["first"] - 1, got["a"]["last"] - 1) == parts[best] and got["a"].how == "plateau"
    assert (got["b"].how, got["b"].n, got["b"].level) == ("most_robust", 1, 3.0)
    picked = windows.pick_window(df, windows.find_plateau(df, ["g"], "x", "y", 3, 0.25), ["g"], "y", {"x": 1e-4}, ("x",)).collect()
    i, j = parts[best]
    assert {r.g: r.x for r in picked} == {"a": x[np.argmin(np.abs(y - y[i : j + 1].mean()) + 1e-4 * x)], "b": 2.0}
    ring = {r.g: (r.x_first, r.x_last) for r in windows.ring_plateau(df, ["g"], "x", "y", 0.25, 3).collect()}
    i, j = min(parts, key=lambda p: (p[0] - p[1], p[0] + p[1]))
    assert ring == {"a": (x[i], x[j])}


def test_continued_nodes(spark):
    rng = np.random.default_rng(9)
    sma = np.arange(5.0, 155, 5)
    cols = {"x0": 100 + 0.5 * sma + rng.random(30), "y0": 80 + 0.003 * sma, "eps": 0.85 + 0.0002 * sma, "pa": 0.3 - 0.0001 * sma}
    intens, frac = np.exp(-sma / 30 + 0.1 * rng.random(30)), np.where(sma > 100, 150 - sma, np.nan) / 60
    rows = [("a", *map(float, r)) for r in zip(sma, intens, frac, *cols.values(), strict=True)]
    nodes = spark.createDataFrame(rows, "g string, sma double, intens double, real_data_frac double, x0 double, y0 double, eps double, pa double")
    for needed, radii in ((183.0, [160.0, 170.0, 180.0, 183.0]), (187.0, [160.0, 170.0, 180.0, 190.0]), (151.0, [151.0]), (150.2, [])):
        got = windows.extend_nodes(nodes, spark.createDataFrame([("a", needed)], "g string, r_needed double"), ["g"]).where("node_origin = 'synthetic'").orderBy("sma").collect()
        assert np.allclose([r.sma for r in got], radii)
        w = np.clip(np.nan_to_num(frac[-20:], nan=0.25), 0.05, 1)
        d = np.array(radii) - 150
        for c, limit in (("x0", 1e-2), ("y0", 1e-2), ("eps", 3e-4), ("pa", 3e-4)):
            slope = np.clip(np.polyfit(sma[-20:], cols[c][-20:], 1, w=w)[0], -limit, limit)
            want = cols[c][-1] + slope * 250 * (1 - np.exp(-d / 250))
            assert np.allclose([r[c] for r in got], np.clip(want, 0, 0.9) if c == "eps" else want)
        fall = min(np.polyfit(sma[-20:], np.log(intens[-20:]), 1, w=w)[0], 0)
        assert np.allclose([r.intens for r in got], intens[-1] * np.exp(fall * d))


def test_circular_smoothing(spark):
    rng = np.random.default_rng(7)
    v = rng.random(36)
    gone = [0, 5, 6, 7, 35]
    df = spark.createDataFrame([("a", k, None if k in gone else float(v[k])) for k in range(36)], "g string, bin int, value double")
    have = np.array([k for k in range(36) if k not in gone])
    full = np.interp(np.arange(36), np.concatenate((have - 36, have, have + 36)), np.tile(v[have], 3))
    kernel = np.hanning(11)[1:-1]
    want = sum(k * np.roll(full, o) for o, k in zip(range(-4, 5), kernel / kernel.sum(), strict=True))
    got = {r.bin: r.smoothed for r in windows.circular_smooth(df, ["g"], 36, width=9).collect()}
    assert np.allclose([got[k] for k in range(36)], want)


def test_model_or_smooth(spark):
    """Images with enough nodes are interpolated in radius, the others smoothed."""
    rng = np.random.default_rng(8)
    image = rng.random((9, 9))
    px = spark.createDataFrame([(g, y, x, float(image[y, x]), float(np.hypot(y - 4, x - 4))) for g in (1, 2) for y in range(9) for x in range(9)], "image_id int, y int, x int, value double, r_ell double")
    sma, intens = np.arange(0.0, 7.0), np.exp(-np.arange(7.0))
    nodes = spark.createDataFrame([(1, float(a), float(b)) for a, b in zip(sma, intens, strict=True)] + [(2, 1.0, 1.0)], "image_id int, sma double, intens double")
    got = {1: np.zeros((9, 9)), 2: np.zeros((9, 9))}
    for r in pixels.model_or_smooth(px, nodes, sigma=1.0).collect():
        got[r.image_id][r.y, r.x] = r.model
    yy, xx = np.mgrid[:9, :9] - 4
    assert np.allclose(got[1], np.interp(np.round(np.hypot(yy, xx), 2), sma, intens))
    k = np.exp(-0.5 * np.arange(-4, 5) ** 2)
    soft = lambda a: np.apply_along_axis(np.convolve, 0, np.apply_along_axis(np.convolve, 1, a, k, "same"), k, "same")
    assert np.allclose(got[2], soft(image) / soft(np.ones((9, 9))))


def test_partitioned_table_spreads_a_large_value(spark, tmp_path):
    df = spark.range(1000).selectExpr("id", "if(id < 900, 'hot', null) as k")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else so small a table is one task
    try:
        tables.write_table(df, f"file://{tmp_path}/t", ["k"], rows=100)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    back = spark.read.parquet(f"file://{tmp_path}/t")
    assert back.count() == 1000 and back.where("k = 'hot'").count() == 900
    assert 1 < len(list((tmp_path / "t" / "k=hot").glob("*.parquet"))) <= 9


def test_small_files_are_listed_and_read_by_tasks(spark, tmp_path):
    """One object in each file: folders and patterns, several folders, unreadable and hidden files."""
    rows = spark.range(300).select(F.concat("id", F.lit(".json")).alias("name"), F.expr("concat('{\\n \"id\": ', id, ', \"status\": \"', if(id % 3 = 0, 'failed', 'ok'), '\"}\\n')").alias("body"))
    heads.write_files(rows, f"file://{tmp_path}/many")
    folders = [p for p in (tmp_path / "many").iterdir()]
    assert len(folders) > 1 and sum(1 for f in folders for _ in f.glob("*.json")) == 300
    for name, text in (("half.json", '{"id": 1000, "sta'), ("empty.json", ""), ("wrong.json", '{"id": "x", "status": "ok"}'), ("_hidden.json", '{"id": 1001, "status": "ok"}')):
        (folders[0] / name).write_text(text)
    want = [k for k in range(300) if k % 3]
    read = lambda glob: sorted(r.id for r in tables.read_results(spark, glob, "id long, status string").collect())
    assert read(f"file://{tmp_path}/many/*/*.json") == read(f"{tmp_path}/many/*") == want
    one = folders[0].name
    assert read(f"{tmp_path}/many/{one}") == read(f"{tmp_path}/many/{one}/*.json") == sorted(int(p.stem) for p in folders[0].glob("[0-9]*.json") if int(p.stem) % 3)
    assert read(f"{tmp_path}/many/{one}/*.none") == read(f"{tmp_path}/none/*") == []
