"""Operators whose work must spread over tasks: labels across many tiles, interpolation across ranges."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fluxspan.operators import filters, graph, joins, pixels, windows


def test_snake_across_tiles(spark):
    """One component winds through all 64 tiles; rounds grow with the logarithm of the tiles that it crosses."""
    n, on = 64, []
    for y in range(0, n, 2):
        on += [(y, x) for x in range(n)] + ([(y + 1, n - 1 if y % 4 == 0 else 0)] if y + 2 < n else [])
    df = spark.createDataFrame([(1, y, x, 1.0) for y, x in on] + [(2, 0, 0, 1.0), (2, 5, 5, 1.0)], "image_id int, y int, x int, value double")
    got = pixels.detect_sources(df, 0.5, 1, tile=8).collect()
    assert len(got) == len(on) + 2
    assert {r.label for r in got if r.image_id == 1} == {0} and len({r.label for r in got if r.image_id == 2}) == 2


def test_contraction_rounds(spark, tmp_path):
    rng = random.Random(1)
    names = rng.sample(range(10**6), 700)
    chain = [("c", a, b) for a, b in zip(names, names[1:], strict=False)]
    ordered = [("o", k, k + 1) for k in range(700)]
    star = [("s", 7, k) for k in range(10, 300)]
    links = spark.createDataFrame(chain + ordered + star, "g string, a long, b long")
    roots, rounds = graph.components(links, ["g"])
    got = {(r.g, r.node): r.root for r in roots.collect()}
    assert rounds < 10
    assert {v for (g, _), v in got.items() if g == "c"} == {min(names)} and len([1 for g, _ in got if g == "c"]) == 700
    assert {v for (g, _), v in got.items() if g == "o"} == {0} and {v for (g, _), v in got.items() if g == "s"} == {7}


@pytest.mark.parametrize("outside", ["null", "end"])
@pytest.mark.parametrize("rows", [10**6, 60])
def test_interpolation_across_ranges(spark, outside, rows):
    """rows=60: a group covers several ranges, some of them without a node."""
    rng = np.random.default_rng(rows)
    nodes, points = [], []
    for g, k, m in (("a", 40, 300), ("b", 3, 200), (None, 5, 50), ("alone", 0, 20), ("bare", 4, 0)):
        xs = np.sort(rng.choice(200, k, replace=False) / 10.0)
        nodes += [(g, float(x), float(rng.normal())) for x in xs]
        points += [(g, j, float(x)) for j, x in enumerate(np.concatenate((rng.uniform(-3, 25, m - min(m, k)), xs[: min(m, k)])))]
    n = spark.createDataFrame(nodes, "g string, nx double, ny double")
    p = spark.createDataFrame(points, "g string, j int, x double")
    got = {(r.g, r.j): r.interpolated for r in joins.interp_join(p, n, ["g"], "x", "nx", "ny", outside, rows=rows).collect()}
    assert len(got) == len(points)
    for g, j, x in points:
        own = [(a, b) for k, a, b in nodes if k == g]
        edge = {} if outside == "end" else {"left": np.nan, "right": np.nan}
        want = np.interp(x, *zip(*own, strict=True), **edge) if own else np.nan
        assert got[g, j] is None if np.isnan(want) else np.isclose(got[g, j], want), (g, j, x)


def test_interpolation_plan_spreads_one_group(spark):
    p = spark.range(40_000).select(F.lit(1).alias("g"), (F.col("id") / 100).alias("x"))
    n = spark.range(0, 40_000, 7).select(F.lit(1).alias("g"), (F.col("id") / 100).alias("nx"), F.col("id").cast("double").alias("ny"))
    whole = {"spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in whole}
    try:
        for k, v in whole.items():
            spark.conf.set(k, v)
        out = joins.interp_join(p, n, ["g"], "x", "nx", "ny", rows=5_000)
        spread = [r["count"] for r in out.withColumn("task", F.spark_partition_id()).groupBy("task").count().collect()]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(spread) >= 5 and max(spread) < 20_000
    wrong = out.where(F.abs(F.col("interpolated") - F.col("x") * 100) > 1e-6).count()
    assert wrong == 0 and out.count() == 40_000


def test_a_thousand_regions_on_one_image(spark):
    """Joined rows stay near the hits: regions meet the pixels of their tiles only, not the whole image."""
    rng, n = np.random.default_rng(6), 200
    px = spark.range(n * n).select(F.lit(1).alias("image_id"), (F.col("id") / n).cast("int").alias("y"), (F.col("id") % n).cast("int").alias("x"), F.lit(1.0).alias("value")).repartition(4)
    circles = [(1, k, float(rng.uniform(-10, 210)), float(rng.uniform(-10, 210)), float(rng.choice([0.0, 3.0, 20.0])), float(rng.uniform(3, 40)), 0.25) for k in range(1000)] + [(1, 1000, 100.0, 100.0, 0.0, 1e9, 1.0), (2, 0, 1.0, 1.0, 0.0, 5.0, 1.0)]
    regions = spark.createDataFrame(circles, "image_id int, region int, x0 double, y0 double, r_in double, r_out double, pix_area double")
    yy, xx = np.mgrid[:n, :n]
    want = {k: int((((xx - x0) ** 2 + (yy - y0) ** 2 >= (a / s**0.5) ** 2) & ((xx - x0) ** 2 + (yy - y0) ** 2 <= (b / s**0.5) ** 2)).sum()) for i, k, x0, y0, a, b, s in circles if i == 1}
    got = {r.region: r["count"] for r in filters.in_circle(px, regions).groupBy("region").count().collect()}
    assert got == {k: c for k, c in want.items() if c}
    scale = F.sqrt("pix_area")
    gap = lambda c: F.greatest(F.col(f"_{c}0"), -F.col(f"_{c}1"), F.lit(0.0))
    far = lambda c: F.greatest(F.abs(f"_{c}0"), F.abs(f"_{c}1"))
    cover = filters.tile_cover(px, regions, (F.col("r_out") / scale, F.col("r_out") / scale), F.hypot(gap("x"), gap("y")), F.hypot(far("x"), far("y")), F.col("r_in") / scale, F.col("r_out") / scale, "image_id")
    joined = filters._tiled(px).join(cover, ["image_id", "ty", "tx"]).count()
    assert joined < 3 * sum(want.values()) + 5_000 < 1001 * n * n / 3


def test_ellipses_by_tiles(spark):
    rng, n = np.random.default_rng(7), 120
    px = spark.range(n * n).select(F.lit(1).alias("image_id"), (F.col("id") / n).cast("int").alias("y"), (F.col("id") % n).cast("int").alias("x"))
    shapes = [(1, k, float(rng.uniform(0, n)), float(rng.uniform(0, n)), float(rng.uniform(-4, 4)), float(rng.choice([0.0, 0.2, 0.7, 1.0, 1.5])), float(rng.choice([0.0, 10.0])), float(rng.uniform(5, 70))) for k in range(60)]
    geom = spark.createDataFrame(shapes, "image_id int, region int, x0 double, y0 double, pa double, q double, r_in double, r_out double")
    every = filters.with_r_ell(px, geom).where("r_ell between r_in and r_out").groupBy("region").agg(F.count("*").alias("n"), F.sum("r_ell").alias("s"))
    got = filters.in_ellipse(px, geom).groupBy("region").agg(F.count("*").alias("n"), F.sum("r_ell").alias("s"))
    a, b = ({r.region: (r.n, round(r.s, 6)) for r in d.collect()} for d in (every, got))
    assert a == b and len(a) > 40


def test_longest_run_of_flat_rings(spark):
    """Rows that all lie within the range make one run, without a list of all stretches."""
    n = 3000
    df = spark.range(n).select((F.col("id") % 2).alias("g"), F.col("id").cast("double").alias("r_mid"), F.when(F.col("id") >= n - 10, 9.0).otherwise(F.col("id") % 3 / 10).alias("mbar"))
    got = {r.g: (r.n, r.x_first, r.x_last) for r in windows.ring_plateau(df, ["g"], widest=0.4).collect()}
    assert got == {0: (1495, 0.0, 2988.0), 1: (1495, 1.0, 2989.0)}


def test_cones_about_the_poles(spark):
    """A cone near a pole reaches right ascensions far from its centre's."""
    rng = np.random.default_rng(8)
    dec = np.concatenate((rng.uniform(-90, -86, 150), rng.uniform(86, 90, 150), rng.uniform(-90, 90, 100), [-90, 90, 88.5, -88.5, 0]))
    ra = rng.uniform(0, 360, len(dec))
    t = spark.createDataFrame([(k, float(a), float(d)) for k, (a, d) in enumerate(zip(ra, dec, strict=True))], "t long, ra double, dec double")
    o = t.selectExpr("t as o", "ra as ora", "dec as odec")
    a, d = np.radians(ra), np.radians(dec)
    h = np.sin((d[:, None] - d) / 2) ** 2 + np.cos(d)[:, None] * np.cos(d) * np.sin((a[:, None] - a) / 2) ** 2
    sep = np.degrees(2 * np.arcsin(np.sqrt(np.minimum(h, 1))))
    for radius in (1.5, 0.7, 100.0):
        got = sorted((r.t, r.o) for r in joins.cone_join(t, o, radius).select("t", "o").collect())
        assert got == sorted(zip(*(x.tolist() for x in np.nonzero(sep <= radius)), strict=True)), radius
