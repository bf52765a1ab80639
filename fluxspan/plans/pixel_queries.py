"""Queries on pixel views: predicates, profiles, backgrounds, labels, spectra."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import catalog, filters, joins, pixels, psf_error, spectra, stats, windows
from . import views as v
from .registry import PLATEAU_SQL, query, rounded


@query("flt5_valid", f"with {v.PIXELS} select image_id, count(*) as n, count(*) filter (value is not null and x % 3 > 0) as n_valid from pixels group by 1")
def _(spark, d):
    px = v.pixels(spark, d).withColumn("wht", F.when(F.col("x") % 3 > 0, 1.0))
    return filters.with_valid(px).groupBy("image_id").agg(F.count("*").alias("n"), F.count_if("valid").alias("n_valid"))


@query("flt6_circle", f"with {v.PIXELS}, {v.CENTERS} select image_id, count(*) as n, round(avg(value), 6) as mean from pixels join centers using (image_id) where power(x - cx, 2) + power(y - cy, 2) between 25 and 400 group by 1")
def _(spark, d):
    px = v.pixels(spark, d)
    regions = v.centers(px).select("image_id", F.col("cx").alias("x0"), F.col("cy").alias("y0"), F.lit(2.5).alias("r_in"), F.lit(10.0).alias("r_out"), F.lit(0.25).alias("pix_area"))
    return rounded(filters.in_circle(px, regions).groupBy("image_id").agg(F.count("*").alias("n"), F.avg("value").alias("mean")))


@query("flt7_ellipse", f"with {v.PIXELS}, {v.CENTERS}, e as (select image_id, value, sqrt(power((x - cx) * cos(0.5) + (y - cy) * sin(0.5), 2) + power(((y - cy) * cos(0.5) - (x - cx) * sin(0.5)) / 0.7, 2)) as r from pixels join centers using (image_id)) select image_id, count(*) as n, round(avg(value), 6) as mean from e where r between 5.03 and 20.07 group by 1")
def _(spark, d):
    px = v.pixels(spark, d)
    geom = v.centers(px).select("image_id", F.col("cx").alias("x0"), F.col("cy").alias("y0"), F.lit(0.5).alias("pa"), F.lit(0.7).alias("q"), F.lit(5.03).alias("r_in"), F.lit(20.07).alias("r_out"))
    return rounded(filters.in_ellipse(px, geom).groupBy("image_id").agg(F.count("*").alias("n"), F.avg("value").alias("mean")))


@query("flt8_usable", f"with {v.PIXELS} select image_id, count(*) as region_pixels, count(*) filter (x % 5 > 0 and value > 0) as usable_pixels, round(count(*) filter (x % 5 > 0 and value > 0) / count(*)::double, 6) as usable_fraction from pixels group by 1")
def _(spark, d):
    px = v.pixels(spark, d).withColumns({"masked": F.col("x") % 5 == 0, "residual": F.col("value"), "model": F.col("value")})
    return rounded(filters.usable(px, ["image_id"])[1])


@query("flt9_crop", f"with {v.PIXELS}, b as (select image_id, min(x) lx, max(x) hx, min(y) ly, max(y) hy from pixels where value > 0.3 group by 1) select image_id, count(*) as n, sum(x - greatest(lx - 1, 0)) as sx, sum(y - greatest(ly - 1, 0)) as sy from pixels join b using (image_id) where x between lx - 1 and hx + 1 and y between ly - 1 and hy + 1 group by 1")
def _(spark, d):
    px = v.pixels(spark, d).withColumn("value", F.when(F.col("value") > 0.3, F.col("value")))
    return filters.crop_finite(px, 1).groupBy("image_id").agg(F.count("*").alias("n"), F.sum("x").alias("sx"), F.sum("y").alias("sy"))


@query("flt10_cutout", f"with {v.PIXELS}, {v.CENTERS} select image_id, count(*) as n, round(sum(value), 6) as total from pixels join centers using (image_id) where x between round(cx) - 6 and round(cx) + 6 and y between round(cy) - 6 and round(cy) + 6 group by 1")
def _(spark, d):
    px = v.pixels(spark, d)
    return rounded(filters.cutout(px, v.centers(px), 6).groupBy("image_id").agg(F.count("*").alias("n"), F.sum("value").alias("total")))


@query("flt11_downsample", f"with {v.PIXELS} select image_id, (y / 4)::int as y, (x / 4)::int as x, value from pixels where y % 4 = 0 and x % 4 = 0")
def _(spark, d):
    return filters.downsample(v.pixels(spark, d), 4)


@query("flt11_nth_sample", f"with {v.PIXELS}, k as (select *, row_number() over (partition by image_id order by y, x) - 1 as i from pixels where value > 0) select image_id, y, x, value from k where i % 7 = 0")
def _(spark, d):
    return filters.nth_sample(v.pixels(spark, d).withColumn("value", F.when(F.col("value") > 0, F.col("value"))), 7)


@query("jn10_band_join", f"with {v.PIXELS} select a.image_id, count(*) as n, round(sum(a.value * b.value), 6) as dot from pixels a join pixels b on a.image_id = b.image_id and a.y = b.y and a.x = b.x where a.value > 0 and a.x % 4 > 0 group by 1")
def _(spark, d):
    px = v.pixels(spark, d)
    one = px.where("value > 0").withColumn("masked", F.col("x") % 4 == 0)
    return rounded(joins.band_join(one, px, "image_id").groupBy("image_id").agg(F.count("*").alias("n"), F.sum(F.col("v150") * F.col("v090")).alias("dot")))


@query("jn7_source_regions", f"with {v.PIXELS}, {v.CENTERS}, s as (select image_id, y // 4 * 1000 + x // 4 as label, power(x - cx, 2) + power(y - cy, 2) <= 100 as inside from pixels join centers using (image_id)) select image_id, label, 'core' as region from s group by 1, 2 having bool_or(inside)")
def _(spark, d):
    px = v.pixels(spark, d)
    seg = px.select("image_id", "y", "x", F.expr("cast(y div 4 * 1000 + x div 4 as long)").alias("label"))
    regions = v.centers(px).select("image_id", F.lit("core").alias("region"), F.col("cx").alias("x0"), F.col("cy").alias("y0"), F.lit(0.0).alias("r_in"), F.lit(10.0).alias("r_out"), F.lit(1.0).alias("pix_area"))
    return joins.sources_in_regions(seg.select("image_id", "label").distinct(), seg, filters.in_circle(px, regions).select("image_id", "region", "y", "x")).select("image_id", "label", "region")


@query("agg3_corners", f"""with {v.PIXELS}, s as (select image_id, max(x) + 1 nx, max(y) + 1 ny from pixels group by 1), c as (select image_id, value from pixels join s using (image_id) where (x < floor(0.2 * nx) or x >= nx - floor(0.2 * nx)) and (y < floor(0.2 * ny) or y >= ny - floor(0.2 * ny))),
b as (select image_id, median(value) - 2 * stddev_pop(value) lo, median(value) + 2 * stddev_pop(value) hi from c group by 1) select image_id, round(avg(value), 6) as mean, round(median(value), 6) as median, count(*) as n, round(stddev_pop(value), 6) as std from c join b using (image_id) where value between lo and hi group by 1 having count(*) > 50""")
def _(spark, d):
    return rounded(stats.corner_check(v.pixels(spark, d), 0.2, 50, k=2.0, iters=1))


@query("agg5_radial_profile", f"with {v.PIXELS}, {v.CENTERS} select image_id, floor(sqrt(power(x - cx, 2) + power(y - cy, 2)) / 2.0)::int as ring, round(median(value), 6) as intensity, count(*) as n_pix, (floor(sqrt(power(x - cx, 2) + power(y - cy, 2)) / 2.0) + 0.5) * 2.0 as r_mid from pixels join centers using (image_id) group by all having count(*) >= 20")
def _(spark, d):
    px = v.pixels(spark, d)
    return rounded(stats.radial_profile(px, v.centers(px), 2.0, 20, 100).select("image_id", "ring", "intensity", "n_pix", "r_mid"))


@query("agg7_moments", f"""with {v.PIXELS}, m as (select image_id, sum(value) w, sum(value * x) / sum(value) x0, sum(value * y) / sum(value) y0, sum(value * x * x) / sum(value) - power(sum(value * x) / sum(value), 2) vx, sum(value * y * y) / sum(value) - power(sum(value * y) / sum(value), 2) vy, sum(value * x * y) / sum(value) - sum(value * x) * sum(value * y) / power(sum(value), 2) vxy from pixels where value > 0 group by 1)
select image_id, round(x0, 5) as x0, round(y0, 5) as y0, round(1 - sqrt(greatest((vx + vy) / 2 - sqrt(power((vx - vy) / 2, 2) + vxy * vxy), 0) / ((vx + vy) / 2 + sqrt(power((vx - vy) / 2, 2) + vxy * vxy))), 5) as eps, round(0.5 * atan2(2 * vxy, vx - vy), 5) as pa from m""")
def _(spark, d):
    return rounded(stats.ellipse_moments(v.pixels(spark, d), ["image_id"]), 5)


@query("agg8_residual_audit", f"with {v.PIXELS} select image_id, count(value) as n, round(min(value), 6) as v_min, round(median(value), 6) as v_median, round(max(value), 6) as v_max, round(avg(value), 6) as v_mean, round(stddev_pop(value), 6) as v_std, round(quantile_cont(value, 0.01), 6) as p01, round(quantile_cont(value, 0.99), 6) as p99 from pixels group by 1")
def _(spark, d):
    return rounded(stats.value_stats(v.pixels(spark, d), ["image_id"]))


@query("agg13_quadrants", f"with {v.PIXELS}, {v.CENTERS} select image_id, (case when y < cy then 0 else 2 end + case when x < cx then 0 else 1 end)::int as quadrant, count(*) as n, round(median(value), 6) as v_median from pixels join centers using (image_id) group by all")
def _(spark, d):
    px = v.pixels(spark, d)
    return rounded(stats.quadrant_stats(px, v.centers(px)).select("image_id", "quadrant", "n", "v_median"))


@query("agg9_bias_profile", f"""with {v.PIXELS}, {v.CENTERS}, q as (select image_id, sqrt(power(x - cx, 2) + power(y - cy, 2)) as r, value from pixels join centers using (image_id)), t as (select image_id, greatest(quantile_cont(r, 0.995), 0) as top from q group by 1)
select image_id, floor(r / (top / 24))::int as rbin, count(*) as n_pix, round(median(value), 6) as value_median, round(avg(value), 6) as value_mean from q join t using (image_id) where floor(r / (top / 24)) < 24 group by all having count(*) >= 20""")
def _(spark, d):
    px = v.pixels(spark, d)
    r = px.join(v.centers(px), "image_id").withColumn("r", F.sqrt(F.pow(F.col("x") - F.col("cx"), 2) + F.pow(F.col("y") - F.col("cy"), 2)))
    return rounded(stats.bias_profile(r, ["image_id"], least=20).select("image_id", "rbin", "n_pix", "value_median", "value_mean"))


@query("agg10_region_bias", f"with {v.PIXELS} select image_id, count(value) as n_use, round(median(value), 6) as resid_median, round(avg(value), 6) as resid_mean, case when median(value) > 0 then 'positive' when median(value) < 0 then 'negative' else 'zero' end as median_sign, case when avg(value) > 0 then 'positive' when avg(value) < 0 then 'negative' else 'zero' end as mean_sign from pixels group by 1")
def _(spark, d):
    return rounded(stats.region_bias(v.pixels(spark, d), ["image_id"]))


@query("agg11_overlap", f"with {v.PIXELS}, p as (select image_id, floor(x / 8.0)::int as rbin, median(value) a, median(value * value - 0.5) b, count(*) n from pixels group by all) select image_id, rbin, n as n_pix, round(a - b, 6) as difference, sign(a) = sign(b) as same_sign from p where n >= 10")
def _(spark, d):
    from ..operators.catalog import overlap_profile

    px = v.pixels(spark, d).withColumn("other", F.col("value") * F.col("value") - 0.5)
    return rounded(overlap_profile(px, ["image_id"], "x", "value", "other", 8.0).select("image_id", "rbin", "n_pix", "difference", "same_sign"))


@query("agg12_coverage", f"with {v.PIXELS} select image_id, count(*) as n, count(*) filter (value > 0) as n_model, round(count(*) filter (value > 0) / count(*)::double, 6) as frac_model from pixels group by 1")
def _(spark, d):
    return rounded(stats.coverage(v.pixels(spark, d).withColumn("model", F.col("value") > 0), ["image_id"], ["model"]))


@query("agg14_zones", f"""with {v.PIXELS}, b as (select image_id, median(value) - 2 * stddev_pop(value) lo, median(value) + 2 * stddev_pop(value) hi from pixels group by 1)
select image_id, count(value) as raw_n, round(quantile_cont(value, 0.05), 6) as raw_p05, count(*) filter (value between lo and hi) as clip_n, round(avg(value) filter (value between lo and hi), 6) as clip_mean, round(quantile_cont(value, 0.95) filter (value between lo and hi), 6) as clip_p95 from pixels join b using (image_id) group by 1""")
def _(spark, d):
    return rounded(stats.zone_stats(v.pixels(spark, d), ["image_id"], k=2.0, iters=1).select("image_id", "raw_n", "raw_p05", "clip_n", "clip_mean", "clip_p95"))


@query("agg15_variance_sbf", f"with {v.PIXELS}, q as (select image_id, quantile_cont(value, 0.05) a, quantile_cont(value, 0.95) b, avg(value * value) m from pixels group by 1) select image_id, count(*) as n_core, round(var_pop(value), 6) as var_core, round(var_pop(value) / max(m), 6) as pf from pixels join q using (image_id) where value between a and b group by 1")
def _(spark, d):
    px = v.pixels(spark, d).withColumn("model", F.col("value") * F.col("value"))
    return rounded(stats.variance_sbf(px, ["image_id"], 0.001).select("image_id", "n_core", "var_core", "pf"))


@query("agg17_source_catalog", f"with {v.PIXELS}, s as (select image_id, y // 4 * 1000 + x // 4 as label, avg(x) as xc, count(*) as n, sum(value) as f, sum(greatest(value, 0)) as p from pixels group by all) select image_id, label, round(xc, 6) as xcentroid, n as area_pix, round(case when f > 0 then f else p end, 6) as flux_adopted from s where n <= 625 and case when f > 0 then f else p end > 0")
def _(spark, d):
    px = v.pixels(spark, d)
    seg = px.select("image_id", "y", "x", F.expr("cast(y div 4 * 1000 + x div 4 as long)").alias("label"))
    return rounded(stats.source_catalog(px, seg, 0.001).select("image_id", "label", "xcentroid", "area_pix", "flux_adopted"))


@query("agg18_residual_sources", f"with {v.PIXELS} select image_id, y // 4 * 1000 + x // 4 as label, count(*) as area_pix, round(max(value) / 0.1, 6) as peak_sn from pixels group by all having max(value) > 0.2")
def _(spark, d):
    px = v.pixels(spark, d)
    seg = px.select("image_id", "y", "x", F.expr("cast(y div 4 * 1000 + x div 4 as long)").alias("label"))
    return rounded(stats.residual_sources(px, seg, 0.2, 0.1).select("image_id", "label", "area_pix", "peak_sn"))


@query("agg52_branch_plan", f"with {v.PIXELS} select image_id, round(avg((value > 0.1)::int), 6) as masked_fraction from pixels group by 1")
def _(spark, d):
    return rounded(stats.branch_plan(v.pixels(spark, d).withColumn("masked", F.col("value") > 0.1), ["image_id"]))


@query("num3_smooth", f"""with {v.PIXELS}, k as (select unnest(range(-4, 5)) as o), kw as (select o, exp(-0.5 * o * o) / (select sum(exp(-0.5 * o * o)) from k) as w from k),
sx as (select image_id, y, x + o as x, sum(value * w) v, sum(w) w from pixels, kw group by all), sy as (select image_id, y + o as y, x, sum(v * kw.w) v, sum(sx.w * kw.w) w from sx, kw group by all) select p.image_id, p.y, p.x, round(v / w, 6) as smoothed from pixels p join sy using (image_id, y, x)""")
def _(spark, d):
    return rounded(pixels.smooth(v.pixels(spark, d), 1.0).select("image_id", "y", "x", "smoothed"))


@query("num4_detect", f"""with recursive {v.PIXELS}, lit as (select image_id, y::bigint * 16777216 + x as p, y, x from pixels where value > 0.2),
adj as (select a.image_id, a.p, b.p as q from lit a join lit b on a.image_id = b.image_id and b.y between a.y - 1 and a.y + 1 and b.x between a.x - 1 and a.x + 1 and a.p <> b.p),
reach as (select image_id, p, p as l from lit where (image_id, p) not in (select image_id, p from adj where q < p) union select r.image_id, a.q, r.l from reach r join adj a on a.image_id = r.image_id and a.p = r.p),
lab as (select image_id, p, min(l) as label from reach group by all)
select image_id, label, count(*) as n from lab group by all having count(*) >= 2""")
def _(spark, d):
    seg = pixels.detect_sources(v.pixels(spark, d), 0.2, 2, tile=16)
    return seg.groupBy("image_id", "label").agg(F.count("*").alias("n"))


@query("num5_compact_mask", f"with {v.PIXELS}, s as (select image_id, y, x, case when value > 0.1 then 1 else y * 64 + x + 2 end as label from pixels), n as (select image_id, label, count(*) n from s group by all) select image_id, y, x from s join n using (image_id, label) where n <= 1")
def _(spark, d):
    seg = v.pixels(spark, d).select("image_id", "y", "x", F.when(F.col("value") > 0.1, 1).otherwise(F.col("y") * 64 + F.col("x") + 2).alias("label"))
    return pixels.compact_mask(seg, 1).select("image_id", "y", "x")


@query("num6_dilate", f"with {v.PIXELS}, m as (select * from pixels where value > 0.3), o as (select unnest([0, 0, 0, 1, -1]) as dy, unnest([0, 1, -1, 0, 0]) as dx), g as (select distinct image_id, y + dy as y, x + dx as x from m, o) select p.image_id, p.y, p.x from pixels p join g using (image_id, y, x)")
def _(spark, d):
    px = v.pixels(spark, d)
    return pixels.dilate(px.where("value > 0.3"), px, 1).select("image_id", "y", "x")


@query("num8_unroll", f"""with {v.PIXELS}, {v.CENTERS}, p as (select image_id, value, sqrt(power(x - cx, 2) + power(y - cy, 2)) r, atan2(y - cy, x - cx) / (2 * pi()) as t from pixels join centers using (image_id)), c as (select image_id, floor((r - 4) / (12 / 3.0))::int as sub, least(floor((t - floor(t)) * 12), 11)::int as angle, avg(value) as m, count(*) as n from p where r >= 4 and r < 16 group by all)
select i.image_id, s.sub, a.angle, round(m, 6) as mean, coalesce(n, 0) as n from (select distinct image_id from c) i, (select unnest(range(0, 3))::int as sub) s, (select unnest(range(0, 12))::int as angle) a left join c on c.image_id = i.image_id and c.sub = s.sub and c.angle = a.angle""")
def _(spark, d):
    px = v.pixels(spark, d)
    geom = v.centers(px).select("image_id", F.col("cx").alias("x0"), F.col("cy").alias("y0"))
    return rounded(pixels.unroll_ring(px, geom, 4.0, 16.0, 3, 12))


@query("win12_circular_smooth", f"""with {v.PIXELS}, {v.CENTERS}, q as (select image_id, value, sqrt(power(x - cx, 2) + power(y - cy, 2)) as r, atan2(y - cy, x - cx) / (2 * pi()) as t from pixels join centers using (image_id)),
c as (select image_id, least(floor((t - floor(t)) * 36), 35)::int as b, avg(value) as v from q where r >= 4 and r < 16 group by all),
w as (select image_id, b + unnest([-36, 0, 36]) as b, v from c), n as (select *, lead(b) over o as nb, lead(v) over o as nv from w window o as (partition by image_id order by b)),
f as (select image_id, k.b, v + (nv - v) * (k.b - n.b) / (nb - n.b) as v from n join (select unnest(range(0, 36)) as b) k on k.b >= n.b and k.b < n.nb),
h as (select o, (0.5 - 0.5 * cos(2 * pi() * (o + 5) / 10)) as k from (select unnest(range(-4, 5)) as o)), z as (select sum(k) as total from h)
select image_id, (((f.b + h.o) % 36 + 36) % 36)::int as angle, round(sum(f.v * h.k / (select total from z)), 6) as smoothed from f join h on true group by all""")
def _(spark, d):
    px = v.pixels(spark, d)
    geom = v.centers(px).select("image_id", F.col("cx").alias("x0"), F.col("cy").alias("y0"))
    ring = pixels.unroll_ring(px, geom, 4.0, 16.0, 1, 36)
    return rounded(windows.circular_smooth(ring, ["image_id"], 36, "angle", "mean", 9))


@query("win9_clean_nodes", "with o as (select l_suppkey, l_quantity as sma, l_extendedprice as intens, l_discount as eps, l_tax as f, l_orderkey * 10 + l_linenumber as k from lineitem where l_quantity > 0), u as (select *, row_number() over (partition by l_suppkey, sma order by k desc) as r from o), s as (select l_suppkey, count(*) n, max(sma) filter (f >= 0.05) t from u where r = 1 group by 1) select l_suppkey, sma, intens, n as n_nodes, t as trusted_edge from u join s using (l_suppkey) where r = 1 and n >= 8")
def _(spark, d):
    iso = v.table(spark, d, "lineitem").select("l_suppkey", F.col("l_quantity").alias("sma"), F.col("l_extendedprice").alias("intens"), F.col("l_discount").alias("eps"), F.col("l_tax").alias("real_data_frac"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("k"))
    return windows.clean_nodes(iso, ["l_suppkey"], "k", 8, 0.05).select("l_suppkey", "sma", "intens", "n_nodes", "trusted_edge")


@query("num1_periodogram_whole")
def _(spark, d):
    return rounded(spectra.periodogram(v.pixels(spark, d)).select("image_id", "ky", "kx", "power"))


@query("agg37_rerun")
def _(spark, d):
    """Images as galaxies, their halves as annuli; a narrow and a wide PSF table; one image in three has a supplied error."""
    px = v.pixels(spark, d)
    side = px.groupBy("image_id").agg(F.max("y").alias("_y"))
    residuals = px.join(side, "image_id").select(F.col("image_id").alias("galaxy"), F.when(2 * F.col("y") < F.col("_y"), "inner").otherwise("outer").alias("region"), F.col("y").cast("int").alias("y"), "x", "value")
    images = px.select(F.col("image_id").alias("galaxy")).distinct()
    cells = [("DET_DIST", a, b, 0.2 if (a, b) == (0, 0) else 0.1) for a in (-1, 0, 1) for b in (-1, 0, 1)] + [("DET_SAMP", a, b, 0.04) for a in range(-2, 3) for b in range(-2, 3)]
    stamp = F.explode(F.array(*[F.struct(F.lit(e).alias("psf_ext"), F.lit(a).alias("dy"), F.lit(b).alias("dx"), F.lit(value).alias("value")) for e, a, b, value in cells]))
    regions = F.explode(F.array(F.struct(F.lit("inner").alias("region"), F.lit(0.05).alias("sigma")), F.struct(F.lit("outer").alias("region"), F.lit(0.1).alias("sigma"))))
    science = images.select("galaxy", regions.alias("r")).select("galaxy", "r.*", F.lit(0.0).alias("Pr"), F.lit(1.0).alias("Imean"), F.lit(0.05).alias("kmin"), F.lit(0.6).alias("kmax"), F.lit(0.004).alias("pix_area"))
    again = psf_error.rerun_psf_sigma(residuals, images.select("galaxy", stamp.alias("s")).select("galaxy", "s.*"), science, 3, 1489, 16, 5)
    rows = images.select("galaxy", F.when(F.col("galaxy") % 3 == 0, 0.1).alias("psf_supplied"), F.lit(None).cast("double").alias("psf_branch"), F.lit(None).cast("double").alias("psf_saved")).join(again.select("galaxy", "psf_rerun"), "galaxy", "left")
    return rounded(catalog.psf_sigma(rows).select("galaxy", "sigma_psf", "sigma_psf_status"))


@query("num2_expectation")
def _(spark, d):
    px = v.pixels(spark, d)
    psf = px.select("image_id").distinct().withColumn("o", F.explode(F.array(*[F.struct(F.lit(a).alias("dy"), F.lit(b).alias("dx"), F.lit(0.2 if (a, b) == (0, 0) else 0.1).alias("value")) for a in (-1, 0, 1) for b in (-1, 0, 1)]))).select("image_id", "o.*")
    return rounded(spectra.expectation_spectrum(px, psf, 4, 1489, 12, 5))


@query("win3_pick_window", f"""with {PLATEAU_SQL} select p.event_type, round(p.x, 4) as x, round(abs(p.y - l.level) + 0.0001 * p.x, 4) as cost from profile p join plateau l on l.event_type = p.event_type qualify row_number() over (partition by p.event_type order by abs(p.y - l.level) + 0.0001 * p.x, p.y) = 1""")
def _(spark, d):
    prof = v.profile(spark, d)
    plateau = windows.find_plateau(prof, ["event_type"], "x", "y", 3, 25.0)
    return rounded(windows.pick_window(prof, plateau, ["event_type"], "y", {"x": 1e-4}).select("event_type", "x", "cost"), 4)
