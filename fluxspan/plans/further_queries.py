"""Queries of sources, sinks, streams and statistics that need longer SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalar as fn
from ..operators import catalog, filters, fits, joins, mentions, pixels, spectra, stats, windows
from ..sources import heads, tables
from ..streaming import readiness
from . import registry, storage
from . import views as v
from .registry import query, rounded


def clipped_sql(source: str, keys: str, k: float, rounds: int, value: str = "value") -> str:
    """CTEs c0..c<rounds> over `source`: the rows left after each round of clipping, and b1.. with the bounds."""
    parts = [f"c0 as (select * from {source} where {value} is not null)"]
    for i in range(1, rounds + 1):
        parts.append(f"b{i} as (select {keys}, median({value}) - {k} * stddev_pop({value}) as lo, median({value}) + {k} * stddev_pop({value}) as hi from c{i - 1} group by all)")
        parts.append(f"c{i} as (select c{i - 1}.* from c{i - 1} join b{i} using ({keys}) where {value} between lo and hi)")
    return ",\n".join(parts)


# -- sources and sinks ---------------------------------------------------------------------------------------------

@query("src1_csv", """select s_suppkey, s_name, case when s_suppkey % 3 > 0 then s_acctbal end as s_acctbal from supplier""")
def _(spark, d):
    path = storage.folder(spark)
    s = v.table(spark, d, "supplier").select("s_suppkey", "s_name", F.when(F.col("s_suppkey") % 3 == 0, F.when(F.col("s_suppkey") % 2 == 0, float("nan")).otherwise(float("inf"))).otherwise(F.col("s_acctbal")).alias("s_acctbal"))
    s.withColumn("s_acctbal", F.expr("case when isnan(s_acctbal) then 'nan' when s_acctbal = double('infinity') then 'inf' else cast(s_acctbal as string) end")).write.option("header", True).csv(path)
    schema = "s_suppkey long, s_name string, s_acctbal double"
    return tables.read_csv_table(spark, path, schema).unionByName(tables.read_csv_table(spark, f"{path}-absent", schema))


@query("src2_results", "select c_custkey, c_mktsegment as segment, c_acctbal as mbar from customer where c_custkey % 3 > 0")
def _(spark, d):
    path = storage.folder(spark)
    c = v.table(spark, d, "customer").select("c_custkey", F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("mbar"), F.when(F.col("c_custkey") % 3 == 0, "failed").otherwise("ok").alias("status"))
    # one object in each file
    heads.write_files(c.select(F.concat(F.monotonically_increasing_id(), F.lit(".json")).alias("name"), F.concat(F.to_json(F.struct("*")), F.lit("\n")).alias("body")), path)
    return tables.read_results(spark, f"{path}/*/*.json", "c_custkey long, segment string, mbar double, status string").drop("status")


@query("src3_experiments", """select s_name as experiment, r as region_key, s_acctbal / 1000 as resid_median, s_nationkey::bigint as n_use
from supplier, (select unnest(['inner', 'outer']) as r) where r = 'inner' or s_suppkey % 2 = 0""")
def _(spark, d):
    path = storage.folder(spark)
    region = F.struct(F.col("s_nationkey").cast("long").alias("n_use"), (F.col("s_acctbal") / 1000).alias("resid_median"))
    both = F.when(F.col("s_suppkey") % 2 == 0, F.create_map(F.lit("inner"), region, F.lit("outer"), region)).otherwise(F.create_map(F.lit("inner"), region))
    rows = v.table(spark, d, "supplier").select(F.struct(F.col("s_name").alias("experiment"), both.alias("residual_regions")).alias("j"))
    heads.write_files(rows.select(F.concat(F.monotonically_increasing_id(), F.lit(".json")).alias("name"), F.to_json("j").alias("body")), path)
    return tables.read_experiments(spark, f"{path}/*/*.json").select("experiment", "region_key", "resid_median", "n_use")


@query("src4_logs", """select c_custkey, c_nationkey < 20 as log_exists, case when c_nationkey >= 20 then 'log missing' else concat_ws(';', case when c_custkey % 2 = 0 then 'truncated_file_warning' end,
case when c_custkey % 3 = 0 then 'isophote_real_only_failed' end, case when c_custkey % 5 = 0 then 'sersic_fit_warning' end) end as warnings, case when c_nationkey < 20 then c_mktsegment else '' end as iso_dataset,
case when c_nationkey < 20 and c_custkey % 7 > 0 then 'DET_DIST' else '' end as psf_extension, case when c_nationkey < 20 and c_custkey % 4 > 0 then c_acctbal end as bkg_check_med,
case when c_nationkey < 20 and c_custkey % 4 > 0 then -0.5::double end as bkg_check_mean, case when c_nationkey < 20 and c_custkey % 4 > 0 then 0.001::double end as bkg_check_std, case when c_nationkey < 20 and c_custkey % 4 > 0 then c_custkey end as bkg_check_n from customer""")
def _(spark, d):
    c = v.table(spark, d, "customer")
    said = lambda k, text: F.when(F.col("c_custkey") % k == 0, F.lit(text))
    lines = F.concat_ws(
        "\n", F.lit("start"), said(5, "Warning: fit may be unsuccessful; check fit_info"), said(3, "[ISO] No meaningful fit was possible."), said(2, "WARNING: File may have been truncated: actual 10"),
        F.concat(F.lit("[ISO] fit dataset used = "), "c_mktsegment", F.lit(", n = 3")), F.when(F.col("c_custkey") % 7 > 0, F.lit("[PSF] selected extension = DET_DIST ")),
        F.when(F.col("c_custkey") % 4 > 0, F.concat(F.lit("[BKG-CHECK] corners: med="), F.col("c_acctbal").cast("string"), F.lit(", mean=-5e-1, std=1.0e-3, N="), F.col("c_custkey").cast("string"))),
    )
    logs = c.where("c_nationkey < 20").select("c_custkey", lines.alias("value"))
    return tables.parse_logs(logs, c, key="c_custkey")


@query("src6_header_cards", "select s_name as path, s_acctbal as ra, s_nationkey::double as dec, case when s_suppkey % 2 = 0 then 'TARG_RA' else 'CRVAL1' end as source from supplier where s_suppkey % 5 > 0")
def _(spark, d):
    even = F.col("s_suppkey") % 2 == 0
    card = lambda key, value: F.rpad(F.concat(F.rpad(key, 8, " "), F.lit("= "), value.cast("string"), F.lit(" / a comment")), 80, " ")
    cards = F.concat(
        F.rpad(F.when(F.col("s_suppkey") % 5 == 0, "XTENSION=").otherwise("SIMPLE  =                    T"), 80, " "), card(F.lit("OBJECT"), F.concat(F.lit("'"), "s_name", F.lit("'"))),
        card(F.when(even, "TARG_RA").otherwise("CRVAL1"), F.col("s_acctbal")), card(F.when(even, "TARG_DEC").otherwise("CRVAL2"), F.col("s_nationkey")),
        card(F.lit("RA_TARG"), F.lit(1.0)), F.rpad(F.lit("END"), 80, " "), card(F.lit("DEC_TARG"), F.lit(2.0)),
    )
    files = v.table(spark, d, "supplier").select(F.concat(F.translate("s_name", "#", "-"), F.lit(".fits.gz")).alias("name"), F.rpad(cards, 2880, " ").cast("binary").alias("head"))
    path = storage.folder(spark)
    heads.write_images(files, path, F.lit(200 * 2880))
    found = tables.target_coord(tables.read_header_cards(spark, f"{path}/*.fits.gz"))
    return found.withColumn("path", F.translate(F.regexp_extract("path", "([^/]+)[.]fits[.]gz$", 1), "-", "#"))


@query("src7_texts", "select lang, sum(length(text) + 1)::bigint as chars from documents where text is not null group by 1")
def _(spark, d):
    path = storage.folder(spark)
    v.table(spark, d, "documents").where("text is not null").select("lang", F.col("text").alias("value")).write.option("maxRecordsPerFile", 1000).partitionBy("lang").text(path)
    texts = tables.read_texts(spark, f"{path}/*/*", tables.read_texts(spark, f"{path}/*/*").select("article", F.lit(1).alias("labelled")))
    each = spark.read.text(path, wholetext=True).groupBy("lang").agg(F.sum(F.length("value")).alias("chars"))
    total = texts.where("labelled = 1").agg(F.sum(F.length("text")).alias("all_chars"))
    return each.join(total, F.lit(True)).groupBy("lang").agg(F.max("chars").alias("chars"), F.max("all_chars").alias("_all")).drop("_all")


@query("snk1_write_summary", "select n_nationkey, n_name, null::int as r_regionkey, null as r_name from nation union all select null, null, r_regionkey, r_name from region")
def _(spark, d):
    path = storage.folder(spark)
    df = tables.write_summary([v.table(spark, d, "nation").drop("n_regionkey"), v.table(spark, d, "region")], path)
    return spark.read.option("header", True).schema(df.schema).csv(path)


@query("snk3_partitioned", "select l_returnflag, l_linestatus, count(*) as n, round(sum(l_quantity), 2) as quantity from lineitem group by all")
def _(spark, d):
    path = storage.folder(spark)
    tables.write_table(v.table(spark, d, "lineitem"), path, ["l_returnflag", "l_linestatus"], rows=1000)
    return rounded(spark.read.parquet(path).groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("quantity")), 2)


@query("top2_sorted", "select c_mktsegment, c_acctbal, c_custkey, row_number() over (order by c_mktsegment, c_acctbal desc, c_custkey) as place from customer")
def _(spark, d):
    out = storage.written(tables.sorted_table(v.table(spark, d, "customer").select("c_mktsegment", "c_acctbal", "c_custkey"), ["c_mktsegment", "-c_acctbal", "c_custkey"]).withColumn("at", F.monotonically_increasing_id()))
    # numbers of sorted partitions and of rows in them: places without one task for all rows
    part = F.shiftright("at", 33)
    sizes = out.groupBy(part.alias("part")).agg(F.count("*").alias("size"))
    before = sizes.alias("a").join(sizes.select(F.col("part").alias("other"), F.col("size").alias("s")), F.col("other") < F.col("part"), "left").groupBy("part").agg(F.coalesce(F.sum("s"), F.lit(0)).alias("base"))
    return out.withColumn("part", part).join(before, "part").select("c_mktsegment", "c_acctbal", "c_custkey", (F.col("base") + F.col("at").bitwiseAND((1 << 33) - 1) + 1).alias("place"))


# -- filters, joins, catalogue -------------------------------------------------------------------------------------

@query("flt3_classify", """select s_suppkey, case s_suppkey % 3 when 0 then 'nrcalong' when 1 then 'nrcb' else 'unknown' end as detector, printf('%05d', s_suppkey % 100000) as proposal, case when s_suppkey % 4 > 0 then printf('o%03d', s_suppkey % 4) else '' end as object_tag,
printf('%05d', s_suppkey % 100000) || '/' || case when s_suppkey % 4 > 0 then printf('o%03d', s_suppkey % 4) else 'none' end || '/' || case s_suppkey % 3 when 0 then 'nrcalong' when 1 then 'nrcb' else 'unknown' end || '/' || f as destination,
case s_suppkey % 4 when 1 then 'NGC 1' when 2 then 'NGC 2' when 3 then 'o003' else 'none' end || '/' || case s_suppkey % 3 when 0 then 'nrcalong' when 1 then 'nrcb' else 'unknown' end || '/' || f as by_object
from (select *, 'jw' || printf('%05d', s_suppkey % 100000) || case when s_suppkey % 4 > 0 then printf('-o%03d', s_suppkey % 4) else '' end || '_' || case s_suppkey % 3 when 0 then 'nrcalong' when 1 then 'nrcb1' else 'miri' end || '_i2d.fits' as f from supplier)""")
def _(spark, d):
    k = F.col("s_suppkey")
    name = F.concat(F.lit("jw"), F.lpad((k % 100000).cast("string"), 5, "0"), F.when(k % 4 > 0, F.concat(F.lit("-o00"), (k % 4).cast("string"))).otherwise(""), F.lit("_"), F.when(k % 3 == 0, "nrcalong").when(k % 3 == 1, "nrcb1").otherwise("miri"), F.lit("_i2d.fits"))
    prods = v.table(spark, d, "supplier").select("s_suppkey", name.alias("file_name"))
    targets = v.table(spark, d, "nation").where("n_nationkey between 1 and 2").select(F.concat(F.lit("o00"), F.col("n_nationkey").cast("string")).alias("object_tag"), F.concat(F.lit("NGC "), F.col("n_nationkey").cast("string")).alias("target"))
    other = filters.classify_products(prods, scheme="object", targets=targets).select("s_suppkey", F.col("destination").alias("by_object"))
    return filters.classify_products(prods).select("s_suppkey", "detector", "proposal", "object_tag", "destination").join(other, "s_suppkey")


@query("jn1_weighted_share", """select s_suppkey as galaxy, round((0.1 * (1 + s_nationkey) + 0.3 * s_suppkey) / (1 + s_nationkey + s_suppkey), 9) as Pr_over_P0_weighted, 'clean' as quality_flag from supplier""")
def _(spark, d):
    s = v.table(spark, d, "supplier").withColumnRenamed("s_suppkey", "galaxy")
    results = s.select("galaxy", F.lit(1.0).alias("mbar_inner"), F.lit(2.0).alias("mbar_outer"), F.lit(0.1).alias("Pr_over_P0_inner"), F.lit(0.3).alias("Pr_over_P0_outer"))
    errors = s.select("galaxy", (1 + F.col("s_nationkey")).cast("double").alias("weight_inner"), F.col("galaxy").cast("double").alias("weight_outer"))
    return rounded(joins.assemble_paper(results, errors, s.select("galaxy", F.lit(None).cast("string").alias("warnings"))).select("galaxy", "Pr_over_P0_weighted", "quality_flag"), 9)


@query("jn5_unprocessed", "select c_custkey from customer where c_nationkey % 2 = 0 and c_acctbal > 0 and c_custkey not in (select o_custkey from orders where o_orderpriority = '1-URGENT' and o_orderstatus = 'F')")
def _(spark, d):
    c = v.table(spark, d, "customer").withColumns({"has_f150w": F.col("c_nationkey") % 2 == 0, "has_f090w": F.col("c_acctbal") > 0})
    done = v.table(spark, d, "orders").where("o_orderpriority = '1-URGENT' and o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return joins.unprocessed(c, done, "c_custkey").select("c_custkey")


@query("jn7_centroids", f"""with {v.PIXELS}, {v.CENTERS}, s as (select image_id, y // 4 * 1000 + x // 4 as label, avg(x) as xc, avg(y) as yc, bool_or(power(x - cx, 2) + power(y - cy, 2) <= 100) as inside from pixels join centers using (image_id) group by 1, 2)
select s.image_id, label::bigint as label from s join centers using (image_id) where case when image_id % 2 = 0 then inside else power(round_even(xc, 0) - cx, 2) + power(round_even(yc, 0) - cy, 2) <= 100 end""")
def _(spark, d):
    px = v.pixels(spark, d)
    seg = px.select("image_id", "y", "x", F.expr("cast(y div 4 * 1000 + x div 4 as long)").alias("label"))
    sources = seg.groupBy("image_id", "label").agg(F.avg("x").alias("xcentroid"), F.avg("y").alias("ycentroid"))
    regions = v.centers(px).select("image_id", F.lit("core").alias("region"), F.col("cx").alias("x0"), F.col("cy").alias("y0"), F.lit(0.0).alias("r_in"), F.lit(10.0).alias("r_out"), F.lit(1.0).alias("pix_area"))
    return joins.sources_in_regions(sources, seg.where("image_id % 2 = 0"), filters.in_circle(px, regions).select("image_id", "region", "y", "x")).select("image_id", "label")


@query("agg47_availability", """with o as (select *, case o_orderstatus when 'O' then 'F150W' when 'F' then 'F090W' else 'F200W' end as f from orders) select o_custkey, count(*) as obs_count, string_agg(distinct f, ';' order by f) as filters,
string_agg(distinct o_orderpriority, ';' order by o_orderpriority) as programs, bool_or(f = 'F150W') as has_f150w, bool_or(f = 'F090W') as has_f090w, count(distinct o_orderkey) as n_obs_ids, bool_or(f = 'F150W') and bool_or(f = 'F090W') as recommended,
coalesce(string_agg(o_orderkey::varchar, ';' order by o_orderkey::varchar) filter (f = 'F150W'), '') as f150w_obsids, coalesce(string_agg('u' || o_orderkey, ';' order by 'u' || o_orderkey) filter (f = 'F090W'), '') as f090w_dataurls from o group by 1""")
def _(spark, d):
    o = v.table(spark, d, "orders").withColumns({"f": F.when(F.col("o_orderstatus") == "O", "f150w").when(F.col("o_orderstatus") == "F", "F090W").otherwise("F200W"), "dataURL": F.concat(F.lit("u"), F.col("o_orderkey").cast("string"))})
    got = catalog.availability(o.withColumn("f", F.upper("f")), ["o_custkey"], "f", "o_orderpriority", "o_orderkey")
    return got.select("o_custkey", "obs_count", "filters", "programs", "has_f150w", "has_f090w", "n_obs_ids", "recommended", "f150w_obsids", "f090w_dataurls")


@query("agg49_observations", "select o_orderstatus, count(*) as n_observations, count(distinct o_orderpriority) as n_o_orderpriority, string_agg(distinct o_orderpriority, ';' order by o_orderpriority) as o_orderpriority, count(distinct o_custkey % 7) as n_instrument, string_agg(distinct (o_custkey % 7)::varchar, ';' order by (o_custkey % 7)::varchar) as instrument from orders group by 1")
def _(spark, d):
    return catalog.observation_summary(v.table(spark, d, "orders").withColumn("instrument", F.col("o_custkey") % 7), ["o_orderpriority", "instrument"], ["o_orderstatus"])


@query("set2_membership", "select o_custkey as name, string_agg(distinct o_orderpriority, ';' order by o_orderpriority) as samples, string_agg(distinct 'http/' || o_orderpriority, ';' order by 'http/' || o_orderpriority) as urls, count(distinct o_orderpriority) as n_samples from orders group by 1")
def _(spark, d):
    return catalog.sample_membership(v.table(spark, d, "orders").select(F.col("o_orderpriority").alias("sample"), F.concat(F.lit("http/"), "o_orderpriority").alias("url"), F.array("o_custkey").alias("names")))


@query("agg36_reddening", """select p_partkey, case p_partkey % 3 when 0 then p_retailprice else p_size::double end as ebv, case when p_partkey % 2 = 0 then 0.5::double end as sigma_ebv,
concat_ws(';', case p_partkey % 3 when 0 then 'ebv_col=ext sandf mean' else 'ebv_col=ext sfd mean' end, case when p_partkey % 2 = 0 then 'sigma_col=ext sfd std' end) as ebv_columns from part""")
def _(spark, d):
    k = F.col("p_partkey")
    cells = [(F.lit("ext SFD mean"), F.col("p_size").cast("double")), (F.when(k % 3 == 0, F.lit("ext SandF mean")), F.col("p_retailprice")), (F.when(k % 2 == 0, F.lit("ext SFD std")), F.lit(0.5)), (F.lit("distance"), F.lit(9.0)), (F.lit("ext SandF value"), F.lit(-1.0))]
    rows = v.table(spark, d, "part").select("p_partkey", F.explode(F.array(*[F.struct(n.alias("column"), x.alias("value")) for n, x in cells])).alias("c")).select("p_partkey", "c.*").where("column is not null")
    return catalog.pick_reddening(rows, ["p_partkey"])


@query("agg37_psf", """select c_custkey, case c_custkey % 4 when 0 then 0.1 when 1 then 0.2 when 2 then c_nationkey / 100.0 else 0.0 end::double as sigma_psf, case c_custkey % 4 when 0 then 'supplied' when 1 then 'branches' when 2 then 'comparison' else 'missing' end as sigma_psf_status from customer""")
def _(spark, d):
    k = F.col("c_custkey") % 4
    c = v.table(spark, d, "customer")
    wanted = c.select(F.col("c_custkey").alias("galaxy"), F.lit(0.04).alias("kmin"), F.lit(0.25).alias("kmax"), F.lit(64).alias("realisations"), F.lit(2).alias("pad"))
    # the wanted window and settings, and others that must not count
    cells = [("DET_DIST", 0.04 + 1e-11, 64, F.lit(1.0)), ("DET_SAMP", 0.04, 64, 1 + F.col("c_nationkey") / 100), ("DET_SAMP", 0.04, 4, F.lit(9.0)), ("DET_SAMP", 0.05, 64, F.lit(9.0))]
    saved = c.where(k == 2).select(F.col("c_custkey").alias("galaxy"), F.explode(F.array(*[F.struct(F.lit(e).alias("psf_ext"), F.lit(lo).alias("kmin"), F.lit(0.25).alias("kmax"), F.lit(n).alias("realisations"), F.lit(2).alias("pad"), m.alias("mbar")) for e, lo, n, m in cells])).alias("s")).select("galaxy", "s.*")
    got = catalog.saved_psf_sigma(saved, wanted).withColumnRenamed("galaxy", "c_custkey")
    rows = c.select("c_custkey", F.when(k == 0, 0.1).alias("psf_supplied"), F.when(k <= 1, 0.2).alias("psf_branch")).join(got, "c_custkey", "left")
    return rounded(catalog.psf_sigma(rows).select("c_custkey", "sigma_psf", "sigma_psf_status"), 9)


@query("agg31_measurement_sigma", """select l_orderkey, l_linenumber, case when a is null and b is null then p else greatest(coalesce(a, b), coalesce(b, a)) end as sigma, case when a is null and b is null then case when p is null then 'none' else 'residual_proxy' end when b is null or a >= b then 'window_scatter' else 'fit_covariance' end as how
from (select *, nullif(l_discount, 0) as a, nullif(l_tax, 0) as b, case when l_linenumber > 1 then l_quantity end as p from lineitem)""")
def _(spark, d):
    s, how = stats.measurement_sigma("a", "b", "p")
    zero = F.lit(0.0)
    li = v.table(spark, d, "lineitem").withColumns({"a": F.nullif("l_discount", zero), "b": F.nullif("l_tax", zero), "p": F.when(F.col("l_linenumber") > 1, F.col("l_quantity"))})
    return li.select("l_orderkey", "l_linenumber", s.alias("sigma"), how.alias("how"))


@query("agg51_experiments", """select l_suppkey, round(sum(abs(l_discount - 0.05)), 4) as abs_residual_sum, count(*) as n_regions, max(case when l_linenumber = 1 then l_quantity end) as zero_cross_circle, max(case when l_linenumber = 2 then l_quantity end) as zero_cross_ellipse,
min(l_tax) as kmin, max(l_tax) as kmax from lineitem group by 1""")
def _(spark, d):
    li = v.table(spark, d, "lineitem").withColumn("resid_median", F.col("l_discount") - 0.05)
    crossings = li.where("l_linenumber <= 2").select("l_suppkey", F.when(F.col("l_linenumber") == 1, "circle").otherwise("ellipse").alias("shape"), F.col("l_quantity").alias("zero_x"))
    best = li.groupBy("l_suppkey").agg(F.struct(F.min("l_tax").alias("kmin"), F.max("l_tax").alias("kmax")).alias("recommended"))
    return rounded(catalog.experiment_metrics(li, ["l_suppkey"], crossings=crossings, recommended=best), 4)


@query("win14_decide", f"with {v.MEASUREMENTS}, k as (select galaxy, wnd, sigma, first(sigma) over w as b, row_number() over w as r from meas where region = 'inner' window w as (partition by galaxy order by wnd)) select galaxy, wnd, case when r = 1 then 'baseline' when round(sigma / b, 9) < 0.95 then 'keep' when round(sigma / b, 9) > 1.10 then 'reject' else 'neutral' end as decision from k")
def _(spark, d):
    return windows.decide(v.measurements(spark, d).where("region = 'inner'"), ["galaxy"], "wnd", "sigma").select("galaxy", "wnd", "decision")


@query("win14_decide_model", f"""with {v.MEASUREMENTS}, k as (select galaxy, wnd, round(sigma / first(sigma) over w, 9) as s, round(mbar / first(mbar) over w, 9) as q, row_number() over w as r from meas where region = 'inner' window w as (partition by galaxy order by wnd))
select galaxy, wnd, case when r = 1 then 'baseline' when q < 0.99 and s > 1.05 then 'sigma too poor' when q < 0.99 then 'residuals weaker' when q > 1.01 then 'residuals stronger' else 'residuals similar' end as reason, case when r > 1 and (q < 0.99 and s > 1.05 or q > 1.01) then 'reject' else 'keep' end as decision from k""")
def _(spark, d):
    return windows.decide_model(v.measurements(spark, d).where("region = 'inner'"), ["galaxy"], "wnd", "mbar", "sigma", 0.99, 1.01, 1.05).select("galaxy", "wnd", "reason", "decision")


# -- measurements --------------------------------------------------------------------------------------------------

@query("agg28_power_budget", """with q as (select o_orderkey, case when o_custkey % 11 > 0 then o_totalprice / 1e4 else -1.0 end as p0, case when o_custkey % 7 > 0 then 2.0 else 0.0 end as m, case when o_custkey % 5 > 0 then (o_custkey % 20)::double end as pr from orders), g as (select *, p0 > 0 and m > 0 as h, p0 > 0 and m > 0 and coalesce(p0 - pr > 0, false) as ok from q)
select o_orderkey, case when not p0 > 0 then 'bad raw P0' when not m > 0 then 'bad Imean' when pr is null then 'Pr is not finite' when p0 - pr <= 0 then 'non-positive corrected power' else '' end as failure_reason, ok as measurement_ok, case when h then round(p0 - pr, 6) end as P_fluc,
case when h then round(pr / p0, 6) end as Pr_over_P0, case when h then round(p0 / case when m > 0 then m end, 9) end as Pf_raw, case when ok then round((p0 - pr) / case when m > 0 then m end, 9) end as Pf, case when h then round(-2.5 * log10(case when h then p0 / m else 1 end) - 2.5 * log10(2.350443e-5 * 0.001 / 3631.0), 6) end as mbar_raw,
case when ok then round(-2.5 * log10(case when ok then (p0 - pr) / m else 1 end) - 2.5 * log10(2.350443e-5 * 0.001 / 3631.0), 6) end as mbar, case when ok then round(2.5 / ln(10) * 0.1 / case when ok then p0 - pr end, 4) end as mbar_sigma from g""")
def _(spark, d):
    k = F.col("o_custkey")
    o = v.table(spark, d, "orders").select("o_orderkey", F.when(k % 11 > 0, F.col("o_totalprice") / 1e4).otherwise(-1.0).alias("P0"), F.when(k % 7 > 0, 2.0).otherwise(0.0).alias("Imean"), F.when(k % 5 > 0, (k % 20).cast("double")).alias("Pr"), F.lit(0.001).alias("area"), F.lit(0.1).alias("P0_fit_sigma"))
    return rounded(fits.power_budget(o).select("o_orderkey", "failure_reason", "measurement_ok", "P_fluc", "Pr_over_P0", "Pf_raw", "Pf", "mbar_raw", "mbar", "mbar_sigma"), mbar_sigma=4, Pf=9, Pf_raw=9)


@query("agg40_intrinsic_scatter")
def _(spark, d):
    c = v.calibration(spark, d).withColumns({"y": F.col("y") / 5, "sigma": F.when(F.col("g") < "Brand#3", F.col("sigma") / 20).otherwise(F.col("sigma") * 10)})
    return rounded(fits.intrinsic_scatter(c, ["g"], 1, pivot=0.4), 5)


LIMITS = f"""{v.SOURCES}, lim as (select galaxy, region, min(mag_ab) + 2 as m_lim from sources where region % 5 > 0 group by all), f as (select galaxy, region, m_lim, least(floor((mag_ab - (m_lim - 1.5)) / 0.25), 5)::int as b from sources join lim using (galaxy, region) where mag_ab between m_lim - 1.5 and m_lim),
n as (select galaxy, region, b, count(*)::double as n, (b + 0.5) * 0.25 - 1.5 as x, log10(count(*) / (1000.0 * 0.25)) as y from f group by all),
s as (select galaxy, region, count(*) as k, sum(n) as t, sum(n) s0, sum(n * x) sx, sum(n * y) sy, sum(n * x * x) sxx, sum(n * x * y) sxy from n group by all),
g as (select *, case when k >= 3 and s0 * sxx - sx * sx > 0 then (s0 * sxy - sx * sy) / (s0 * sxx - sx * sx) end as gamma from s),
h as (select *, coalesce(gamma between 0.1 and 0.7, false) as ok, (sy - gamma * sx) / s0 as a from g), e as (select galaxy, region, sqrt(avg(power(y - a - gamma * x, 2))) as rmse from n join h using (galaxy, region) group by all)"""


@query("agg22_luminosity_function", f"""with {LIMITS} select r.galaxy, r.region, coalesce(k, 0) as lf_n_fit_bins, coalesce(t, 0)::bigint as lf_n_fit_sources, round(case when ok then gamma else 0.3 end, 6) as lf_gamma,
round(case when ok then power(10.0, a) else t * 0.3 * ln(10) / (1000.0 * (1 - power(10.0, -0.45))) end, 6) as lf_phi_mlim, case when ok then 'local_histogram' when k is null then 'fixed_gamma_no_local_norm' else 'local_window_norm_fixed_gamma' end as lf_fit_method,
case when ok then round(rmse, 6) end as lf_fit_rmse from (select distinct galaxy, region from sources) r left join h using (galaxy, region) left join e using (galaxy, region)""")
def _(spark, d):
    s = v.sources(spark, d)
    limits = s.where("region % 5 > 0").groupBy("galaxy", "region").agg((F.min("mag_ab") + 2).alias("m_lim"))
    areas = s.select("galaxy", "region").distinct().withColumn("area", F.lit(1000.0))
    return rounded(stats.fit_lf(s, limits, ["galaxy", "region"], areas))


@query("agg23_region_contaminants", """with r as (select c_custkey, c_nationkey as k, c_acctbal / 1000 as phi, 0.3 + (c_custkey % 6) / 10.0 as gamma, c_custkey % 4 as n_src, n_regionkey as g from customer join nation on n_nationkey = c_nationkey),
q as (select *, case when phi > 0 then phi when g < 3 then 2.0 end as p, coalesce(phi, 0) <= 0 and g < 3 as borrowed, case when g < 4 then 0.25 end as gpr from r), z as (select *, case when gamma < 0.8 then p / ((0.8 - gamma) * ln(10)) end as own from q)
select c_custkey, round(coalesce(own, gpr), 6) as Pr, case when borrowed then 'fit+global_phi' else 'fit' end as lf_fit_method, coalesce(nullif(concat_ws('; ', case when borrowed then 'used global LF normalization' end, case when own is null and gpr is not null then 'used global Pr fallback' end,
case when coalesce(own, gpr) is not null and n_src = 0 then 'no local detected sources; correction inherited from global reference' end), ''), 'local combined contaminant LF') as pr_note from z""")
def _(spark, d):
    c, n = v.table(spark, d, "customer"), v.table(spark, d, "nation")
    # a limit of the zero point itself has unit flux
    regions = c.join(n, n.n_nationkey == c.c_nationkey).select("c_custkey", F.col("n_regionkey").alias("g"), fn.ab_zeropoint(F.lit(0.001)).alias("m_lim"), (0.3 + (F.col("c_custkey") % 6) / 10.0).alias("lf_gamma"), (F.col("c_acctbal") / 1000).alias("lf_phi_mlim"), F.lit("fit").alias("lf_fit_method"), (F.col("c_custkey") % 4).alias("n_detected_sources"))
    whole = v.table(spark, d, "region").select(F.col("r_regionkey").alias("g"), F.when(F.col("r_regionkey") < 3, 2.0).alias("lf_phi_mlim"), F.when(F.col("r_regionkey") < 4, 0.25).alias("Pr"))
    return rounded(stats.region_contaminants(regions, whole, ["g"], 0.001).select("c_custkey", "Pr", "lf_fit_method", "pr_note"))


# -- pixels --------------------------------------------------------------------------------------------------------

@query("flt12_sigma_cap", f"""with {v.PIXELS}, {clipped_sql('pixels', 'image_id', 2.0, 3)}, s as (select image_id, median(value) - 2.0 * stddev_pop(value) as a, median(value) + 2.0 * stddev_pop(value) as z from c3 group by 1)
select image_id, count(*) filter (value < a or value > z) as n_changed, round(sum(greatest(a, least(z, value))), 6) as total from pixels join s using (image_id) group by 1""")
def _(spark, d):
    c = stats.sigma_cap(v.pixels(spark, d), ["image_id"], "value", 2.0, 3)
    return rounded(c.groupBy("image_id").agg(F.count_if("changed").alias("n_changed"), F.sum("capped").alias("total")))


@query("agg2_tile_background", f"""with {v.PIXELS}, t as (select image_id, y // 8 as ty, x // 8 as tx, value from pixels), {clipped_sql('t', 'image_id, ty, tx', 3.0, 5)}, m as (select image_id, ty, tx, median(value) as tile, count(*) as n from c5 group by all)
select image_id, ty, tx, tile, n_tile, round(median(b) over (partition by image_id), 6) as scalar, round(b, 6) as background from (
select m.image_id, m.ty::int as ty, m.tx::int as tx, round(max(m.tile), 6) as tile, max(m.n) as n_tile, median(o.tile) as b from m join m o on o.image_id = m.image_id and abs(o.ty - m.ty) <= 1 and abs(o.tx - m.tx) <= 1 group by all)""")
def _(spark, d):
    return rounded(stats.tile_background(v.pixels(spark, d), 8, 3))


def smoothed_sql(sigma: float, half: int, source: str = "pixels") -> str:
    """CTEs ending in sm(image_id, y, x, value, v): the image smoothed along x and then along y, normalised by the weights."""
    return f"""k as (select unnest(range(-{half}, {half} + 1)) as o), kw as (select o, exp(-0.5 * o * o / ({sigma} * {sigma})) / (select sum(exp(-0.5 * o * o / ({sigma} * {sigma}))) from k) as w from k),
sx as (select image_id, y, x + o as x, sum(value * w) v, sum(w) w from {source}, kw group by all), sy as (select image_id, y + o as y, x, sum(v * kw.w) v, sum(sx.w * kw.w) w from sx, kw group by all), sm as (select p.image_id, p.y, p.x, value, v / w as v from {source} p join sy using (image_id, y, x))"""


@query("agg6_center", f"""with {v.PIXELS}, bright as (select * from pixels where image_id > 0), {smoothed_sql(2.0, 8, 'bright')}, q as (select image_id, quantile_cont(v, 0.995) as t, min(v) as lo, arg_max(x, v) as mx, arg_max(y, v) as my from sm group by 1),
w as (select image_id, count(*) as n, sum((v - lo + 1e-12) * x) / sum(v - lo + 1e-12) as wx, sum((v - lo + 1e-12) * y) / sum(v - lo + 1e-12) as wy from sm join q using (image_id) where v >= t group by 1), f as (select image_id, (max(x) + 1) / 2.0 as fx, (max(y) + 1) / 2.0 as fy from pixels group by 1)
select image_id, coalesce(n, 0) as n_bright, round(coalesce(case when n >= 17 then wx else mx end, fx), 4) as cx, round(coalesce(case when n >= 17 then wy else my end, fy), 4) as cy from f left join q using (image_id) left join w using (image_id)""")
def _(spark, d):
    px = v.pixels(spark, d).withColumn("value", F.when(F.col("image_id") > 0, F.col("value")))
    soft = px.select("image_id", "y", "x").join(pixels.smooth(px, 2.0).select("image_id", "y", "x", "smoothed"), ["image_id", "y", "x"], "left")
    return rounded(stats.guess_center(soft, least=17), 4)


@query("agg11_overlap_notes", f"""with {v.PIXELS}, p as (select image_id, x, value as a, value * value - 0.5 as b from pixels), r as (select image_id, (floor(x / 8.0) + 0.5) * 8.0 as r_mid, abs(median(a) - median(b)) as s, median(a) as one from p group by image_id, floor(x / 8.0) having count(*) >= 10),
i as (select image_id, median(a - b) as im, avg(a - b) as ia from p where x <= 40 group by 1), s as (select image_id, median(s) filter (r_mid <= 20) as ina, median(s) filter (r_mid >= 2.0 / 3 * 40) as outa, median(one) as sc from r where r_mid <= 40 group by 1)
select image_id, round(im, 6) as inside_median, round(ia, 6) as inside_mean, round(ina, 6) as inner_abs, round(outa, 6) as outer_abs, case when im > 0 then 'positive' when im < 0 then 'negative' else 'zero' end as inside_sign, ina > 0.01 * greatest(sc, 1e-12) as visible_inside,
case when outa > 1.25 * greatest(ina, 1e-12) then 'grows outwards' when outa < 0.8 * greatest(ina, 1e-12) then 'weakens outwards' else 'comparable' end as growth from i join s using (image_id)""")
def _(spark, d):
    px = v.pixels(spark, d).withColumn("other", F.col("value") * F.col("value") - 0.5)
    profile = catalog.overlap_profile(px, ["image_id"], "x", "value", "other", 8.0)
    edges = px.select("image_id").distinct().withColumn("edge", F.lit(40.0))
    return rounded(catalog.overlap_notes(px, profile, edges, ["image_id"], "x", "value", "other"))


@query("agg16_scan_rings", f"""with {v.PIXELS}, {v.CENTERS}, q as (select image_id, value, value * value as model, sqrt(power(x - cx, 2) + power(y - cy, 2)) as r from pixels join centers using (image_id)), k as (select unnest(range(0, 8))::int as ring), z as (select q.*, ring from q join k on r >= 2 + 4 * ring and r < 10 + 4 * ring),
b as (select image_id, ring, quantile_cont(value, 0.05) as a, quantile_cont(value, 0.95) as b, avg(model) as m from z group by all) select image_id, ring, count(*) as n_core, case when count(*) >= 20 then round(var_pop(value) / max(m), 6) end as pf from z join b using (image_id, ring) where value between a and b group by all""")
def _(spark, d):
    px = v.pixels(spark, d)
    return rounded(stats.scan_rings(px.withColumn("model", F.col("value") * F.col("value")), v.centers(px), 2.0, 30.0, 4.0, 8.0, 0.001, least=20).select("image_id", "ring", "n_core", "pf"))


@query("agg16_frame_rings", f"""with {v.PIXELS_BIG}, c as (select image_id, max(x) as mx, max(y) as my from big group by 1), r as (select image_id, greatest(60, least(sqrt(100 * 100 + 90 * 90), sqrt(power(mx - 100, 2) + 90 * 90), sqrt(100 * 100 + power(my - 90, 2)), sqrt(power(mx - 100, 2) + power(my - 90, 2))) - 20) as stop from c),
k as (select image_id, unnest(range(0, greatest(ceil((stop - 30) / 20)::int, 1)))::int as ring from r), z as (select image_id, ring, value, 1.0 + x as model from big join k using (image_id) where sqrt(power(x - 100, 2) + power(y - 90, 2)) >= 30 + 20 * ring and sqrt(power(x - 100, 2) + power(y - 90, 2)) < 90 + 20 * ring),
b as (select image_id, ring, quantile_cont(value, 0.05) as a, quantile_cont(value, 0.95) as b, avg(model) as m from z group by all) select image_id, ring, (30 + 20 * ring)::double as r_in, (90 + 20 * ring)::double as r_out, count(*) as n_core, round(var_pop(value) / max(m), 2) as pf from z join b using (image_id, ring) where value between a and b group by all having count(*) >= 100""")
def _(spark, d):
    px = v.pixels_big(spark, d).withColumn("model", 1.0 + F.col("x"))
    centers = px.select("image_id").distinct().withColumns({"cx": F.lit(100.0), "cy": F.lit(90.0)})
    return rounded(stats.scan_frame_rings(px, centers, 0.001).where("n_core >= 100").select("image_id", "ring", "r_in", "r_out", "n_core", "pf"), 2)


@query("agg17_drop_counters", f"""with {v.PIXELS}, s as (select image_id, case when x < 8 then y // 8 * 1000 + 900 else y // 4 * 1000 + x // 4 end as label, count(*) as n, sum(value - 0.3) as f, sum(greatest(value - 0.3, 0)) as p from pixels group by all)
select image_id, count(*) filter (n <= 60 and (f > 0 or p > 0)) as n_kept, count(*) filter (n > 60) as n_too_large, count(*) filter (n <= 60 and not (f > 0 or p > 0)) as n_not_positive, 0::bigint as n_no_magnitude from s group by 1""")
def _(spark, d):
    px = v.pixels(spark, d).withColumn("value", F.col("value") - 0.3)
    seg = px.select("image_id", "y", "x", F.expr("cast(if(x < 8, y div 8 * 1000 + 900, y div 4 * 1000 + x div 4) as long)").alias("label"))
    return stats.drop_counters(stats.labelled_sources(px, seg, 0.001, 60), ["image_id"])


COLORS = f"{v.PIXELS}, pairs as (select image_id, value as v150, value * (1.5 + x / 100.0) as v090 from pixels where value > 0)"

def _color_sql() -> str:
    def bounds(c: str) -> str:
        text = clipped_sql("pairs", "image_id", 3.0, 5, c)
        for i in range(5, -1, -1):
            text = text.replace(f"c{i} ", f"{c}c{i} ").replace(f"c{i}.", f"{c}c{i}.").replace(f"b{i} ", f"{c}b{i} ")
        return text

    limits = lambda c: f"(select image_id, max(lo) as lo, min(hi) as hi from ({' union all '.join(f'select * from {c}b{i}' for i in range(1, 6))}) group by 1)"
    return f"""with {COLORS}, {bounds('v150')}, {bounds('v090')}, l150 as {limits('v150')}, l090 as {limits('v090')},
k as (select image_id, v150, v090, -2.5 * log10(v090 / v150) as c from pairs join l150 a using (image_id) join l090 b using (image_id) where v150 between a.lo and a.hi and v090 between b.lo and b.hi and v150 > 0 and v090 > 0),
m as (select image_id, count(*) as n, -2.5 * log10(median(v090) / median(v150)) as color, median(c) as mc from k group by 1), d as (select image_id, 1.4826 * median(abs(c - mc)) as mad from k join m using (image_id) group by 1)
select image_id, n as n_color, case when n >= 1500 then round(color, 6) end as color, case when n >= 1500 then round(mad, 6) end as color_mad, case when n >= 1500 then round(mad / sqrt(n), 6) end as color_sem, case when n >= 1500 then '' else 'too few pixels' end as note from m join d using (image_id)"""


@query("agg33_annulus_color", _color_sql())
def _(spark, d):
    px = v.pixels(spark, d).where("value > 0").select("image_id", F.col("value").alias("v150"), (F.col("value") * (1.5 + F.col("x") / 100)).alias("v090"))
    return rounded(stats.annulus_color(px, ["image_id"], least=1500))


@query("agg33_coarse_color", f"with {v.PIXELS} select image_id, count(*) as n_color, round(-2.5 * log10(median(value + 1 + x / 100.0) / median(value + 1)), 6) as color from pixels group by 1")
def _(spark, d):
    px = v.pixels(spark, d).select("image_id", (F.col("value") + 1).alias("v150"), (F.col("value") + 1 + F.col("x") / 100).alias("v090"))
    return rounded(stats.coarse_color(px, ["image_id"]))


@query("win1_zones", f"""with {v.PIXELS}, {v.CENTERS}, w as (select image_id, cx, cy, unnest(range(0, 4)) as k from centers), z as (select p.image_id, k as win, value, x % 5 = 0 as masked, value * value as model, sqrt(power((x - cx) * cos(0.3) + (y - cy) * sin(0.3), 2) + power(((y - cy) * cos(0.3) - (x - cx) * sin(0.3)) / 0.8, 2)) as r from pixels p join w using (image_id)),
i as (select * from z where r between 2.01 + 4 * win and 10.03 + 4 * win), s as (select image_id, win, count(*) as n_zone, count(*) filter (not masked and model > 0) as n_use, avg(masked::int) as mf, avg(model) filter (not masked and model > 0) as m, quantile_cont(value, 0.05) filter (not masked and model > 0) as a, quantile_cont(value, 0.95) filter (not masked and model > 0) as b from i group by all)
select image_id, win as "window", max(n_zone) as n_zone, max(n_use) as n_use, round(max(mf), 6) as mask_fraction, round(max(m), 6) as i_mean, count(*) as n_core, round(var_pop(value), 6) as var_core, round(-2.5 * log10(var_pop(value) / max(m)) - 2.5 * log10(2.350443e-5 * 0.001 / 3631.0), 5) as mbar from i join s using (image_id, win) where not masked and model > 0 and value between a and b and n_use >= 100 group by all having count(*) >= 50""")
def _(spark, d):
    px = v.pixels(spark, d).withColumns({"masked": F.col("x") % 5 == 0, "model": F.col("value") * F.col("value")})
    w = v.centers(px).withColumn("window", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long"))))
    w = w.select("image_id", "window", (2.01 + 4 * F.col("window")).alias("x_first"), (10.03 + 4 * F.col("window")).alias("x_last"), F.col("cx").alias("x0"), F.col("cy").alias("y0"), F.lit(0.2).alias("eps"), F.lit(0.3).alias("pa"))
    got = windows.window_zones(w, px, ["image_id"], 0.001, 100, 50)
    return rounded(got.select("image_id", "window", "n_zone", "n_use", "mask_fraction", "i_mean", "n_core", "var_core", "mbar"), mbar=5)


@query("num5_big_labels", f"with {v.PIXELS}, s as (select image_id, y, x, case when value > 0.1 then 1 else y * 64 + x + 2 end as label from pixels), n as (select image_id, label, count(*) n from s group by all), f as (select image_id, count(*) as t from pixels group by 1) select image_id, y, x from s join n using (image_id, label) join f using (image_id) where n <= 0.005 * t")
def _(spark, d):
    px = v.pixels(spark, d)
    seg = px.select("image_id", "y", "x", F.when(F.col("value") > 0.1, 1).otherwise(F.col("y") * 64 + F.col("x") + 2).alias("label"))
    return pixels.drop_big_labels(seg, px.groupBy("image_id").agg(F.count("*").alias("n_pix"))).select("image_id", "y", "x")


@query("num6_square", f"with {v.PIXELS}, m as (select * from pixels where value > 0.35), o as (select unnest(range(-2, 3)) as dy), q as (select a.dy, b.dy as dx from o a, o b), g as (select distinct image_id, y + dy as y, x + dx as x from m, q) select p.image_id, p.y, p.x from pixels p join g using (image_id, y, x)")
def _(spark, d):
    px = v.pixels(spark, d)
    return pixels.dilate(px.where("value > 0.35"), px, 2, "square").select("image_id", "y", "x")


@query("num9_psf", f"""with {v.PIXELS}, s as (select image_id, y % 9 as y, x % 7 as x, sum(greatest(value, 0)) as v from pixels where image_id % 2 = 0 or value < 0 group by all), t as (select image_id, sum(v) as t, max(y) + 1 as py, max(x) + 1 as px from s group by 1)
select image_id, (y + 10 - py // 2)::int as y, (x + 2 - px // 2)::int as x, round(v / t, 9) as value from s join t using (image_id) where t > 0 and y + 10 - py // 2 between 0 and 19 and x + 2 - px // 2 between 0 and 4""")
def _(spark, d):
    cube = v.pixels(spark, d).select("image_id", (F.col("y") % 9).alias("y"), (F.col("x") % 7).alias("x"), F.when((F.col("image_id") % 2 == 0) & (F.col("value") < 0), float("nan")).otherwise(F.greatest("value", F.lit(0.0))).alias("value"), (F.col("image_id") % 2 == 0).alias("even"))
    psf = cube.where("even or value = 0").drop("even")
    frames = psf.select("image_id").distinct().withColumns({"ny": F.lit(20), "nx": F.lit(5)})
    return rounded(pixels.pad_psf(pixels.normalise_psf(psf), frames), 9)


#: The Fourier transform of whole images by rows and then by columns: dft(image_id, ky, kx, fy, fx, power).
DFT = f"""{v.PIXELS}, sz as (select image_id, max(y) + 1 as ny, 64 as nx, count(*) as n, avg(value) as m from pixels group by 1), kx as (select unnest(range(0, 64)) as kx),
rowf as (select image_id, y, kx, sum((value - m) * cos(-2 * pi() * kx * x / 64)) as re, sum((value - m) * sin(-2 * pi() * kx * x / 64)) as im from pixels join sz using (image_id), kx group by all), ky as (select image_id, unnest(range(0, ny)) as ky from sz),
colf as (select image_id, ky, kx, sum(re * cos(-2 * pi() * ky * y / ny) - im * sin(-2 * pi() * ky * y / ny)) as re, sum(re * sin(-2 * pi() * ky * y / ny) + im * cos(-2 * pi() * ky * y / ny)) as im from rowf join ky using (image_id) join sz using (image_id) group by all),
dft as (select image_id, ky, kx, case when 2 * ky < ny then ky else ky - ny end / ny::double as fy, case when 2 * kx < nx then kx else kx - nx end / nx::double as fx, (re * re + im * im) / n as power from colf join sz using (image_id))"""


def radial_sql(edges: int, least: int) -> str:
    return f"""pk as (select image_id, floor(sqrt(fx * fx + fy * fy) / (top / {edges - 1}))::int as kbin, median(power) as power, count(*) as n, max(top) as top from dft join (select image_id, max(sqrt(fx * fx + fy * fy)) as top from dft group by 1) using (image_id)
where sqrt(fx * fx + fy * fy) > 0 and sqrt(fx * fx + fy * fy) < top group by 1, 2 having count(*) >= {least})"""


@query("num1_periodogram", f"with {DFT} select image_id, ky::int as ky, kx::int as kx, round(power, 6) as power from dft")
def _(spark, d):
    return rounded(spectra.periodogram(v.pixels(spark, d)).select("image_id", "ky", "kx", "power"))


@query("agg24_radial_power", f"with {DFT}, {radial_sql(20, 10)} select image_id, kbin, round(power, 6) as power, n, round((kbin + 0.5) * top / 19, 6) as k from pk")
def _(spark, d):
    return rounded(spectra.radial_periodogram(v.pixels(spark, d), "image_id", 20, 10))


@query("agg24_parseval", f"""with {DFT}, {radial_sql(20, 11)}, va as (select image_id, var_pop(value) as v from pixels group by 1), me as (select image_id, avg(power) as p from dft group by 1), sc as (select pk.image_id, (kbin + 0.5) * top / 19 as k, power * v / p as power from pk join va using (image_id) join me using (image_id)),
tz as (select image_id, (k - lag(k) over w) * (power + lag(power) over w) / 2 as a from sc window w as (partition by image_id order by k)), it as (select image_id, sum(a) as i from tz group by 1) select image_id, round(k, 6) as k, round(power / i, 5) as power from sc join it using (image_id)""")
def _(spark, d):
    return rounded(spectra.unit_area(spectra.parseval_power(v.pixels(spark, d), "image_id", 20), ["image_id"]).select("image_id", "k", "power"), k=6, power=5)


@query("agg25_expectation_median", f"with {v.PIXELS} select image_id, x as kbin, round(median(value), 6) as power, round(median(x / 64.0), 6) as k, count(*) as n_realisations from pixels group by 1, 2")
def _(spark, d):
    spec = v.pixels(spark, d).select("image_id", F.col("y").alias("realisation"), F.col("x").alias("kbin"), (F.col("x") / 64).alias("k"), F.col("value").alias("power"))
    return rounded(spectra.expectation_median(spec, ["image_id"]))


LOW_K = f"""{DFT}, {radial_sql(40, 5)}, e as (select image_id, (kbin + 0.5) * top / 39 as k, power as p, 1 / (0.1 + (kbin + 0.5) * top / 39) as e from pk), wn as (select unnest([0.05, 0.1])::double as kmin, unnest([0.4, 0.5])::double as kmax),
ft as (select image_id, kmin, kmax, regr_slope(p, e) as p0, regr_intercept(p, e) as p1, count(*) as n from e join wn on k between kmin and kmax where e > 0 and p > 0 group by all having count(*) >= 5 and regr_slope(p, e) > 0)"""


def _low_k(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    pk = spectra.radial_periodogram(v.pixels(spark, d), "image_id", 40, 5)
    ek = pk.select("image_id", "k", (1 / (0.1 + F.col("k"))).alias("power"))
    return pk, ek, spectra.window_fits(pk, ek, ["image_id"], [(0.05, 0.4), (0.1, 0.5)], 5)


@query("agg29_k_diagnostic", f"with {LOW_K} select image_id, kmin, kmax, count(*) as n_low_bins, round(avg(p - p0 * e - p1), 5) as low_mean_delta, round(median(p - p0 * e - p1), 5) as low_median_delta from e join ft using (image_id) where k < kmin group by all")
def _(spark, d):
    return rounded(spectra.k_diagnostic(*_low_k(spark, d), ["image_id"]), 5)


@query("agg29_low_k_table", f"with {LOW_K}, o as (select *, row_number() over (partition by image_id order by k) as bin from e) select image_id, kmin, kmax, bin::int as bin, round(k, 5) as k, round(p, 5) as p, round(e, 5) as e, round(p0 * e + p1, 5) as fit, round(p - p0 * e - p1, 5) as delta, round(p - p1, 5) as p_less_p1, round(p0 * e, 5) as p0_e from o join ft using (image_id) where bin <= 15")
def _(spark, d):
    return rounded(spectra.low_k_table(*_low_k(spark, d), ["image_id"]), 5)


@query("num7_model", f"""with {v.PIXELS}, {v.CENTERS}, rr as (select p.image_id, y, x, value, sqrt(power(x - cx, 2) + power(y - cy, 2)) as r from pixels p join centers using (image_id)),
ring as (select image_id, floor(r / 2.0) as ring, median(value) as intens from rr group by all having count(*) >= 20), node as (select image_id, (ring + 0.5) * 2.0 as sma, intens from ring where image_id in (select image_id from rr group by 1 having count(*) >= 100) and (image_id > 0 or (ring + 0.5) * 2.0 < 5)),
rich as (select image_id from node group by 1 having count(*) >= 5), q as (select distinct image_id, round(r, 2) as rq from rr where image_id in (select image_id from rich)),
lo as (select q.image_id, rq, n.sma as a, n.intens as va from q asof left join node n on q.image_id = n.image_id and q.rq >= n.sma), hi as (select l.*, n.sma as b, n.intens as vb from lo l asof left join node n on l.image_id = n.image_id and l.rq <= n.sma),
m as (select image_id, rq, case when a is null or b is null then coalesce(va, vb) when a = b then va else va + (vb - va) * (rq - a) / (b - a) end as model from hi),
poor as (select * from pixels where image_id not in (select image_id from rich)), {smoothed_sql(1.0, 4, 'poor')},
u as (select rr.image_id, y, x, model, value - model as residual from rr join m on m.image_id = rr.image_id and m.rq = round(rr.r, 2) union all select image_id, y, x, v, value - v from sm)
select image_id, y, x, round(model, 6) as model, round(residual, 6) as residual from u""")
def _(spark, d):
    px = v.pixels(spark, d)
    nodes = stats.radial_profile(px, v.centers(px), 2.0, 20, 100).select("image_id", F.col("r_mid").alias("sma"), F.col("intensity").alias("intens"))
    geom = v.centers(px).select("image_id", F.col("cx").alias("x0"), F.col("cy").alias("y0"), F.lit(0.0).alias("pa"), F.lit(1.0).alias("q"))
    some = nodes.where("image_id > 0 or sma < 5")  # the first image has too few nodes
    return rounded(pixels.model_or_smooth(filters.with_r_ell(px, geom), some, sigma=1.0).select("image_id", "y", "x", "model", "residual"))


@query("win10_extend_nodes")
def _(spark, d):
    px = v.pixels(spark, d)
    prof = stats.radial_profile(px, v.centers(px), 2.0, 20, 100).join(v.centers(px), "image_id")
    k = F.col("r_mid")
    nodes = prof.select("image_id", k.alias("sma"), ((F.col("intensity") + 1) * F.exp(-k / 50)).alias("intens"), (F.col("cx") + 0.004 * k + F.col("intensity")).alias("x0"), (F.col("cy") + k).alias("y0"), (0.88 + F.col("intensity") / 100 + k / 5000).alias("eps"), (0.1 - 0.0001 * k).alias("pa"), F.when(k > 10, k / 40).alias("real_data_frac"))
    return rounded(windows.extend_nodes(nodes, nodes.groupBy("image_id").agg((F.max("sma") + 30 + F.col("image_id") % 7).alias("r_needed")), ["image_id"]), 6)


# -- streams -------------------------------------------------------------------------------------------------------

#: Hours that events may be late, and that a target waits from its first poll on.
LATE_H, WAIT_H = 2, 24


@query("str1_readiness", f"""with e as (select user_id::varchar || '#' || strftime(ts, '%Y-%m-%d') as target, user_id % 4 as kind, case when event_type in ('click', 'view') then 'f150w' else 'f090w' end as band, ts, event_id % 3 > 0 as readable,
row_number() over (partition by user_id, ts::date, event_type in ('click', 'view') order by ts) as poll, min(ts) over (partition by user_id, ts::date) as first, max(ts) over () - interval {LATE_H} hour as mark from events),
b as (select target, band, min(ts) filter (ts <= mark and readable and (kind <> 1 or poll >= 3)) as t, any_value(first) + interval {WAIT_H} hour as late, any_value(mark) as mark from e group by all),
r as (select target, any_value(late) as late, any_value(mark) as mark, case when count(t) = 2 then max(t) end as t from b group by 1)
select target, t is not null as ready, case when t is not null then 'all bands' else 'timeout' end as reason, coalesce(t, late) as "at" from r where t is not null or late <= mark""")
def _(spark, d):
    path = storage.folder(spark)
    raw = spark.readStream.schema(v.events(spark, d).schema).parquet(f"{d}/events.parquet*").withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", f"{LATE_H} hours")
    size = F.when(F.col("user_id") % 4 == 3, 199).otherwise(100).cast("long")
    expected = F.when(F.col("user_id") % 4 == 3, 200).when(F.col("user_id") % 4 != 1, 100).cast("long")
    band = F.when(F.col("event_type").isin("click", "view"), "f150w").otherwise("f090w")
    target = F.concat_ws("#", F.col("user_id").cast("string"), F.date_format("ts", "yyyy-MM-dd"))
    polls = raw.select(target.alias("target"), band.alias("band"), size.alias("size"), expected.alias("expected"), (F.col("event_id") % 3 > 0).alias("readable"), "ts")
    ready = readiness.ready_stream(polls, timeout_s=WAIT_H * 3600)
    readiness.run_to_end(spark, ready.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").outputMode("append"))
    return spark.read.schema(readiness.READY).parquet(f"{path}/out")


#: SQL: the words of a text.
WORDS = "list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"


def runs_sql(table: str, keep: str) -> str:
    """SQL: runs of two and three words of each text."""
    return " union all ".join(f"select {keep}, unnest(list_transform(range(1, len(w) - {k - 1} + 1), lambda i: array_to_string(w[i:i + {k - 1}], ' '))) as run from {table} where len(w) >= {k}" for k in (2, 3))


@query("agg48_aliases", f"""with b as (select item_id, {WORDS} as w from benchmark where text is not null), a as (select run as alias, min('item ' || item_id) as name from ({runs_sql('b', 'item_id')}) group by 1),
d as (select source, {WORDS} as w from documents where text is not null), p as (select name, source, count(*) as n from ({runs_sql('d', 'source')}) join a on run = alias group by all)
select name, sum(n)::bigint as mention_count, count(*) as n_articles, string_agg(source, ';' order by source) as articles from p group by 1""")
def _(spark, d):
    """All runs of two and three words of the items, some 10,000 at the checked size, stand for their items."""
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    w = F.filter(F.split(lower, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), lambda x: x != "")
    items = v.table(spark, d, "benchmark").where("text is not null").select("item_id", w.alias("w"))
    runs = [items.where(F.size("w") >= k).select("item_id", F.explode(F.expr(f"transform(sequence(1, size(w) - {k - 1}), i -> array_join(slice(w, i, {k}), ' '))")).alias("alias")) for k in (2, 3)]
    aliases = runs[0].union(runs[1]).select("alias", F.concat(F.lit("item "), F.col("item_id").cast("string")).alias("name"))
    return mentions.alias_mentions(v.table(spark, d, "documents"), aliases, "source")


@query("str2_merge_status", "select c_custkey from customer where c_custkey not in (select user_id from (select user_id, arg_max(event_type, (epoch_us(ts), event_type)) as s from events group by 1) where s = 'purchase')")
def _(spark, d):
    path = storage.folder(spark)
    raw = spark.readStream.schema(v.events(spark, d).schema).parquet(f"{d}/events.parquet*")
    readiness.run_to_end(spark, readiness.merge_status(raw, f"{path}/table", ["user_id"], "ts", "event_type", f"{path}/state"))
    status = readiness.read_status(spark, f"{path}/table").select(F.col("user_id").alias("c_custkey"), "event_type")
    return readiness.still_to_do(v.table(spark, d, "customer").select("c_custkey"), status, ["c_custkey"], "event_type", "purchase")


registry._sql["num1_periodogram_whole"] = registry._sql["num1_periodogram"]
