"""Queries of the photometric operators over the test tables, with the equivalent SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar as fn
from ..operators import catalog, filters, fits, joins, stats, windows
from ..sources import tables
from . import views as v

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f: Query) -> Query:
        _queries[name] = f
        if sql:
            _sql[name] = sql
        return f

    return keep


def queries() -> dict[str, Query]:
    from . import further_queries, pixel_queries  # noqa: F401  register themselves

    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    from . import further_queries, pixel_queries  # noqa: F401

    return dict(_sql)


def rounded(df: DataFrame, digits: int = 6, **other: int) -> DataFrame:
    """Doubles rounded, as sums depend on the order of rows."""
    return df.select(*[F.round(F.col(c), other.get(c, digits)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


# -- scalar functions ----------------------------------------------------------------------------------------------

@query("fn1_normalize_name", """select s_suppkey, case when kind <> '' then kind || ' ' || number else t end as name from (
  select s_suppkey, t, regexp_extract(t, '^(NGC|IC) ?0*([0-9]+)$', 1) as kind, regexp_extract(t, '^(NGC|IC) ?0*([0-9]+)$', 2) as number from (
  select s_suppkey, trim(regexp_replace(replace(upper(case when s_suppkey % 3 = 0 then 'ngc-00' || s_suppkey when s_suppkey % 3 = 1 then 'Ic ' || s_suppkey else s_name end), '-', ' '), '\\s+', ' ', 'g')) as t from supplier))""")
def _(spark, d):
    raw = F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit("ngc-00"), "s_suppkey")).when(F.col("s_suppkey") % 3 == 1, F.concat(F.lit("Ic "), "s_suppkey")).otherwise(F.col("s_name"))
    return v.table(spark, d, "supplier").select("s_suppkey", fn.normalize_name(raw).alias("name"))


@query("fn2_slug", "select p_partkey, substring(regexp_replace(regexp_replace(trim(p_name || ' / ' || p_type), '[^A-Za-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), 1, 80) as slug from part")
def _(spark, d):
    return v.table(spark, d, "part").select("p_partkey", fn.slug(F.concat("p_name", F.lit(" / "), "p_type")).alias("slug"))


@query("fn3_companion", "select p_partkey, 'jw' || p_partkey || '_F090W_i2d.fits' as raw, 'jw' || p_partkey || '_f090w_F150W.fits' as other from part")
def _(spark, d):
    p = v.table(spark, d, "part")
    return p.select("p_partkey", fn.companion(F.concat(F.lit("jw"), "p_partkey", F.lit("_F150W_i2d.fits")), other="F090W").alias("raw"), fn.companion(F.concat(F.lit("jw"), "p_partkey", F.lit("_F150W_F150W.fits"))).alias("other"))


@query("fn4_zeropoint_flux", "select l_orderkey, l_linenumber, round(-2.5 * log10(2.350443e-5 * nullif(l_tax, 0) / 3631.0), 6) as zp, round(power(10.0, -0.4 * (20 + l_discount - (-2.5 * log10(2.350443e-5 * nullif(l_tax, 0) / 3631.0)))), 3) as flux from lineitem")
def _(spark, d):
    return rounded(v.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", fn.ab_zeropoint("l_tax").alias("zp"), fn.flux_from_mag(20 + F.col("l_discount"), "l_tax").alias("flux")), flux=3)


@query("fn5_mbar", "select l_orderkey, l_linenumber, case when l_quantity - l_discount * 100 > 0 then round(-2.5 * log10(case when l_quantity - l_discount * 100 > 0 then l_quantity - l_discount * 100 end) + (-2.5 * log10(2.350443e-5 * (0.001 + l_tax) / 3631.0)), 6) end as mbar from lineitem")
def _(spark, d):
    return rounded(v.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", fn.mbar("l_quantity", F.col("l_discount") * 100, 0.001 + F.col("l_tax")).alias("mbar")))


@query("fn6_distance", "select o_orderkey, round(power(10.0, (25 + o_totalprice / 1e5 - 25) / 5), 6) as mpc, round(power(10.0, (o_totalprice / 1e6) / 5) - 1, 6) as frac from orders")
def _(spark, d):
    return rounded(v.table(spark, d, "orders").select("o_orderkey", fn.mu_to_mpc(25 + F.col("o_totalprice") / 1e5).alias("mpc"), fn.distance_fraction(F.col("o_totalprice") / 1e6).alias("frac")))


@query("fn7_quadrature", "select c_custkey, case when c_acctbal >= 0 or c_nationkey > 0 then round(sqrt(case when c_acctbal >= 0 then c_acctbal * c_acctbal else 0 end + case when c_nationkey > 0 then c_nationkey * c_nationkey else 0 end), 4) end as q from customer")
def _(spark, d):
    return rounded(v.table(spark, d, "customer").select("c_custkey", fn.quadrature("c_acctbal", F.when(F.col("c_nationkey") > 0, F.col("c_nationkey"))).alias("q")), 4)


@query("fn8_parse_truthy", "select e.event_id, try_cast(json_extract_string(props, '$.k') as double) as k, event_type = 'click' as t from events e")
def _(spark, d):
    e = v.events(spark, d)
    return e.select("event_id", fn.parse(F.get_json_object("props", "$.k")).alias("k"), fn.truthy(F.when(F.col("event_type") == "click", "True").otherwise("False")).alias("t"))


@query("fn9_text_cell", "select s_suppkey, printf('%.3f', s_acctbal) || ' ± ' || printf('%.3f', s_nationkey / 7.0) as cell from supplier")
def _(spark, d):
    return v.table(spark, d, "supplier").select("s_suppkey", fn.fmt_pm("s_acctbal", F.col("s_nationkey") / 7.0).alias("cell"))


@query("fn10_effective_flag", "select c_custkey, case c_nationkey % 4 when 0 then 'clean' when 1 then 'clean' when 2 then 'sersic_fit_warning' else 'clean' end as flag from customer")
def _(spark, d):
    raw = F.element_at(F.array(F.lit(""), F.lit("truncated_file_warning"), F.lit("truncated_file_warning;sersic_fit_warning"), F.lit("clean")), (F.col("c_nationkey") % 4 + 1).cast("int"))
    return v.table(spark, d, "customer").select("c_custkey", fn.effective_flag(raw).alias("flag"))


@query("fn11_expected_size", "select p_partkey, case when p_size % 2 = 0 then p_size::bigint when p_size % 3 = 0 then (p_size * 1024)::bigint end as size from part")
def _(spark, d):
    p = v.table(spark, d, "part")
    return p.select("p_partkey", fn.expected_size(F.when(F.col("p_size") % 2 == 0, F.col("p_size").cast("string")).otherwise("x"), F.when(F.col("p_size") % 3 == 0, F.col("p_size").cast("string"))).alias("size"))


# -- sources and sinks ---------------------------------------------------------------------------------------------

@query("src5_manifest", "select o_orderkey::varchar as data_uri, o_orderstatus as folder_tag, o_orderpriority as category, o_custkey::varchar as file_name from orders where o_orderkey % 5 > 2")
def _(spark, d):
    o = v.table(spark, d, "orders")
    four = F.concat_ws("\t", F.col("o_orderkey").cast("string"), "o_orderstatus", "o_orderpriority", F.col("o_custkey").cast("string"))
    line = F.when(F.col("o_orderkey") % 5 == 0, F.lit("")).when(F.col("o_orderkey") % 5 == 1, F.concat(F.lit("# "), four)).when(F.col("o_orderkey") % 5 == 2, F.concat(four, F.lit("\tx"))).otherwise(four)
    return tables.parse_manifest(o.select(line.alias("value")))


@query("src8_extract_values", "select page_id, try_cast(nullif(regexp_extract(html, '([0-9]+)', 1), '') as double) as number, case when regexp_extract(html, '([0-9]+)', 1) = '' then 'number' else '' end as missing from pages")
def _(spark, d):
    return tables.extract_values(v.table(spark, d, "pages"), {"number": "([0-9]+)"}, "html").select("page_id", "number", "missing")


@query("snk1_union_of_keys", "select n_nationkey, n_name, null::int as r_regionkey, null as r_name from nation union all select null, null, r_regionkey, r_name from region")
def _(spark, d):
    return tables.union_of_keys([v.table(spark, d, "nation").drop("n_regionkey"), v.table(spark, d, "region")])


@query("snk2_upsert", "select c_custkey, case when c_custkey % 4 = 0 then c_acctbal + 1 else c_acctbal end as c_acctbal from customer")
def _(spark, d):
    c = v.table(spark, d, "customer").select("c_custkey", "c_acctbal")
    return tables.upsert_cache(c, c.where("c_custkey % 4 = 0").withColumn("c_acctbal", F.col("c_acctbal") + 1), "c_custkey")


# -- filters -------------------------------------------------------------------------------------------------------

@query("flt1_public_mosaic", "select o_orderkey from orders where o_orderstatus = 'O' and o_custkey % 5 >= 3 and o_orderkey % 2 = 0")
def _(spark, d):
    o = v.table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "O", "public").otherwise("EXCLUSIVE").alias("dataRights"), (F.col("o_custkey") % 5).cast("string").alias("calib_level"), F.when(F.col("o_orderkey") % 2 == 0, "mast:x_i2d.fits").otherwise("mast:x_cal.fits").alias("dataURL"))
    return o.where(filters.is_public_mosaic()).select("o_orderkey")


@query("flt2_products", "select p_partkey from part where p_size % 3 = 0 and p_partkey % 2 = 0 and p_size % 2 = 0")
def _(spark, d):
    name = F.concat(F.lit("jw"), F.lpad((F.col("p_partkey") % 100000).cast("string"), 5, "0"), F.when(F.col("p_size") % 2 == 0, "-o001_t_").otherwise("-c1001_t_"), F.when(F.col("p_size") % 3 == 0, "i2d.fits").otherwise("cal.fits"))
    p = v.table(spark, d, "part").select("p_partkey", F.regexp_replace(name, "_t_", "_").alias("file_name"), F.when(F.col("p_partkey") % 2 == 0, "F150W").otherwise("F200W").alias("filters"), F.lit("obs").alias("obs_id"), F.lit("science").alias("product_type"))
    return filters.filter_products(p, 3, ["F150W", "F090W"]).select("p_partkey")


@query("flt4_filter_key", "select c_custkey, case when c_custkey % 2 = 0 then 'F162M' else 'F150W' end as key from customer")
def _(spark, d):
    return v.table(spark, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, "f162m").otherwise("CLEAR").alias("PUPIL"), F.lit("F150W ").alias("FILTER")).select("c_custkey", filters.filter_key().alias("key"))


@query("flt13_mad_cut", """with m as (select l_suppkey, median(l_quantity) m from lineitem group by 1), a as (select l_suppkey, median(abs(l_quantity - m)) s from lineitem join m using (l_suppkey) group by 1),
k as (select l.*, l_quantity <= m + 1.5 * s as ok from lineitem l join m using (l_suppkey) join a using (l_suppkey)), n as (select l_suppkey, count(*) filter (ok) as alive from k group by 1)
select l_orderkey, l_linenumber from k join n using (l_suppkey) where ok or alive < 5""")
def _(spark, d):
    return filters.mad_quality_cut(v.table(spark, d, "lineitem"), ["l_suppkey"], ["l_quantity"]).select("l_orderkey", "l_linenumber")


@query("flt14_check_region", "select l_suppkey, count(*) as n, round(max(l_discount) - min(l_discount), 6) as value_range, round(stddev_pop(l_discount), 6) as std, count(*) >= 600 as passed, max(l_discount) - min(l_discount) > 0.2 as warn_range, stddev_pop(l_discount) < 1e-7 as warn_flat from lineitem group by 1")
def _(spark, d):
    return rounded(filters.check_region(v.table(spark, d, "lineitem"), ["l_suppkey"], "l_discount", least=600))


@query("flt15_splice", "select l_orderkey, l_linenumber, case when l_discount > 0 then l_discount else l_tax end as model from lineitem")
def _(spark, d):
    return v.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", filters.splice_models("l_discount", "l_tax").alias("model"))


# -- joins ---------------------------------------------------------------------------------------------------------

@query("jn1_assemble", """select s_suppkey as galaxy, round(s_acctbal - l.m, 4) as inner_outer_delta, case when n_nationkey % 2 = 0 then 'clean' else n_name end as quality_flag from supplier
join (select l_suppkey, avg(l_discount) as m from lineitem group by 1) l on l_suppkey = s_suppkey left join nation on n_nationkey = s_nationkey and s_nationkey < 20""")
def _(spark, d):
    s, n = v.table(spark, d, "supplier"), v.table(spark, d, "nation")
    results = s.select(F.col("s_suppkey").alias("galaxy"), F.col("s_acctbal").alias("mbar_inner"))
    errors = v.table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("galaxy")).agg(F.avg("l_discount").alias("mbar_outer"))
    targets = s.join(n, n.n_nationkey == s.s_nationkey).where("s_nationkey < 20").select(F.col("s_suppkey").alias("galaxy"), F.when(F.col("n_nationkey") % 2 == 0, " ").otherwise(F.col("n_name")).alias("warnings"))
    out = joins.assemble_paper(results, errors, targets)
    return rounded(out.select("galaxy", "inner_outer_delta", "quality_flag"), 4)


_sql["jn1_assemble"] = _sql["jn1_assemble"].replace("case when n_nationkey % 2 = 0 then 'clean' else n_name end", "case when n_nationkey is null or n_nationkey % 2 = 0 then 'clean' else n_name end")


@query("jn2_calibration_input", """select c_custkey as galaxy, round(c_acctbal / 1000 - o.mu, 3) as M_abs, round(sqrt(0.01 + o.s * o.s), 4) as sigma_M_abs, case when o.mu is null then 'none' when c_nationkey % 3 = 0 then 'clean' else 'flagged' end as fit_sample
from customer left join (select o_custkey, avg(o_totalprice) / 1e4 as mu, count(*) / 100.0 as s from orders group by 1) o on o_custkey = c_custkey where o.mu is not null
union all select c_custkey, null, 0.1, 'none' from customer where c_custkey not in (select o_custkey from orders)""")
def _(spark, d):
    paper = v.table(spark, d, "customer").select(F.col("c_custkey").alias("galaxy"), (F.col("c_acctbal") / 1000).alias("mbar"), F.lit(0.1).alias("sigma_mbar"), F.when(F.col("c_nationkey") % 3 == 0, "clean").otherwise("warn").alias("quality_flag"))
    lit = v.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("galaxy")).agg((F.avg("o_totalprice") / 1e4).alias("mu_lit"), (F.count("*") / 100.0).alias("sigma_mu_lit"))
    return rounded(joins.calibration_input(paper, lit).select("galaxy", "M_abs", "sigma_M_abs", "fit_sample"), M_abs=3, sigma_M_abs=4)


@query("jn3_merge_known", "select s_suppkey, case when s_suppkey % 2 = 0 then n_name else s_name end as name, n_nationkey::double as size from supplier join nation on n_nationkey = s_nationkey")
def _(spark, d):
    s, n = v.table(spark, d, "supplier"), v.table(spark, d, "nation")
    targets = s.select("s_suppkey", F.when(F.col("s_suppkey") % 2 == 0, "").otherwise(F.col("s_name")).alias("name"), F.lit(-1.0).alias("size"))
    known = s.join(n, n.n_nationkey == s.s_nationkey).select("s_suppkey", F.col("n_name").alias("name"), F.col("n_nationkey").cast("double").alias("size"))
    return joins.merge_known(targets, known, "s_suppkey", ["name"], ["size"])


@query("jn4_availability", """with r as (select o_custkey, o_orderstatus, o_totalprice, row_number() over (partition by o_custkey order by o_orderkey desc) k from orders), c as (select * from r where k = 1 and o_custkey % 2 = 0)
select c_custkey, case when c.o_custkey is not null then c.o_orderstatus else 'fresh' end as status, case when c.o_custkey is not null then 'cache' else 'fresh' end as availability_source from customer left join c on c.o_custkey = c_custkey""")
def _(spark, d):
    cands = v.table(spark, d, "customer").select("c_custkey")
    cache = v.table(spark, d, "orders").where("o_custkey % 2 = 0").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderstatus").alias("status"), F.col("o_orderkey").alias("file_rank"))
    return joins.attach_availability(cands, cache, cands.withColumn("status", F.lit("fresh")), "c_custkey", ["status"])


SKY = """t as (select s_suppkey, (s_suppkey * 37.77) % 360 as ra, (s_suppkey * 11.3) % 180 - 90 as dec from supplier), o as (select c_custkey, (c_custkey * 7.7) % 360 as ora, (c_custkey * 3.7) % 180 - 90 as odec from customer),
h as (select s_suppkey, c_custkey, degrees(2 * asin(sqrt(least(1, power(sin((radians(odec) - radians(dec)) / 2), 2) + cos(radians(dec)) * cos(radians(odec)) * power(sin((radians(ora) - radians(ra)) / 2), 2))))) as sep from t, o)"""


@query("jn6_cone_join", f"with {SKY} select s_suppkey, c_custkey, round(sep, 6) as separation from h where sep <= 1.5")
def _(spark, d):
    # decimals, as in the SQL: separations on the radius depend on the last bit
    at = lambda key, turn, n: F.expr(f"cast({key} as decimal(19, 0)) * {turn}BD % {n}BD")
    t = v.table(spark, d, "supplier").select("s_suppkey", at("s_suppkey", 37.77, 360).cast("double").alias("ra"), (at("s_suppkey", 11.3, 180) - 90).cast("double").alias("dec"))
    o = v.table(spark, d, "customer").select("c_custkey", at("c_custkey", 7.7, 360).cast("double").alias("ora"), (at("c_custkey", 3.7, 180) - 90).cast("double").alias("odec"))
    return rounded(joins.cone_join(t, o, 1.5).select("s_suppkey", "c_custkey", "separation"))


@query("jn8_interp_join", f"""with {v.PROFILE}, pts as (select distinct event_type, x + 0.25 as px from profile), b as (select event_type, x, y, lead(x) over (partition by event_type order by x) as x2, lead(y) over (partition by event_type order by x) as y2 from profile)
select p.event_type, px, round(case when x2 is not null then y + (y2 - y) * (px - x) / (x2 - x) end, 6) as interpolated from pts p asof left join b on b.event_type = p.event_type and p.px >= b.x""")
def _(spark, d):
    p = v.profile(spark, d)
    return rounded(joins.interp_join(p.select("event_type", (F.col("x") + 0.25).alias("px")), p, ["event_type"], "px", "x", "y"))


@query("jn9_near_join", f"with {v.MEASUREMENTS} select a.galaxy, a.wnd, round(a.mbar, 6) as mbar, round(b.mbar, 6) as other from meas a join meas b on a.galaxy = b.galaxy and a.wnd = b.wnd where a.region = 'inner' and b.region = 'outer'")
def _(spark, d):
    m = v.measurements(spark, d)
    a = m.where("region = 'inner'").select("galaxy", "wnd", (F.col("wnd") / 7.0).alias("kmin"), "mbar")
    b = m.where("region = 'outer'").select("galaxy", (F.col("wnd") / 7.0 + 2e-10).alias("kmin"), F.col("mbar").alias("other"))
    return rounded(joins.near_join(a, b, ["galaxy"], ["kmin"], 1e-9).select("galaxy", "wnd", "mbar", "other"))


def _branches(li: DataFrame) -> DataFrame:
    return li.select(F.col("l_suppkey").alias("galaxy"), F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("branch"), F.col("l_returnflag").alias("resid_source"), F.lit("m").alias("model_source"), F.col("l_linestatus").alias("psf_ext"), F.lit("o").alias("opd_path"), (F.col("l_linenumber") == 7).alias("uses_two_annuli"), F.log10("l_extendedprice").alias("mbar"))


@query("jn11_psf_branches", """with r as (select l_suppkey as galaxy, l_orderkey || '-' || l_linenumber as branch, l_returnflag as f, l_linestatus as s, log10(l_extendedprice) as m, first_value(l_orderkey || '-' || l_linenumber) over w as ref, first_value(l_returnflag) over w as rf, first_value(l_linestatus) over w as rs, first_value(log10(l_extendedprice)) over w as rm
from lineitem window w as (partition by l_suppkey order by case when l_linenumber = 7 then 1 else 2 end, l_orderkey || '-' || l_linenumber, l_extendedprice))
select galaxy, min(ref) as psf_branch_ref, round(max(abs(m - rm)) filter (branch <> ref and f = rf and s <> rs), 6) as sigma_psf, count(*) filter (branch <> ref and f = rf and s <> rs) as psf_branch_alt_count from r group by 1""")
def _(spark, d):
    return rounded(joins.psf_branch_sigma(_branches(v.table(spark, d, "lineitem"))))


@query("jn11_psf_branches_whole", """with r as (select l_suppkey as galaxy, l_orderkey || '-' || l_linenumber as branch, l_returnflag as f, l_linestatus as s, log10(l_extendedprice) as m, first_value(l_orderkey || '-' || l_linenumber) over w as ref, first_value(l_returnflag) over w as rf, first_value(l_linestatus) over w as rs, first_value(log10(l_extendedprice)) over w as rm
from lineitem window w as (partition by l_suppkey order by case when l_linenumber = 7 then 1 else 2 end, l_orderkey || '-' || l_linenumber, l_extendedprice))
select galaxy, min(ref) as psf_branch_ref, round(max(abs(m - rm)) filter (branch <> ref and f = rf and s <> rs), 6) as sigma_psf, count(*) filter (branch <> ref and f = rf and s <> rs) as psf_branch_alt_count from r group by 1""")
def _(spark, d):
    return rounded(joins.psf_branch_sigma(_branches(v.table(spark, d, "lineitem"))))


@query("jn12_delta", f"with {v.MEASUREMENTS} select a.galaxy, a.wnd, round(a.mbar - b.mbar, 6) as delta from meas a left join meas b on a.galaxy = b.galaxy and b.wnd = 4 and b.region = 'inner' where a.region = 'inner'")
def _(spark, d):
    m = v.measurements(spark, d).where("region = 'inner'").withColumn("kmin", F.col("wnd") / 100.0)
    return rounded(joins.delta_from_reference(m).select("galaxy", "wnd", "delta"))


@query("jn13_reconcile", "select o_orderkey, case when l.k is null then 'failed' when o_custkey % 3 = l.k % 3 then 'done' else 'size_mismatch' end as state from orders left join (select l_orderkey as k from lineitem where l_linenumber = 2) l on l.k = o_orderkey")
def _(spark, d):
    todo = v.table(spark, d, "orders").select("o_orderkey", (F.col("o_custkey") % 3).alias("size"))
    done = v.table(spark, d, "lineitem").where("l_linenumber = 2").select(F.col("l_orderkey").alias("o_orderkey"), (F.col("l_orderkey") % 3).alias("size"))
    return joins.reconcile(todo, done, "o_orderkey").select("o_orderkey", "state")


def _external(customers: DataFrame, orders: DataFrame) -> DataFrame:
    ours = customers.select(F.col("c_custkey").alias("galaxy"), (F.col("c_acctbal") / 1000).alias("mu"), F.lit(0.1).alias("sigma_mu"))
    ext = orders.select(F.col("o_custkey").alias("galaxy"), (F.col("o_totalprice") / 1e4).alias("ext_mag"), F.lit(0.02).alias("ext_mag_sigma"), (F.col("o_custkey") % 10 / 10.0).alias("ext_color"), F.lit(0.03).alias("ext_color_sigma"))
    return rounded(joins.compare_external(ours, ext, -3.45, 1.17, 0.014, 0.22).select("galaxy", "delta_mu", "sigma_delta"))


@query("jn14_external", "select c_custkey as galaxy, round(c_acctbal / 1000 - (o_totalprice / 1e4 - (-3.45 + 1.17 * (o_custkey % 10 / 10.0 - 0.4))), 6) as delta_mu, round(sqrt(0.01 + 0.0004 + power(1.17 * 0.03, 2) + power(0.014, 2) + power(0.22 * (o_custkey % 10 / 10.0 - 0.4), 2)), 6) as sigma_delta from customer join orders on o_custkey = c_custkey")
def _(spark, d):
    return _external(v.table(spark, d, "customer"), v.table(spark, d, "orders"))


@query("jn14_external_whole", "select c_custkey as galaxy, round(c_acctbal / 1000 - (o_totalprice / 1e4 - (-3.45 + 1.17 * (o_custkey % 10 / 10.0 - 0.4))), 6) as delta_mu, round(sqrt(0.01 + 0.0004 + power(1.17 * 0.03, 2) + power(0.014, 2) + power(0.22 * (o_custkey % 10 / 10.0 - 0.4), 2)), 6) as sigma_delta from customer join orders on o_custkey = c_custkey")
def _(spark, d):
    return _external(v.table(spark, d, "customer"), v.table(spark, d, "orders"))


# -- measurements and calibration ----------------------------------------------------------------------------------

@query("agg30_robust_scatter", f"""with {v.MEASUREMENTS}, m as (select galaxy, region, median(mbar) m, count(*) n, stddev_samp(mbar) sd, (max(mbar) - min(mbar)) / 2 h from meas group by all),
a as (select galaxy, region, 1.4826 * median(abs(mbar - m)) mad from meas join m using (galaxy, region) group by all)
select galaxy, region, n, round(case when n >= 3 and mad > 0 then mad when n >= 2 and sd > 0 then sd when n = 2 then h end, 6) as scatter, case when n >= 3 and mad > 0 then 'mad' when n >= 2 and sd > 0 then 'std' when n = 2 then 'half_range' else 'none' end as scatter_method from m join a using (galaxy, region)""")
def _(spark, d):
    return rounded(stats.robust_scatter(v.measurements(spark, d), ["galaxy", "region"]))


COMBINED = f"""{v.MEASUREMENTS}, w as (select galaxy, wnd, max(mbar) filter (region = 'inner') mi, max(sigma) filter (region = 'inner') si, max(mbar) filter (region = 'outer') mo, max(sigma) filter (region = 'outer') so from meas group by all),
comb as (select galaxy, wnd, case when mi is not null and mo is not null then (mi / (si * si) + mo / (so * so)) / (1 / (si * si) + 1 / (so * so)) else coalesce(mi, mo) end as m, case when mi is not null and mo is not null then 1 / sqrt(1 / (si * si) + 1 / (so * so)) else coalesce(si, so) end as f,
case when mi is not null and mo is not null then abs(mi - mo) / 2 end as h, mi is not null and mo is not null as both_ from w)"""


@query("agg32_combine_annuli", f"with {COMBINED} select galaxy, wnd, round(m, 6) as mbar_weighted, round(f, 6) as sigma_weighted_formal, round(h, 6) as annulus_scatter, round(greatest(f, coalesce(h, f)), 6) as sigma_adopted, both_ as uses_two_annuli from comb")
def _(spark, d):
    return rounded(stats.combine_annuli(v.measurements(spark, d), ["galaxy", "wnd"]).select("galaxy", "wnd", "mbar_weighted", "sigma_weighted_formal", "annulus_scatter", "sigma_adopted", "uses_two_annuli"))


@query("win11_recommend", f"with {COMBINED}, k as (select galaxy, wnd, row_number() over (partition by galaxy order by both_ desc, (wnd = 4) desc, greatest(f, coalesce(h, f)), f, wnd) as r from comb) select galaxy, wnd from k where r = 1")
def _(spark, d):
    c = stats.combine_annuli(v.measurements(spark, d), ["galaxy", "wnd"]).withColumns({"kmin": F.col("wnd") / 100.0, "kmax": F.lit(0.25)})
    return windows.recommend(c, ["galaxy"]).select("galaxy", "wnd")


@query("agg35_error_budget", """select s_suppkey, round(sqrt(pk * pk + pr * pr + sky * sky + 0.02 * 0.02), 6) as sigma_total, 'sigma_psf' as missing_components from (select s_suppkey, wi * 0.05 + wo * (0.01 + s_nationkey / 100.0) as pk,
wi * (2.5 / ln(10) * 0.25 * 0.1 / 0.9) + wo * (2.5 / ln(10) * 0.25 * 0.2 / 0.8) as pr, wi * (2.5 / ln(10) * 0.01 / 2) + wo * (2.5 / ln(10) * 0.01 / 3) as sky from
(select s_suppkey, s_nationkey, 400.0 / (400.0 + 1 / power(0.01 + s_nationkey / 100.0, 2)) as wi, 1 / power(0.01 + s_nationkey / 100.0, 2) / (400.0 + 1 / power(0.01 + s_nationkey / 100.0, 2)) as wo from supplier))""")
def _(spark, d):
    s = v.table(spark, d, "supplier").select("s_suppkey", F.lit(0.05).alias("sigma_inner"), (0.01 + F.col("s_nationkey") / 100.0).alias("sigma_outer"), F.lit(0.1).alias("ratio_inner"), F.lit(0.2).alias("ratio_outer"), F.lit(0.01).alias("sky_delta"), F.lit(2.0).alias("i_inner"), F.lit(3.0).alias("i_outer"), F.lit(None).cast("double").alias("sigma_psf"), F.lit(0.02).alias("sigma_ext"))
    return rounded(catalog.error_budget(s).select("s_suppkey", "sigma_total", "missing_components"))


@query("agg36_extinction", "select c_custkey, round(case c_nationkey % 4 when 0 then 0.1 when 1 then 0.2 when 2 then 0.1 * 2.0 * c_nationkey / 100.0 else 0 end, 6) as sigma_ext, case c_nationkey % 4 when 0 then 'supplied' when 1 then 'cache' when 2 then 'ebv' else 'missing' end as sigma_ext_status from customer")
def _(spark, d):
    k, none = F.col("c_nationkey") % 4, F.lit(None).cast("double")
    c = v.table(spark, d, "customer").select("c_custkey", F.when(k == 0, 0.1).alias("ext_supplied"), none.alias("ext_table"), F.when(k == 1, 0.2).alias("ext_cache"), none.alias("ext_common"), none.alias("sigma_ebv"), F.when(k == 2, F.col("c_nationkey") / 100.0).alias("ebv"))
    return rounded(catalog.extinction_sigma(c, 2.0).select("c_custkey", "sigma_ext", "sigma_ext_status"))


SUMS = """s as (select g, count(*) n, sum(1/(sigma*sigma)) s0, sum((x-0.4)/(sigma*sigma)) s1, sum((x-0.4)*(x-0.4)/(sigma*sigma)) s2, sum(y/(sigma*sigma)) t0, sum(y*(x-0.4)/(sigma*sigma)) t1, sum(y*y/(sigma*sigma)) yy from cal group by g),
fit as (select g, n, (s2*t0 - s1*t1)/(s0*s2 - s1*s1) c0, (s0*t1 - s1*t0)/(s0*s2 - s1*s1) c1, s2/(s0*s2 - s1*s1) v00, -s1/(s0*s2 - s1*s1) v01, s0/(s0*s2 - s1*s1) v11, s0, s1, s2, t0, t1, yy from s)"""


@query("agg39_weighted_poly_fit", f"with {v.CALIBRATION}, {SUMS} select g, n, round(c0, 6) as c0, round(c1, 6) as c1, round(v00, 9) as cov_00, round(v01, 9) as cov_01, round(v11, 9) as cov_11, round(yy - c0 * t0 - c1 * t1, 2) as chi2 from fit")
def _(spark, d):
    fit = fits.weighted_poly_fit(v.calibration(spark, d), ["g"], 1, pivot=0.4)
    return rounded(fit.select("g", "n", "c0", "c1", "cov_00", "cov_01", "cov_11", "chi2"), cov_00=9, cov_01=9, cov_11=9, chi2=2)


@query("agg41_predict", f"with {v.CALIBRATION}, {SUMS} select l_orderkey, l_linenumber, round(c0 + c1 * (x - 0.4), 5) as predicted, round(v00 + 2 * v01 * (x - 0.4) + v11 * (x - 0.4) * (x - 0.4), 8) as fit_variance from cal join fit using (g)")
def _(spark, d):
    c = v.calibration(spark, d)
    return rounded(fits.predict_poly(c, fits.weighted_poly_fit(c, ["g"], 1, pivot=0.4), ["g"], 1, pivot=0.4).select("l_orderkey", "l_linenumber", "predicted", "fit_variance"), predicted=5, fit_variance=8)


@query("agg42_leave_one_out", f"""with {v.CALIBRATION}, {SUMS}, d as (select l_orderkey, l_linenumber, x - 0.4 as u, y, 1/(sigma*sigma) w, s0 - 1/(sigma*sigma) a0, s1 - (x-0.4)/(sigma*sigma) a1, s2 - (x-0.4)*(x-0.4)/(sigma*sigma) a2, t0 - y/(sigma*sigma) b0, t1 - y*(x-0.4)/(sigma*sigma) b1 from cal join fit using (g))
select l_orderkey, l_linenumber, round(y - ((a2*b0 - a1*b1)/(a0*a2 - a1*a1) + (a0*b1 - a1*b0)/(a0*a2 - a1*a1) * u), 5) as loo_residual from d""")
def _(spark, d):
    return rounded(fits.leave_one_out(v.calibration(spark, d), ["g"], 1, pivot=0.4).select("l_orderkey", "l_linenumber", "loo_residual"), 5)


@query("agg43_model_comparison")
def _(spark, d):
    return rounded(fits.model_comparison(v.calibration(spark, d), ["g"], pivot=0.4), 3)


@query("agg38_residual_summary", f"""with {v.CALIBRATION}, m as (select g, count(*) n, sum((y-3)/(sigma*sigma))/sum(1/(sigma*sigma)) wm, sqrt(1/sum(1/(sigma*sigma))) me, sqrt(avg((y-3)*(y-3))) rms, median(100*abs(power(10.0, (y-3)/5) - 1)) md from cal group by g)
select g, max(n) as n, round(max(wm), 6) as weighted_mean, round(max(me), 6) as mean_error, round(max(rms), 6) as rms, round(max(md), 5) as median_distance_pct, round(sqrt(sum(power(y-3-wm, 2)/(sigma*sigma))/sum(1/(sigma*sigma))), 6) as wrms from cal join m using (g) group by g""")
def _(spark, d):
    return rounded(fits.residual_summary(v.calibration(spark, d).withColumn("r", F.col("y") - 3), ["g"], "r", "sigma"), median_distance_pct=5)


@query("agg44_diagnostics", f"with {v.CALIBRATION} select g, 'sigma' as quantity, count(*) as n, round(corr(sigma, y), 6) as pearson_r from cal group by g union all select g, 'x', count(*), round(corr(x, y), 6) from cal group by g")
def _(spark, d):
    return rounded(fits.residual_diagnostics(v.calibration(spark, d), ["g"], "y", ["x", "sigma"]))


@query("agg45_window_sensitivity", "select l_linenumber, count(*) as n, round(quantile_cont(l_discount - l_tax, 0.16), 6) as p16, round(quantile_cont(l_discount - l_tax, 0.5), 6) as p50, round(quantile_cont(l_discount - l_tax, 0.84), 6) as p84 from lineitem group by 1")
def _(spark, d):
    return rounded(fits.window_sensitivity(v.table(spark, d, "lineitem").withColumn("delta", F.col("l_discount") - F.col("l_tax")), ["l_linenumber"]))


@query("agg46_variance_budget", "with u as (select l_orderkey * 10 + l_linenumber as k, unnest(['l_discount', 'l_tax', 'l_quantity']) as component, power(unnest([l_discount, l_tax, l_quantity]), 2) as variance from lineitem) select k, component, round(variance, 6) as variance, round(variance / sum(variance) over (partition by k), 6) as share from u")
def _(spark, d):
    li = v.table(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("k"), "l_discount", "l_tax", "l_quantity")
    return rounded(fits.variance_budget(li, "k", ["l_discount", "l_tax", "l_quantity"]))


@query("agg26_spectrum_fit", """with s as (select l_suppkey, count(*) n, regr_slope(l_extendedprice, l_quantity) p0, regr_intercept(l_extendedprice, l_quantity) p1, corr(l_extendedprice, l_quantity) c from lineitem group by 1)
select l_suppkey, n as n_fit, case when n >= 10 and p0 > 0 then round(p0, 4) end as P0, case when n >= 10 and p0 > 0 then round(p1, 2) end as P1, case when n >= 10 and p0 > 0 then round(c, 6) end as corr from s""")
def _(spark, d):
    return rounded(fits.spectrum_fit(v.table(spark, d, "lineitem"), ["l_suppkey"], "l_quantity", "l_extendedprice").select("l_suppkey", "n_fit", "P0", "P1", "corr"), P0=4, P1=2)


@query("agg27_gate", """with s as (select l_suppkey, regr_slope(l_extendedprice, l_quantity) p0, regr_intercept(l_extendedprice, l_quantity) p1, corr(l_extendedprice, l_quantity) c, count(*) n from lineitem group by 1)
select l_suppkey, case when n < 10 or p0 is null or p0 <= 0 then 'P0 not positive' when abs(c) < 0.3 then 'weak correlation' when p0 + p1 <= 0 then 'total not positive' when abs(p1) > 5 * p0 then 'P1 dominates' else '' end as gate_reason from s""")
def _(spark, d):
    return fits.gate_fit(fits.spectrum_fit(v.table(spark, d, "lineitem"), ["l_suppkey"], "l_quantity", "l_extendedprice")).select("l_suppkey", "gate_reason")


# -- sources and luminosity functions ------------------------------------------------------------------------------

@query("agg19_source_summary", f"with {v.SOURCES} select galaxy, region, count(*) as n_overlap, count(mag_ab) as n_valid, count(*) filter (flux_adopted <= 0) as n_nonpositive, round(min(mag_ab), 6) as mag_min, round(median(mag_ab), 6) as mag_med, round(max(mag_ab), 6) as mag_max from sources group by all")
def _(spark, d):
    return rounded(stats.source_summary(v.sources(spark, d), ["galaxy", "region"]))


TURN = f"""{v.SOURCES}, b as (select galaxy, region, floor(mag_ab / 0.25) as b, count(*) n from sources group by all), t as (select galaxy, region, sum(n) as n, arg_max(b, n * 1000000 - b) as b from b group by all)"""


@query("agg20_turnover", f"with {TURN} select galaxy, region, n::bigint as n_sources, case when n >= 3 then (b + 0.5) * 0.25 end as m_turnover from t")
def _(spark, d):
    return stats.turnover_mag(v.sources(spark, d), ["galaxy", "region"])


@query("agg21_limit_mag", f"with {TURN}, q as (select galaxy, region, quantile_cont(mag_ab, 0.8) q from sources group by all), gb as (select galaxy, floor(mag_ab / 0.25) b, count(*) n from sources group by all), gt as (select galaxy, sum(n) n, arg_max(b, n * 1000000 - b) b from gb group by all) select t.galaxy, t.region, t.n::bigint as n_sources, round(case when t.n >= 6 then (t.b + 0.5) * 0.25 when gt.n >= 20 then (gt.b + 0.5) * 0.25 else q end, 6) as m_lim, case when t.n >= 6 then 'region_turnover' when gt.n >= 20 then 'global_turnover' else 'quantile_0.80' end as m_lim_method from t join q using (galaxy, region) join gt on gt.galaxy = t.galaxy")
def _(spark, d):
    return rounded(stats.limit_mag(v.sources(spark, d), ["galaxy", "region"], ["galaxy"]))


@query("agg23_contaminant_power", "select l_orderkey, l_linenumber, case when l_discount * 10 < 0.8 then round(l_quantity * l_tax * l_tax / ((0.8 - l_discount * 10) * ln(10)), 6) end as pr from lineitem")
def _(spark, d):
    return rounded(v.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", stats.contaminant_power("l_quantity", "l_tax", F.col("l_discount") * 10).alias("pr")))


@query("agg23_contaminant_power_whole", "select l_orderkey, l_linenumber, case when l_discount * 10 < 0.8 then round(l_quantity * l_tax * l_tax / ((0.8 - l_discount * 10) * ln(10)), 6) end as pr from lineitem")
def _(spark, d):
    return rounded(v.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", stats.contaminant_power("l_quantity", "l_tax", F.col("l_discount") * 10).alias("pr")))


@query("agg34_color_summary", "select l_suppkey, round(sum(l_tax / power(0.01 + l_discount, 2)) / sum(1 / power(0.01 + l_discount, 2)), 6) as color_weighted, round(avg(l_tax), 6) as color_mean, round(stddev_samp(l_tax), 6) as color_std, round((max(l_tax) - min(l_tax)) / 2, 6) as color_half_range from lineitem group by 1")
def _(spark, d):
    return rounded(stats.color_summary(v.table(spark, d, "lineitem").withColumn("s", 0.01 + F.col("l_discount")), ["l_suppkey"], "l_tax", "s"))


@query("agg4_bkg_delta", "select l_orderkey, l_linenumber, round(case l_linenumber % 4 when 0 then abs(l_discount) when 1 then abs(l_tax) when 2 then greatest(abs(l_discount), abs(l_tax)) else l_quantity / sqrt(l_linenumber) end, 6) as delta from lineitem")
def _(spark, d):
    stat = F.element_at(F.array(*map(F.lit, ("median", "mean", "max_abs_mean_median", "sem"))), F.col("l_linenumber") % 4 + 1)
    return rounded(v.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", stats.bkg_delta(stat, "l_discount", "l_tax", "l_quantity", "l_linenumber").alias("delta")))


@query("agg50_star_shapes", "select p_brand, count(*) as n_stars, round(avg(pi() * p_size * p_retailprice / 4), 2) as area_mean, round(avg(least(p_size, p_retailprice / 100) / greatest(p_size, p_retailprice / 100)), 6) as round_mean, round(avg((least(p_size, p_retailprice / 100) / greatest(p_size, p_retailprice / 100) > 0.8)::int), 6) as share_round from part group by 1")
def _(spark, d):
    p = v.table(spark, d, "part").select("p_brand", F.col("p_size").cast("double").alias("fwhm_x"), (F.col("p_retailprice") / 100).alias("fwhm_y"))
    return rounded(stats.psf_stats(p, ["p_brand"]).select("p_brand", "n_stars", (F.col("area_mean") * 100).alias("area_mean"), "round_mean", "share_round"), area_mean=2)


@query("agg1_sigma_clip", "select event_type, n, round(mean, 6) as mean, round(median, 6) as median, round(std, 6) as std from (" + """
with v0 as (select event_type, value from events where value is not null), b1 as (select event_type, median(value) - 3 * stddev_pop(value) lo, median(value) + 3 * stddev_pop(value) hi from v0 group by 1), v1 as (select v0.* from v0 join b1 using (event_type) where value between lo and hi),
b2 as (select event_type, median(value) - 3 * stddev_pop(value) lo, median(value) + 3 * stddev_pop(value) hi from v1 group by 1), v2 as (select v1.* from v1 join b2 using (event_type) where value between lo and hi), b3 as (select event_type, median(value) - 3 * stddev_pop(value) lo, median(value) + 3 * stddev_pop(value) hi from v2 group by 1), v3 as (select v2.* from v2 join b3 using (event_type) where value between lo and hi),
b4 as (select event_type, median(value) - 3 * stddev_pop(value) lo, median(value) + 3 * stddev_pop(value) hi from v3 group by 1), v4 as (select v3.* from v3 join b4 using (event_type) where value between lo and hi), b5 as (select event_type, median(value) - 3 * stddev_pop(value) lo, median(value) + 3 * stddev_pop(value) hi from v4 group by 1), v5 as (select v4.* from v4 join b5 using (event_type) where value between lo and hi)
select event_type, count(*) as n, avg(value) as mean, median(value) as median, stddev_pop(value) as std from v5 group by 1)""")
def _(spark, d):
    return rounded(stats.sigma_clip_stats(v.events(spark, d), ["event_type"], "value").select("event_type", "n", "mean", "median", "std"))


# -- ordered rows --------------------------------------------------------------------------------------------------

@query("win1_isophote_windows", f"""with {v.PROFILE}, w as (select event_type, row_number() over (partition by event_type order by x) - 1 as i, first(x) over s as x_first, last(x) over s as x_last, count(*) over s as n, median(y) over s as m from profile window s as (partition by event_type order by x rows between current row and 7 following))
select event_type, (i / 2)::int as window, x_first, x_last, round((x_last - x_first) / 7, 6) as mean_gap, round(m, 6) as y from w where n = 8 and i % 2 = 0""")
def _(spark, d):
    return rounded(windows.isophote_windows(v.profile(spark, d), ["event_type"], "x", cols=("y",)))


def stretches_sql(least: int, widest: float) -> str:
    """CTEs r (numbered profile) and s: all stretches i..j of at least `least` rows whose range is `widest` at most."""
    return f"""{v.PROFILE}, r as (select event_type, x, y, row_number() over (partition by event_type order by x) as i from profile),
s as (select a.event_type, a.i as i, b.i as j, any_value(a.x) as x_first, any_value(b.x) as x_last, count(*)::int as n, avg(c.y) as level, regr_slope(c.y, c.x) as slope, regr_intercept(c.y, c.x) as icept, regr_sxx(c.y, c.x) as sxx, regr_syy(c.y, c.x) as syy, regr_sxy(c.y, c.x) as sxy
from r a join r b on a.event_type = b.event_type and b.i >= a.i + {least - 1} join r c on c.event_type = a.event_type and c.i between a.i and b.i group by a.event_type, a.i, b.i having max(c.y) - min(c.y) <= {widest})"""


PLATEAU_SQL = f"""{stretches_sql(3, 25.0)}, t as (select event_type, i, j, x_first, x_last, n, level, slope, sqrt(greatest(syy - coalesce(slope, 0) * sxy, 0) / n) as scatter, sqrt(greatest(syy, 0) / n) / sqrt(n) as err from s),
m as (select event_type, median(abs(slope)) as a, median(scatter) as b, median(err) as c, median(n::double) as d from t group by 1),
k as (select event_type, median(abs(abs(slope) - a)) as a, median(abs(scatter - b)) as b, median(abs(err - c)) as c, median(abs(n - d)) as d from t join m using (event_type) group by 1),
z as (select t.*, (abs(slope) - m.a) / (case when k.a > 0 then 1.4826 * k.a else 1 end) + (scatter - m.b) / (case when k.b > 0 then 1.4826 * k.b else 1 end) + 0.7 * (err - m.c) / (case when k.c > 0 then 1.4826 * k.c else 1 end) - 0.5 * (n - m.d) / (case when k.d > 0 then 1.4826 * k.d else 1 end) as score
from t join m using (event_type) join k using (event_type)),
best as (select event_type, i, j, x_first, x_last, n, level, slope, scatter, score, 'plateau' as how from z qualify row_number() over (partition by event_type order by score, n desc, i) = 1),
lone as (select r.event_type, i, i as j, x as x_first, x as x_last, 1 as n, y as level, null::double as slope, null::double as scatter, null::double as score, 'most_robust' as how from r join (select event_type, median(y) as med from r group by 1) q using (event_type)
where r.event_type not in (select event_type from best) qualify row_number() over (partition by r.event_type order by abs(y - med), i) = 1), plateau as (select * from best union all select * from lone)"""


@query("win2_plateau", f"""with {PLATEAU_SQL} select event_type, i::int as first, j::int as last, round(x_first, 5) as x_first, round(x_last, 5) as x_last, n, round(level, 5) as level, round(slope, 5) as slope, round(scatter, 5) as scatter, round(score, 5) as score, how from plateau""")
def _(spark, d):
    return rounded(windows.find_plateau(v.profile(spark, d), ["event_type"], "x", "y", 3, 25.0), 5)


@query("win4_ring_plateau", f"""with {stretches_sql(3, 15.0)} select event_type, n, round(x_first, 5) as x_first, round(x_last, 5) as x_last, round((x_first + x_last) / 2, 5) as r_mid, round(level, 5) as level from s qualify row_number() over (partition by event_type order by n desc, x_first + x_last) = 1""")
def _(spark, d):
    return rounded(windows.ring_plateau(v.profile(spark, d), ["event_type"], "x", "y", 15.0, 3), 5)


@query("win5_zero_crossing", f"""with {v.PROFILE}, p as (select event_type, x, y, lag(x) over w as px, lag(y) over w as py from profile window w as (partition by event_type order by x)), z as (select event_type, x, case when py * y < 0 then px - py * (x - px) / (y - py) when y = 0 and px is not null then x end as z, y from p)
select event_type, round(arg_min(z, x) filter (z is not null), 5) as zero_x, min(x) filter (y < 0) as first_negative_x from z group by 1""")
def _(spark, d):
    return rounded(windows.zero_crossing(v.profile(spark, d), ["event_type"], "x", "y"), 5)


@query("win6_steps", f"with {v.PROFILE}, p as (select event_type, y - lag(y) over (partition by event_type order by x) as dy from profile where x between 0 and 1e6) select event_type, count(*) as n, round(stddev_pop(dy), 6) as y_step_std, round(max(abs(dy)), 6) as y_step_max from p group by 1 having count(*) >= 5")
def _(spark, d):
    return rounded(windows.isophote_steps(v.profile(spark, d), ["event_type"], "x", 0, 1e6, ["y"]))


@query("win7_gradient", f"""with {v.PROFILE}, p as (select *, x - lag(x) over w as h0, lead(x) over w - x as h1, (y - lag(y) over w) / (x - lag(x) over w) as d0, (lead(y) over w - y) / (lead(x) over w - x) as d1 from profile window w as (partition by event_type order by x)),
g as (select *, coalesce((d0 * h1 + d1 * h0) / (h0 + h1), d0, d1) as gr from p) select event_type, x, round(case when gr < 0 then gr else -greatest(abs(y), 1e-6) / greatest(x, 1.0) end, 6) as grad from g""")
def _(spark, d):
    return rounded(windows.profile_gradient(v.profile(spark, d), ["event_type"], "x", "y").select("event_type", "x", "grad"))


@query("win8_unwrap", f"""with {v.PROFILE}, p as (select event_type, x, y % 6 as a from profile), t as (select *, a - lag(a) over (partition by event_type order by x) as dd from p)
select event_type, x, round(a + 6.283185307179586 * sum(coalesce(-floor((dd + 3.141592653589793) / 6.283185307179586), 0)) over (partition by event_type order by x), 6) as unwrapped from t""")
def _(spark, d):
    return rounded(windows.unwrap(v.profile(spark, d).withColumn("a", F.col("y") % 6), ["event_type"], "x", "a").select("event_type", "x", "unwrapped"))


@query("win13_best", "with k as (select l_suppkey, l_orderkey * 10 + l_linenumber as experiment, row_number() over (partition by l_suppkey order by l_discount, l_tax, l_orderkey * 10 + l_linenumber) as r from lineitem) select l_suppkey, experiment from k where r = 1")
def _(spark, d):
    li = v.table(spark, d, "lineitem").withColumn("experiment", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    return windows.best_experiment(li, ["l_suppkey"], "l_discount", "l_tax").select("l_suppkey", "experiment")


# -- catalogue -----------------------------------------------------------------------------------------------------


@query("agg48_mentions", "with w as (select doc_id, source, unnest(regexp_extract_all(text, '(of|the|und|que|les)')) as name from documents), p as (select name, source, count(*) n from w group by all) select name, sum(n)::bigint as mention_count, count(*) as n_articles, string_agg(source, ';' order by source) as articles from p group by 1")
def _(spark, d):
    return catalog.mention_counts(v.table(spark, d, "documents"), "(of|the|und|que|les)", "source")


@query("agg49_search_summary", "select o_orderpriority, count(*) as n, count(*) filter (o_orderstatus = 'O') as n_f150w, count(*) filter (o_custkey % 2 = 0) as n_f090w, count(*) filter (o_orderstatus = 'O' and o_custkey % 2 = 0) as n_both from orders group by 1")
def _(spark, d):
    return catalog.search_summary(v.table(spark, d, "orders").withColumns({"has_f150w": F.col("o_orderstatus") == "O", "has_f090w": F.col("o_custkey") % 2 == 0}), "o_orderpriority")


@query("set1_candidate_union", "with u as (select o_custkey as name, o_orderstatus as article, 0 as k, 'orders' as c from orders union all select c_custkey, c_mktsegment, 1, 'customer' from customer) select name, arg_min(c, k) as source_class, string_agg(distinct article, ';' order by article) as articles from u group by 1")
def _(spark, d):
    a = v.table(spark, d, "orders").select(F.col("o_custkey").alias("name"), F.col("o_orderstatus").alias("article"))
    b = v.table(spark, d, "customer").select(F.col("c_custkey").alias("name"), F.col("c_mktsegment").alias("article"))
    return catalog.candidate_union([(a, "orders"), (b, "customer")])


@query("set3_branch_union", "select 'reference' as branch, count(*) as n, count(x) as nx from (select *, null as x from orders where o_orderkey % 2 = 0) union all select 'variant', count(*), count(x) from (select *, 1 as x from orders where o_orderkey % 2 = 1)")
def _(spark, d):
    o = v.table(spark, d, "orders")
    u = catalog.branch_union({"reference": o.where("o_orderkey % 2 = 0"), "variant": o.where("o_orderkey % 2 = 1").withColumn("x", F.lit(1))})
    return u.groupBy("branch").agg(F.count("*").alias("n"), F.count("x").alias("nx"))


@query("set4_dedupe", "select o_custkey, min(o_orderkey) as o_orderkey from orders group by 1")
def _(spark, d):
    return catalog.dedupe_products(v.table(spark, d, "orders"), "o_custkey", ["o_orderkey"]).select("o_custkey", "o_orderkey")


@query("set5_combine", "with u as (select o_custkey as k, 'article' as o from orders union select c_custkey, 'literature' from customer where c_acctbal > 5000) select k, string_agg(distinct o, '+' order by o) as origin from u group by 1")
def _(spark, d):
    return catalog.combine_unprocessed(v.table(spark, d, "orders").select(F.col("o_custkey").alias("k")), v.table(spark, d, "customer").where("c_acctbal > 5000").select(F.col("c_custkey").alias("k")), "k")


@query("top1_ring_peaks", "with k as (select l_suppkey, l_orderkey, l_linenumber, row_number() over (partition by l_suppkey order by abs(l_discount - 0.05) desc, l_orderkey * 10 + l_linenumber desc) as rank from lineitem) select l_suppkey, l_orderkey, l_linenumber, rank::int as rank from k where rank <= 12")
def _(spark, d):
    li = v.table(spark, d, "lineitem").withColumns({"dv": F.col("l_discount") - 0.05, "n": F.col("l_orderkey") * 10 + F.col("l_linenumber")})
    return catalog.ring_peaks(li, ["l_suppkey"], "dv", "n").select("l_suppkey", "l_orderkey", "l_linenumber", "rank")


@query("top3_priority", "select c_custkey, case when c_acctbal > 8000 then 'A_minus' when c_acctbal > 5000 then 'B' when c_mktsegment = 'BUILDING' then 'C' else 'none' end as priority from customer")
def _(spark, d):
    rules = [("A_minus", F.col("c_acctbal") > 8000), ("B", F.col("c_acctbal") > 5000), ("C", F.col("c_mktsegment") == "BUILDING")]
    return catalog.prioritise(v.table(spark, d, "customer"), rules, ["c_custkey"]).select("c_custkey", "priority")


@query("str2_latest_status", "select user_id, arg_max(event_type, (epoch_us(ts), event_type)) as event_type, max(ts) as ts from events group by 1")
def _(spark, d):
    from ..streaming.readiness import latest_status

    return latest_status(v.events(spark, d), ["user_id"], "ts", "event_type")
