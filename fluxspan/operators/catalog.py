"""Candidate search: mentions, availability, unions, priorities, error budget of results."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import fin, fin_nonneg, quadrature
from .joins import near_join
from .ranks import grouped
from .stats import sign_label


def mention_counts(texts: DataFrame, pattern: str, article: str = "article", text: str = "text", aliases: DataFrame | None = None) -> DataFrame:
    """Names found in texts: total count and sorted articles (AGG48).  aliases: alias, name - counted under the name."""
    found = texts.select(article, F.explode(F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).alias("alias"))
    if aliases is not None:
        found = found.join(aliases, "alias", "left").withColumn("alias", F.coalesce("name", "alias"))
    per = found.groupBy(F.col("alias").alias("name"), article).agg(F.count("*").alias("n"))
    return per.groupBy("name").agg(F.sum("n").alias("mention_count"), F.count("*").alias("n_articles"), F.array_join(F.array_sort(F.collect_set(F.col(article).cast("string"))), ";").alias("articles"))


def availability(obs: DataFrame, g: list[str], filters: str = "filters", program: str = "proposal_id", obs_id: str = "obs_id", url: str = "dataURL") -> DataFrame:
    """Counts, distinct filters and programmes, flags, observations and products of both bands of each group (AGG47)."""
    each = lambda c: F.array_join(F.array_sort(F.collect_set(F.col(c).cast("string"))), ";")
    has = lambda f: F.coalesce(F.bool_or(F.upper(filters) == f), F.lit(False))
    of = lambda c, f: F.array_join(F.array_sort(F.collect_list(F.when(F.upper(filters) == f, F.col(c).cast("string")))), ";")
    bands = {b: b.upper() for b in ("f150w", "f090w")}
    joined = [of(obs_id, f).alias(f"{b}_obsids") for b, f in bands.items()]
    if url in obs.columns:
        joined += [of(url, f).alias(f"{b}_dataurls") for b, f in bands.items()]
    flags = [has(f).alias(f"has_{b}") for b, f in bands.items()]
    out = obs.groupBy(*g).agg(F.count("*").alias("obs_count"), each(filters).alias("filters"), each(program).alias("programs"), *flags, F.countDistinct(obs_id).alias("n_obs_ids"), *joined)
    return out.withColumn("recommended", F.col("has_f150w") & F.col("has_f090w"))


def search_summary(cands: DataFrame, by: str = "source_class") -> DataFrame:
    """Counters of candidates by class and filter availability (AGG49)."""
    return cands.groupBy(by).agg(F.count("*").alias("n"), F.count_if("has_f150w").alias("n_f150w"), F.count_if("has_f090w").alias("n_f090w"), F.count_if(F.col("has_f150w") & F.col("has_f090w")).alias("n_both"))


def observation_summary(obs: DataFrame, cols: list[str], g: list[str] | None = None) -> DataFrame:
    """Number of observations and, of each column, the number of distinct values and the sorted values (AGG49)."""
    each = [e for c in cols for e in (F.countDistinct(c).alias(f"n_{c}"), F.array_join(F.array_sort(F.collect_set(F.col(c).cast("string"))), ";").alias(c))]
    return (obs.groupBy(*g) if g else obs).agg(F.count("*").alias("n_observations"), *each)


def candidate_union(parts: list[tuple[DataFrame, str]], name: str = "name") -> DataFrame:
    """Names of all parts; the first part's class wins, articles are merged (SET1)."""
    rows = reduce(lambda a, b: a.unionByName(b), [df.select(name, "article", F.lit(k).alias("_k"), F.lit(c).alias("source_class")) for k, (df, c) in enumerate(parts)])
    return rows.groupBy(name).agg(F.min_by("source_class", "_k").alias("source_class"), F.array_join(F.array_sort(F.collect_set("article")), ";").alias("articles"))


def sample_membership(samples: DataFrame) -> DataFrame:
    """sample with its names, and its url if there is one -> each name's sorted samples and urls (SET2)."""
    cols = ["sample", *(["url"] if "url" in samples.columns else [])]
    sets = [F.array_join(F.array_sort(F.collect_set(c)), ";").alias(f"{c}s") for c in cols]
    return samples.select(*cols, F.explode("names").alias("name")).groupBy("name").agg(*sets, F.countDistinct("sample").alias("n_samples"))


def branch_union(parts: dict[str, DataFrame]) -> DataFrame:
    """Rows of all branches with the branch's name; columns that a branch lacks are NULL (SET3)."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [df.withColumn("branch", F.lit(n)) for n, df in parts.items()])


def dedupe_products(prods: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first row of each product (SET4)."""
    return prods.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_r = 1").drop("_r")


def combine_unprocessed(a: DataFrame, b: DataFrame, key: str, names: tuple[str, str] = ("article", "literature")) -> DataFrame:
    """Work lists of two searches, each key once with the searches that found it (SET5)."""
    both = a.select(key, F.lit(names[0]).alias("origin")).unionByName(b.select(key, F.lit(names[1]).alias("origin")))
    return both.groupBy(key).agg(F.array_join(F.array_sort(F.collect_set("origin")), "+").alias("origin"))


def prioritise(cands: DataFrame, rules: list[tuple[str, Column]], order: list[str]) -> DataFrame:
    """Class of the first rule that holds, rows in order of classes (TOP3)."""
    rank = F.lit(len(rules))
    name = F.lit("none")
    for k, (label, rule) in reversed(list(enumerate(rules))):
        ok = F.coalesce(rule, F.lit(False))
        rank, name = F.when(ok, k).otherwise(rank), F.when(ok, label).otherwise(name)
    return cands.withColumns({"priority": name, "priority_rank": rank}).orderBy("priority_rank", *order)


def ring_peaks(ring: DataFrame, g: list[str], value: str, count: str, k: int = 12) -> DataFrame:
    """The k largest deviations of each group, then by count (TOP1)."""
    w = Window.partitionBy(*g).orderBy(F.desc(F.abs(value)), F.desc(count), value)
    return ring.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def inverse_weights(inner: str, outer: str) -> tuple[Column, Column]:
    """Shares of inverse variances; one side alone has all."""
    a, b = (F.when(fin(c) > 0, 1 / F.pow(fin(c), 2)) for c in (inner, outer))
    total = F.coalesce(a, F.lit(0.0)) + F.coalesce(b, F.lit(0.0))
    share = lambda w: F.when(total > 0, F.coalesce(w, F.lit(0.0)) / total)
    return share(a), share(b)


def error_budget(rows: DataFrame, pr_frac: float = 0.25) -> DataFrame:
    """Terms of the error budget and their quadratures (AGG35).

    rows: sigma_inner, sigma_outer, ratio_inner, ratio_outer (Pr / P0), sky_delta, i_inner, i_outer, sigma_psf, sigma_ext.
    """
    wi, wo = inverse_weights("sigma_inner", "sigma_outer")
    mean = lambda a, b: F.when(wi.isNotNull(), wi * F.coalesce(a, b) + wo * F.coalesce(b, a))
    pr = lambda c: F.when(fin_nonneg(c) < 1, 2.5 / F.log(F.lit(10.0)) * pr_frac * F.col(c) / (1 - F.col(c)))
    sky = lambda c: F.when(fin(c) > 0, 2.5 / F.log(F.lit(10.0)) * F.col("sky_delta") / F.col(c))
    out = rows.withColumns({"weight_inner": wi, "weight_outer": wo, "sigma_pk": mean(fin_nonneg("sigma_inner"), fin_nonneg("sigma_outer")), "sigma_pr": mean(pr("ratio_inner"), pr("ratio_outer")), "sigma_sky": mean(sky("i_inner"), sky("i_outer"))})
    terms = ["sigma_pk", "sigma_pr", "sigma_sky", "sigma_psf", "sigma_ext"]
    missing = F.array_join(F.array_compact(F.array(*[F.when(fin_nonneg(t).isNull(), F.lit(t)) for t in terms])), ";")
    return out.withColumns({"sigma_total": quadrature(*terms), "sigma_total_no_psf": quadrature(*[t for t in terms if t != "sigma_psf"]), "missing_components": missing})


def pick_reddening(values: DataFrame, g: list[str], name: str = "column", value: str = "value") -> DataFrame:
    """E(B-V) and its error from a table's columns by what their names say (AGG36): g, ebv, sigma_ebv, ebv_columns.

    values: one row for each numeric column of a table.  The column with the highest score wins, then the last name.
    """
    low, has = F.lower(name), lambda *words: F.greatest(*[F.lower(name).contains(w).cast("int") for w in words], F.lit(0))
    spread = has("std", "sigma", "err")
    base = 8 * has("sandf", "schlafly") + 5 * has("sfd") + 3 * has("ebv", "e(b-v)", "reddening", "ext")
    rows = values.where(fin_nonneg(value).isNotNull()).withColumns({"_mean": base + 4 * has("mean", "value"), "_std": F.when(spread == 1, base + 4), "_n": low})
    best = lambda s, what: F.max_by(what, F.when(F.col(s) > 0, F.struct(s, "_n", value)))
    out = rows.groupBy(*g).agg(best("_mean", value).alias("ebv"), best("_std", value).alias("sigma_ebv"), best("_mean", "_n").alias("_a"), best("_std", "_n").alias("_b"))
    notes = F.concat_ws(";", F.concat(F.lit("ebv_col="), "_a"), F.concat(F.lit("sigma_col="), "_b"))
    return out.withColumn("ebv_columns", notes).drop("_a", "_b")


def extinction_sigma(rows: DataFrame, coefficient: float, floor: float = 0.10) -> DataFrame:
    """Extinction error by precedence: supplied, table, cache, common, E(B-V), else 0 and missing (AGG36)."""
    ebv = F.coalesce(fin_nonneg("sigma_ebv") * coefficient, floor * coefficient * fin_nonneg("ebv"))
    steps = [("supplied", fin_nonneg("ext_supplied")), ("table", fin_nonneg("ext_table")), ("cache", fin_nonneg("ext_cache")), ("common", fin_nonneg("ext_common")), ("ebv", ebv)]
    status = F.coalesce(*[F.when(v.isNotNull(), F.lit(n)) for n, v in steps], F.lit("missing"))
    return rows.withColumns({"sigma_ext": F.coalesce(*[v for _, v in steps], F.lit(0.0)), "sigma_ext_status": status})


def saved_psf_sigma(comparisons: DataFrame, wanted: DataFrame, key: str = "galaxy", tol: float = 1e-9) -> DataFrame:
    """|difference| of two saved measurements with the two point-spread tables at the wanted window and settings (AGG37).

    comparisons: key, kmin, kmax, realisations, pad, psf_ext (DET_DIST or DET_SAMP), mbar; wanted: key, kmin, kmax,
    realisations, pad.
    """
    same = near_join(wanted, comparisons, [key, "realisations", "pad"], ["kmin", "kmax"], tol)
    side = lambda e: F.max(F.when(F.col("psf_ext") == e, F.col("mbar")))
    return same.groupBy(key).agg(F.abs(side("DET_DIST") - side("DET_SAMP")).alias("psf_saved"))


def psf_sigma(rows: DataFrame) -> DataFrame:
    """Point-spread error by precedence: supplied, branches, saved comparison, a rerun with both tables (`psf_rerun`, where the
    rows have it), else 0 and missing (AGG37)."""
    steps = [("supplied", fin_nonneg("psf_supplied")), ("branches", fin_nonneg("psf_branch")), ("comparison", fin_nonneg("psf_saved"))]
    steps += [("rerun", fin_nonneg("psf_rerun"))] if "psf_rerun" in rows.columns else []
    status = F.coalesce(*[F.when(v.isNotNull(), F.lit(n)) for n, v in steps], F.lit("missing"))
    return rows.withColumns({"sigma_psf": F.coalesce(*[v for _, v in steps], F.lit(0.0)), "sigma_psf_status": status})


def experiment_metrics(regions: DataFrame, g: list[str], value: str = "resid_median", crossings: DataFrame | None = None, recommended: DataFrame | None = None) -> DataFrame:
    """Sum of |median residual| over the regions of each experiment, with their number (AGG51).

    crossings: g, shape, zero_x (`zero_crossing` of each bias profile) -> zero_cross_<shape>; recommended: g and a struct
    `recommended`, whose fields become columns.
    """
    out = regions.groupBy(*g).agg(F.sum(F.abs(fin(value))).alias("abs_residual_sum"), F.count(fin(value)).alias("n_regions"))
    if crossings is not None:
        wide = crossings.groupBy(*g).agg(*[F.max(F.when(F.col("shape") == s, F.col("zero_x"))).alias(f"zero_cross_{s}") for s in ("circle", "ellipse")])
        out = out.join(wide, g, "left")
    if recommended is not None:
        out = out.join(recommended.select(*g, "recommended.*"), g, "left")
    return out


#: Limits of the notes on how two models differ.
VISIBLE, GROWS, WEAKENS, FLOOR = 0.01, 1.25, 0.80, 1e-12


def overlap_notes(pixels: DataFrame, profile: DataFrame, edges: DataFrame, g: list[str], r: str, one: str, other: str) -> DataFrame:
    """Sign of the difference inside the fitted range, and how it changes with radius (AGG11).

    profile: `overlap_profile`; edges: g, edge - the fitted range of each group.  Rings count as inner up to half of it and
    as outer from two thirds on.
    """
    d = fin(one) - fin(other)
    inside = grouped(pixels.join(edges, g).where(F.col(r) <= F.col("edge")), g, [F.avg(d).alias("inside_mean")], {"inside_median": (d, 0.5)}).select(*g, "inside_median", "inside_mean")
    p = profile.join(edges, g).where(F.col("r_mid") <= F.col("edge"))
    size = F.abs("difference")
    s = p.groupBy(*g).agg(F.median(F.when(F.col("r_mid") <= 0.5 * F.col("edge"), size)).alias("inner_abs"), F.median(F.when(F.col("r_mid") >= 2 / 3 * F.col("edge"), size)).alias("outer_abs"), F.median("one_median").alias("scale"))
    a, b = F.greatest("inner_abs", F.lit(FLOOR)), F.col("outer_abs")
    growth = F.when(F.col("inner_abs").isNull() | b.isNull(), "unknown").when(b > GROWS * a, "grows outwards").when(b < WEAKENS * a, "weakens outwards").otherwise("comparable")
    seen = F.coalesce(F.col("inner_abs") > VISIBLE * F.greatest("scale", F.lit(FLOOR)), F.lit(False))
    return inside.join(s, g, "left").withColumns({"inside_sign": sign_label("inside_median"), "visible_inside": seen, "growth": growth}).drop("scale")


def overlap_profile(pixels: DataFrame, g: list[str], r: str, one: str, other: str, width: float, least: int = 10) -> DataFrame:
    """Ring medians of two models' residuals, their difference and whether their signs agree (AGG11)."""
    b = F.floor(F.col(r) / width).cast("int")
    s = grouped(pixels.withColumn("rbin", b), [*g, "rbin"], [F.count("*").alias("n_pix")], {"one_median": (F.col(one), 0.5), "other_median": (F.col(other), 0.5)})
    return s.where(F.col("n_pix") >= least).withColumns({"difference": F.col("one_median") - F.col("other_median"), "same_sign": F.signum("one_median") == F.signum("other_median"), "r_mid": (F.col("rbin") + 0.5) * width})
