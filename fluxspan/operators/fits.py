"""Weighted fits from sums: polynomials, predictions, leave-one-out, intrinsic scatter, model comparison, residuals."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import ab_zeropoint, fin, fin_pos
from ..plans.storage import discard, written


def _solved(d: DataFrame, degree: int) -> DataFrame:
    """Adds coefficients `_c0`.. and the inverse `_i00`, `_i01`.. of the normal matrix of a polynomial; NULL where it is singular.

    d: `_s0`.., sums of w x^k for k = 0..2 degree; `_t0`.., sums of w y x^k for k = 0..degree.  Cofactors, determinant and inverse
    are columns on their own: written into each other they are thousands of terms, which take Spark
    seconds to plan; as SQL text a formula is one call from Python.
    """
    n = degree + 1
    m = lambda i, j: f"_s{i + j}"
    pairs = [(i, j) for i in range(n) for j in range(i, n)]
    at = lambda c, i, j: f"{c}{min(i, j)}{max(i, j)}"

    def cofactor(i: int, j: int) -> str:
        r, c = [k for k in range(n) if k != i], [k for k in range(n) if k != j]
        minor = "1D" if n == 1 else m(r[0], c[0]) if n == 2 else f"{m(r[0], c[0])} * {m(r[1], c[1])} - {m(r[0], c[1])} * {m(r[1], c[0])}"
        return f"({minor})" if (i + j) % 2 == 0 else f"-({minor})"

    d = d.selectExpr("*", *[f"{cofactor(i, j)} as _a{i}{j}" for i, j in pairs])
    d = d.selectExpr("*", " + ".join(f"{m(0, j)} * {at('_a', 0, j)}" for j in range(n)) + " as _d")
    d = d.selectExpr("*", f"case when abs(_d) > 1e-13D * abs({' * '.join(m(i, i) for i in range(n))}) then _d end as _det")
    d = d.selectExpr("*", *[f"_a{i}{j} / _det as _i{i}{j}" for i, j in pairs])
    return d.selectExpr("*", *[" + ".join(f"{at('_i', i, j)} * _t{j}" for j in range(n)) + f" as _c{i}" for i in range(n)])


def weighted_poly_fit(df: DataFrame, g: list[str], degree: int, x: str = "x", y: str = "y", sigma: str = "sigma", pivot: float = 0.0, sigma_int: Column | float = 0.0) -> DataFrame:
    """Polynomial of degree 0 to 2 about a pivot, weights 1 / (sigma^2 + sigma_int^2): one pass of sums (AGG39).

    Returns n, c0.., cov_ij, chi2, chi2_red, aic, bic.  Too few points, or a singular matrix: NULL.
    """
    si = sigma_int if isinstance(sigma_int, Column) else F.lit(float(sigma_int))
    d = df.where(fin(x).isNotNull() & fin(y).isNotNull() & fin_pos(sigma).isNotNull()).select(*g, (F.col(x) - pivot).alias("_x"), F.col(y).cast("double").alias("_y"), (1 / (F.pow(sigma, 2) + si * si)).alias("_w"))
    p = lambda k: F.pow("_x", k) if k else F.lit(1.0)
    sums = d.groupBy(*g).agg(F.count("*").alias("n"), *[F.sum(F.col("_w") * p(k)).alias(f"_s{k}") for k in range(2 * degree + 1)], *[F.sum(F.col("_w") * F.col("_y") * p(k)).alias(f"_t{k}") for k in range(degree + 1)], F.sum(F.col("_w") * F.col("_y") * F.col("_y")).alias("_yy"))
    return _fit_columns(sums, g, degree)


def _fit_columns(sums: DataFrame, g: list[str], degree: int) -> DataFrame:
    k = degree + 1
    coefficients = [(f"c{i}", f"_c{i}") for i in range(k)] + [(f"cov_{i}{j}", f"_i{i}{j}") for i in range(k) for j in range(i, k)]
    out = _solved(sums, degree).selectExpr("*", *[f"case when n > {degree} then {e} end as {c}" for c, e in coefficients])
    model = " + ".join(f"c{i} * _t{i}" for i in range(k))
    out = out.selectExpr("*", f"case when c0 is not null then greatest(_yy - ({model}), 0D) end as chi2")
    kept = [f"`{c}`" for c in out.columns if not c.startswith("_") or c in g]
    return out.selectExpr(*kept, f"case when n > {k} then chi2 / (n - {k}) end as chi2_red", f"chi2 + {2 * k} as aic", f"chi2 + {k} * ln(cast(n as double)) as bic")


#: Fixed value: the largest scatter that the search tries, 0.02 doubled five times.
LARGEST_SCATTER = 0.64


def _valid(df: DataFrame, g: list[str], x: str, y: str, sigma: str, pivot: float) -> DataFrame:
    """The rows that a fit counts: g, _x, _y, _e."""
    ok = fin(x).isNotNull() & fin(y).isNotNull() & fin_pos(sigma).isNotNull()
    return df.where(ok).select(*g, (F.col(x) - pivot).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"), F.col(sigma).cast("double").alias("_e"))


def _names(degree: int) -> list[str]:
    return [*[f"_s{k}" for k in range(2 * degree + 1)], *[f"_t{k}" for k in range(degree + 1)], "_yy"]


def _sums_by_sigma(valid: DataFrame, g: list[str], degree: int) -> DataFrame:
    """Stored sums, without weights, of each group and sigma: weights depend on sigma alone."""
    p = lambda k: F.pow("_x", k) if k else F.lit(1.0)
    terms = [*[p(k) for k in range(2 * degree + 1)], *[F.col("_y") * p(k) for k in range(degree + 1)], F.col("_y") * F.col("_y")]
    return written(valid.groupBy(*g, "_e").agg(F.count("*").alias("_c"), *[F.sum(t).alias(c) for c, t in zip(_names(degree), terms, strict=True)]))


def _weighted(sums: DataFrame, g: list[str], degree: int, w: str) -> DataFrame:
    return sums.groupBy(*g).agg(F.expr("sum(_c) as n"), *[F.expr(f"sum({w} * {c}) as {c}") for c in _names(degree)])


def _scatters(sums: DataFrame, g: list[str], degrees: list[int], top: float, ways: int, rounds: int) -> DataFrame:
    """g, _degree, n, chi2_red, sigma_int from sums for the highest of the degrees.  Each round tries a grid of values for all
    groups and degrees at once and stores the cells that hold the roots, so a plan has one round."""
    high = max(degrees)

    def fitted(tried: DataFrame, names: list[str]) -> DataFrame:
        parts = [_fit_columns(tried.where(F.col("_degree") == k).select(*names, "n", *_names(k)), names, k).select(*names, "n", "chi2_red") for k in degrees]
        return reduce(lambda a, b: a.unionByName(b), parts)

    key = [*g, "_degree"]
    each = F.explode(F.array(*[F.lit(k) for k in degrees])).alias("_degree")
    base = written(fitted(_weighted(sums, g, high, "1 / (_e * _e)").select("*", each), key))
    cell = written(base.select(*key, F.lit(0.0).alias("lo"), F.lit(top).alias("hi")))
    for _ in range(rounds):
        grid = cell.selectExpr("*", f"explode(sequence(0, {ways})) as _k").selectExpr("*", f"lo + (hi - lo) * _k / {ways} as si_try").drop("_k")
        names = [*key, "lo", "hi", "si_try"]
        tried = _weighted(sums.join(grid, g), names, high, "1 / (_e * _e + si_try * si_try)")
        above = fitted(tried, names).groupBy(*key, "lo", "hi").agg(F.expr("max(case when chi2_red > 1 then si_try end) as _a"), F.expr("min(case when chi2_red <= 1 then si_try end) as _b"))
        new = written(above.selectExpr(*[f"`{c}`" for c in key], "coalesce(_a, lo) as lo", "_b as hi"))
        discard(cell)
        cell = new
    found = F.when(F.col("chi2_red") <= 1, 0.0).when(F.col("hi").isNotNull(), (F.col("lo") + F.col("hi")) / 2)
    return base.join(cell, key, "left").select(*key, "n", "chi2_red", found.alias("sigma_int"))


def intrinsic_scatter(df: DataFrame, g: list[str], degree: int, x: str = "x", y: str = "y", sigma: str = "sigma", pivot: float = 0.0, top: float = LARGEST_SCATTER, ways: int = 16, rounds: int = 8) -> DataFrame:
    """Scatter that makes reduced chi2 one: 0 if it is at most one already, NULL above `top` (AGG40).

    Rows are summed once for each group and sigma.  Each round tries a grid of values for all groups at once on those sums
    and keeps the cell that holds the root.
    """
    sums = _sums_by_sigma(_valid(df, g, x, y, sigma, pivot), g, degree)
    return _scatters(sums, g, [degree], top, ways, rounds).select(*g, "n", "chi2_red", "sigma_int")


def predict_poly(df: DataFrame, fits: DataFrame, g: list[str], degree: int, x: str = "x", pivot: float = 0.0) -> DataFrame:
    """Predicted value and its variance v' C v from the fit (AGG41)."""
    d = F.col(x) - pivot
    v = [F.pow(d, i) if i else F.lit(1.0) for i in range(degree + 1)]
    cov = lambda i, j: F.col(f"cov_{min(i, j)}{max(i, j)}")
    total = lambda xs: reduce(lambda a, b: a + b, xs)
    cols = [f"c{i}" for i in range(degree + 1)] + [f"cov_{i}{j}" for i in range(degree + 1) for j in range(i, degree + 1)]
    out = df.join(fits.select(*g, *cols), g)
    return out.withColumns({"predicted": total([F.col(f"c{i}") * v[i] for i in range(degree + 1)]), "fit_variance": total([v[i] * v[j] * cov(i, j) for i in range(degree + 1) for j in range(degree + 1)])}).drop(*cols)


def _left_out(d: DataFrame, degree: int, enough: Column) -> DataFrame:
    """Adds `_pred`, the prediction from the other rows, and its variance `_var`.  d: _x, `_s0`.. and `_t0`.., the sums less the
    row's own part."""
    p = lambda k: F.pow("_x", k) if k else F.lit(1.0)
    total = lambda xs: reduce(lambda a, b: a + b, xs)
    every = range(degree + 1)
    pred, var = total([F.col(f"_c{i}") * p(i) for i in every]), total([F.col(f"_i{min(i, j)}{max(i, j)}") * p(i) * p(j) for i in every for j in every])
    return _solved(d, degree).withColumns({"_pred": F.when(enough, pred), "_var": F.when(enough, var)})


def _own_parts(degree: int, y: str) -> dict[str, Column]:
    p = lambda k: F.pow("_x", k) if k else F.lit(1.0)
    return {f"_s{k}": F.col("_w") * p(k) for k in range(2 * degree + 1)} | {f"_t{k}": F.col("_w") * F.col(y) * p(k) for k in range(degree + 1)}


def leave_one_out(df: DataFrame, g: list[str], degree: int, x: str = "x", y: str = "y", sigma: str = "sigma", pivot: float = 0.0, sigma_int: float = 0.0) -> DataFrame:
    """Residual of each row from the fit to the others: group sums minus its own part, solved in place (AGG42)."""
    d = df.where(fin(x).isNotNull() & fin(y).isNotNull() & fin_pos(sigma).isNotNull()).withColumns({"_x": F.col(x) - pivot, "_w": 1 / (F.pow(sigma, 2) + sigma_int**2)})
    parts = _own_parts(degree, y)
    sums = d.groupBy(*g).agg(F.count("*").alias("_n"), *[F.sum(e).alias(f"{n}_all") for n, e in parts.items()])
    d = d.join(sums, g).withColumns({n: F.col(f"{n}_all") - e for n, e in parts.items()})
    d = _left_out(d, degree, F.col("_n") - 1 > degree)
    return d.withColumns({"loo_predicted": F.col("_pred"), "loo_residual": F.col(y) - F.col("_pred"), "loo_sigma": F.sqrt(F.pow(sigma, 2) + sigma_int**2 + F.col("_var"))}).select(*df.columns, "loo_predicted", "loo_residual", "loo_sigma")


def residual_summary(df: DataFrame, g: list[str], value: str, sigma: str) -> DataFrame:
    """Weighted mean and its error, weighted and plain RMS, median relative distance error in per cent (AGG38)."""
    ok = df.where(fin(value).isNotNull() & fin_pos(sigma).isNotNull()).withColumn("_w", 1 / F.pow(sigma, 2))
    m = ok.groupBy(*g).agg(F.count("*").alias("n"), (F.sum(F.col("_w") * F.col(value)) / F.sum("_w")).alias("weighted_mean"), F.sqrt(1 / F.sum("_w")).alias("mean_error"), F.sqrt(F.avg(F.pow(value, 2))).alias("rms"), F.median(100 * F.abs(F.pow(F.lit(10.0), F.col(value) / 5) - 1)).alias("median_distance_pct"))
    w = ok.join(m.select(*g, "weighted_mean"), g).groupBy(*g).agg(F.sqrt(F.sum(F.col("_w") * F.pow(F.col(value) - F.col("weighted_mean"), 2)) / F.sum("_w")).alias("wrms"))
    return m.join(w, g)


def model_comparison(df: DataFrame, g: list[str], x: str = "x", y: str = "y", sigma: str = "sigma", pivot: float = 0.0) -> DataFrame:
    """Constant, linear and quadratic: fit quality, intrinsic scatter, in-sample and leave-one-out scatter (AGG43).

    Leave-one-out sigmas, and so the weights of their scatter, include the intrinsic scatter of the whole sample; scatters
    are about their weighted mean.  Rows that the fits don't count have no part in the scatters.  The valid rows are stored
    and summed once for all models; each model reads them once more, beside its groups' fits.
    """
    rms = lambda w, r: F.sqrt(F.greatest(F.sum(w * r * r) / F.sum(w) - F.pow(F.sum(w * r) / F.sum(w), 2), F.lit(0.0)))
    rows = written(_valid(df, g, x, y, sigma, pivot))
    sums = _sums_by_sigma(rows, g, 2)
    extra = written(_scatters(sums, g, [0, 1, 2], LARGEST_SCATTER, 16, 8))
    whole = written(_weighted(sums, g, 2, "1 / (_e * _e)"))
    out = None
    for degree, name in enumerate(("constant", "linear", "quadratic")):
        mine = whole.select(*g, "n", *_names(degree))
        fit = written(_fit_columns(mine, g, degree).join(extra.where(F.col("_degree") == degree).select(*g, "sigma_int"), g))
        parts = _own_parts(degree, "_y")
        at = mine.select(*g, *[F.col(n).alias(f"{n}_all") for n in parts]).join(fit.select(*g, "n", "sigma_int", *[f"c{i}" for i in range(degree + 1)]), g)
        d = rows.join(written(at), g).withColumn("_w", 1 / F.pow("_e", 2)).withColumns({n: F.col(f"{n}_all") - e for n, e in parts.items()})
        d = _left_out(d, degree, F.col("n") - 1 > degree)
        inside = F.col("_y") - reduce(lambda a, b: a + b, [F.col(f"c{i}") * (F.pow("_x", i) if i else F.lit(1.0)) for i in range(degree + 1)])
        d = d.select(*g, "_w", inside.alias("_in"), (F.col("_y") - F.col("_pred")).alias("_loo"), (F.pow("_e", 2) + F.col("_var") + F.pow(F.coalesce("sigma_int", F.lit(0.0)), 2)).alias("_v"))
        d = d.withColumn("_u", F.when(F.col("_loo").isNotNull(), 1 / F.col("_v")))
        scatter = d.groupBy(*g).agg(rms(F.col("_w"), F.col("_in")).alias("wrms_in"), rms(F.col("_u"), F.col("_loo")).alias("wrms_loo"), F.stddev_samp("_loo").alias("rms_loo"))
        part = fit.select(*g, F.lit(name).alias("model"), "n", "chi2", "chi2_red", "aic", "bic", "sigma_int").join(scatter, g)
        out = part if out is None else out.unionByName(part)
    return out


def residual_diagnostics(df: DataFrame, g: list[str], residual: str, cols: list[str]) -> DataFrame:
    """Number and Pearson correlation of pairwise finite residuals with each quantity (AGG44)."""
    long = df.unpivot([*g, residual], cols, "quantity", "q").where(fin("q").isNotNull() & fin(residual).isNotNull())
    return long.groupBy(*g, "quantity").agg(F.count("*").alias("n"), F.corr("q", residual).alias("pearson_r"))


def window_sensitivity(df: DataFrame, g: list[str], delta: str = "delta") -> DataFrame:
    """Median, 16th and 84th percentile of the differences (AGG45)."""
    return df.groupBy(*g).agg(F.count(fin(delta)).alias("n"), *[F.percentile(fin(delta), F.lit(p)).alias(n) for p, n in ((0.16, "p16"), (0.5, "p50"), (0.84, "p84"))])


def variance_budget(df: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """Squared components of each row and their shares of the total (AGG46)."""
    long = df.unpivot([key], cols, "component", "s").where(fin("s").isNotNull()).withColumn("variance", F.pow("s", 2)).drop("s")
    return long.withColumn("share", F.col("variance") / F.sum("variance").over(Window.partitionBy(key)))


def spectrum_fit(points: DataFrame, g: list[str], e: str = "e", p: str = "p", least: int = 10) -> DataFrame:
    """P = P0 E + P1 by least squares: n, P0, P1, correlation, residual std, error and share of P0 (AGG26)."""
    ok = points.where((fin(e) > 0) & (fin(p) > 0))
    s = ok.groupBy(*g).agg(F.count("*").alias("n_fit"), F.regr_slope(p, e).alias("P0"), F.regr_intercept(p, e).alias("P1"), F.corr(p, e).alias("corr"), F.regr_sxx(p, e).alias("_sxx"), F.regr_syy(p, e).alias("_syy"), F.regr_sxy(p, e).alias("_sxy"))
    rss = F.greatest(F.col("_syy") - F.col("P0") * F.col("_sxy"), F.lit(0.0))
    good = (F.col("n_fit") >= least) & (F.col("P0") > 0)
    keep = lambda c: F.when(good, c)
    return s.select(*g, "n_fit", keep(F.col("P0")).alias("P0"), keep(F.col("P1")).alias("P1"), keep(F.col("corr")).alias("corr"), keep(F.sqrt(rss / (F.col("n_fit") - 1))).alias("fit_resid_std"), keep(F.sqrt(rss / (F.col("n_fit") - 2) / F.col("_sxx"))).alias("P0_fit_sigma"), keep(F.col("P0") / (F.col("P0") + F.col("P1"))).alias("frac"))


def gate_fit(fits: DataFrame) -> DataFrame:
    """Reason why a spectrum fit is refused, empty if it isn't (AGG27)."""
    why = F.when(F.col("P0").isNull() | (F.col("P0") <= 0), "P0 not positive").when(F.abs("corr") < 0.3, "weak correlation").when(F.col("P0") + F.col("P1") <= 0, "total not positive").when(F.abs("P1") > 5 * F.col("P0"), "P1 dominates").otherwise("")
    return fits.withColumn("gate_reason", why)


def power_budget(fits: DataFrame, area: str = "area") -> DataFrame:
    """P0 less contaminants, fluctuation power and magnitude raw and corrected, formal sigmas, first reason for failing (AGG28).

    fits: P0, Imean, Pr, P0_fit_sigma, `area` (arcsec2 of a pixel).  Raw values need P0 and Imean, corrected ones Pr as well:
    a missing Pr is no zero.
    """
    p0, mean, pr, sigma = fin_pos("P0"), fin_pos("Imean"), fin("Pr"), fin_pos("P0_fit_sigma")
    left = p0 - pr
    reason = F.when(p0.isNull(), "bad raw P0").when(mean.isNull(), "bad Imean").when(pr.isNull(), "Pr is not finite").when(left <= 0, "non-positive corrected power").otherwise("")
    ok, zero = left > 0, ab_zeropoint(area)
    magnitude = lambda pf: -2.5 * F.log10(pf) + zero
    have = F.when(p0.isNotNull() & mean.isNotNull(), p0 / mean)
    corrected = F.when(ok, left / mean)
    return fits.withColumns({
        "failure_reason": reason,
        "measurement_ok": reason == "",
        "P_fluc": F.when(have.isNotNull(), left),
        "Pr_over_P0": F.when(have.isNotNull(), pr / p0),
        "Pf_raw": have,
        "Pf": corrected,
        "mbar_raw": magnitude(have),
        "mbar": magnitude(corrected),
        "Pf_sigma_raw": have * sigma / p0,
        "Pf_sigma": corrected * sigma / left,
        "mbar_sigma_raw": F.when(have.isNotNull(), 2.5 / F.log(F.lit(10.0)) * sigma / p0),
        "mbar_sigma": F.when(corrected.isNotNull(), 2.5 / F.log(F.lit(10.0)) * sigma / left),
    })
