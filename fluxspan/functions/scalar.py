"""Column functions of the photometric domain.  Missing is NULL everywhere: NaN and infinities become NULL on entry."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Square arcseconds in a steradian, MJy/sr to Jy/arcsec2, zero point of AB magnitudes in Jy.
ARCSEC2_PER_SR = 2.350443e-11
MJY_SR_TO_JY_ARCSEC2 = 2.350443e-5
AB_ZERO_JY = 3631.0
#: Pivot colour, wavelength (micron) and R_V of the extinction law, floor of its relative error.
COLOR_PIVOT = 0.40
EXT_LAMBDA, EXT_RV, EXT_FLOOR = 1.501, 3.1, 0.10


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def fin(c: Column | str) -> Column:
    """The value if it is a finite number, else NULL (FN8)."""
    c = col(c).cast("double")
    return F.when(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), c)


def parse(c: Column | str) -> Column:
    """A text as a finite double, else NULL."""
    return fin(F.trim(col(c)).try_cast("double"))


def fin_pos(c: Column | str) -> Column:
    return F.when(fin(c) > 0, col(c).cast("double"))


def fin_nonneg(c: Column | str) -> Column:
    return F.when(fin(c) >= 0, col(c).cast("double"))


def truthy(c: Column | str) -> Column:
    return F.coalesce(F.lower(F.trim(col(c).cast("string"))).isin("true", "1", "yes", "y"), F.lit(False))


def normalize_name(c: Column | str) -> Column:
    """Upper case, hyphens as blanks; NGC and IC numbers without leading zeros; other text trimmed (FN1)."""
    text = F.trim(F.regexp_replace(F.translate(F.upper(col(c)), "-", " "), r"\s+", " "))
    kind, number = F.regexp_extract(text, r"^(NGC|IC) ?0*([0-9]+)$", 1), F.regexp_extract(text, r"^(NGC|IC) ?0*([0-9]+)$", 2)
    return F.when(kind != "", F.concat_ws(" ", kind, number)).otherwise(text)


def slug(c: Column | str, joiner: str = "_", length: int = 80) -> Column:
    """Letters and digits, other runs as one joiner, none at the ends (FN2)."""
    return F.substring(F.regexp_replace(F.regexp_replace(F.trim(col(c)), r"[^A-Za-z0-9]+", joiner), f"^{joiner}+|{joiner}+$", ""), 1, length)


def companion(c: Column | str, one: str = "f150w", other: str = "f090w") -> Column:
    """File name of the other band: the first occurrence of the band, in any case, replaced (FN3)."""
    return F.regexp_replace(col(c), f"(?i)^(.*?){one}", f"$1{other}")


def product_url(c: Column | str, base: str) -> Column:
    return F.concat(F.lit(base), F.replace(F.url_encode(col(c)), F.lit("+"), F.lit("%20")))


def ab_zeropoint(area: Column | str) -> Column:
    """Magnitude of one image unit (MJy/sr) in a pixel of `area` arcsec2 (FN4)."""
    return -2.5 * F.log10(F.lit(MJY_SR_TO_JY_ARCSEC2) * fin_pos(area) / AB_ZERO_JY)


def flux_from_mag(mag: Column | str, area: Column | str) -> Column:
    return F.pow(F.lit(10.0), -0.4 * (fin(mag) - ab_zeropoint(area)))


def mbar(p0: Column | str, pr: Column | str, area: Column | str) -> Column:
    """Fluctuation magnitude of the power left after contaminants (FN5); NULL unless it is positive."""
    left = fin(p0) - F.coalesce(fin(pr), F.lit(0.0))
    return F.when(left > 0, -2.5 * F.log10(F.when(left > 0, left)) + ab_zeropoint(area))


def mu_to_mpc(mu: Column | str) -> Column:
    return F.pow(F.lit(10.0), (fin(mu) - 25) / 5)


def sigma_mpc(mu: Column | str, sigma: Column | str) -> Column:
    return mu_to_mpc(mu) * F.lit(0.46051701859880917) * fin(sigma)


def distance_fraction(delta: Column | str) -> Column:
    """Relative distance error of a modulus difference (FN6)."""
    return F.pow(F.lit(10.0), fin(delta) / 5) - 1


def quadrature(*cols: Column | str) -> Column:
    """Root of the summed squares of finite, non-negative terms; NULL if there is none (FN7)."""
    terms = [fin_nonneg(c) for c in cols]
    total = reduce(lambda a, b: a + b, [F.coalesce(t * t, F.lit(0.0)) for t in terms])
    return F.when(reduce(lambda a, b: a | b, [t.isNotNull() for t in terms]), F.sqrt(total))


def fmt_pm(value: Column | str, sigma: Column | str, digits: int = 3) -> Column:
    """`value ± sigma` as text; without sigma the value alone (FN9)."""
    v, s = (F.regexp_replace(F.format_number(fin(c), digits), ",", "") for c in (value, sigma))
    return F.when(v.isNull(), F.lit("")).when(s.isNull(), v).otherwise(F.concat(v, F.lit(" ± "), s))


def effective_flag(c: Column | str, harmless: tuple[str, ...] = ("truncated_file_warning",)) -> Column:
    """Quality flags without harmless ones; `clean` if none is left (FN10)."""
    left = F.filter(F.split(F.coalesce(col(c), F.lit("")), ";"), lambda x: (F.trim(x) != "") & (F.trim(x) != "clean") & ~F.trim(x).isin(*harmless))
    return F.when(F.size(left) == 0, F.lit("clean")).otherwise(F.array_join(left, ";"))


def expected_size(size: Column | str, size_kb: Column | str) -> Column:
    """Bytes: the size, else kilobytes times 1024, else NULL (FN11)."""
    return F.coalesce(col(size).try_cast("long"), (col(size_kb).try_cast("double") * 1024).cast("long"))


def extinction_coefficient() -> float:
    """A(F150W) for E(B-V) = 1 from the near-infrared law: R_V (a + b / R_V) with x = 1 / wavelength."""
    x = 1 / EXT_LAMBDA
    return EXT_RV * (0.574 * x**1.61 - 0.527 * x**1.61 / EXT_RV)
