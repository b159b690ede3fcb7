"""Inverse normal distribution function as a Column (Wichura, AS 241)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .clean import c

# The published coefficients of algorithm AS 241 (PPND16), from the
# highest power down, for the central region and the nearer tail.
CENTRAL_NUM = (2.5090809287301226727e3, 3.3430575583588128105e4, 6.7265770927008700853e4,
               4.5921953931549871457e4, 1.3731693765509461125e4, 1.9715909503065514427e3,
               1.3314166789178437745e2, 3.3871328727963666080e0)
CENTRAL_DEN = (5.2264952788528545610e3, 2.8729085735721942674e4, 3.9307895800092710610e4,
               2.1213794301586595867e4, 5.3941960214247511077e3, 6.8718700749205790830e2,
               4.2313330701600911252e1, 1.0)
TAIL_NUM = (7.74545014278341407640e-4, 2.27238449892691845833e-2, 2.41780725177450611770e-1,
            1.27045825245236838258e0, 3.64784832476320460504e0, 5.76949722146069140550e0,
            4.63033784615654529590e0, 1.42343711074968357734e0)
TAIL_DEN = (1.05075007164441684324e-9, 5.47593808499534494600e-4, 1.51986665636164571966e-2,
            1.48103976427480074590e-1, 6.89767334985100004550e-1, 1.67638483018380384940e0,
            2.05319162663775882187e0, 1.0)


def _horner(t: Column, coefficients) -> Column:
    value = F.lit(coefficients[0])
    for k in coefficients[1:]:
        value = value * t + F.lit(k)
    return value


def probit(p) -> Column:
    """Valid for p in [1e-6, 1 - 1e-6], where ranks are clipped."""
    p = c(p)
    q = p - 0.5
    t = F.lit(0.180625) - q * q
    central = q * _horner(t, CENTRAL_NUM) / _horner(t, CENTRAL_DEN)
    r = F.sqrt(-F.ln(F.least(p, F.lit(1.0) - p))) - 1.6
    tail = F.signum(q) * _horner(r, TAIL_NUM) / _horner(r, TAIL_DEN)
    return F.when(F.abs(q) <= 0.425, central).otherwise(tail)


def spread_rank(rank, driver: str = "gaussian", sigma: float = 1.0) -> Column:
    """Map a percentile rank to a gaussian, uniform or cauchy score."""
    r = F.when(c(rank).isNotNull(),
               F.greatest(F.least(c(rank), F.lit(1 - 1e-6)), F.lit(1e-6)))
    if driver == "uniform":
        return r - 0.5
    if driver == "cauchy":
        return F.tan(F.pi() * (r - 0.5)) * F.lit(float(sigma))
    return probit(r) * F.lit(float(sigma))


def bind(value: Column, use) -> Column:
    """``use(value)`` with the value computed once per row, for formulas that repeat an
    expensive argument many times."""
    return F.transform(F.array(value), use)[0]
