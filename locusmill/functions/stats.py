"""Scalar functions of the association model."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

_LN10 = math.log(10.0)


def neg_log10_two_sided(t: np.ndarray) -> np.ndarray:
    """-log10 of the two-sided normal tail of t; finite however large t is."""
    z = np.abs(np.asarray(t, np.float64))
    out = np.full(z.shape, np.nan)
    near = z < 35
    out[near] = [-math.log10(math.erfc(x / math.sqrt(2))) + 0.0 for x in z[near]]
    far = z >= 35
    x = z[far]
    # log of the tail's asymptotic series: phi(x)/x (1 - 1/x^2 + 3/x^4 - 15/x^6)
    tail = np.log1p(-1 / x**2 + 3 / x**4 - 15 / x**6)
    out[far] = (x**2 / 2 + np.log(x) + 0.5 * math.log(2 * math.pi) - math.log(2.0) - tail) / _LN10
    return out


@F.arrow_udf(DoubleType())
def neg_log10_p(t: pa.Array) -> pa.Array:
    """Column function: -log10 p of a test statistic; null stays null."""
    x = t.to_numpy(zero_copy_only=False).astype(np.float64)
    return pa.array(neg_log10_two_sided(x), pa.float64(), mask=np.isnan(x))


def chi2_1_tail(x: float) -> float:
    """Upper tail of chi-squared with one degree of freedom."""
    return math.erfc(math.sqrt(max(x, 0.0) / 2))


def inverse_link(eta: Column, family: str = "gaussian", link: str = "identity") -> Column:
    """Mean for a linear predictor."""
    forms = {("gaussian", "identity"): eta, ("gaussian", "log"): F.exp(eta), ("gaussian", "sqrt"): eta * eta, ("binomial", "logit"): 1 / (1 + F.exp(-eta))}
    if (family, link) not in forms:
        raise ValueError(f"no inverse link for {family}, {link}")
    return forms[family, link]


def mean_slope(mu: Column, family: str = "gaussian", link: str = "identity") -> Column:
    """Derivative of the mean by the linear predictor, at mean mu."""
    forms = {("gaussian", "identity"): F.lit(1.0), ("gaussian", "log"): mu, ("gaussian", "sqrt"): 2 * F.sqrt(mu), ("binomial", "logit"): mu * (1 - mu)}
    if (family, link) not in forms:
        raise ValueError(f"no slope for {family}, {link}")
    return forms[family, link]


def strip_cell(c: Column) -> Column:
    """A cell without carriage returns, quotes and outer blanks."""
    return F.trim(F.regexp_replace(c, r'[\r"]', ""))


def number(c: Column) -> Column:
    """try_cast to double; what isn't a number is null."""
    return c.try_cast("double")


def pair_key(a: Column, b: Column) -> Column:
    """A key that is the same for (a, b) and (b, a)."""
    return F.struct(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi"))


def or_default(c: Column, default: str = "NA") -> Column:
    """default where a text is null or empty."""
    return F.coalesce(F.when(c != "", c), F.lit(default))


def two_bits(byte: Column, k: int) -> Column:
    """The k-th pair of bits of a byte, least significant first."""
    return F.shiftright(byte, 2 * k).bitwiseAND(F.lit(3))


def dosage_of_code(code: Column) -> Column:
    """Packed genotype code to dosage: 0 is 2, 1 is missing, 2 is 1, 3 is 0."""
    return F.when(code == 0, 2.0).when(code == 2, 1.0).when(code == 3, 0.0)
