"""Gamma-family functions on columns, evaluated in Arrow batches."""

from __future__ import annotations

from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql.functions import pandas_udf

from seqpart.session import ship_package

# --- fixed values: Lanczos coefficients for ln Gamma, g = 7 ------------------------------------------------------
LANCZOS = (0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059,
           12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7)
# -----------------------------------------------------------------------------------------------------------------


def _ln_gamma(x):
    x = np.asarray(x, dtype=float) - 1.0
    total = np.full(x.shape, LANCZOS[0])
    for at, c in enumerate(LANCZOS[1:], start=1):
        total += c / (x + at)
    t = x + 7.5
    return 0.5 * np.log(2 * np.pi) + (x + 0.5) * np.log(t) - t + np.log(total)


def _gamma_p(a, x):
    """Regularised lower incomplete gamma: series below a+1, continued fraction above."""
    a, x = np.asarray(a, float), np.asarray(x, float)
    scale = np.where(x > 0, np.exp(a * np.log(np.where(x > 0, x, 1.0)) - x - _ln_gamma(a)), 0.0)
    term = 1.0 / a
    total = term.copy()
    with np.errstate(over="ignore", invalid="ignore"):
        for k in count(1):
            term = np.where(x < a + 1, term * x / (a + k), 0.0)
            total = total + term
            if not (np.abs(term) > 1e-15 * np.abs(total)).any():
                break
        b = x + 1.0 - a
        c, d = np.full(x.shape, 1e300), 1.0 / np.where(b == 0, 1e-300, b)
        h = d
        for k in count(1):
            an = -k * (k - a)
            b = b + 2.0
            d = 1.0 / np.where(np.abs(an * d + b) < 1e-300, 1e-300, an * d + b)
            c = np.where(np.abs(b + an / c) < 1e-300, 1e-300, b + an / c)
            h = h * d * c
            if not (np.abs(d * c - 1.0)[x >= a + 1] > 1e-14).any():
                break
    return np.where(x < a + 1, scale * total, 1.0 - scale * h)


def _poly_gamma(x, order: int):
    """Digamma (order 0) or trigamma (order 1): shift above 10, then the asymptotic series."""
    x = np.asarray(x, float).copy()
    out = np.zeros_like(x)
    for _ in range(10):
        small = x < 10
        out = out + np.where(small, -1.0 / x if order == 0 else 1.0 / (x * x), 0.0)
        x = np.where(small, x + 1, x)
    z = 1.0 / (x * x)
    if order == 0:
        return out + np.log(x) - 0.5 / x - z * (1 / 12 - z * (1 / 120 - z * (1 / 252 - z * (1 / 240 - z / 132))))
    return out + 1 / x + z / 2 + z / x * (1 / 6 - z * (1 / 30 - z * (1 / 42 - z * (1 / 30 - z * 5 / 66))))


def _ln_gamma_series(x: pd.Series) -> pd.Series:
    return pd.Series(_ln_gamma(x))


def _gamma_p_series(a: pd.Series, x: pd.Series) -> pd.Series:
    return pd.Series(_gamma_p(a, x))


def _digamma_series(x: pd.Series) -> pd.Series:
    return pd.Series(_poly_gamma(x, 0))


def _trigamma_series(x: pd.Series) -> pd.Series:
    return pd.Series(_poly_gamma(x, 1))


def _erfc_series(x: pd.Series) -> pd.Series:
    x = np.asarray(x, float)
    p = _gamma_p(np.full(x.shape, 0.5), x * x)
    return pd.Series(np.where(x >= 0, 1.0 - p, 1.0 + p))


def _columnar(fn):
    """A Column function over ``fn``; the package is made importable in the workers first."""

    def call(*cols: Column) -> Column:
        ship_package(SparkSession.active())
        return pandas_udf(fn, "double")(*cols)

    return call


log_gamma = _columnar(_ln_gamma_series)
gamma_p = _columnar(_gamma_p_series)
digamma = _columnar(_digamma_series)
trigamma = _columnar(_trigamma_series)
erfc = _columnar(_erfc_series)
