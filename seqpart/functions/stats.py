"""Score statistics as JVM-side Column expressions (nats inside, bits where stated)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

LN2 = math.log(2.0)
TINY_TAIL = 5e-9  # below this a Gumbel tail equals its own exponent to double precision
OMEGA = 1.0 / 256.0


def bits(nats: Column) -> Column:
    return nats / F.lit(LN2)


# Gumbel ------------------------------------------------------------------------------------------------
def _gy(x: Column, mu, lam) -> Column:
    return (x - mu) * lam


def gumbel_pdf(x, mu, lam) -> Column:
    y = _gy(x, mu, lam)
    return F.lit(lam) * F.exp(-y - F.exp(-y)) if not isinstance(lam, Column) else lam * F.exp(-y - F.exp(-y))


def gumbel_logpdf(x, mu, lam) -> Column:
    y = _gy(x, mu, lam)
    return F.log(lam if isinstance(lam, Column) else F.lit(lam)) - y - F.exp(-y)


def gumbel_cdf(x, mu, lam) -> Column:
    return F.exp(-F.exp(-_gy(x, mu, lam)))


def gumbel_logcdf(x, mu, lam) -> Column:
    return -F.exp(-_gy(x, mu, lam))


def gumbel_surv(x, mu, lam) -> Column:
    tail = F.exp(-_gy(x, mu, lam))
    return F.when(tail < TINY_TAIL, tail).otherwise(-F.expm1(-tail))


def gumbel_logsurv(x, mu, lam) -> Column:
    y = _gy(x, mu, lam)
    tail = F.exp(-y)
    return (
        F.when(tail < TINY_TAIL, -y)
        .when(F.exp(-tail) < TINY_TAIL, -F.exp(-tail))
        .otherwise(F.log(-F.expm1(-tail)))
    )


def gumbel_invcdf(p, mu, lam) -> Column:
    return mu - F.log(-F.log(p)) / lam


def gumbel_invsurv(p, mu, lam) -> Column:
    return mu - F.log(-F.log1p(-p)) / lam


# exponential -----------------------------------------------------------------------------------------------
def exp_pdf(x, mu, lam) -> Column:
    return F.when(x < mu, F.lit(0.0)).otherwise(lam * F.exp(-(x - mu) * lam))


def exp_cdf(x, mu, lam) -> Column:
    return F.when(x < mu, F.lit(0.0)).otherwise(-F.expm1(-(x - mu) * lam))


def exp_surv(x, mu, lam) -> Column:
    return F.when(x < mu, F.lit(1.0)).otherwise(F.exp(-(x - mu) * lam))


def exp_logsurv(x, mu, lam) -> Column:
    return F.when(x < mu, F.lit(0.0)).otherwise(-(x - mu) * lam)


def exp_invcdf(p, mu, lam) -> Column:
    return mu - F.log1p(-p) / lam


# scores -------------------------------------------------------------------------------------------------------
def null_score(n: Column) -> Column:
    """Length model of the null hypothesis: L ln(L/(L+1)) + ln(1/(L+1))."""
    return n * F.log(n / (n + 1)) - F.log(n + 1)


def logsum(a: Column, b: Column) -> Column:
    """ln(e^a + e^b) without overflow."""
    return F.greatest(a, b) + F.log1p(F.exp(-F.abs(a - b)))


def domain_bits(envsc: Column, n: Column, env_len: Column, null: Column, correction: Column) -> Column:
    """Envelope score in bits after the composition correction."""
    outside = (n - env_len) * F.log(n / (n + 3))
    bias = logsum(F.lit(0.0), F.lit(math.log(OMEGA)) + correction)
    return bits(envsc + outside - (null + bias))


def log_p(score_bits: Column, tau: Column, lam: Column) -> Column:
    return exp_logsurv(score_bits, tau, lam)


def significant(lnp: Column, z, e) -> Column:
    """Strict test in log space: lnP + ln Z < ln E."""
    ln_z = F.log(z) if isinstance(z, Column) else F.lit(math.log(z))
    ln_e = F.log(e) if isinstance(e, Column) else F.lit(math.log(e))
    return lnp + ln_z < ln_e


def outside_identity_window(pid: Column, low: float = 0.0, high: float = 0.0, flip: bool = False) -> Column:
    """Identity rejects when it lies outside (low, high]; ``flip`` rejects inside instead."""
    inside = (pid > low) & (pid <= high)
    return inside if flip else ~inside


def gate_stage(usc, null, filt, vit, fwd, mmu, vmu, tau, lam, f1=0.02, f2=1e-3, f3=1e-5, bias=True) -> Column:
    """Name of the filter stage a pair stops at, or ``pass``. Ties with a threshold pass."""
    filtersc = filt if bias else null
    p_msv = gumbel_surv(bits(usc - null), mmu, lam)
    p_bias = gumbel_surv(bits(usc - filtersc), mmu, lam)
    p_vit = gumbel_surv(bits(vit - filtersc), vmu, lam)
    p_fwd = exp_surv(bits(fwd - filtersc), tau, lam)
    return (
        F.when(p_msv > f1, "msv")
        .when(p_bias > f1, "bias")
        .when((p_bias > f2) & (p_vit > f2), "viterbi")
        .when(p_fwd > f3, "forward")
        .otherwise("pass")
    )


def scaled_evalue(e, n: Column, z) -> Column:
    """Threshold rescaled from the search space Z to the current number of records, 10 decimals."""
    return F.round(F.lit(e) * n / F.lit(z), 10)


def reportable(lnp: Column, score: Column, z, e: float | None = 10.0, t: float | None = None) -> Column:
    """Inclusive report/include test: e^lnP * Z <= E, or score >= T when a score threshold is set."""
    return score >= t if t is not None else F.exp(lnp) * z <= e


def posterior_char(p: Column) -> Column:
    """Posterior probability as one character: ``*`` from .95, else its rounded tenth."""
    return F.when(p + 0.05 >= 1.0, "*").otherwise(F.floor((p + 0.05) * 10.0).cast("string"))


def posterior_value(c: Column) -> Column:
    return (
        F.when(c == "*", 1.0).when(c == ".", 0.0).when(c == "0", 0.01).otherwise(c.try_cast("double") / 10.0)
    )
