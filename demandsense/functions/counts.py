"""Quantiles of count distributions (Poisson, negative binomial) as one Column.

For each row the smallest n with CDF(n) >= q is found by folding the probability
recurrence over 0..N in log space; N = ceil(mean + 10 sd + 20) leaves no visible
tail.  All asked quantiles come out of the same fold.
"""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The three reported quantiles, the smallest mean, and the variance
# to mean ratio above which a series counts as over-dispersed.
QUANTILES = (0.1, 0.5, 0.9)
MIN_MEAN = 1e-6
OVERDISPERSION = 1.05


def _first_reaching(log_p0: Column, log_step, upper: Column, qs) -> Column:
    """Fold n = 0..upper keeping (log pmf, cdf, answer per quantile)."""
    def pick(cdf, n, prev):
        return F.array(*[
            F.coalesce(prev[i], F.when(cdf >= F.lit(q - 1e-12), n)) for i, q in enumerate(qs)
        ])

    none = F.array(*[F.lit(None).cast("double") for _ in qs])
    p0 = F.exp(log_p0)
    start = F.struct(log_p0.alias("lp"), p0.alias("cdf"), pick(p0, F.lit(0.0), none).alias("ans"))

    def step(acc, n):
        n = n.cast("double")
        lp = acc["lp"] + log_step(n)
        cdf = acc["cdf"] + F.exp(lp)
        return F.struct(lp.alias("lp"), cdf.alias("cdf"), pick(cdf, n, acc["ans"]).alias("ans"))

    folded = F.aggregate(F.sequence(F.lit(1), upper.cast("int")), start, step)
    return F.transform(folded["ans"], lambda a: F.coalesce(a, upper.cast("double")))


def count_quantiles(mean: Column, std: Column | None = None, qs=QUANTILES) -> Column:
    """array<double> of quantiles by moments: negative binomial when the variance is
    clearly above the mean, Poisson otherwise (always Poisson without ``std``)."""
    m = F.greatest(F.coalesce(mean.cast("double"), F.lit(0.0)), F.lit(MIN_MEAN))
    var = F.coalesce(std.cast("double"), F.lit(0.0)) ** 2 if std is not None else F.lit(0.0)
    over = var > m * OVERDISPERSION
    sd = F.sqrt(F.greatest(var, m))
    upper = F.ceil(m + 10.0 * sd + 20.0)
    k = m * m / F.greatest(var - m, F.lit(1e-6))
    log_p, log_q = F.log(k / (k + m)), F.log(m / (k + m))
    poisson = _first_reaching(-m, lambda n: F.log(m) - F.log(n), upper, qs)
    if std is None:
        return poisson
    negbin = _first_reaching(k * log_p, lambda n: F.log(k + n - 1.0) - F.log(n) + log_q, upper, qs)
    return F.when(over, negbin).otherwise(poisson)


def poisson_quantiles(mean: Column, qs=QUANTILES) -> Column:
    return count_quantiles(mean, None, qs)
