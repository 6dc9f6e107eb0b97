"""Mathematical functions as Column expressions."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

LOG_SQRT_2PI = math.log(math.sqrt(2 * math.pi))
#: Lanczos coefficients (g = 7).
_LANCZOS = [0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059, 12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7]


def z_score(x: Column, mean: Column, stdv: Column) -> Column:
    return (x - mean) / stdv


def normal_pdf(x: Column, mean: Column, stdv: Column) -> Column:
    return F.exp(log_normal_pdf(x, mean, stdv))


def log_normal_pdf(x: Column, mean: Column, stdv: Column) -> Column:
    z = (x - mean) / stdv
    return -F.lit(LOG_SQRT_2PI) - F.ln(stdv) - z * z / 2


def logsum(a: Column, b: Column) -> Column:
    """ln(exp(a) + exp(b)); null is minus infinity."""
    hi, lo = F.greatest(a, b), F.least(a, b)
    return F.when(a.isNull() | b.isNull(), hi).otherwise(hi + F.log1p(F.exp(lo - hi)))


def logsum_agg(x: Column, most: Column) -> Column:
    """Aggregate ln(sum(exp(x))), given the group's largest x."""
    return F.max(most) + F.ln(F.sum(F.exp(x - most)))


def modification_probability(ll_modified: Column, ll_plain: Column) -> Column:
    return 1 / (1 + F.exp(ll_plain - ll_modified))


def as_byte(p: Column) -> Column:
    return F.least(F.lit(255), F.floor(p * 255)).cast("int")


def phred(p: Column, most: float = 30.0) -> Column:
    return F.when(p <= 0, F.lit(most)).otherwise(F.least(F.lit(most), -10 * F.ln(p) / F.lit(math.log(10))))


def strand_odds(ref_fwd: Column, ref_rev: Column, alt_fwd: Column, alt_rev: Column) -> Column:
    """Symmetric odds ratio of strand counts, each count plus 1."""
    a, b, c, d = (x + 1.0 for x in (ref_fwd, ref_rev, alt_fwd, alt_rev))
    r = (a * d) / (b * c)
    return F.ln(r + 1 / r) + F.ln(F.least(a, b) / F.greatest(a, b)) - F.ln(F.least(c, d) / F.greatest(c, d))


def choose(n: Column, k: Column) -> Column:
    return F.when((k < 0) | (k > n), F.lit(0).cast("long")).otherwise(F.aggregate(F.sequence(F.lit(1), F.greatest(k, F.lit(1))), F.lit(1).cast("long"), lambda a, i: F.when(i > k, a).otherwise(F.floor(a * (n - i + 1) / i).cast("long"))))


def skip_bin(level_1: Column, level_2: Column, width: float = 0.5, bins: int = 30) -> Column:
    return F.least(F.floor(F.abs(level_1 - level_2) / width), F.lit(bins - 1)).cast("int")


def lgamma(x: Column) -> Column:
    """Log of the gamma function for positive x, by Lanczos' series."""
    y = x - 1
    s = F.lit(_LANCZOS[0])
    for i, c in enumerate(_LANCZOS[1:], 1):
        s = s + F.lit(c) / (y + i)
    t = y + 7.5
    return F.lit(LOG_SQRT_2PI) + (y + 0.5) * F.ln(t) - t + F.ln(s)


def gamma_sum_log_density(x: Column, n: Column, shape: float, rate: Column) -> Column:
    """Log density at x of a sum of n gamma variables of one shape and rate."""
    a = n * shape
    return a * F.ln(rate) - lgamma(a) + (a - 1) * F.ln(x) - rate * x


def inverse_gaussian_lambda(mean: Column, stdv: Column) -> Column:
    return mean**3 / stdv**2


def fisher_exact(a: int, b: int, c: int, d: int) -> float:
    """Two-sided p of a 2 x 2 table: the tables of its margins that are no likelier."""
    n, row, col = a + b + c + d, a + b, a + c
    if not n:
        return 1.0
    f = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, n + 1)))])
    x = np.arange(max(0, row + col - n), min(row, col) + 1)
    log_p = f[row] + f[n - row] + f[col] + f[n - col] - f[n] - f[x] - f[row - x] - f[col - x] - f[n - row - col + x]
    own = log_p[a - x[0]]
    return float(min(1.0, np.exp(log_p[log_p <= own + 1e-7]).sum()))


def fisher_phred(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Strand bias as a phred score of the exact two-sided p; 1000 where p underflows. Tables are walked from the own one to both
    ends, each by its ratio to the one before, so that a table costs one logarithm; their weights are relative to the own one."""
    row, col, n = a + b, a + c, a + b + c + d
    f = lambda x: lgamma(x + 1.0)  # noqa: E731  log of the factorial
    own = f(row) + f(n - row) + f(col) + f(n - col) - f(n) - f(a) - f(b) - f(c) - f(d)
    zero = F.lit(0).cast("long")
    start = F.struct(F.lit(0.0).alias("l"), F.lit(0.0).alias("s"))

    def side(down, across, near, far):
        """Sum over the tables that lose from down and across and gain in near and far."""

        def step(v, i):
            w = v["l"] + F.ln((down - i + 1.0) * (across - i + 1.0) / ((near + i) * (far + i)))
            # As a variable of an inner function the weight is taken once.
            return F.get(F.transform(F.array(w), lambda w: F.struct(w.alias("l"), (v["s"] + F.when(w <= 1e-7, F.exp(w)).otherwise(0.0)).alias("s"))), F.lit(0))

        most = F.least(down, across)
        steps = F.when(most > 0, F.sequence(zero + 1, F.greatest(most, zero + 1))).otherwise(F.array().cast("array<bigint>"))
        return F.aggregate(steps, start, step)["s"]

    total = F.least(F.lit(1.0), F.exp(own) * (1.0 + side(b, c, a, d) + side(a, d, b, c)))
    scaled = lambda p: F.when(p > 0, F.least(F.lit(1000.0), -10 * F.log10(p)) + 0.0).otherwise(1000.0)
    return F.when(n == 0, 0.0).otherwise(F.get(F.transform(F.array(total), scaled), F.lit(0)))
