"""Scalar expressions of the age-period-cohort model, as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def cohort_index(age: Column | str, period: Column | str, n_ages: int | Column, per_age: int | Column) -> Column:
    """Cohort number of a Lexis cell: (I - i) * M + j."""
    return ((n_ages - col(age)) * per_age + col(period)).cast("int")


def inv_logit(eta: Column | str) -> Column:
    """1 / (1 + exp(-eta)); stable for large eta, where exp(eta) / (1 + exp(eta)) is not a number."""
    return 1.0 / (1.0 + F.exp(-col(eta)))


def logit(p: Column | str) -> Column:
    p = col(p)
    return F.ln(p / (1.0 - p))


def empirical_logit(cases: Column | str, population: Column | str) -> Column:
    """Logit of (y + 0.5) / (n + 1), the proportion kept 1e-8 away from 0 and 1."""
    p = (col(cases) + F.lit(0.5)) / (col(population) + F.lit(1.0))
    return logit(F.least(F.greatest(p, F.lit(1e-8)), F.lit(1 - 1e-8)))


def softplus(eta: Column | str) -> Column:
    e = col(eta)
    return F.greatest(e, F.lit(0.0)) + F.log1p(F.exp(-F.abs(e)))


def x_log_ratio(x: Column | str, y: Column | str) -> Column:
    """x * ln(x / y), 0 where x is 0."""
    x, y = col(x), col(y)
    return F.when(x > 0, x * F.ln(x / y)).otherwise(F.lit(0.0))


def deviance_term(cases: Column | str, population: Column | str, p: Column) -> Column:
    """Binomial deviance of a cell, 0 ln 0 being 0."""
    y, n = col(cases), col(population)
    return 2.0 * (x_log_ratio(y, n * p) + x_log_ratio(n - y, n * (1.0 - p)))


def pg_mean(c: Column | str) -> Column:
    """Mean of PG(1, c): tanh(c/2) / (2c), 1/4 near 0."""
    c = col(c)
    near = F.abs(c) < 1e-4
    safe = F.when(near, F.lit(1.0)).otherwise(c)
    return F.when(near, F.lit(0.25)).otherwise(F.tanh(safe / 2) / (2 * safe))


def pg_variance(c: Column | str) -> Column:
    """Variance of PG(1, c), 1/24 near 0."""
    c = col(c)
    near = F.abs(c) < 1e-4
    safe = F.when(near, F.lit(1.0)).otherwise(c)
    t = F.tanh(safe / 2)
    return F.when(near, F.lit(1.0 / 24)).otherwise(((2 / safe) * t - (1 - t * t)) / (4 * safe * safe))


def fisher_weight(population: Column | str, p: Column) -> Column:
    return col(population) * p * (1.0 - p)
