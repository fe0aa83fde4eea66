"""Posterior layer: draws are tables; effects, quantiles, convergence, DIC and plot data are aggregations over them."""

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.spec import AXES, ModelSpec

FIT = ("series_id", "spec_id")


def long_effects(draws: DataFrame, combined: bool = False) -> DataFrame:
    """(series_id, spec_id, chain, draw, param, idx, value) of the effects; ``combined`` adds the heterogeneity of an axis."""
    keys = [*FIT, "chain", "draw"]
    parts = []
    for a in AXES:
        whole = F.when(F.col(f"{a}2").isNull(), F.col(a)).otherwise(F.zip_with(a, f"{a}2", lambda x, y: x + y)) if combined else F.col(a)
        parts.append(F.struct(F.lit(a).alias("param"), whole.alias("values")))
    rows = draws.select(*keys, F.explode(F.array(*parts)).alias("p")).select(*keys, "p.param", F.posexplode("p.values").alias("at", "value"))
    return rows.select(*keys, "param", (F.col("at") + 1).alias("idx"), "value")


def long_parameters(draws: DataFrame) -> DataFrame:
    """Intercept, precisions, overdispersion and deviance in the same long form (idx 0)."""
    names = ["intercept", *[f"{a}{k}_parameter" for k in ("", "2") for a in AXES], "overdispersion", "deviance"]
    pairs = F.array(*[F.struct(F.lit(n).alias("param"), F.col(n).alias("value")) for n in names])
    rows = draws.select(*FIT, "chain", "draw", F.explode(pairs).alias("p")).select(*FIT, "chain", "draw", "p.param", F.lit(0).alias("idx"), "p.value")
    return rows.where(F.col("value").isNotNull())


def slopes(effects: DataFrame, *by: str) -> DataFrame:
    """Least-squares slope of every effect on its index."""
    return effects.groupBy(*by, "param").agg(F.regr_slope("value", F.col("idx").cast("double")).alias("slope"))


def centred(effects: DataFrame, *by: str) -> DataFrame:
    mean = F.avg("value").over(Window.partitionBy(*by, "param"))
    return effects.withColumn("value", F.col("value") - mean)


def gauge(effects: DataFrame, per_age: int, convention: str, *by: str) -> DataFrame:
    """Move the linear trend that a full model does not identify so that the chosen effect has slope 0 in every draw.

    With shift f: age + f M i, period - f j, cohort + f k, all centred again; predictors stay as they are (the
    intercept changes by the means).
    """
    if convention == "none":
        return effects
    sign = {"age": -1.0 / per_age, "period": 1.0, "cohort": -1.0}[convention]
    s = slopes(effects.where(F.col("param") == convention), *by).select(*by, (F.lit(sign) * F.col("slope")).alias("_f"))
    joined = effects.join(s, list(by)) if by else effects.join(F.broadcast(s))
    i = F.col("idx").cast("double")
    move = F.when(F.col("param") == "age", F.col("_f") * per_age * i).when(F.col("param") == "period", -F.col("_f") * i).otherwise(F.col("_f") * i)
    return centred(joined.withColumn("value", F.col("value") + move).drop("_f"), *by)


def quantiles(rows: DataFrame, probabilities: list[float], *by: str, value: str = "value") -> DataFrame:
    """Exact quantiles (linear interpolation) pooled over chains: one row a group and probability."""
    q = rows.groupBy(*by).agg(F.percentile(value, F.array(*[F.lit(float(p)) for p in probabilities])).alias("q"))
    pairs = F.arrays_zip(F.array(*[F.lit(float(p)) for p in probabilities]).alias("p"), F.col("q").alias("value"))
    return q.select(*by, F.explode(pairs).alias("x")).select(*by, F.col("x.p").alias("probability"), F.col("x.value").alias("value"))


def effects(draws: DataFrame, spec: ModelSpec, per_age: int, probabilities: list[float] | None = (0.5,), convention: str = "age", combined: bool = False, covariates: bool = False) -> DataFrame:
    """Mean (``probabilities`` None) or quantiles of every effect; gauge-fixed where the model has all three and no covariate."""
    rows = long_effects(draws, combined)
    rows = gauge(rows, per_age, convention if spec.full and not covariates else "none", *FIT, "chain", "draw")
    if probabilities is None:
        return rows.groupBy(*FIT, "param", "idx").agg(F.avg("value").alias("value"))
    return quantiles(rows, list(probabilities), *FIT, "param", "idx")


# --------------------------------------------------------------------------- convergence
def psrf_point(rows: DataFrame, *by: str) -> DataFrame:
    """Gelman-Rubin statistic of each group of (chain, value): point estimate and the moments behind it.

    Brooks and Gelman's correction (df + 3) / (df + 1) is applied; groups of one chain give null.
    """
    one = rows.groupBy(*by, "chain").agg(F.avg("value").alias("m"), F.var_samp("value").alias("s2"), F.count("value").cast("double").alias("n"))
    two = one.groupBy(*by).agg(
        F.count("*").cast("double").alias("m"), F.avg("n").alias("n"), F.avg("s2").alias("W"), F.var_samp("m").alias("vm"), F.var_samp("s2").alias("vs"),
        F.covar_samp("s2", F.col("m") * F.col("m")).alias("c2"), F.covar_samp("s2", "m").alias("c1"), F.avg("m").alias("mean"),
    )
    n, m, w, b = F.col("n"), F.col("m"), F.col("W"), F.col("n") * F.col("vm")
    v = (n - 1) / n * w + (1 + 1 / m) * b / n
    var_w, var_b = F.col("vs") / m, 2 * b * b / F.nullif(m - 1, F.lit(0.0))
    cov = n / m * (F.col("c2") - 2 * F.col("mean") * F.col("c1"))
    var_v = ((n - 1) * (n - 1) * var_w + (1 + 1 / m) * (1 + 1 / m) * var_b + 2 * (n - 1) * (1 + 1 / m) * cov) / (n * n)
    df = F.try_divide(2 * v * v, var_v)
    adjust = F.when(df.isNull(), F.lit(1.0)).otherwise((df + 3) / (df + 1))
    fix, rnd = (n - 1) / n, F.try_divide((1 + 1 / m) * b, n * w)
    return two.where(m > 1).select(*by, m.alias("n_chains"), adjust.alias("adjust"), fix.alias("fixed"), rnd.alias("random"), F.try_divide(2 * w * w, var_w).alias("df_within"), F.sqrt(adjust * (fix + rnd)).alias("psrf"))


def beta_cdf(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_cdf(1 - x, b, a)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1) or 1e-300)
    h = d
    for k in range(1, 500):
        for t in (k * (b - k) * x / ((a + 2 * k - 1) * (a + 2 * k)), -(a + k) * (a + b + k) * x / ((a + 2 * k) * (a + 2 * k + 1))):
            d, c = 1 / (1 + t * d or 1e-300), 1 + t / c or 1e-300
            h *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return front * h


def f_quantile(p: float, d1: float, d2: float) -> float:
    """Quantile of the F distribution by bisection."""
    if not (d1 > 0 and d2 > 0) or math.isinf(d2) or math.isnan(d2):
        d2 = 1e9 if d2 == math.inf else d2
        if not (d1 > 0 and d2 > 0):
            return math.nan
    d2 = min(d2, 1e9)
    lo, hi = 0.0, 1.0
    while beta_cdf(d1 * hi / (d1 * hi + d2), d1 / 2, d2 / 2) < p:
        hi *= 2
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if beta_cdf(d1 * mid / (d1 * mid + d2), d1 / 2, d2 / 2) < p else (lo, mid)
    return (lo + hi) / 2


def _f_975(d1: Column, d2: Column) -> Column:
    def values(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([f_quantile(0.975, x, y) for x, y in zip(a.fillna(0), b.fillna(math.inf))])

    return F.pandas_udf(values, "double")(d1, d2)


def psrf(rows: DataFrame, *by: str) -> DataFrame:
    """Point estimate and upper 97.5 % limit of the Gelman-Rubin statistic."""
    p = psrf_point(rows, *by)
    upper = F.sqrt(F.col("adjust") * (F.col("fixed") + _f_975(F.col("n_chains") - 1, F.col("df_within")) * F.col("random")))
    return p.select(*by, "psrf", upper.alias("upper"))


def convergence(draws: DataFrame, threshold: float = 1.1, level: int = 2) -> DataFrame:
    """max_psrf and converged of each fit, over intercept, precisions, overdispersion and the predictor of every cell.

    A fit of one chain, or without draws, has no max_psrf and counts as not converged.
    """
    keys, good = [*FIT, "chain", "draw"], draws.where(F.col("error").isNull())
    eta = good.select(*keys, F.lit("eta").alias("param"), F.posexplode("eta").alias("idx", "value"))
    rows = long_parameters(good).where(F.col("param") != "deviance").unionByName(eta)
    r = psrf(rows, *FIT, "param", "idx") if level == 2 else psrf_point(rows, *FIT, "param", "idx")
    r = r.withColumn("_r", F.col("upper" if level == 2 else "psrf"))
    out = r.groupBy(*FIT).agg(F.max(F.when(~F.isnan("_r"), F.col("_r"))).alias("max_psrf"))
    out = draws.select(*FIT).distinct().join(out, list(FIT), "left")
    return out.withColumn("converged", F.coalesce(F.col("max_psrf") < threshold, F.lit(False)))


def thin(draws: DataFrame, keep: int = 1000) -> DataFrame:
    """Every n-th draw of each chain, so that about ``keep`` of each are left."""
    n = F.count("*").over(Window.partitionBy(*FIT, "chain"))
    step = F.greatest(F.lit(1), F.round(n / F.lit(keep)).cast("int"))
    return draws.withColumn("_step", step).where((F.col("draw") + 1) % F.col("_step") == 0).drop("_step")


# --------------------------------------------------------------------------- deviance information
def fitted(draws: DataFrame, n_periods: int) -> DataFrame:
    """Posterior mean of the predictor of every cell."""
    rows = draws.select(*FIT, F.posexplode("eta").alias("at", "eta")).groupBy(*FIT, "at").agg(F.avg("eta").alias("eta"))
    return rows.select(*FIT, (F.floor(F.col("at") / n_periods) + 1).cast("int").alias("age_idx"), (F.col("at") % n_periods + 1).cast("int").alias("period_idx"), "eta")


def dic(mean_deviance: Column, deviance_at_mean: Column) -> dict[str, Column]:
    return {"pd": mean_deviance - deviance_at_mean, "dic": 2 * mean_deviance - deviance_at_mean}


def information(draws: DataFrame, cells: DataFrame, n_periods: int) -> DataFrame:
    """(series_id, spec_id, mean_deviance, deviance_at_mean, pd, dic)."""
    from .relational import deviance

    draws = draws.where(F.col("error").isNull())
    d = draws.groupBy(*FIT).agg(F.avg("deviance").alias("mean_deviance"))
    at = deviance(fitted(draws, n_periods).join(cells.select("series_id", "age_idx", "period_idx", "population", "cases"), ["series_id", "age_idx", "period_idx"]), *FIT)
    return d.join(at.withColumnRenamed("deviance", "deviance_at_mean"), list(FIT)).withColumns(dic(F.col("mean_deviance"), F.col("deviance_at_mean")))


def summary(draws: DataFrame) -> DataFrame:
    """5, 50 and 95 % quantiles of the hyper-parameters."""
    return quantiles(long_parameters(draws), [0.05, 0.5, 0.95], *FIT, "param")


def plot_data(draws: DataFrame, spec: ModelSpec, per_age: int, probabilities: tuple[float, ...] = (0.05, 0.5, 0.95), convention: str = "age", combined: bool = False, covariates: dict[str, list[float]] | None = None) -> DataFrame:
    """Quantile curves of every effect with the line type to draw them with: solid for the middle one, dashed for others.

    ``panel`` is effect; for an axis with a covariate there are also the panels covariate (its values) and relative (the
    effect over the covariate).  Effects of a model with covariates are left in their own gauge.
    """
    q = effects(draws, spec, per_age, list(probabilities), convention, combined, bool(covariates)).withColumn("panel", F.lit("effect"))
    middle = sorted(probabilities)[len(probabilities) // 2]
    for axis, values in (covariates or {}).items():
        known = draws.sparkSession.createDataFrame([(axis, i + 1, float(v)) for i, v in enumerate(values)], "param string, idx int, _v double")
        rows = long_effects(draws, combined).join(F.broadcast(known), ["param", "idx"]).withColumn("value", F.try_divide("value", "_v"))
        q = q.unionByName(quantiles(rows, list(probabilities), *FIT, "param", "idx").withColumn("panel", F.lit("relative")))
        fits = draws.select(*FIT).distinct().join(F.broadcast(known))
        q = q.unionByName(fits.select(*FIT, "param", "idx", F.lit(float(middle)).alias("probability"), F.col("_v").alias("value"), F.lit("covariate").alias("panel")))
    return q.withColumn("line", F.when(F.col("probability") == middle, "solid").otherwise("dashed"))


def plot_ranges(curves: DataFrame) -> DataFrame:
    """The range of every axis of ``plot_data``: smallest and largest finite value of a panel and its indices."""
    fine = F.when(~F.isnan("value") & (F.abs("value") != float("inf")), F.col("value"))
    return curves.groupBy(*FIT, "param", "panel").agg(F.min(fine).alias("low"), F.max(fine).alias("high"), F.min("idx").alias("first"), F.max("idx").alias("last"))
