"""The deterministic layer: everything that is computed from cells by grouping, joining and windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import deviance_term, empirical_logit, fisher_weight, inv_logit, logit


def margins(cells: DataFrame) -> DataFrame:
    """Age, period, cohort and grand totals in one pass (grouping sets)."""
    sets = cells.groupingSets([["age_idx"], ["period_idx"], ["cohort_idx"], []], "age_idx", "period_idx", "cohort_idx")
    return sets.agg(F.sum("population").alias("population"), F.sum("cases").alias("cases"), F.count("*").alias("n_cells"))


def axis_totals(cells: DataFrame, axis: str) -> DataFrame:
    return cells.groupBy(axis).agg(F.sum("population").alias("population"), F.sum("cases").alias("cases"), F.count("*").alias("n_cells"))


def auto_mcmc(cells: DataFrame) -> DataFrame:
    """Chain length from rarity: 40,000 for well filled cells up to 120,000 for empty ones, rounded half to even to thousands."""
    y = F.col("cases").cast("double")
    stats = cells.where(F.col("cases").isNotNull()).agg(F.avg(F.when(y == 0, 1.0).otherwise(0.0)).alias("zero_frac"), F.avg(F.when(y <= 5, 1.0).otherwise(0.0)).alias("few_frac"))
    rarity = F.greatest(F.col("zero_frac"), F.col("few_frac") / 2)
    n = F.bround(40.0 * (1 + 2 * F.least(rarity, F.lit(1.0)))) * 1000
    return stats.select("zero_frac", "few_frac", F.when(F.col("zero_frac").isNull(), F.lit(80000.0)).otherwise(n).cast("long").alias("n_iter"))


def _mean_over_all(x: Column) -> Column:
    return F.avg(x).over(Window.partitionBy(F.lit(1)))  # one row an index of an axis


def start_values(cells: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(mu, age starts, period starts): overall logit and centred empirical logits of the margins."""
    mu = cells.agg((F.sum("cases") / F.sum("population")).alias("p")).select(logit("p").alias("mu"))

    def axis(name: str) -> DataFrame:
        raw = axis_totals(cells, name).select(name, empirical_logit("cases", "population").alias("raw"))
        return raw.select(name, (F.col("raw") - _mean_over_all(F.col("raw"))).alias("effect"))

    return mu, axis("age_idx"), axis("period_idx")


def linear_predictor(cells: DataFrame, mu: DataFrame, age: DataFrame | None = None, period: DataFrame | None = None, cohort: DataFrame | None = None) -> DataFrame:
    """cells with eta: index joins of the effects (tables of one row an index) and a sum; a missing effect is 0."""
    out = cells.join(F.broadcast(mu))  # one row
    eta = F.col("mu")
    for name, effect in (("age_idx", age), ("period_idx", period), ("cohort_idx", cohort)):
        if effect is not None:
            out = out.join(F.broadcast(effect.select(name, F.col("effect").alias(f"_{name}"))), name, "left")
            eta = eta + F.coalesce(F.col(f"_{name}"), F.lit(0.0))
    return out.withColumn("eta", eta).drop("mu", "_age_idx", "_period_idx", "_cohort_idx")


def rates(with_eta: DataFrame) -> DataFrame:
    p = inv_logit("eta")
    return with_eta.withColumns({"rate": p, "expected": F.col("population") * p, "weight": fisher_weight("population", p), "residual": F.col("cases") - F.col("population") * p})


def deviance(with_eta: DataFrame, *by: str) -> DataFrame:
    p = inv_logit("eta")
    return with_eta.groupBy(*by).agg(F.sum(deviance_term("cases", "population", p)).alias("deviance"))


def score_margins(with_rates: DataFrame, axis: str) -> DataFrame:
    """Gradient of the log-likelihood and Fisher weight of every index of an axis."""
    return with_rates.groupBy(axis).agg(F.sum("residual").alias("score"), F.sum("weight").alias("weight"))


def coupling(with_rates: DataFrame, first: str, second: str) -> DataFrame:
    """Off-diagonal block of the precision matrix: weights summed over the cells that two indices share."""
    return with_rates.groupBy(first, second).agg(F.sum("weight").alias("weight"))


def random_walk_penalty(effects: DataFrame, index: str, order: int, *by: str) -> DataFrame:
    """Sum of squared first or second differences along an index, the quadratic form x'D'Dx."""
    w = Window.partitionBy(*by).orderBy(index) if by else Window.partitionBy(F.lit(1)).orderBy(index)
    x = F.col("effect")
    d = x - F.lag(x, 1).over(w) if order == 1 else x - 2 * F.lag(x, 1).over(w) + F.lag(x, 2).over(w)
    return effects.withColumn("_d", d).groupBy(*by).agg(F.sum(F.col("_d") * F.col("_d")).alias("penalty"))


def normalised_covariate(covariate: DataFrame, length: int, *by: str) -> DataFrame:
    """(idx, value) divided by the mean of the first ``length`` values."""
    first = covariate.where(F.col("idx") <= length)
    mean = F.avg("value").over(Window.partitionBy(*(by or [F.lit(1)])))
    return first.withColumn("value", F.col("value") / mean)


def relative_effect(effects: DataFrame, covariate: DataFrame, index: str) -> DataFrame:
    """Absolute effect, covariate and their ratio where the covariate is not 0."""
    both = effects.join(covariate.withColumnRenamed("idx", index), index)
    return both.withColumn("relative", F.when(F.col("value") != 0, F.col("effect") / F.col("value")))


def structure_matrix(spark, length: int, order: int) -> DataFrame:
    """D'D of a random walk in long form (r, c, v), without its zeros."""
    coef = [1.0, -1.0] if order == 1 else [1.0, -2.0, 1.0]
    d = spark.range(1, length - order + 1).select(F.explode(F.array(*[F.struct((F.col("id") + k).cast("int").alias("at"), F.lit(v).alias("v")) for k, v in enumerate(coef)])).alias("x"), "id").select("id", "x.at", "x.v")
    a, b = d.alias("a"), d.alias("b")
    return a.join(b, F.col("a.id") == F.col("b.id")).groupBy(F.col("a.at").alias("r"), F.col("b.at").alias("c")).agg(F.sum(F.col("a.v") * F.col("b.v")).alias("v")).where("v != 0")
