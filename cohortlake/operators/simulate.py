"""Binomial counts from given effects."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expressions import inv_logit
from ..sources.lexis import grid
from .relational import linear_predictor


def expected(spark: SparkSession, intercept: float, age: list[float], period: list[float], cohort: list[float], per_age: int, population: int | DataFrame) -> DataFrame:
    """Grid with eta, rate and population of given effects."""
    if len(cohort) != per_age * (len(age) - 1) + len(period):
        raise ValueError("length of cohort must be periods_per_agegroup * (agegroups - 1) + periods")
    table = lambda name, v: spark.createDataFrame([(i + 1, float(x)) for i, x in enumerate(v)], f"{name} int, effect double")
    cells = grid(spark, len(age), len(period), per_age)
    cells = cells.join(population, ["age_idx", "period_idx"]) if isinstance(population, DataFrame) else cells.withColumn("population", F.lit(int(population)).cast("long"))
    mu = spark.createDataFrame([(float(intercept),)], "mu double")
    return linear_predictor(cells, mu, table("age_idx", age), table("period_idx", period), table("cohort_idx", cohort)).withColumn("rate", inv_logit("eta"))


def simulate(cells: DataFrame, seed: int = 1) -> DataFrame:
    """``cells`` (age_idx, period_idx, population, rate) with binomial cases, seeded by cell."""

    def draw(batches):
        for pdf in batches:
            cases = [int(np.random.Generator(np.random.Philox(np.random.SeedSequence([seed, int(i), int(j)]))).binomial(int(n), p)) for i, j, n, p in zip(pdf["age_idx"], pdf["period_idx"], pdf["population"], pdf["rate"])]
            yield pdf.assign(cases=pd.Series(cases, index=pdf.index, dtype="int64"))

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cells.schema.fields)
    return cells.mapInPandas(draw, f"{fields}, cases bigint")
