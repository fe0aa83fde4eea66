"""An example data set: 10 periods of 8 age groups, five periods an age group, with a period and a cohort covariate."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from .lexis import cells_from_matrices

AGES, PERIODS, PER_AGE, POPULATION, INTERCEPT = 8, 10, 5, 1_000_000, -5.0


@dataclass(frozen=True)
class Example:
    """cases and population are periods x ages; the covariates have a value a period and a cohort."""

    cases: list[list[int]]
    population: list[list[int]]
    period_covariate: list[float]
    cohort_covariate: list[float]

    def cells(self, spark: SparkSession) -> DataFrame:
        return cells_from_matrices(spark, self.cases, self.population, PER_AGE, "example")


def example() -> Example:
    """Rounded expected counts of a concave age effect, a period effect with a valley and a cohort effect that rises and falls."""
    cohorts = PER_AGE * (AGES - 1) + PERIODS
    age = [-math.sqrt(5 * (1 - i / (AGES - 1))) for i in range(AGES)]
    period = [abs(j - PERIODS / 2) / 6 for j in range(PERIODS)]
    cohort = [(min(k, cohorts - k) - cohorts / 4) / 20 for k in range(cohorts)]
    cohort_index = lambda i, j: (AGES - 1 - i) * PER_AGE + j
    centre = lambda v: [x - sum(v) / len(v) for x in v]
    age, period, cohort = centre(age), centre(period), centre(cohort)
    cases = [[round(POPULATION / (1 + math.exp(-(INTERCEPT + age[i] + period[j] + cohort[cohort_index(i, j)])))) for i in range(AGES)] for j in range(PERIODS)]
    return Example(cases, [[POPULATION] * AGES for _ in range(PERIODS)], [1 + 0.1 * j for j in range(PERIODS)], [1 + 0.5 * math.sin(k / 7) for k in range(cohorts)])
