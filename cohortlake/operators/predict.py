"""Forecasts: random-walk extrapolation of period and cohort effects draw by draw."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.spec import ModelSpec
from .posterior import FIT, quantiles

PREDICTED = "series_id string, spec_id string, chain int, draw int, age_idx int, period_idx int, rate double, cases bigint"


def extend(values: np.ndarray, order: int, n: int, precision: float, rng: np.random.Generator) -> np.ndarray:
    """The series continued by n values of its random walk (order 0 carries the last one forward)."""
    e = rng.standard_normal(n) / np.sqrt(precision) if order else np.zeros(n)
    if order == 2:
        slope = values[-1] - values[-2]
        new = values[-1] + np.arange(1, n + 1) * slope + np.cumsum(np.cumsum(e))
    else:
        new = values[-1] + np.cumsum(e)
    return np.concatenate([values, new])


def mean_path(effects: DataFrame, order: int, horizon: int, *by: str) -> DataFrame:
    """Expected continuation of an effect (by.., idx, value): constant for order 1, linear for order 2."""
    last = effects.groupBy(*by).agg(F.max_by("value", "idx").alias("_last"), F.max("idx").alias("_n"), F.sort_array(F.collect_list(F.struct("idx", "value")), asc=False).alias("_v"))
    step = F.col("_last") - F.get("_v", F.lit(1))["value"] if order == 2 else F.lit(0.0)
    out = last.withColumn("_h", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    return out.select(*by, (F.col("_n") + F.col("_h")).cast("int").alias("idx"), (F.col("_last") + F.col("_h") * step).alias("value"))


def predict_draws(draws: DataFrame, specs: list[ModelSpec], population: DataFrame, n_ages: int, n_periods: int, per_age: int, periods: int = 0, seed: int = 1) -> DataFrame:
    """Predictive rate and cases of every (age, period) up to ``periods`` after the last one, one row a draw and cell.

    ``population`` (series_id, age_idx, period_idx, population) is joined by key; where it has no row, cases are null.
    Absent effects are 0; heterogeneity of observed indices is added, that of new ones and overdispersion are drawn.
    Seeds depend on series, specification, chain and draw only.
    """
    by_key = {s.key: s for s in specs}
    last = n_periods + periods
    n_cohorts = per_age * (n_ages - 1) + last
    i, j = (x.ravel() for x in np.meshgrid(np.arange(n_ages), np.arange(last), indexing="ij"))
    k = (n_ages - 1 - i) * per_age + j

    def one(batches):
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                spec = by_key[r.spec_id]
                rng = np.random.Generator(np.random.Philox(np.random.SeedSequence([seed, zlib.crc32(str(r.series_id).encode()), zlib.crc32(r.spec_id.encode()), int(r.chain), int(r.draw)])))
                eta = np.full(len(i), r.intercept)
                for axis, at, n in (("age", i, n_ages), ("period", j, last), ("cohort", k, n_cohorts)):
                    if (v := getattr(r, axis)) is not None:
                        v = np.asarray(v, float)
                        eta = eta + extend(v, spec.order(axis), n - len(v), getattr(r, f"{axis}_parameter"), rng)[at]
                    if (v := getattr(r, f"{axis}2")) is not None:
                        v = np.asarray(v, float)
                        new = rng.standard_normal(n - len(v)) / np.sqrt(getattr(r, f"{axis}2_parameter"))
                        eta = eta + np.concatenate([v, new])[at]
                if spec.overdisp:
                    eta = eta + rng.standard_normal(len(eta)) / np.sqrt(r.overdispersion)
                rate = 1 / (1 + np.exp(-eta))
                people = np.full((n_ages, last), -1, dtype=np.int64)
                for p in r.people:
                    if 1 <= p["age_idx"] <= n_ages and 1 <= p["period_idx"] <= last and p["population"] is not None:
                        people[p["age_idx"] - 1, p["period_idx"] - 1] = p["population"]
                people = people.ravel()
                cases = pd.array(rng.binomial(np.maximum(people, 0), rate), dtype="Int64")
                cases[people < 0] = pd.NA
                yield pd.DataFrame({"series_id": r.series_id, "spec_id": r.spec_id, "chain": r.chain, "draw": r.draw, "age_idx": i + 1, "period_idx": j + 1, "rate": rate, "cases": cases})

    people = population.groupBy("series_id").agg(F.collect_list(F.struct("age_idx", "period_idx", "population")).alias("people"))  # a diagram each
    return draws.where(F.col("error").isNull()).drop("eta").join(people, "series_id").mapInPandas(one, PREDICTED)


def predict(draws: DataFrame, specs: list[ModelSpec], population: DataFrame, n_ages: int, n_periods: int, per_age: int, periods: int = 0, probabilities: list[float] = (0.05, 0.5, 0.95), seed: int = 1) -> dict[str, DataFrame]:
    """Quantiles of rates and cases per cell and of cases per period, over all draws."""
    rows = predict_draws(draws, specs, population, n_ages, n_periods, per_age, periods, seed)
    q = list(probabilities)
    per_period = rows.groupBy(*FIT, "chain", "draw", "period_idx").agg(F.sum("cases").alias("cases"))
    return {
        "rates": quantiles(rows, q, *FIT, "age_idx", "period_idx", value="rate"),
        "cases": quantiles(rows.where("cases is not null"), q, *FIT, "age_idx", "period_idx", value="cases"),
        "cases_period": quantiles(per_period.where("cases is not null"), q, *FIT, "period_idx", value="cases"),
    }
