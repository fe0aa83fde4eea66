"""Fit, inspect, predict: the public surface over tables."""

from __future__ import annotations

import warnings
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import posterior
from .operators import predict as forecast
from .operators.relational import auto_mcmc
from .operators.sampler import mean_one, sample
from .plans.spec import AXES, Mcmc, ModelSpec
from .sources.lexis import validate
from .storage import work_table


@dataclass
class ApcFit:
    """Stored draws of one specification for one or many series, and what is computed from them."""

    spec: ModelSpec
    cells: DataFrame
    draws: DataFrame
    n_ages: int
    n_periods: int
    per_age: int
    mcmc: Mcmc
    covariates: dict[str, list[float]] = field(default_factory=dict)
    failed: list[tuple[str, int, str]] = field(default_factory=list)  # series, chain, reason

    def effects(self, probabilities: list[float] | None = (0.5,), convention: str = "age", combined: bool = False) -> DataFrame:
        return posterior.effects(self.draws, self.spec, self.per_age, probabilities, convention, combined, bool(self.covariates))

    def convergence(self, threshold: float = 1.1, level: int = 2) -> DataFrame:
        return posterior.convergence(self.draws, threshold, level)

    def information(self) -> DataFrame:
        return posterior.information(self.draws, self.cells, self.n_periods)

    def plot_data(self, probabilities: tuple[float, ...] = (0.05, 0.5, 0.95), convention: str = "age", combined: bool = False) -> DataFrame:
        return posterior.plot_data(self.draws, self.spec, self.per_age, probabilities, convention, combined, self.covariates)

    def predict(self, periods: int = 0, population: DataFrame | None = None, probabilities: list[float] = (0.05, 0.5, 0.95), seed: int = 1) -> dict[str, DataFrame]:
        if self.covariates and periods:
            raise ValueError("forecasts of a model with covariates need future covariate values; pass periods=0")
        people = self.cells if population is None else population
        return forecast.predict(self.draws, [self.spec], people, self.n_ages, self.n_periods, self.per_age, periods, probabilities, seed)

    def settings(self) -> str:
        """The model and the sampler's settings, line by line."""
        m, h = self.mcmc, self.spec.hyper
        lines = [f"{a:<8}{getattr(self.spec, a) or 'absent'}" + (" with a covariate" if a in self.covariates else "") for a in AXES]
        lines += [f"overdispersion {'yes' if self.spec.overdisp else 'no'}", f"diagram {self.n_ages} age groups x {self.n_periods} periods, {self.per_age} periods an age group"]
        lines += [f"{m.chains} chains of {m.n_iter} sweeps, {m.burn_in} of them burn-in, every {m.step}. kept", "priors " + ", ".join(f"{k} Gamma({a:g}, {b:g})" for k, (a, b) in h.items())]
        return "\n".join(lines)

    def describe(self) -> str:
        """A printed summary: convergence, model, deviance, pD, DIC and hyper-parameter quantiles of each series."""
        lines = []
        found = {r.series_id: r for r in self.information().collect()}
        for c in self.convergence().orderBy("series_id").collect():
            state = "convergence unknown (one chain)" if c.max_psrf is None else ("converged" if c.converged else "NOT converged") + f" (max R-hat {c.max_psrf:.3f})"
            lines += [f"series {c.series_id}: {state}", f"  model: {self.spec.key}"]
            if r := found.get(c.series_id):
                lines.append(f"  deviance {r.mean_deviance:.2f}  pD {r.pd:.2f}  DIC {r.dic:.2f}")
        lines += [f"  {s}: chain {c} failed: {why}" for s, c, why in self.failed]
        for r in posterior.summary(self.draws).groupBy("series_id", "param").agg(F.array_sort(F.collect_list(F.struct("probability", "value"))).alias("q")).orderBy("series_id", "param").collect():
            lines.append(f"  {r.series_id} {r.param}: " + "  ".join(f"{x.probability:g}: {x.value:.4g}" for x in r.q))
        return "\n".join(lines)


def _reject_bad_cells(cells: DataFrame, n_ages: int, n_periods: int) -> None:
    y, n = F.col("cases"), F.col("population")
    broken = (y > n) | (y < 0) | y.isNull() | n.isNull()
    outside = ~F.coalesce(F.col("age_idx").between(1, n_ages) & F.col("period_idx").between(1, n_periods), F.lit(False))
    per = cells.groupBy("series_id").agg(F.count("*").alias("n"), F.count(F.when(broken, 1)).alias("bad"), F.count(F.when(outside, 1)).alias("outside"), F.count_distinct("age_idx", "period_idx").alias("d"))
    for r in per.where("bad > 0 or outside > 0 or n > d").limit(1).collect():
        raise ValueError(f"series {r.series_id}: {r.bad} bad cells, {r.outside} outside the diagram, {r.n - r.d} repeated ones")


def fit(cells: DataFrame, spec: ModelSpec, n_ages: int, n_periods: int, per_age: int, mcmc: Mcmc | None = None, seed: int = 1, method: str = "pg", period_covariate: list[float] | None = None, cohort_covariate: list[float] | None = None) -> ApcFit:
    """Validate cells, sample and store the draws; ``cells`` may hold many series (series_id), which are fitted in parallel."""
    if method != "pg":
        raise ValueError("only the Polya-Gamma sampler is built; method='iwls' is not available")
    if n_periods <= per_age:
        raise ValueError(f"a diagram needs more periods than one age group spans: {n_periods} <= {per_age}")
    if "series_id" not in cells.columns:
        cells = cells.withColumn("series_id", F.lit("all"))
    _reject_bad_cells(cells, n_ages, n_periods)
    mcmc = mcmc or Mcmc()
    if "auto" in (mcmc.n_iter, mcmc.burn_in, mcmc.step):
        mcmc = mcmc.resolved(auto_mcmc(cells).first().n_iter)
    else:
        mcmc = mcmc.resolved(0)
    draws = work_table(sample(cells, [spec], mcmc, n_ages, n_periods, per_age, seed, period_covariate, cohort_covariate), "draws")
    failed = [(r.series_id, r.chain, r.error) for r in draws.where(F.col("error").isNotNull()).select("series_id", "chain", "error").limit(100).collect()]
    if failed:
        warnings.warn(f"{len(failed)} chains failed, the first of them with: {failed[0][2]}", stacklevel=2)
    lengths = {"period": (period_covariate, n_periods), "cohort": (cohort_covariate, per_age * (n_ages - 1) + n_periods)}
    covariates = {a: mean_one(c, n, a).tolist() for a, (c, n) in lengths.items() if c is not None}
    return ApcFit(spec, cells, draws, n_ages, n_periods, per_age, mcmc, covariates, failed)


__all__ = ["ApcFit", "Mcmc", "ModelSpec", "fit", "validate"]
