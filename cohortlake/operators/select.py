"""Greedy model search by DIC among converged fits; every round is one Spark job over all candidates and chains."""

from __future__ import annotations

import warnings
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.spec import Mcmc, ModelSpec
from ..storage import drop_work_table, work_table
from .posterior import convergence, information
from .relational import auto_mcmc
from .sampler import sample

SCREEN = Mcmc(10_000, 5_000, 5)


def rank(fits: DataFrame, *by: str) -> DataFrame:
    """fits (spec_id, dic, converged) by DIC, nulls last, with the chosen one marked: the best converged, else the best."""
    dic = F.when(~F.isnan("dic"), F.col("dic"))
    w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))
    order = [dic.asc_nulls_last(), F.col("spec_id")]
    best = F.row_number().over(w.orderBy((~(F.col("converged") & dic.isNotNull())).cast("int"), *order)) == 1
    return fits.withColumn("position", F.row_number().over(w.orderBy(*order))).withColumn("selected", best)


@dataclass
class Selection:
    table: DataFrame
    best: ModelSpec
    path: list[str]
    dic_margin: float
    psrf_tol: float
    converged: bool
    draws: DataFrame | None = None

    def show(self) -> str:
        number = lambda v, d=2: f"{'NA' if v is None else f'{v:.{d}f}':>12}"
        names = ("DIC", "pD", "deviance", "max R-hat", "seconds")
        lines = [f"{'model':<40} " + " ".join(f"{n:>12}" for n in names) + f" {'converged':>10}"]
        for r in self.table.orderBy("position").collect():
            lines.append(f"{r.spec_id:<40} {number(r.dic)} {number(r.pd)} {number(r.mean_deviance)} {number(r.max_psrf, 3)} {number(r.seconds, 1)} {'yes' if r.converged else 'no':>10} {'<--' if r.selected else ''}".rstrip())
        return "\n".join([*lines, *([] if self.converged else ["Warning: no model converged; the choice rests on DIC alone."])])


FITTED = "spec_id string, dic double, converged boolean, pd double, mean_deviance double, max_psrf double, seconds double"


def select_model(cells: DataFrame, n_ages: int, n_periods: int, per_age: int, pinned: dict[str, str | None] | None = None, overdispersion: bool | None = None, try_heterogeneity: bool = False, dic_margin: float = 4.0, psrf_tol: float = 1.1, screen: Mcmc = SCREEN, final: Mcmc | str = "auto", refit: bool = True, hyper: dict | None = None, seed: int = 1) -> Selection:
    """Forward search of one series from first-order walks; a richer model is adopted if its DIC is lower by the margin.

    The chosen model is fitted again with ``final`` sweeps (auto: as many as its cells ask for) unless ``refit`` is false.
    """
    spark, pinned = cells.sparkSession, dict(pinned or {})
    if "series_id" not in cells.columns:
        cells = cells.withColumn("series_id", F.lit("all"))
    if cells.select("series_id").distinct().limit(2).count() > 1:
        raise ValueError("the search is for one series; call it for each")
    spec = ModelSpec(**{a: pinned.get(a, "rw1") for a in ("age", "period", "cohort")}, overdisp=bool(overdispersion), hyper=dict(hyper or {}))
    fixed = frozenset(pinned) | ({"overdisp"} if overdispersion is not None else frozenset())
    specs: dict[str, ModelSpec] = {}
    done: dict[str, tuple] = {}  # as in FITTED

    def fit(new: list[ModelSpec]) -> None:
        new = [s for s in new if s.key not in done]
        if not new:
            return
        draws = work_table(sample(cells, new, screen, n_ages, n_periods, per_age, seed), "screened")
        took = draws.groupBy("spec_id").agg(F.max("seconds").alias("seconds"))
        found = convergence(draws, psrf_tol).join(information(draws, cells, n_periods), ["series_id", "spec_id"], "left").join(took, "spec_id").collect()
        drop_work_table(draws)
        got = {r.spec_id: r for r in found}
        for s in new:
            r = got.get(s.key)
            specs[s.key] = s
            done[s.key] = (s.key, r.dic, r.converged and r.dic is not None, r.pd, r.mean_deviance, r.max_psrf, r.seconds) if r else (s.key, None, False, None, None, None, None)

    fit([spec])
    path = [spec.key]
    while True:
        near = spec.neighbours(fixed, try_heterogeneity)
        fit(near)
        here = done[spec.key]
        best = min((done[s.key] for s in near if done[s.key][2]), key=lambda x: x[1], default=None)
        if best is None or (here[2] and best[1] >= here[1] - dic_margin):
            break
        spec = specs[best[0]]
        path.append(spec.key)
    converged = done[spec.key][2]
    if not converged:  # the path means nothing then
        finite = [(r[1], k) for k, r in done.items() if r[1] is not None]
        if finite:
            spec = specs[min(finite)[1]]
        path = [spec.key]
        warnings.warn("no model converged; the choice rests on DIC alone", stacklevel=2)
    table = rank(spark.createDataFrame(list(done.values()), FITTED)).withColumn("selected", F.col("spec_id") == spec.key)
    draws = None
    if refit:
        mcmc = Mcmc().resolved(auto_mcmc(cells).first().n_iter) if final == "auto" else final
        draws = work_table(sample(cells, [spec], mcmc, n_ages, n_periods, per_age, seed), "draws")
    return Selection(table, spec, path, dic_margin, psrf_tol, converged, draws)
