"""Fitting many models at once: one grouped pandas task for each (series, specification, chain)."""

from __future__ import annotations

import time
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.kernels import Design, run_chain
from ..plans.spec import AXES, Mcmc, ModelSpec

DRAWS = (
    "series_id string, spec_id string, chain int, draw int, intercept double, "
    + ", ".join(f"{a}{k} array<double>" for k in ("", "2") for a in AXES) + ", "
    + ", ".join(f"{a}{k}_parameter double" for k in ("", "2") for a in AXES)
    + ", overdispersion double, deviance double, accepted double, eta array<double>, seconds double, error string"
)


def sample(cells: DataFrame, specs: list[ModelSpec], mcmc: Mcmc, n_ages: int, n_periods: int, per_age: int, seed: int = 1, period_cov: list[float] | None = None, cohort_cov: list[float] | None = None) -> DataFrame:
    """Posterior draws, one row a kept sweep, of every series under every specification.

    ``cells`` needs series_id, age_idx, period_idx, population and cases, each cell once.  Chains are independent tasks, seeded
    by (seed, series, specification, chain), so the result does not depend on partitioning or retries.  A chain that
    fails numerically, or has a cell outside the diagram, gives one row with ``error`` and no draw; ``seconds`` is what a chain took.  ``eta`` has the linear predictor of every cell, age by age.
    Effects of an axis with a covariate are stored as they enter the predictor (coefficient times covariate).
    """
    if n_periods <= per_age:
        raise ValueError(f"a diagram needs more periods than one age group spans: {n_periods} <= {per_age}")
    spark = cells.sparkSession
    by_key = {s.key: s for s in specs}
    scale = {a: mean_one(c, n, a) for a, c, n in (("period", period_cov, n_periods), ("cohort", cohort_cov, per_age * (n_ages - 1) + n_periods))}
    for s in specs:
        for a, c in scale.items():
            if c is not None and (getattr(s, a) is None or s.het(a)):
                raise ValueError(f"a covariate of {a} needs a {a} effect without heterogeneity")

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        series, key, number = pdf["series_id"].iloc[0], pdf["spec_id"].iloc[0], int(pdf["chain"].iloc[0])
        spec, base = by_key[key], {"series_id": series, "spec_id": key, "chain": number}
        began = time.perf_counter()
        try:
            if not (pdf["age_idx"].between(1, n_ages) & pdf["period_idx"].between(1, n_periods)).all():
                raise ValueError("a cell lies outside the diagram")
            y, n = np.zeros((n_ages, n_periods)), np.zeros((n_ages, n_periods))
            at = (pdf["age_idx"].to_numpy() - 1, pdf["period_idx"].to_numpy() - 1)
            y[at], n[at] = pdf["cases"].to_numpy(), pdf["population"].to_numpy()
            design = Design(spec, n_ages, n_periods, per_age, scale["period"], scale["cohort"])
            ids = [seed, zlib.crc32(str(series).encode()), zlib.crc32(key.encode()), number]
            got = run_chain(y.ravel(), n.ravel(), design, spec, mcmc.n_iter, mcmc.burn_in, mcmc.step, ids)
        except (np.linalg.LinAlgError, FloatingPointError, ValueError) as e:
            names = [c.split()[0] for c in DRAWS.split(", ")]
            row = dict.fromkeys(names) | base | {"draw": -1, "error": str(e)}
            return pd.DataFrame({k: pd.Series([row[k]], dtype=object if row[k] is None else None) for k in names})
        out = {k: [v] * len(got["deviance"]) for k, v in base.items()} | {"draw": range(len(got["deviance"])), "intercept": got["beta"][:, 0]}
        for kind in ("", "2"):
            for a in AXES:
                b = next((i for i, x in enumerate(design.blocks) if x.name == a + kind), None)
                factor = 1.0 if scale.get(a) is None else scale[a]
                out[a + kind] = None if b is None else list(got["beta"][:, design.blocks[b].at] * factor)
                out[f"{a}{kind}_parameter"] = None if b is None else got["precision"][:, b]
        out |= {"overdispersion": got["zeta"] if spec.overdisp else None, "deviance": got["deviance"], "accepted": float(got["accepted"]), "eta": list(got["eta"]), "seconds": time.perf_counter() - began, "error": None}
        n_kept = len(got["deviance"])
        filled = {k: pd.Series([v] * n_kept if v is None or np.isscalar(v) else list(v), dtype=object if v is None else None) for k, v in out.items()}
        return pd.DataFrame(filled, columns=[c.split()[0] for c in DRAWS.split(", ")])

    jobs = [(s.key, c) for s in specs for c in range(mcmc.chains)]
    plan = spark.createDataFrame(jobs, "spec_id string, chain int")
    rows = cells.select("series_id", "age_idx", "period_idx", "population", "cases").crossJoin(F.broadcast(plan))
    # several times as many partitions as groups of one series: chains take long and rows are few
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * len(jobs))
    return rows.repartition(parts, "series_id", "spec_id", "chain").groupBy("series_id", "spec_id", "chain").applyInPandas(chain, DRAWS)


def mean_one(values: list[float] | None, length: int, name: str) -> np.ndarray | None:
    if values is None:
        return None
    if len(values) < length:
        raise ValueError(f"covariate of {name} has {len(values)} values, {length} are needed")
    v = np.asarray(values[:length], dtype=float)
    v = v / v.mean()
    if not np.isfinite(v).all() or (np.abs(v) <= 1e-8).any():
        raise ValueError(f"covariate of {name} must be finite and not 0")
    return v
