"""Dense numpy kernels of the sampler: one chain is sequential linear algebra of a few hundred parameters."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from .spec import AXES, ModelSpec


def structure(length: int, order: int) -> np.ndarray:
    d = np.diff(np.eye(length), n=order, axis=0)
    return d.T @ d


def prior_factor(k: np.ndarray) -> float:
    """Geometric mean of the marginal variances of an intrinsic field with precision 1."""
    value, vector = np.linalg.eigh(k)
    use = value > 1e-9 * value.max()
    return float(np.exp(np.log((vector[:, use] ** 2 / value[use]).sum(axis=1)).mean()))


def pg_moments(c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and variance of PG(1, c)."""
    c = np.abs(c)
    x = np.maximum(c, 1e-4)
    t = np.tanh(x / 2)
    small = c < 1e-4
    return np.where(small, 0.25, t / (2 * x)), np.where(small, 1 / 24, (2 / x * t - (1 - t * t)) / (4 * x * x))


@dataclass
class Block:
    """A stretch of the parameter vector: the smooth or the unstructured effect of an axis."""

    name: str
    axis: str
    at: slice
    penalty: np.ndarray
    rank: int
    a: float
    b: float


class Design:
    """Parameter layout, design matrix, priors and constraint null space of a model on an I x J diagram.

    Every linear predictor is ``X @ beta``; the sum-to-zero constraints (and, for a full model with a second-order
    period effect, a zero period slope) are met by writing beta = Z gamma with an orthonormal basis Z of their null space.
    """

    def __init__(self, spec: ModelSpec, n_ages: int, n_periods: int, per_age: int, period_cov: np.ndarray | None = None, cohort_cov: np.ndarray | None = None) -> None:
        i, j = (x.ravel() for x in np.meshgrid(np.arange(n_ages), np.arange(n_periods), indexing="ij"))
        index = {"age": i, "period": j, "cohort": (n_ages - 1 - i) * per_age + j}
        length = {"age": n_ages, "period": n_periods, "cohort": per_age * (n_ages - 1) + n_periods}
        scale = {"age": None, "period": period_cov, "cohort": cohort_cov}
        self.length, self.blocks, at = length, [], 1
        columns, rows = [np.ones((len(i), 1))], []
        for kind in ("", "2"):
            for axis in AXES:
                if getattr(spec, axis) is None or (kind and not spec.het(axis)):
                    continue
                n = length[axis]
                x = np.zeros((len(i), n))
                x[np.arange(len(i)), index[axis]] = 1.0 if scale[axis] is None else scale[axis][index[axis]]
                columns.append(x)
                a, b = spec.hyper[axis + "_het" if kind else axis]
                if kind:
                    penalty, rank = np.eye(n), n - 1
                else:
                    penalty, rank = structure(n, spec.order(axis)), n - spec.order(axis)
                    if spec.prior_scale:
                        penalty = penalty * prior_factor(penalty)
                self.blocks.append(Block(axis + kind, axis, slice(at, at + n), penalty, rank, a, b))
                rows.append((at, np.ones(n)))
                if axis == "period" and not kind and spec.full and spec.order("period") == 2:
                    rows.append((at, np.arange(n) - (n - 1) / 2))
                at += n
        self.n, self.x = at, np.hstack(columns)
        limits = np.zeros((len(rows), at))
        for k, (start, v) in enumerate(rows):
            limits[k, start : start + len(v)] = v
        self.z = np.linalg.svd(limits, full_matrices=True)[2][len(rows) :].T
        self.xz = self.x @ self.z
        self.penalties = [self.z[b.at].T @ b.penalty @ self.z[b.at] for b in self.blocks]

    def prior(self, precision: list[float]) -> np.ndarray:
        out = np.zeros((self.z.shape[1],) * 2)
        for k, p in zip(precision, self.penalties):
            out += k * p
        return out

    def solve(self, weight: np.ndarray, prior: np.ndarray) -> np.ndarray:
        """Inverse Cholesky factor of XZ'WXZ + prior (a small ridge keeps it positive)."""
        q = (self.xz * weight[:, None]).T @ self.xz + prior
        q[np.diag_indices_from(q)] += 1e-6 * q.diagonal().mean()
        return np.linalg.inv(np.linalg.cholesky(q))


def run_chain(y: np.ndarray, n: np.ndarray, design: Design, spec: ModelSpec, n_iter: int, burn_in: int, step: int, seed) -> dict[str, np.ndarray]:
    """Posterior draws of one chain: Polya-Gamma Gibbs steps with interweaving of the precisions and a Laplace step.

    ``y`` and ``n`` are laid out age by age.  PG variates are normal with the exact mean and variance.
    """
    rng = np.random.Generator(np.random.Philox(np.random.SeedSequence(seed)))
    y, n = y.astype(float), n.astype(float)
    half, cells = y - n / 2, len(y)
    a0, b0 = spec.hyper["overdisp"]
    mu = np.log((y.sum() + 0.5) / (n.sum() - y.sum() + 0.5))
    start = np.zeros(design.n)
    start[0] = mu
    for b in design.blocks:
        if b.name in ("age", "period"):
            hit = (design.x[:, b.at] != 0).astype(float)
            p = np.clip((hit.T @ y + 0.5) / (hit.T @ n + 1), 1e-8, 1 - 1e-8)
            e = np.log(p / (1 - p))
            start[b.at] = e - e.mean()
    gamma = design.z.T @ start
    precision, zeta, delta = [1.0] * len(design.blocks), a0 / b0, np.zeros(cells)
    kept: dict[str, list] = {k: [] for k in ("beta", "precision", "zeta", "eta", "deviance")}
    accepted = 0

    def log_target(g: np.ndarray, eta: np.ndarray, prior: np.ndarray) -> float:
        return float((y * eta - n * np.logaddexp(0, eta)).sum() - 0.5 * g @ prior @ g)

    def proposal(g: np.ndarray, eta: np.ndarray, prior: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-eta))
        li = design.solve(n * p * (1 - p), prior)
        return g + li.T @ (li @ (design.xz.T @ (y - n * p) - prior @ g)), li

    def log_density(g: np.ndarray, mean: np.ndarray, li: np.ndarray) -> float:
        r = np.linalg.solve(li.T, g - mean)
        return float(-np.log(np.abs(li.diagonal())).sum() - 0.5 * r @ r)

    for it in range(1, n_iter + 1):
        fixed = design.xz @ gamma
        m, v = pg_moments(fixed + delta)
        omega = np.maximum(n * m + np.sqrt(n * v) * rng.standard_normal(cells), 1e-9)
        w, r = (omega * zeta / (omega + zeta), half * zeta / (omega + zeta)) if spec.overdisp else (omega, half)
        li = design.solve(w, design.prior(precision))
        gamma = li.T @ (li @ (design.xz.T @ r) + rng.standard_normal(len(gamma)))
        fixed = design.xz @ gamma
        if spec.overdisp:
            delta = (half - omega * fixed) / (omega + zeta) + rng.standard_normal(cells) / np.sqrt(omega + zeta)
            zeta = rng.gamma(a0 + cells / 2, 1 / (b0 + delta @ delta / 2))
        beta = design.z @ gamma
        for k, b in enumerate(design.blocks):
            e = beta[b.at]
            precision[k] = rng.gamma(b.a + b.rank / 2, 1 / (b.b + e @ b.penalty @ e / 2))
        # interweaving: move a precision and its smooth effect together
        for k, b in enumerate(design.blocks):
            if b.name.endswith("2"):
                continue
            new = float(np.exp(np.log(precision[k]) + 0.4 * rng.standard_normal()))
            scaled = beta[b.at] * np.sqrt(precision[k] / new)
            change = design.x[:, b.at] @ (scaled - beta[b.at])
            gap = fixed + delta - half / omega
            ratio = -0.5 * (omega * ((gap + change) ** 2 - gap**2)).sum() + b.a * np.log(new / precision[k]) - b.b * (new - precision[k])
            if np.log(rng.random()) < ratio:
                beta[b.at], precision[k], fixed = scaled, new, fixed + change
        gamma = design.z.T @ beta
        # Laplace step on all effects against the exact binomial likelihood
        prior = design.prior(precision)
        eta = fixed + delta
        mean, li = proposal(gamma, eta, prior)
        new = mean + li.T @ rng.standard_normal(len(gamma))
        new_eta = design.xz @ new + delta
        back, lb = proposal(new, new_eta, prior)
        ratio = log_target(new, new_eta, prior) - log_target(gamma, eta, prior) + log_density(gamma, back, lb) - log_density(new, mean, li)
        if np.isfinite(ratio) and np.log(rng.random()) < ratio:
            gamma, eta = new, new_eta
            accepted += 1
        if it > burn_in and (it - burn_in) % step == 0:
            fit = n / (1 + np.exp(-eta))
            with np.errstate(divide="ignore", invalid="ignore"):
                d = np.where(y > 0, y * np.log(y / fit), 0.0) + np.where(n - y > 0, (n - y) * np.log((n - y) / (n - fit)), 0.0)
            for k, x in (("beta", design.z @ gamma), ("precision", list(precision)), ("zeta", zeta), ("eta", eta), ("deviance", 2 * d.sum())):
                kept[k].append(x)
    out = {k: np.array(x) for k, x in kept.items()}
    return out | {"accepted": np.array(accepted / n_iter)}
