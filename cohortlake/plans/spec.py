"""Model specifications and sampler options."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field, replace

EFFECTS = ("rw1", "rw2", "rw1+het", "rw2+het")
AXES = ("age", "period", "cohort")
# Gamma(shape, rate) hyper-priors of the precisions (fixed values)
HYPER = {
    "age": (1.0, 0.5), "period": (1.0, 0.0005), "cohort": (1.0, 0.0005), "overdisp": (1.0, 0.05),
    "age_het": (1.0, 0.05), "period_het": (1.0, 0.05), "cohort_het": (1.0, 0.05),
}


@dataclass(frozen=True)
class Mcmc:
    """Numbers of sweeps; ``auto`` values are filled by ``resolved``."""

    n_iter: int | str = "auto"
    burn_in: int | str = "auto"
    step: int | str = "auto"
    chains: int = 4

    def resolved(self, auto_iter: int) -> Mcmc:
        n = auto_iter if self.n_iter == "auto" else self.n_iter
        burn = n // 2 if self.burn_in == "auto" else self.burn_in
        step = max(1, round((n - burn) / 1000)) if self.step == "auto" else self.step
        out = Mcmc(n, burn, step, self.chains)
        for k in ("n_iter", "burn_in", "step", "chains"):
            v = getattr(out, k)
            if not isinstance(v, int) or isinstance(v, bool) or v < (0 if k == "burn_in" else 1):
                raise ValueError(f"{k} must be a whole number")
        if burn >= n:
            raise ValueError("burn_in must be smaller than n_iter")
        if n - burn < step:
            raise ValueError("no draw would be kept: n_iter - burn_in < step")
        return out


@dataclass(frozen=True)
class ModelSpec:
    """age, period, cohort: None or one of EFFECTS; covariates scale the period or cohort effect."""

    age: str | None = "rw1"
    period: str | None = "rw1"
    cohort: str | None = "rw1"
    overdisp: bool = False
    prior_scale: bool = False
    hyper: dict = field(default_factory=lambda: dict(HYPER), hash=False, compare=False)

    def __post_init__(self) -> None:
        for a in AXES:
            v = getattr(self, a)
            if isinstance(v, str) and not v.strip():
                object.__setattr__(self, a, None)
            elif v is not None and v not in EFFECTS:
                raise ValueError(f"{a}: {v!r} is none of {EFFECTS}")
        if not any(getattr(self, a) for a in AXES):
            raise ValueError("a model needs an effect of age, period or cohort")
        object.__setattr__(self, "hyper", {**HYPER, **(self.hyper or {})})
        for k, (a, b) in self.hyper.items():
            if not (a > 0 and b > 0):
                raise ValueError(f"hyper-parameters of {k} must be positive")

    def order(self, axis: str) -> int:
        v = getattr(self, axis)
        return 0 if v is None else int(v[2])

    def het(self, axis: str) -> bool:
        v = getattr(self, axis)
        return v is not None and v.endswith("+het")

    @property
    def full(self) -> bool:
        return all(getattr(self, a) for a in AXES)

    @property
    def key(self) -> str:
        return "|".join([*(getattr(self, a) or "-" for a in AXES), "overdisp" if self.overdisp else "plain"])

    def neighbours(self, pinned: frozenset[str] = frozenset(), try_het: bool = False) -> list[ModelSpec]:
        """Specifications one step richer: rw1 to rw2, added heterogeneity, added overdispersion; pinned parts stay."""
        out = []
        for a in AXES:
            v = getattr(self, a)
            if v is None or a in pinned:
                continue
            if v.startswith("rw1"):
                out.append(replace(self, **{a: v.replace("rw1", "rw2")}))
            if try_het and not v.endswith("+het"):
                out.append(replace(self, **{a: v + "+het"}))
        if not self.overdisp and "overdisp" not in pinned:
            out.append(replace(self, overdisp=True))
        return out

    def to_dict(self) -> dict:
        return asdict(self)
