import numpy as np
import pytest

from cohortlake.operators.posterior import beta_cdf, f_quantile
from cohortlake.operators.predict import extend
from cohortlake.plans.kernels import Design, pg_moments, prior_factor, run_chain, structure
from cohortlake.plans.spec import Mcmc, ModelSpec


@pytest.mark.parametrize("order,length,sd,factor", [(1, 10, 1.224, 1.498701), (1, 25, 1.943, 3.773848), (1, 50, 2.749, 7.555444), (2, 10, 1.349, 1.818653), (2, 25, 5.195, 26.988486), (2, 50, 14.646, 214.498709)])
def test_prior_factor(order, length, sd, factor):
    f = prior_factor(structure(length, order))
    assert abs(f - factor) < 1e-5 and abs(f**0.5 - sd) < 1e-3
    assert abs(prior_factor(structure(length, order) * f) - 1) < 1e-6


def test_pg_moments():
    m, v = pg_moments(np.array([1e-5, 0.5, 2.0, -3.0]))
    assert np.allclose(m, [0.25, 0.2449186624, 0.190398539, 0.1508580423], atol=1e-9)
    assert np.allclose(v, [0.0416666667, 0.0396598008, 0.0213512384, 0.0117423758], atol=1e-9)


def test_design_constraints():
    d = Design(ModelSpec("rw2", "rw2", "rw2+het"), 5, 8, 2)
    assert d.n == 1 + 5 + 8 + 16 + 16
    for b in d.blocks:
        assert np.allclose(d.z[b.at].sum(axis=0), 0)
    assert np.allclose((np.arange(8) - 3.5) @ d.z[d.blocks[1].at], 0)


def test_f_quantile():
    assert abs(f_quantile(0.95, 3, 10) - 3.708265) < 1e-5 and abs(f_quantile(0.975, 3, 1e12) - 3.116135) < 1e-4
    assert abs(beta_cdf(0.3, 2, 5) - 0.579825) < 1e-6


def test_chain_is_reproducible_and_recovers_the_predictor():
    rng = np.random.default_rng(3)
    i, j = (x.ravel() for x in np.meshgrid(np.arange(8), np.arange(10), indexing="ij"))
    eta = -3 + 0.2 * (i - 3.5) + 0.3 * np.sin(j / 2)
    n = np.full(80, 20_000)
    y = rng.binomial(n, 1 / (1 + np.exp(-eta)))
    spec = ModelSpec("rw1", "rw1", "rw1")
    a, b = (run_chain(y, n, Design(spec, 8, 10, 2), spec, 400, 200, 1, [1, 2]) for _ in range(2))
    assert (a["eta"] == b["eta"]).all() and a["eta"].shape == (200, 80)
    assert np.sqrt(((a["eta"].mean(axis=0) - eta) ** 2).mean()) < 0.03 and a["accepted"] > 0.5


def test_unit_covariate_changes_nothing():
    spec, y, n = ModelSpec("rw1", "rw1", None), np.arange(20) % 7 + 1, np.full(20, 50)
    a = run_chain(y, n, Design(spec, 4, 5, 1), spec, 60, 30, 1, [5])
    b = run_chain(y, n, Design(spec, 4, 5, 1, np.ones(5)), spec, 60, 30, 1, [5])
    assert (a["eta"] == b["eta"]).all()


def test_saturated_and_empty_cells():
    spec = ModelSpec("rw1", "rw1", None, overdisp=True)
    y, n = np.array([0, 5, 5, 0, 3, 0] * 2), np.array([5, 5, 5, 0, 9, 9] * 2)
    got = run_chain(y, n, Design(spec, 3, 4, 1), spec, 100, 50, 5, [1])
    assert np.isfinite(got["deviance"]).all() and len(got["deviance"]) == 10


def test_extend():
    rng = np.random.default_rng(0)
    assert list(extend(np.array([1.0, 3.0]), 0, 2, 1.0, rng)) == [1, 3, 3, 3]
    assert np.allclose(extend(np.array([1.0, 3.0]), 2, 3, 1e18, rng), [1, 3, 5, 7, 9], atol=1e-6)


@pytest.mark.parametrize("bad", [dict(n_iter=10, burn_in=10, step=1), dict(n_iter=10, burn_in=9, step=5), dict(n_iter=10.5, burn_in=1, step=1)])
def test_mcmc_options(bad):
    with pytest.raises(ValueError):
        Mcmc(**bad).resolved(0)


def test_mcmc_auto():
    m = Mcmc().resolved(40_000)
    assert (m.n_iter, m.burn_in, m.step) == (40_000, 20_000, 20)


def test_spec():
    assert [s.key for s in ModelSpec().neighbours(try_het=True)] == ["rw2|rw1|rw1|plain", "rw1+het|rw1|rw1|plain", "rw1|rw2|rw1|plain", "rw1|rw1+het|rw1|plain", "rw1|rw1|rw2|plain", "rw1|rw1|rw1+het|plain", "rw1|rw1|rw1|overdisp"]
    for bad in (dict(age="rw3"), dict(age=None, period=" ", cohort=None), dict(hyper={"age": (0, 1)})):
        with pytest.raises(ValueError):
            ModelSpec(**bad)
