import numpy as np
import pytest

from lumenframe.operators import fitted, graph, moments
from lumenframe.sources import generators as g


def test_factor_analysis_never_gets_worse_and_beats_the_diagonal():
    rng = np.random.default_rng(0)
    load = rng.normal(size=(8, 2)) * 1.5
    cov = load @ load.T + np.diag(rng.uniform(0.3, 1, 8))
    fa = moments.factor_analysis(cov)
    assert all(b <= a + 1e-10 for a, b in zip(fa["history"], fa["history"][1:], strict=False))
    assert abs(fa["nll"] - moments.expected_nll(cov, cov)) < 1e-3 < moments.expected_nll(cov, np.diag(np.diag(cov))) - fa["nll"]


def test_conditioning_equals_filter_and_precision_form():
    rng = np.random.default_rng(1)
    n, a, q, r = 12, 0.8, 0.3, 0.5
    times = np.arange(n)
    prior = q / (1 - a * a) * a ** np.abs(times[:, None] - times[None, :])
    x, seen = rng.normal(size=n), rng.random(n) < 0.7
    mean, cov, _ = fitted.condition(np.zeros(n), prior, np.full(n, r), x, seen)
    m, p = fitted.kalman_matrix(x[:, None], seen[:, None], np.array([[a]]), np.array([[q]]), np.array([[1.0]]), np.array([r]), np.array([[q / (1 - a * a)]]))
    assert np.allclose(m[:, 0], mean, atol=1e-9) and np.allclose(p[:, 0, 0], np.diag(cov), atol=1e-9)
    precision = np.linalg.inv(np.linalg.inv(prior) + np.diag(seen / r))
    assert np.allclose(precision @ (np.where(seen, x, 0) / r), mean, atol=1e-8) and np.allclose(precision, cov, atol=1e-8)


def test_shortest_paths_and_scaling():
    d = graph.shortest_paths(5, [0, 1, 2], [1, 2, 3], [1.0, 2.0, 1.5])
    assert d[0, 3] == 4.5 and np.isinf(d[0, 4])
    x = np.random.default_rng(2).normal(size=(20, 2))
    full = np.linalg.norm(x[:, None] - x[None], axis=-1)
    y, negative = graph.classical_scaling(full)
    assert np.allclose(np.linalg.norm(y[:, None] - y[None], axis=-1), full, atol=1e-8) and negative < 1e-8


def test_constrained_maps():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 4))
    for kind, sign in (("skew", -1), ("symmetric", 1)):
        m = rng.normal(size=(4, 4))
        m = m + sign * m.T
        assert np.allclose(fitted.constrained_map(x, x @ m.T, kind), m)


def test_fits_on_known_truth(spark):
    for r in fitted.skew_fit(spark, "").collect():
        if r["kind"] != "symmetric":
            assert r["rate"] == pytest.approx(2.0, abs=0.1)
    fields = {(r["replicate"], r["model"]): r for r in fitted.field_fit(spark, "").collect()}
    assert all(fields[k, "cubic"]["rollout_rmse"] < 0.05 < fields[k, "affine"]["rollout_rmse"] for k in (0, 1))
    assert all(r["value"] >= 0.9 for r in fitted.demixing(spark, "").where("metric = 'accuracy'").collect())
    assert all(r["value"] < 0.5 for r in fitted.demixing(spark, "").where("metric = 'nmse' and target <> 'interaction'").collect())
    auto = {r["method"]: r for r in fitted.autoencoder(spark, "").where("chosen").collect()}
    assert auto["nonlinear"]["mse"] < auto["linear"]["mse"] < auto["frozen"]["mse"] * 3 and auto["nonlinear"]["rank_correlation"] > 0.8
    assert all(r["rmse_seen"] < 1 for r in fitted.gp_posterior(spark, "").collect())


def test_gradients_by_central_differences():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(30, 6))
    for hidden in (0, 4):
        sizes, bent = fitted.layers(6, hidden)
        params = [v for a, b in sizes for v in (rng.normal(size=(a, b)), rng.normal(size=b))]
        _, grads = fitted.loss_and_gradients(x, params, bent)
        for k, v in enumerate(params):
            at = tuple(rng.integers(0, n) for n in v.shape)
            old, sides = v[at], []
            for step in (1e-6, -1e-6):
                v[at] = old + step
                sides.append(fitted.loss_and_gradients(x, params, bent)[0])
            v[at] = old
            assert (sides[0] - sides[1]) / 2e-6 == pytest.approx(grads[k][at], abs=1e-6)


def test_training_does_not_see_other_rows():
    """Poisoned test rows change nothing; poisoned training rows do."""
    rng = np.random.default_rng(6)
    x, held = rng.normal(size=(40, 6)), rng.normal(size=(10, 6))
    a = fitted.train_autoencoder(x, held, 3, 0, rounds=40)
    b = fitted.train_autoencoder(x + 0, held + 0, 3, 0, rounds=40)
    c = fitted.train_autoencoder(x * 1.5, held, 3, 0, rounds=40)
    assert all(np.array_equal(u, v) for u, v in zip(a[1], b[1])) and not all(np.array_equal(u, v) for u, v in zip(a[1], c[1]))


def test_draws_do_not_hang_on_partitions(spark):
    seeds = g.units(spark, 2, 2, 3)
    a = sorted(map(tuple, g.linear_sequences(seeds.repartition(1), 10).collect()))
    assert a == sorted(map(tuple, g.linear_sequences(seeds.repartition(5), 10).collect()))
