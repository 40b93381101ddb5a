"""State-space models against dense Gaussian algebra on small sequences."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenframe.functions import state_space as ss
from lumenframe.functions.scans import filter_steps, ordered
from lumenframe.operators import channels

MODEL = ss.Model((0.9, 0.5, 0.0), ((0.8, 0.3, 0.1), (0.5, -0.6, 0.0), (0.2, 0.7, -0.4)), (0.5, 0.6, 0.2))
FOLDER = "/root/testdata/sf0.001"


def sample(users=5, seed=0, steps=14):
    rng = np.random.default_rng(seed)
    rows = []
    for u in range(users):
        for t in range(rng.integers(1, steps) if u else 30):
            y = [None if rng.random() < 0.4 else float(rng.normal()) for _ in MODEL.noise]
            rows.append((u, t, int(rng.integers(1, 4)), [None] * 3 if t in (4, 5) else y))
    return rows


def dense(rows, model):
    """Posterior mean and covariance of all latents of a sequence, and the NLL of its seen values."""
    at = np.cumsum([0] + [r[2] for r in rows[1:]])
    n, k, c = len(rows), len(model.rates), len(model.noise)
    prior = np.zeros((n, k, n, k))
    for j, rate in enumerate(model.rates):
        prior[:, j, :, j] = np.array([[1.0 if a == b else rate ** abs(a - b) for b in at] for a in at])
    prior = prior.reshape(n * k, n * k)
    y = np.array([[np.nan if v is None else v for v in r[3]] for r in rows]).reshape(-1)
    seen = ~np.isnan(y)
    a = np.kron(np.eye(n), np.array(model.loading))[seen]
    cov = a @ prior @ a.T + np.diag(np.tile(model.noise, n)[seen])
    gain = np.linalg.solve(cov, a @ prior).T
    nll = 0.5 * (seen.sum() * np.log(2 * np.pi) + np.linalg.slogdet(cov)[1] + y[seen] @ np.linalg.solve(cov, y[seen])) if c and seen.any() else 0.0
    return (gain @ y[seen]).reshape(n, k), (prior - gain @ a @ prior).reshape(n, k, n, k), nll


@pytest.fixture(scope="module", params=[10_000, 3])
def steps(request, spark):
    """Sequences in one batch, and in batches of three rows that cut them."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", request.param)
    rows = sample()
    yield rows, ordered(spark.createDataFrame(rows, "user long, t long, gap long, y array<double>"), "user", "t").cache()
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def by_user(rows):
    out = {}
    for r in rows:
        out.setdefault(r[0], []).append(r)
    return out


def test_smoother_and_path_equal_the_dense_posterior(steps):
    rows, frame = steps
    got = by_user(sorted(map(tuple, ss.smooth_channels(ss.filter_channels(frame, "user", MODEL), "user", MODEL, lags=40).collect())))
    for user, own in by_user(rows).items():
        mean, cov, _ = dense(own, MODEL)
        for t, (_, _, sm, sp, lags) in enumerate(got[user]):
            assert sm == pytest.approx(mean[t], abs=1e-9) and sp == pytest.approx(cov[t, :, t].ravel(), abs=1e-9)
            assert len(lags) == len(own) - 1 - t  # with enough lags the whole path's covariance
            for d, block in enumerate(lags):
                assert block == pytest.approx(cov[t, :, t + d + 1].ravel(), abs=1e-9)


def test_short_windows_of_lags(steps):
    rows, frame = steps
    got = by_user(sorted(map(tuple, ss.smooth_channels(ss.filter_channels(frame, "user", MODEL), "user", MODEL, lags=2).collect())))
    for user, own in by_user(rows).items():
        _, cov, _ = dense(own, MODEL)
        for t, (_, _, _, _, lags) in enumerate(got[user]):
            assert len(lags) == min(2, len(own) - 1 - t)
            for d, block in enumerate(lags):
                assert block == pytest.approx(cov[t, :, t + d + 1].ravel(), abs=1e-9)


def test_precisions_equal_the_covariance_form(steps):
    rows, frame = steps
    eliminated = ss.eliminate_channels(frame, "user", MODEL).cache()
    got = by_user(sorted(map(tuple, ss.solve_channels(eliminated, "user", MODEL).collect())))
    nll = {r[0]: r[1] for r in eliminated.groupBy("user").agg(F.sum("part") + F.max_by("tail", "t")).collect()}
    filtered = {r[0]: r[1] for r in ss.filter_channels(frame, "user", MODEL).groupBy("user").agg(F.sum("nll")).collect()}
    for user, own in by_user(rows).items():
        mean, cov, want = dense(own, MODEL)
        assert nll[user] == pytest.approx(want, abs=1e-8) and filtered[user] == pytest.approx(want, abs=1e-8)
        for t, (_, _, sm, sp) in enumerate(got[user]):
            assert sm == pytest.approx(mean[t], abs=1e-9) and sp == pytest.approx(cov[t, :, t].ravel(), abs=1e-9)


def test_one_channel_is_the_scalar_filter(spark):
    """One latent of stationary variance q / (1 - a^2), seen through a loading of one: the scalar filter scaled."""
    a, q, r = 0.85, 0.1, 0.4
    size = (q / (1 - a * a)) ** 0.5
    rng = np.random.default_rng(2)
    rows = [(u, t, 1, float(rng.normal()), bool(rng.random() < 0.7)) for u in range(4) for t in range(20)]
    frame = ordered(spark.createDataFrame(rows, "user long, t long, gap long, x double, seen boolean"), "user", "t").cache()
    scalar = {(s["user"], s["t"]): s for s in filter_steps(frame, "user", a, q, r).collect()}
    many = ss.filter_channels(frame.withColumn("y", F.array(F.when(F.col("seen"), F.col("x")))), "user", ss.Model((a,), ((size,),), (r,))).collect()
    for s in many:
        one = scalar[s["user"], s["t"]]
        assert s["m"][0] * size == pytest.approx(one["m"], abs=1e-9) and s["p"][0] * size * size == pytest.approx(one["v"], abs=1e-9)
        assert s["nll"] == pytest.approx(one["nll"] or 0.0, abs=1e-9)


def test_hidden_entries_equal_dense_conditioning(spark):
    """Every method's mean and variance of hidden entries, and the NLL of all hidden entries of a user together."""
    steps = channels.hide(channels.channel_steps(spark, FOLDER)).cache()
    users = by_user(sorted((r["user_id"], r["t"], r["gap"], r["y"], r["seen"]) for r in steps.collect()))
    nll = {r["user_id"]: r["nll_hidden"] for r in channels.hidden_nll(spark, FOLDER).collect()}
    for name, model in channels.METHODS.items():
        got = {(r["user_id"], r["t"], r["channel"]): r for r in channels._hidden(steps, channels._posterior(steps, model), model).collect()}
        n = 0
        for user in sorted(users)[:4]:
            own = users[user]
            mean, cov, seen_nll = dense([(*r[:3], r[4]) for r in own], model)
            if name == "known":
                assert nll[user] == pytest.approx(dense(own, model)[2] - seen_nll, abs=2e-5)
            load = np.array(model.loading)
            for t, r in enumerate(own):
                for c in range(len(model.noise)):
                    if r[3][c] is not None and r[4][c] is None:
                        row, n = got[user, r[1], c], n + 1
                        assert row["mean"] == pytest.approx(load[c] @ mean[t], abs=1e-8) and row["var"] == pytest.approx(load[c] @ cov[t, :, t] @ load[c] + model.noise[c], abs=1e-8)
        assert n > 20


def test_empty_tables(spark):
    none = spark.createDataFrame([], "user long, t long, gap long, y array<double>")
    assert ss.smooth_channels(ss.filter_channels(none, "user", MODEL), "user", MODEL, 2).count() == 0
    assert ss.solve_channels(ss.eliminate_channels(none, "user", MODEL), "user", MODEL).count() == 0


def test_two_stage_against_plain_algebra(spark):
    steps = channels.hide(channels.channel_steps(spark, FOLDER)).cache()
    users = by_user(sorted((r["user_id"], r["t"], r["gap"], r["y"], r["seen"]) for r in steps.collect()))
    got = {(r["user_id"], r["t"]): r["sm"] for r in channels.two_stage(steps, channels.MODEL).collect()}
    alone, load = channels._alone(channels.MODEL, 0.8), np.array(channels.MODEL.loading)
    user = min(users)
    mean, _, _ = dense([(*r[:3], r[4]) for r in users[user]], alone)
    signal = mean @ np.array(alone.loading).T
    scores = np.linalg.solve(load @ load.T + np.diag(channels.MODEL.noise), signal.T).T @ load
    for t, r in enumerate(users[user]):
        assert got[user, r[1]] == pytest.approx(load @ scores[t], abs=1e-8)
