"""Fits with small dense algebra, one group a task: Gaussian conditioning, demixing and decoding, linear
dynamics and planes, vector fields, and bounded autoencoders. Inputs are simulated with known truth."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from lumenframe.sources import generators as g

LAMBDAS = (1e-4, 0.01, 1.0, 100.0)


# Gaussian processes


def se_kernel(t: np.ndarray, tau: float, nugget: float = 0.02) -> np.ndarray:
    return (1 - nugget) * np.exp(-0.5 * ((t[:, None] - t[None, :]) / tau) ** 2) + nugget * np.eye(len(t))


def condition(mean: np.ndarray, cov: np.ndarray, noise: np.ndarray, x: np.ndarray, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Posterior mean and covariance of a Gaussian given its noisy seen entries, and their mean NLL."""
    if not seen.any():
        return mean, cov, float("nan")
    c = cov[np.ix_(seen, seen)] + np.diag(noise[seen])
    low = np.linalg.cholesky(c)
    white, cross = np.linalg.solve(low, x[seen] - mean[seen]), np.linalg.solve(low, cov[seen])
    nll = 0.5 * (seen.sum() * np.log(2 * np.pi) + 2 * np.log(np.diag(low)).sum() + white @ white)
    return mean + cross.T @ white, cov - cross.T @ cross, float(nll / seen.sum())


def kalman_matrix(x: np.ndarray, seen: np.ndarray, a: np.ndarray, q: np.ndarray, c: np.ndarray, r: np.ndarray, p0: np.ndarray, gains: bool = False):
    """Multivariate filter and smoother with a mask for each channel: smoothed means and covariances, and with
    ``gains`` the smoother's gain of each step but the last."""
    n, k = len(x), len(a)
    m, p, pm, pp = np.zeros((n, k)), np.zeros((n, k, k)), np.zeros((n, k)), np.zeros((n, k, k))
    for t in range(n):
        pm[t], pp[t] = (a @ m[t - 1], a @ p[t - 1] @ a.T + q) if t else (np.zeros(k), p0)
        o = seen[t]
        if o.any():
            h = c[o]
            gain = np.linalg.solve(h @ pp[t] @ h.T + np.diag(r[o]), h @ pp[t]).T
            m[t], p[t] = pm[t] + gain @ (x[t, o] - h @ pm[t]), pp[t] - gain @ h @ pp[t]
        else:
            m[t], p[t] = pm[t], pp[t]
    back = np.zeros((max(n - 1, 0), k, k))
    for t in range(n - 2, -1, -1):
        back[t] = np.linalg.solve(pp[t + 1], a @ p[t]).T
        m[t], p[t] = m[t] + back[t] @ (m[t + 1] - pm[t + 1]), p[t] + back[t] @ (p[t + 1] - pp[t + 1]) @ back[t].T
    return (m, p, back) if gains else (m, p)


def gp_posterior(spark, sf_dir):
    """Simulated sequences with a hidden block: timescale by likelihood on the seen rest, error inside the block."""
    rows = g.linear_sequences(g.units(spark, 2, 3, 4), length=60)
    taus = (2.0, 5.0, 12.0)

    def fit(pdf):
        pdf = pdf.sort_values("t")
        t, x = pdf["t"].to_numpy(float), pdf["x"].to_numpy()
        seen, noise = ~((t >= 28) & (t < 48)), np.full(len(t), 0.4)
        var = max(x[seen].var() - 0.4, 0.05)
        tried = [(condition(np.zeros(len(t)), var * se_kernel(t, tau), noise, x, seen), tau) for tau in taus]
        (mean, cov, nll), tau = min(tried, key=lambda v: (v[0][2], v[1]))
        rmse = lambda o: float(np.sqrt(np.mean((mean[o] - pdf["latent"].to_numpy()[o]) ** 2)))
        return pd.DataFrame([(*(int(pdf[c].iloc[0]) for c in ("scenario", "replicate", "unit")), tau, round(nll, 6), round(rmse(seen), 6), round(rmse(~seen), 6), round(float(np.diag(cov)[~seen].mean()), 6))], columns=["scenario", "replicate", "unit", "tau", "nll", "rmse_seen", "rmse_hidden", "var_hidden"])

    return rows.groupBy("scenario", "replicate", "unit").applyInPandas(fit, f"{g.KEYS}, tau double, nll double, rmse_seen double, rmse_hidden double, var_hidden double")


# Demixing and decoding


def demix(mean: np.ndarray, marginal: np.ndarray, lam: float, k: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """(encoder, decoder) of rank k that map centred means (rows) to a marginal, ridge-regularised."""
    gram = mean.T @ mean + lam * np.trace(mean.T @ mean) / mean.shape[1] * np.eye(mean.shape[1])
    full = np.linalg.solve(gram, mean.T @ marginal).T
    u = np.linalg.svd(full @ mean.T, full_matrices=False)[0][:, :k]
    return u, u.T @ full


def ridge_decoder(x: np.ndarray, y: np.ndarray, lam: float) -> tuple[np.ndarray, float]:
    """Weights and offset for labels of -1 and 1, in the smaller of the primal and the dual form."""
    mean, scale = x.mean(0), np.where(x.std(0) > 1e-12, x.std(0), 1.0)
    z = (x - mean) / scale
    w = z.T @ np.linalg.solve(z @ z.T + lam * np.eye(len(z)), y - y.mean()) if len(z) < z.shape[1] else np.linalg.solve(z.T @ z + lam * np.eye(z.shape[1]), z.T @ (y - y.mean()))
    return w / scale, float(y.mean() - (w / scale) @ mean)


def demixing(spark, sf_dir):
    """Simulated factorial trials in three splits: models are fitted on training trials, penalties are chosen on
    validation trials (error or accuracy, then the smaller penalty), and what is reported is the test trials'.
    Marginals are mapped by the regularised form (rank by the fitted values) and the reduced-rank form (rank by a
    projector of them)."""
    trials = g.factorial_trials(g.units(spark, 1, 3, 60))

    def fit(pdf):
        wide = pdf.pivot_table(index=["unit", "stimulus", "decision"], columns=["t", "p"], values="x")
        bins, channels = pdf["t"].nunique(), pdf["p"].nunique()
        x = wide.to_numpy().reshape(-1, bins, channels)
        s, d = (wide.index.get_level_values(c).to_numpy() for c in ("stimulus", "decision"))
        split = np.arange(len(x)) // 4 % 5  # labels go round with the unit number: three parts train, one validates, one tests
        rows = []

        def parts_of(own):
            cells = np.stack([x[own & (s == a) & (d == b)].mean(0) for a in (-1, 1) for b in (-1, 1)]).reshape(2, 2, bins, channels)
            return cells

        cells = {k: parts_of(np.isin(split, v)) for k, v in (("train", (0, 1, 2)), ("validation", (3,)), ("test", (4,)))}
        centre = cells["train"].mean((0, 1, 2))

        def marginal(c, name):
            c = c - centre
            time = c.mean((0, 1), keepdims=True)
            stim, dec = c.mean(1, keepdims=True) - time, c.mean(0, keepdims=True) - time
            part = {"time": time, "stimulus": stim, "decision": dec, "interaction": c - time - stim - dec}[name]
            return np.broadcast_to(part, c.shape).reshape(-1, channels), c.reshape(-1, channels)

        for name in ("time", "stimulus", "decision", "interaction"):
            target, flat = marginal(cells["train"], name)
            for method, build in (("regularised", demix), ("reduced_rank", reduced_rank)):
                models = {lam: build(flat, target, lam) for lam in LAMBDAS}
                error = lambda k, lam, models=models, name=name: _nmse(*marginal(cells[k], name), *models[lam])
                lam = min(LAMBDAS, key=lambda v: (error("validation", v), v))
                rows.append((name, method, "nmse", error("test", lam), lam))
        z = x.reshape(len(x), -1)
        on = {k: np.isin(split, v) for k, v in (("train", (0, 1, 2)), ("validation", (3,)), ("test", (4,)))}
        for name, y in (("stimulus", s), ("decision", d)):
            models = {lam: ridge_decoder(z[on["train"]], y[on["train"]].astype(float), lam) for lam in LAMBDAS}
            right = lambda k, lam, models=models, y=y: float((np.where(z[on[k]] @ models[lam][0] + models[lam][1] >= 0, 1, -1) == y[on[k]]).mean())
            lam = min(LAMBDAS, key=lambda v: (-right("validation", v), v))
            rows.append((name, "decoder", "accuracy", right("test", lam), lam))
        return pd.DataFrame([(int(pdf["replicate"].iloc[0]), n, w, m, round(float(v), 6), lam) for n, w, m, v, lam in rows], columns=["replicate", "target", "method", "metric", "value", "lam"])

    return trials.groupBy("replicate").applyInPandas(fit, "replicate int, target string, method string, metric string, value double, lam double")


def reduced_rank(mean: np.ndarray, marginal: np.ndarray, lam: float, k: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """(encoder, decoder): the ridge map, then the leading directions of the values it fits."""
    full = np.linalg.solve(mean.T @ mean + lam * np.eye(mean.shape[1]), mean.T @ marginal)
    u = np.linalg.svd(mean @ full, full_matrices=False)[2][:k].T
    return u, (full @ u).T


def _nmse(target: np.ndarray, flat: np.ndarray, encoder: np.ndarray, decoder: np.ndarray) -> float:
    return float(((target - flat @ decoder.T @ encoder.T) ** 2).sum() / max((target**2).sum(), 1e-15))


# Dynamics


def constrained_map(x: np.ndarray, dx: np.ndarray, kind: str) -> np.ndarray:
    """Least squares dx = x M' with M free, skew or symmetric, over a basis of such matrices."""
    k = x.shape[1]
    if kind == "free":
        return np.linalg.lstsq(x, dx, rcond=None)[0].T
    sign = -1.0 if kind == "skew" else 1.0
    basis = []
    for i in range(k):
        for j in range(i + (kind == "skew"), k):
            m = np.zeros((k, k))
            m[i, j], m[j, i] = 1.0, sign if i != j else 1.0
            basis.append(m)
    design = np.stack([(x @ m.T).ravel() for m in basis], 1)
    return np.tensordot(np.linalg.lstsq(design, dx.ravel(), rcond=None)[0], np.stack(basis), 1)


def skew_fit(spark, sf_dir):
    """Planar trajectories: R2 of the free, skew and symmetric map on derivatives, and the turning rate."""
    rows = g.limit_cycles(g.units(spark, 1, 2, 12))

    def fit(pdf):
        own = [p.sort_values("t")[["x", "y"]].to_numpy() for _, p in pdf.groupby("unit")]
        x = np.concatenate([(p[2:] + p[:-2]) / 2 for p in own])
        dx = np.concatenate([(p[2:] - p[:-2]) / 0.1 for p in own])
        out = []
        for kind in ("free", "skew", "symmetric"):
            m = constrained_map(x, dx, kind)
            r2 = 1 - ((dx - x @ m.T) ** 2).sum() / ((dx - dx.mean(0)) ** 2).sum()
            out.append((int(pdf["replicate"].iloc[0]), kind, round(float(r2), 6), round(float((m[1, 0] - m[0, 1]) / 2), 6)))
        return pd.DataFrame(out, columns=["replicate", "kind", "r2", "rate"])

    return rows.groupBy("replicate").applyInPandas(fit, "replicate int, kind string, r2 double, rate double")


def monomials(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The ten monomials up to the third degree: 1, x, y, x2, xy, y2, x3, x2y, xy2, y3."""
    return np.stack([x**i * y**j for n in range(4) for i, j in ((n - j, j) for j in range(n + 1))], -1)


def rollout(weights: np.ndarray, start: np.ndarray, dt: float, steps: int) -> np.ndarray:
    """Fourth-order steps of a field; NaN from where it leaves a radius of 3."""
    field = lambda z: monomials(z[..., 0], z[..., 1])[..., : len(weights)] @ weights
    out = np.full((steps, *start.shape), np.nan)
    out[0] = z = start
    for k in range(1, steps):
        a = field(z)
        b = field(z + dt / 2 * a)
        c = field(z + dt / 2 * b)
        z = z + dt / 6 * (a + 2 * b + 2 * c + field(z + dt * c))
        z = np.where(np.linalg.norm(z, axis=-1, keepdims=True) > 3, np.nan, z)
        out[k] = z
    return out


def field_fit(spark, sf_dir):
    """Affine and cubic vector fields from central differences: field error and rollout error on new starts."""
    rows = g.limit_cycles(g.units(spark, 1, 2, 16))

    def fit(pdf):
        own = {u: p.sort_values("t")[["x", "y"]].to_numpy() for u, p in pdf.groupby("unit")}
        train, test = [p for u, p in own.items() if u % 4], [p for u, p in own.items() if not u % 4]
        z, dz = np.concatenate([p[1:-1] for p in train]), np.concatenate([(p[2:] - p[:-2]) / 0.1 for p in train])
        out = []
        for name, k in (("affine", 3), ("cubic", 10)):
            w = np.linalg.lstsq(monomials(z[:, 0], z[:, 1])[:, :k], dz, rcond=None)[0]
            path = rollout(w, np.stack([p[0] for p in test]), 0.05, len(test[0]))
            err = float(np.sqrt(np.nanmean((path - np.stack(test, 1)) ** 2)))
            v = np.concatenate(test)
            r2 = (v**2).sum(1, keepdims=True)
            truth = v * (1 - r2) + 2 * np.stack([-v[:, 1], v[:, 0]], 1)
            out.append((int(pdf["replicate"].iloc[0]), name, round(float(np.sqrt(((monomials(v[:, 0], v[:, 1])[:, :k] @ w - truth) ** 2).mean() / (truth**2).mean())), 6), round(err, 6)))
        return pd.DataFrame(out, columns=["replicate", "model", "field_nrmse", "rollout_rmse"])

    return rows.groupBy("replicate").applyInPandas(fit, "replicate int, model string, field_nrmse double, rollout_rmse double")


# Autoencoders


def loss_and_gradients(x: np.ndarray, params: list[np.ndarray], bent: list[bool]) -> tuple[float, list[np.ndarray]]:
    """Mean squared reconstruction error and its gradient by every weight and offset."""
    acts = [x]
    for k, tanh in enumerate(bent):
        z = acts[-1] @ params[2 * k] + params[2 * k + 1]
        acts.append(np.tanh(z) if tanh else z)
    delta, grads = 2 * (acts[-1] - x) / x.size, [np.zeros(0)] * len(params)
    for k in range(len(bent) - 1, -1, -1):
        if bent[k]:
            delta = delta * (1 - acts[k + 1] ** 2)
        grads[2 * k], grads[2 * k + 1] = acts[k].T @ delta, delta.sum(0)
        delta = delta @ params[2 * k].T
    return float(((acts[-1] - x) ** 2).mean()), grads


def layers(p: int, hidden: int) -> tuple[list[tuple[int, int]], list[bool]]:
    sizes = [(p, hidden), (hidden, 1), (1, hidden), (hidden, p)] if hidden else [(p, 1), (1, p)]
    return sizes, [bool(hidden) and k in (0, 2) for k in range(len(sizes))]


def predict_and_code(x: np.ndarray, params: list[np.ndarray], bent: list[bool]) -> tuple[np.ndarray, np.ndarray]:
    """Reconstruction, and the code in the middle."""
    z, code = x, x
    for k, tanh in enumerate(bent):
        z = z @ params[2 * k] + params[2 * k + 1]
        z = np.tanh(z) if tanh else z
        code = z if k == len(bent) // 2 - 1 else code
    return z, code


def train_autoencoder(x: np.ndarray, held: np.ndarray, hidden: int, seed: int, rounds: int = 1500, patience: int = 120, rate: float = 0.01, frozen: bool = False) -> tuple[float, list[np.ndarray]]:
    """One code through a tanh layer (hidden 0: linear), full-batch Adam, stopped early on validation loss. With
    ``frozen`` the encoder stays as it was drawn."""
    rng, p = g.stream(61, seed, hidden), x.shape[1]
    sizes, bent = layers(p, hidden)
    params = [v for a, b in sizes for v in (rng.normal(scale=1 / np.sqrt(a), size=(a, b)), np.zeros(b))]
    m1, m2 = [np.zeros_like(v) for v in params], [np.zeros_like(v) for v in params]
    moving = range(len(sizes) if frozen else 0, len(params))
    best, kept, wait = np.inf, [v.copy() for v in params], 0
    for step in range(1, rounds + 1):
        _, grads = loss_and_gradients(x, params, bent)
        for k in moving:
            m1[k], m2[k] = 0.9 * m1[k] + 0.1 * grads[k], 0.999 * m2[k] + 0.001 * grads[k] ** 2
            params[k] -= rate * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-8)
        loss = float(((predict_and_code(held, params, bent)[0] - held) ** 2).mean())
        best, wait, kept = (loss, 0, [v.copy() for v in params]) if loss < best - 1e-9 else (best, wait + 1, kept)
        if wait > patience:
            break
    return best, kept


def autoencoder(spark, sf_dir):
    """Linear, nonlinear and frozen-encoder autoencoders beside one principal direction, a seed a task. Training is
    stopped and seeds are chosen on validation rows (loss, then the seed); errors are the test rows'. The code's rank
    correlation with the hidden coordinate is beside them."""
    rows = g.curved_rows(g.units(spark, 1, 1, 300))
    tries = rows.select("unit", "s", "x", F.explode(F.expr("array(struct('linear' as method, 0 as hidden, 0 as seed), struct('nonlinear' as method, 8 as hidden, 0 as seed), struct('nonlinear' as method, 8 as hidden, 1 as seed), struct('nonlinear' as method, 8 as hidden, 2 as seed), struct('frozen' as method, 8 as hidden, 0 as seed))")).alias("c")).select("unit", "s", "x", "c.*")

    def fit(pdf):
        pdf = pdf.sort_values("unit")
        x, s, part = np.stack(pdf["x"].to_numpy()), pdf["s"].to_numpy(), pdf["unit"].to_numpy() % 5
        train, test = part < 3, part == 4
        z = (x - x[train].mean(0)) / x[train].std(0)
        method, hidden, seed = pdf["method"].iloc[0], int(pdf["hidden"].iloc[0]), int(pdf["seed"].iloc[0])
        loss, params = train_autoencoder(z[train], z[part == 3], hidden, seed, frozen=method == "frozen")
        made, code = predict_and_code(z[test], params, layers(x.shape[1], hidden)[1])
        u = np.linalg.svd(z[train] - z[train].mean(0), full_matrices=False)[2][:1]
        ranks = [np.argsort(np.argsort(v)).astype(float) for v in (code[:, 0], s[test])]
        return pd.DataFrame([(method, seed, round(loss, 6), round(float(((made - z[test]) ** 2).mean()), 6), round(float(((z[test] - z[test] @ u.T @ u) ** 2).mean()), 6), round(abs(float(np.corrcoef(*ranks)[0, 1])), 6))], columns=["method", "seed", "validation_mse", "mse", "pca_mse", "rank_correlation"])

    made = tries.groupBy("method", "hidden", "seed").applyInPandas(fit, "method string, seed int, validation_mse double, mse double, pca_mse double, rank_correlation double")
    best = made.groupBy("method").agg(F.min(F.struct("validation_mse", "seed")).alias("b")).select(F.col("method").alias("of"), F.col("b.seed").alias("chosen"))
    return made.join(F.broadcast(best), F.col("of") == F.col("method")).select("method", "seed", "validation_mse", "mse", "pca_mse", "rank_correlation", (F.col("seed") == F.col("chosen")).alias("chosen"))  # a row for each method


QUERIES = {f.__name__: f for f in (gp_posterior, demixing, skew_fit, field_fit, autoencoder)}
ORACLES: dict[str, str] = {}
