"""Further simulated designs: factor rows with six kinds of residual, cell counts, rotating and driven trajectories,
variants of latent-process trials, matched Gaussian controls. Each unit draws from a stream of its own."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.operators.gaussian import CHANNELS, LATENTS, LOADING, NOISE, OFFSET, STEPS, TAUS, kernel
from lumenframe.session import prepare
from lumenframe.sources.generators import KEYS, _draw, stream, units

RESIDUALS = ("diagonal", "isotropic", "correlated", "heavy_tailed", "scaled", "outliers")
#: Counts of the four cells (s, d) in each design. Fixed values.
CELLS = {"balanced": (12, 12, 12, 12), "unbalanced": (24, 6, 6, 12), "missing": (16, 16, 16, 0)}
RATES, DECAY = (2.0, 0.7), (0.4, 0.9)
TURNING = 61
VARIANTS = ("plain", "changepoint", "jitter", "counts", "correlated", "equal_timescales")


def factor_variants(seeds: DataFrame) -> DataFrame:
    """x = offset + loading z + e; the scenario's number names the kind of residual."""

    def one(*key):
        rng, kind = stream(31, *key), RESIDUALS[key[0] % len(RESIDUALS)]
        z, e = rng.normal(size=LATENTS), rng.normal(size=CHANNELS)
        e = {
            "diagonal": lambda: e * np.sqrt(NOISE), "isotropic": lambda: e * math.sqrt(NOISE.mean()), "correlated": lambda: np.linalg.cholesky(0.5 ** np.abs(np.subtract.outer(np.arange(CHANNELS), np.arange(CHANNELS)))) @ e * np.sqrt(NOISE),
            "heavy_tailed": lambda: rng.standard_t(3, size=CHANNELS) * np.sqrt(NOISE / 3), "scaled": lambda: e * np.sqrt(NOISE) * np.geomspace(0.2, 5, CHANNELS), "outliers": lambda: e * np.sqrt(NOISE) + (rng.uniform() < 0.03) * rng.choice([-8.0, 8.0], size=CHANNELS),
        }[kind]()
        return pd.DataFrame({"kind": [kind], "x": [(OFFSET + LOADING @ z + e).tolist()]})

    return _draw(seeds, one, f"{KEYS}, kind string, x array<double>")


def cell_designs(spark, sf_dir=None):
    """design, s, d, n and each design's rank: the number of its cells that aren't empty."""
    rows = [(k, s, d, n[2 * s + d]) for k, n in CELLS.items() for s in (0, 1) for d in (0, 1)]
    t = prepare(spark).createDataFrame(rows, "design string, s long, d long, n long")
    rank = t.groupBy("design").agg(F.count_if(F.col("n") > 0).alias("rank"), (F.max("n") == F.min("n")).alias("balanced"))
    return t.join(rank, "design")


def turning(z0: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Two planes that turn at RATES and two directions that decay."""
    parts = []
    for j, w in enumerate(RATES):
        a, b = z0[2 * j : 2 * j + 2]
        parts += [np.cos(w * t) * a - np.sin(w * t) * b, np.sin(w * t) * a + np.cos(w * t) * b]
    return np.column_stack([*parts, *(z0[4 + k] * np.exp(-r * t) for k, r in enumerate(DECAY))])


def rotations(seeds: DataFrame, kind: str = "turning", noise: float = 0.0) -> DataFrame:
    """unit, t, z: trajectories of six dimensions that turn, decay, pass as a sequence of bumps, or follow an input."""
    t = np.arange(TURNING) * 0.04

    def one(*key):
        rng = stream(51, *key)
        z0 = rng.normal(size=6) * np.array([1.2, 1.2, 0.8, 0.8, 0.55, 0.55])
        if kind == "turning":
            z = turning(z0, t)
        elif kind == "decay":
            z = z0 * np.exp(-t[:, None] * np.array([1.2, 0.8, 0.5, 0.35, 0.2, 0.1]))
        elif kind == "latency":
            z = np.exp(-(((t[:, None] - np.linspace(0.35, 1.7, 6) - 0.025 * key[2]) / np.linspace(0.13, 0.25, 6)) ** 2)) * np.where(np.arange(6) % 2, -1.0, 1.0)
        else:  # an input drives the state, in Euler steps
            u = np.column_stack([np.sin(1.3 * t + 0.35 * key[2]), np.exp(-(((t - 0.8 - 0.04 * key[2]) / 0.28) ** 2))])
            a, b = -np.linspace(0.25, 0.5, 6), np.array([[0.8, 0], [0, 0.7], [0.5, 0.3], [-0.3, 0.5], [0.2, -0.4], [0.4, 0.25]])
            z = np.empty((len(t), 6))
            z[0] = z0
            for k in range(len(t) - 1):
                z[k + 1] = z[k] + 0.04 * (a * z[k] + b @ u[k])
        z = z + rng.normal(scale=noise, size=z.shape) if noise else z
        return pd.DataFrame({"t": t, "z": z.tolist()})

    return _draw(seeds, one, f"{KEYS}, t double, z array<double>")


def process_variants(seeds: DataFrame) -> DataFrame:
    """z, y (flat): latent-process trials as they are, with a step in the first latent, with observations from shifted
    times, with counts, with correlated noise, and with equal timescales; the scenario's number names the kind."""

    def one(*key):
        rng, kind = stream(71, *key), VARIANTS[key[0] % len(VARIANTS)]
        taus = (0.18, 0.18) if kind == "equal_timescales" else TAUS
        z = np.stack([np.linalg.cholesky(kernel(tau)) @ rng.normal(size=STEPS) for tau in taus], 1)
        if kind == "changepoint":
            z[STEPS // 2 :, 0] += 2.0
        seen = np.roll(z, int(rng.integers(-2, 3)), axis=0) if kind == "jitter" else z
        e = rng.normal(size=(STEPS, CHANNELS))
        if kind == "correlated":
            e = e @ np.linalg.cholesky(0.28 ** np.abs(np.subtract.outer(np.arange(CHANNELS), np.arange(CHANNELS)))).T
        y = seen @ LOADING.T + OFFSET + e * np.sqrt(NOISE)
        if kind == "counts":
            y = np.sqrt(rng.poisson(np.exp(np.clip(z @ LOADING.T + OFFSET, -1.5, 1.1))) + 0.25)
        return pd.DataFrame({"kind": [kind], "z": [z.ravel().tolist()], "y": [y.ravel().tolist()]})

    return _draw(seeds, one, f"{KEYS}, kind string, z array<double>, y array<double>")


def curved_moments(nodes: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """Mean and covariance of the curved map over its hidden coordinate, by Gauss-Legendre nodes."""
    s, w = np.polynomial.legendre.leggauss(nodes)
    x = np.column_stack([s, s * s - 1 / 3, np.sin(np.pi * s), np.cos(np.pi * s), s**3, np.sin(2 * np.pi * s) / 2])
    mean = w @ x / 2
    return mean, (x - mean).T @ ((x - mean) * w[:, None]) / 2


def matched_gaussian(seeds: DataFrame, noise: float = 0.06) -> DataFrame:
    """The control of the curved rows: the same mean and covariance, no curve."""
    mean, cov = curved_moments()
    values, basis = np.linalg.eigh(cov)
    root = basis * np.sqrt(np.maximum(values, 0))

    def one(*key):
        rng = stream(62, *key)
        return pd.DataFrame({"x": [(mean + root @ rng.normal(size=len(mean)) + rng.normal(scale=noise, size=len(mean))).tolist()]})

    return _draw(seeds, one, f"{KEYS}, x array<double>")


def turning_planes(spark, sf_dir=None):
    """Planes of the skew map fitted to clean turning trajectories against the true ones: rates and angles."""
    from lumenframe.operators.dynamics import match_two_planes, plane_error, skew_planes
    from lumenframe.operators.fitted import constrained_map

    rows = rotations(units(spark, 1, 1, 8)).groupBy("replicate", "unit").agg(F.array_sort(F.collect_list(F.struct("t", "z"))).alias("path"))  # one trajectory

    def fit(pdf):
        paths = [np.array([p["z"] for p in own]) for own in pdf.sort_values("unit")["path"]]
        z = np.stack(paths)
        z = z - z.mean(0)
        x, d = ((z[:, 1:] + z[:, :-1]) / 2).reshape(-1, 6), (np.diff(z, axis=1) / 0.04).reshape(-1, 6)
        planes = skew_planes(constrained_map(x, d, "skew"))
        truth = [np.eye(6)[:, :2], np.eye(6)[:, 2:4]]
        order, _ = match_two_planes([p["basis"] for p in planes], truth)
        return pd.DataFrame([(k, order[k], round(abs(p["rate"]), 6), round(plane_error(p["basis"], truth[order[k]])["max_angle"], 5)) for k, p in enumerate(planes)], columns=["plane", "true_plane", "rate", "angle"])

    return rows.groupBy("replicate").applyInPandas(fit, "plane int, true_plane int, rate double, angle double")


def generated_counts(spark, sf_dir=None):
    """Rows and kinds that each design gives for a small seed table."""
    made = [("factor", factor_variants(units(spark, 6, 1, 4)), "kind"), ("process", process_variants(units(spark, 6, 1, 4)), "kind"), *((k, rotations(units(spark, 1, 1, 2), k), None) for k in ("turning", "decay", "latency", "driven")), ("matched", matched_gaussian(units(spark, 1, 1, 5)), None)]
    out = None
    for name, frame, kind in made:
        one = frame.agg(F.count("*").alias("n"), (F.count_distinct(kind) if kind else F.lit(1).cast("long")).alias("kinds")).select(F.lit(name).alias("design"), "n", "kinds")
        out = one if out is None else out.union(one)
    return out


QUERIES = {f.__name__: f for f in (cell_designs, turning_planes, generated_counts)}
_CELLS = ", ".join(f"('{k}', {s}, {d}, {n[2 * s + d]})" for k, n in CELLS.items() for s in (0, 1) for d in (0, 1))
ORACLES = {
    "cell_designs": f"WITH t AS (SELECT design, s::BIGINT AS s, d::BIGINT AS d, n::BIGINT AS n FROM (VALUES {_CELLS}) v(design, s, d, n)) SELECT *, count(*) FILTER (n > 0) OVER (PARTITION BY design) AS rank, max(n) OVER (PARTITION BY design) = min(n) OVER (PARTITION BY design) AS balanced FROM t",
    "generated_counts": f"SELECT * FROM (VALUES ('factor', 24::BIGINT, 6::BIGINT), ('process', 24, 6), ('turning', {2 * TURNING}, 1), ('decay', {2 * TURNING}, 1), ('latency', {2 * TURNING}, 1), ('driven', {2 * TURNING}, 1), ('matched', 5, 1)) v(design, n, kinds)",
}
