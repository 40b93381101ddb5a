"""Seeded simulated inputs. Each row of a seed table is one unit (scenario, replicate, index), drawn from a
stream of its own, so that results don't hang on partitioning or order."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from lumenframe.session import prepare

SEED = 20260819


def stream(*words: int, seed: int = SEED) -> np.random.Generator:
    return np.random.Generator(np.random.PCG64(np.random.SeedSequence((seed, *words))))


def units(spark: SparkSession, scenarios: int, replicates: int, each: int) -> DataFrame:
    """scenario, replicate, unit: a row for each unit to draw."""
    return prepare(spark).range(scenarios * replicates * each).selectExpr(f"cast(id div {replicates * each} as int) scenario", f"cast(id div {each} % {replicates} as int) replicate", f"cast(id % {each} as int) unit")


def _draw(seeds: DataFrame, one, schema: str) -> DataFrame:
    def run(frames):
        for pdf in frames:
            parts = [one(*key).assign(scenario=key[0], replicate=key[1], unit=key[2]) for key in pdf[["scenario", "replicate", "unit"]].itertuples(index=False, name=None)]
            if parts:
                yield pd.concat(parts)[[c.split()[0] for c in schema.split(", ")]]

    return seeds.mapInPandas(run, schema)


KEYS = "scenario int, replicate int, unit int"


def linear_sequences(seeds: DataFrame, length: int = 80, a: float = 0.85, q: float = 0.1, r: float = 0.4) -> DataFrame:
    """Scalar first-order sequences from the stationary law, with noisy observations."""

    def one(*key):
        rng = stream(10, *key)
        z = np.empty(length)
        z[0] = rng.normal(scale=np.sqrt(q / (1 - a * a)))
        for t in range(1, length):
            z[t] = a * z[t - 1] + rng.normal(scale=np.sqrt(q))
        return pd.DataFrame({"t": range(length), "latent": z, "x": z + rng.normal(scale=np.sqrt(r), size=length)})

    return _draw(seeds, one, f"{KEYS}, t int, latent double, x double")


def limit_cycles(seeds: DataFrame, dt: float = 0.05, steps: int = 161, noise: float = 0.0) -> DataFrame:
    """Planar trajectories onto the unit circle, in closed form: radius (1 + (r0^-2 - 1) e^-2t)^-1/2, angle + 2t."""

    def one(*key):
        rng = stream(20, *key)
        r0, angle, t = rng.uniform(0.3, 1.7), rng.uniform(0, 2 * np.pi), dt * np.arange(steps)
        radius = (1 + (r0**-2 - 1) * np.exp(-2 * t)) ** -0.5
        e = rng.normal(scale=noise, size=(2, steps)) if noise else np.zeros((2, steps))
        return pd.DataFrame({"t": t, "x": radius * np.cos(angle + 2 * t) + e[0], "y": radius * np.sin(angle + 2 * t) + e[1]})

    return _draw(seeds, one, f"{KEYS}, t double, x double, y double")


def factor_rows(seeds: DataFrame, loading: np.ndarray, noise: np.ndarray) -> DataFrame:
    """One row a unit: x = loading z + noise."""

    def one(*key):
        rng = stream(30, *key)
        x = loading @ rng.normal(size=loading.shape[1]) + rng.normal(size=len(noise)) * np.sqrt(noise)
        return pd.DataFrame({"x": [x.tolist()]})

    return _draw(seeds, one, f"{KEYS}, x array<double>")


def factorial_trials(seeds: DataFrame, bins: int = 24, channels: int = 12, noise: float = 0.5) -> DataFrame:
    """Trials with two binary labels: a time part, one for each label and one for both."""
    shapes = stream(40).normal(size=(4, channels))
    t = np.linspace(0, 1, bins)
    course = np.stack([np.sin(2 * np.pi * t), t, np.cos(np.pi * t), t * (1 - t) * 4])

    def one(*key):
        rng = stream(41, *key)
        s, d = (1 if key[2] % 2 else -1), (1 if key[2] // 2 % 2 else -1)
        x = sum(k * np.outer(c, v) for k, c, v in zip((1, s, d, s * d * 0.5), course, shapes, strict=True)) + rng.normal(scale=noise, size=(bins, channels))
        return pd.DataFrame({"stimulus": s, "decision": d, "t": np.repeat(np.arange(bins), channels), "p": np.tile(np.arange(channels), bins), "x": x.ravel()})

    return _draw(seeds, one, f"{KEYS}, stimulus int, decision int, t int, p int, x double")


def curved_rows(seeds: DataFrame, noise: float = 0.06) -> DataFrame:
    """Six smooth functions of one hidden coordinate."""

    def one(*key):
        rng = stream(60, *key)
        s = rng.uniform(-1, 1)
        x = np.array([s, s * s - 1 / 3, np.sin(np.pi * s), np.cos(np.pi * s), s**3, np.sin(2 * np.pi * s) / 2]) + rng.normal(scale=noise, size=6)
        return pd.DataFrame({"s": [s], "x": [x.tolist()]})

    return _draw(seeds, one, f"{KEYS}, s double, x array<double>")
