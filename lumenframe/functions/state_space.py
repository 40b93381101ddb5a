"""State-space models of many channels along ordered sequences, in Arrow batches with a state of fixed size.

A model has independent first-order latents of stationary variance one (``rates``: what is left of a latent after
one unit of time), a loading of channels on latents and the channels' noise variances. A step has the time since
the step before (``gap``, any positive whole number) and a value for each channel; a null value is a masked
channel. Steps needn't be evenly spaced: a gap of g moves latents by rates^g.

The sequences of a batch advance side by side (``scans``); frames hold each key's rows in one partition, in order.
With noise independent by channel a step is one rank-one update a seen channel, so masks need no case of their own.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenframe.functions.scans import _runs, _walk


class Model(NamedTuple):
    rates: tuple[float, ...]
    loading: tuple[tuple[float, ...], ...]  # channels x latents
    noise: tuple[float, ...]


FILTERED = "t long, gap long, n_seen int, pm array<double>, pp array<double>, m array<double>, p array<double>, nll double"
SMOOTHED = "t long, sm array<double>, sp array<double>, lags array<array<double>>"
ELIMINATED = "t long, gap long, d array<double>, g array<double>, part double, tail double"
LOG2PI = np.log(2 * np.pi)


def _matrix(column, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, width)


def _lists(values: np.ndarray) -> pa.Array:
    flat = values.reshape(len(values), -1)
    return pa.ListArray.from_arrays(np.arange(0, flat.size + 1, flat.shape[1], dtype=np.int32), pa.array(flat.ravel()))


def _diagonal(values: np.ndarray) -> np.ndarray:
    return values[..., None] * np.eye(values.shape[-1])


def _rho(model: Model, gap: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """What is left of each latent; nothing at a sequence's first step, so that it starts from the stationary state."""
    return np.where(begins[:, None], 0.0, np.array(model.rates) ** gap[:, None])


def filter_channels(steps: DataFrame, key: str, model: Model) -> DataFrame:
    """``steps``: key, t, gap, y (array, null: masked), in order -> key and FILTERED: prior and posterior moments of
    the latents (matrices row by row), negative log likelihood of the step's seen channels given all before."""
    load, noise = np.array(model.loading), np.array(model.noise)
    k = len(model.rates)

    def run(batches):
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, gap, y = np.asarray(batch.column(0)), batch.column(2).to_numpy(zero_copy_only=False), _matrix(batch.column(3), len(noise))
            seen = ~np.isnan(y)
            runs, n = len(_runs(keys)[0]), len(keys)
            m, p = np.zeros((runs, k)), np.zeros((runs, k, k))
            out = np.empty((n, k)), np.empty((n, k, k)), np.empty((n, k)), np.empty((n, k, k)), np.zeros(n)

            def step(on, rows, begins, m=m, p=p, out=out, gap=gap, y=y, seen=seen):
                rho = _rho(model, gap[rows], begins)
                mean, cov = rho * m[on], rho[:, :, None] * p[on] * rho[:, None, :] + _diagonal(1 - rho * rho)
                out[0][rows], out[1][rows] = mean, cov
                for c, h in enumerate(load):
                    look = seen[rows, c]
                    side = cov @ h
                    s = side @ h + noise[c]
                    e = np.where(look, y[rows, c] - mean @ h, 0.0)
                    gain = np.where(look, 1 / s, 0.0)[:, None] * side
                    mean, cov = mean + gain * e[:, None], cov - gain[:, :, None] * side[:, None, :]
                    out[4][rows] += np.where(look, 0.5 * (LOG2PI + np.log(s) + e * e / s), 0.0)
                m[on], p[on] = mean, cov
                out[2][rows], out[3][rows] = mean, cov

            held = _walk(keys, [m, p], step, held)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(seen.sum(1).astype(np.int32)), *(_lists(c) for c in out[:4]), pa.array(out[4])], names=[key, "t", "gap", "n_seen", "pm", "pp", "m", "p", "nll"])

    return steps.select(key, "t", "gap", "y").mapInArrow(run, f"{key} long, {FILTERED}")


def smooth_channels(filtered: DataFrame, key: str, model: Model, lags: int = 0) -> DataFrame:
    """Fixed-interval smoother of filtered steps, dealt by key: key and SMOOTHED. ``lags`` has the covariance of the
    step's latents with those of 1, 2, ... ``lags`` steps later (row by row; fewer at a sequence's end). The smoother's gains are multiplied back
    over a window of so many steps, so the state has a fixed size, and with as many lags as steps it is the whole
    path's covariance."""
    k = len(model.rates)

    def run(batches):
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, gap = np.asarray(batch.column(0)), batch.column(2).to_numpy(zero_copy_only=False)
            pm, m = (_matrix(batch.column(c), k) for c in (3, 5))
            pp, p = (_matrix(batch.column(c), k * k).reshape(-1, k, k) for c in (4, 6))
            runs, n = len(_runs(keys)[0]), len(keys)
            # Of the step after: smoothed and prior moments, gap, its covariances with the steps after it, and how many there are.
            state = [np.zeros((runs, k)), np.zeros((runs, k, k)), np.zeros((runs, k)), np.tile(np.eye(k), (runs, 1, 1)), np.ones(runs), np.zeros((runs, lags, k, k)), np.zeros(runs, int)]
            sm, sp, path, known = np.empty((n, k)), np.empty((n, k, k)), np.zeros((n, lags, k, k)), np.zeros(n, int)

            def step(on, rows, begins, state=state, sm=sm, sp=sp, path=path, known=known, pm=pm, pp=pp, m=m, p=p, gap=gap):
                rho = _rho(model, state[4][on], begins)
                back = np.linalg.solve(np.where(begins[:, None, None], np.eye(k), state[3][on]), rho[:, :, None] * p[rows]).transpose(0, 2, 1)
                sm[rows] = m[rows] + np.einsum("nij,nj->ni", back, state[0][on] - state[2][on])
                sp[rows] = p[rows] + back @ (state[1][on] - state[3][on]) @ back.transpose(0, 2, 1)
                known[rows] = np.where(begins, 0, np.minimum(state[6][on] + 1, lags))
                if lags:
                    path[rows] = back[:, None] @ np.concatenate([state[1][on][:, None], state[5][on][:, :-1]], 1)
                for own, value in zip(state, (sm[rows], sp[rows], pm[rows], pp[rows], gap[rows], path[rows], known[rows]), strict=True):
                    own[on] = value

            held = _walk(keys, state, step, held)
            inner = _lists(path[np.arange(lags)[None, :] < known[:, None]]) if known.any() else pa.array([], pa.list_(pa.float64()))
            shown = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(known)]).astype(np.int32), inner)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), _lists(sm), _lists(sp), shown], names=[key, "t", "sm", "sp", "lags"])

    rows = filtered.select(key, "t", "gap", "pm", "pp", "m", "p").sortWithinPartitions(key, F.col("t").desc())
    return rows.mapInArrow(run, f"{key} long, {SMOOTHED}")


def eliminate_channels(steps: DataFrame, key: str, model: Model) -> DataFrame:
    """Forward half of the block-tridiagonal Cholesky factorisation of the latents' posterior precision, one block a
    step, so that a sequence costs its length: key and ELIMINATED. ``d`` and ``g`` are a step's block and right-hand side with all before it
    eliminated. A key's NLL of its seen values is the sum of ``part`` and the last ``tail``."""
    load, noise = np.array(model.loading), np.array(model.noise)
    k = len(model.rates)
    squares = np.einsum("ci,cj,c->cij", load, load, 1 / noise)

    def run(batches):
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, gap, y = np.asarray(batch.column(0)), batch.column(2).to_numpy(zero_copy_only=False), _matrix(batch.column(3), len(noise))
            seen = ~np.isnan(y)
            runs, n = len(_runs(keys)[0]), len(keys)
            held_d, held_g = np.zeros((runs, k, k)), np.zeros((runs, k))
            d, g, part, tail = np.empty((n, k, k)), np.empty((n, k)), np.empty(n), np.empty(n)
            own_d = np.einsum("nc,cij->nij", seen.astype(float), squares)
            own_g = np.where(seen, y, 0.0) / noise @ load
            own_nll = 0.5 * np.where(seen, LOG2PI + np.log(noise) + np.where(seen, y, 0.0) ** 2 / noise, 0.0).sum(1)

            def step(on, rows, begins, held_d=held_d, held_g=held_g, d=d, g=g, part=part, tail=tail, gap=gap, own_d=own_d, own_g=own_g, own_nll=own_nll):
                rho = _rho(model, gap[rows], begins)
                q = 1 / (1 - rho * rho)  # precision of what is new
                block = np.where(begins[:, None, None], np.eye(k), held_d[on] + _diagonal(rho * rho * q))
                low = np.linalg.cholesky(block)
                side = np.linalg.solve(low, np.concatenate([_diagonal(rho * q), np.where(begins[:, None], 0.0, held_g[on])[:, :, None]], 2))
                cross, white = side[:, :, :k], side[:, :, k]
                d[rows] = _diagonal(q) - cross.transpose(0, 2, 1) @ cross + own_d[rows]
                g[rows] = np.einsum("nij,ni->nj", cross, white) + own_g[rows]
                part[rows] = own_nll[rows] - 0.5 * np.log(q).sum(1) + np.log(np.einsum("nii->ni", low)).sum(1) - 0.5 * (white * white).sum(1)
                last = np.linalg.cholesky(d[rows])
                white = np.linalg.solve(last, g[rows][:, :, None])[:, :, 0]
                tail[rows] = np.log(np.einsum("nii->ni", last)).sum(1) - 0.5 * (white * white).sum(1)
                held_d[on], held_g[on] = d[rows], g[rows]

            held = _walk(keys, [held_d, held_g], step, held)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), _lists(d), _lists(g), pa.array(part), pa.array(tail)], names=[key, "t", "gap", "d", "g", "part", "tail"])

    return steps.select(key, "t", "gap", "y").mapInArrow(run, f"{key} long, {ELIMINATED}")


def solve_channels(eliminated: DataFrame, key: str, model: Model) -> DataFrame:
    """Back substitution: key, t, sm, sp, the latents' posterior moments given all seen values."""
    k = len(model.rates)

    def run(batches):
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, gap = np.asarray(batch.column(0)), batch.column(2).to_numpy(zero_copy_only=False)
            d, g = _matrix(batch.column(3), k * k).reshape(-1, k, k), _matrix(batch.column(4), k)
            runs, n = len(_runs(keys)[0]), len(keys)
            state = [np.zeros((runs, k)), np.zeros((runs, k, k)), np.ones(runs)]
            sm, sp = np.empty((n, k)), np.empty((n, k, k))

            def step(on, rows, begins, state=state, sm=sm, sp=sp, d=d, g=g, gap=gap):
                rho = _rho(model, state[2][on], begins)
                q = 1 / (1 - rho * rho)
                low = np.linalg.inv(np.linalg.cholesky(d[rows] + _diagonal(rho * rho * q)))
                inverse = low.transpose(0, 2, 1) @ low
                sm[rows] = np.einsum("nij,nj->ni", inverse, g[rows] + rho * q * state[0][on])
                turn = inverse * (rho * q)[:, None, :]
                sp[rows] = inverse + turn @ state[1][on] @ turn.transpose(0, 2, 1)
                for own, value in zip(state, (sm[rows], sp[rows], gap[rows]), strict=True):
                    own[on] = value

            held = _walk(keys, state, step, held)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), _lists(sm), _lists(sp)], names=[key, "t", "sm", "sp"])

    rows = eliminated.select(key, "t", "gap", "d", "g").sortWithinPartitions(key, F.col("t").desc())
    return rows.mapInArrow(run, f"{key} long, t long, sm array<double>, sp array<double>")


def channel_mean(model: Model, channel: int, mean: str = "sm") -> Column:
    return sum((F.col(mean)[j] * w for j, w in enumerate(model.loading[channel])), F.lit(0.0))


def channel_variance(model: Model, channel: int, cov: str = "sp") -> Column:
    """Of a value of the channel, its noise included."""
    h, k = model.loading[channel], len(model.rates)
    return sum((F.col(cov)[i * k + j] * (h[i] * h[j]) for i in range(k) for j in range(k)), F.lit(float(model.noise[channel])))
