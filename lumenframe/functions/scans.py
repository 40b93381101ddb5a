"""Recursions along ordered sequences in Arrow batches: a fixed-size state goes from row to row and from batch
to batch, so a sequence may be of any length and is never collected.

The sequences of a batch advance side by side, one vector operation a step. Frames must hold each key's rows
in one partition, in order (``ordered``); what a window by the key has made is already dealt like that.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

STEPS = "t long, pm double, pv double, m double, v double, inn double, s double, nll double"


def ordered(frame: DataFrame, key: str, order: str, dealt: bool = False) -> DataFrame:
    return (frame if dealt else frame.repartition(key)).sortWithinPartitions(key, order)


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first row, rows) of each run of equal keys."""
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return first, np.diff(np.append(first, len(keys)))


def _walk(keys: np.ndarray, state: list[np.ndarray], step, held):
    """Advance ``state`` (arrays with a row for each run) over the rows of a batch by ``step(runs, rows, begins)``.
    ``held``: (key, rows of state) of the run that the batch before ended in. Returns the new ``held``."""
    first, size = _runs(keys)
    fresh = np.ones(len(first), bool)
    if held is not None and held[0] == keys[0]:
        fresh[0] = False
        for own, old in zip(state, held[1], strict=True):
            own[0] = old
    for k in range(int(size.max())):
        on = np.flatnonzero(size > k)
        step(on, first[on] + k, fresh[on] & (k == 0))
    return keys[-1], [own[-1].copy() for own in state]


def filter_batch(keys, x, seen, a, q, r, held):
    """Filter rows of one batch; a, q, r: arrays of parameter points. (pm, pv, m, v) of each row and point."""
    first, _ = _runs(keys)
    g = len(a)
    m, v = np.zeros((len(first), g)), np.zeros((len(first), g))
    out = [np.empty((len(keys), g)) for _ in range(4)]
    prior = q / (1 - a * a)

    def step(on, rows, begins):
        pm = np.where(begins[:, None], 0.0, a * m[on])
        pv = np.where(begins[:, None], prior, a * a * v[on] + q)
        gain = pv / (pv + r)
        look = seen[rows][:, None]
        m[on] = np.where(look, pm + gain * (x[rows][:, None] - pm), pm)
        v[on] = np.where(look, (1 - gain) * pv, pv)
        for column, value in zip(out, (pm, pv, m[on], v[on]), strict=True):
            column[rows] = value

    return out, _walk(keys, [m, v], step, held)


def filter_steps(events: DataFrame, key: str, a: float, q: float, r: float) -> DataFrame:
    """``events``: key, t, x, seen, dealt and in order -> key and STEPS; innovation, its variance and negative log
    likelihood are null where nothing is seen. The prior is the stationary one."""
    points = [np.array([float(p)]) for p in (a, q, r)]

    def run(batches):
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, x, seen = np.asarray(batch.column(0)), batch.column(2).to_numpy(zero_copy_only=False), batch.column(3).to_numpy(zero_copy_only=False).astype(bool)
            (pm, pv, m, v), held = filter_batch(keys, x, seen, *points, held)
            pm, pv, m, v = (c[:, 0] for c in (pm, pv, m, v))
            inn, s = x - pm, pv + float(r)
            nll = (np.log(2 * np.pi * s) + inn * inn / s) * 0.5
            hidden = ~seen
            columns = [batch.column(0), batch.column(1), *(pa.array(c) for c in (pm, pv, m, v)), *(pa.array(c, mask=hidden) for c in (inn, s, nll))]
            yield pa.RecordBatch.from_arrays(columns, names=[key, "t", "pm", "pv", "m", "v", "inn", "s", "nll"])

    return events.select(key, "t", "x", "seen").mapInArrow(run, f"{key} long, {STEPS}")


def smoother_steps(steps: DataFrame, key: str, a: float) -> DataFrame:
    """Fixed-interval smoother of filter steps that are dealt by key: key, t, sm, sv. Rows are put in falling
    order of time inside their partitions."""

    def run(batches):
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.asarray(batch.column(0))
            pm, pv, m, v = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(2, 6))
            first, _ = _runs(keys)
            later = [np.zeros(len(first)) for _ in range(4)]  # of the step after: sm, sv, pm, pv
            sm, sv = np.empty(len(keys)), np.empty(len(keys))

            def step(on, rows, begins, later=later, sm=sm, sv=sv, pm=pm, pv=pv, m=m, v=v):
                gain = v[rows] * a / np.where(begins, 1.0, later[3][on])
                sm[rows] = np.where(begins, m[rows], m[rows] + gain * (later[0][on] - later[2][on]))
                sv[rows] = np.where(begins, v[rows], v[rows] + gain * gain * (later[1][on] - later[3][on]))
                for own, value in zip(later, (sm[rows], sv[rows], pm[rows], pv[rows]), strict=True):
                    own[on] = value

            held = _walk(keys, later, step, held)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sm), pa.array(sv)], names=[key, "t", "sm", "sv"])

    rows = steps.select(key, "t", "pm", "pv", "m", "v").sortWithinPartitions(key, steps["t"].desc())
    return rows.mapInArrow(run, f"{key} long, t long, sm double, sv double")


def grid_nll(events: DataFrame, key: str, grid: list[tuple[float, float, float]]) -> DataFrame:
    """key, point (number in the grid), nll, n: sums over a key's seen steps, all points in one pass. A key that
    goes over a batch's end comes in parts."""
    a, q, r = (np.array(p, float) for p in zip(*grid, strict=True))

    def run(batches):
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, x, seen = np.asarray(batch.column(0)), batch.column(2).to_numpy(zero_copy_only=False), batch.column(3).to_numpy(zero_copy_only=False).astype(bool)
            (pm, pv, _, _), held = filter_batch(keys, x, seen, a, q, r, held)
            s = pv + r
            nll = np.where(seen[:, None], (np.log(2 * np.pi * s) + (x[:, None] - pm) ** 2 / s) * 0.5, 0.0)
            first, _ = _runs(keys)
            sums, n = np.add.reduceat(nll, first), np.add.reduceat(seen.astype(np.int64), first)
            g = len(a)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(keys[first], g)), pa.array(np.tile(np.arange(g, dtype=np.int32), len(first))), pa.array(sums.ravel()), pa.array(np.repeat(n, g))], names=[key, "point", "nll", "n"])

    return events.select(key, "t", "x", "seen").mapInArrow(run, f"{key} long, point int, nll double, n long")


def euler_steps(inputs: DataFrame, key: str, a: float, b: float, dt: float) -> DataFrame:
    """z <- z + dt (a z + b u) from 0 along each key's inputs (key, t, u): key, t, z before the input."""

    def run(batches):
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, u = np.asarray(batch.column(0)), batch.column(2).to_numpy(zero_copy_only=False)
            first, _ = _runs(keys)
            z, out = np.zeros(len(first)), np.empty(len(keys))

            def step(on, rows, begins, z=z, out=out, u=u):
                out[rows] = z[on]
                z[on] = z[on] + dt * (a * z[on] + b * u[rows])

            held = _walk(keys, [z], step, held)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out)], names=[key, "t", "z"])

    return inputs.select(key, "t", "u").mapInArrow(run, f"{key} long, t long, z double")
