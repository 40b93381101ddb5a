"""Condition paths against the same steps on dense arrays."""

import itertools

import duckdb
import numpy as np
import pytest

from lumenframe.operators import paths
from lumenframe.operators.sequence import STANDARD

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def dense():
    """Smoothed means: half x condition x step x entry; every condition has users for the whole window in both halves."""
    rows = duckdb.sql(f"WITH {STANDARD.replace('FROM events', f''' FROM '{FOLDER}/events.parquet' ''')} SELECT user_id, t, x FROM z ORDER BY user_id, t").fetchall()
    sums = np.zeros((2, 5, paths.WINDOW, paths.DIMS + 1))
    for user, own in itertools.groupby(rows, lambda r: r[0]):
        x = [r[2] for r in own]
        for t in range(min(paths.WINDOW, len(x) - paths.DIMS + 1)):
            sums[user // 5 % 2, user % 5, t] += [*x[t : t + paths.DIMS], 1]
    means = sums[..., :-1] / sums[..., -1:]
    smooth = means.copy()
    smooth[:, :, 1:-1] = (means[:, :, :-2] + means[:, :, 1:-1] + means[:, :, 2:]) / 3
    return smooth


def test_fit_and_apply(spark, dense):
    train, test = dense
    over = train.mean(0)
    centre = (train - over).mean((0, 1))
    left = (train - over - centre).reshape(-1, paths.DIMS)
    _, s, vt = np.linalg.svd(left, full_matrices=False)
    axes = vt[: paths.KEPT] * np.sign(vt[np.arange(paths.KEPT), np.abs(vt[: paths.KEPT]).argmax(1)])[:, None]
    got = {(r["axis"], r["i"]): r for r in paths.path_axes(spark, FOLDER).collect()}
    assert len(got) == paths.KEPT * paths.DIMS
    for (k, i), r in got.items():
        assert r["w"] == pytest.approx(axes[k, i], abs=1e-5) and r["share"] == pytest.approx(s[k] ** 2 / (s**2).sum(), abs=1e-5)
    wanted = (test - over - centre) @ axes.T
    scores = paths.path_scores(spark, FOLDER).collect()
    assert len(scores) == wanted.size
    assert all(r["score"] == pytest.approx(wanted[r["condition"], r["t"], r["axis"]], abs=1e-4) for r in scores)
