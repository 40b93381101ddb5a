"""Published figures of the hairpin and the circle, designs with known truth."""

import numpy as np
import pytest

from lumenframe.operators import curves, dynamics
from lumenframe.sources import designs
from lumenframe.sources.generators import units


def test_hairpin(spark):
    got = {(r["graph"], r["metric"]): (r["value"], r["status"]) for r in curves.hairpin_recovery(spark).collect()}
    assert [got["k=6", m][0] for m in ("edges", "components", "shortcuts", "infinite_pairs")] == [622, 1, 0, 0]
    assert [got["k=1", m][0] for m in ("edges", "components", "infinite_pairs")] == [123, 57, 15883]
    assert got["k=6", "isomap_rmse"][0] == pytest.approx(0.0176344, abs=1e-6) and got["k=1", "isomap_rmse"] == (None, "inapplicable")
    assert got["all", "pca_rmse"][0] == pytest.approx(1.63981, abs=1e-5)


def test_circle(spark):
    got = {(r["spacing"], r["metric"]): r["value"] for r in curves.circle_modes(spark).collect()}
    assert got["even", "first"] == got["even", "second"] == pytest.approx(0.9538803685, abs=1e-9)
    assert got["even", "max_angle"] < 1e-4 and got["even", "residual"] < 1e-9 and got["even", "extension_rmse"] < 1e-6
    assert got["crowded", "direct_gap"] < 1e-5


def test_numbering_of_points_does_not_matter():
    rng = np.random.default_rng(2)
    theta = rng.uniform(0, 6, 40)
    a, b = curves.circle_analysis(theta), curves.circle_analysis(theta[rng.permutation(40)])
    assert all(a[k] == pytest.approx(b[k], abs=1e-6) for k in ("first", "second", "residual", "truncation"))


def test_turning_planes(spark):
    got = {r["true_plane"]: r for r in designs.turning_planes(spark).collect()}
    assert got[0]["rate"] == pytest.approx(2.0, abs=0.05) and got[1]["rate"] == pytest.approx(0.7, abs=0.05) and got[0]["angle"] < 3


def test_planes():
    rng = np.random.default_rng(4)
    q = np.linalg.qr(rng.normal(size=(6, 6)))[0]
    m = np.zeros((6, 6))
    m[0, 1], m[1, 0], m[2, 3], m[3, 2] = -2.0, 2.0, -0.7, 0.7
    planes = dynamics.skew_planes(q @ m @ q.T)
    assert [round(p["rate"], 9) for p in planes] == [2.0, 0.7]
    assert dynamics.match_two_planes([planes[1]["basis"], planes[0]["basis"]], [q[:, :2], q[:, 2:4]])[0] == (1, 0)
    assert dynamics.plane_error(dynamics.imaginary_plane(q @ m @ q.T), q[:, :2])["max_angle"] < 1e-5


def test_designs(spark):
    mean, cov = designs.curved_moments()
    x = np.stack([r["x"] for r in designs.matched_gaussian(units(spark, 1, 1, 4000), noise=0.0).collect()])
    assert np.abs(x.mean(0) - mean).max() < 0.06 and np.abs(np.cov(x.T) - cov).max() < 0.06
    kinds = {r["kind"]: r["sd"] for r in designs.factor_variants(units(spark, 6, 1, 300)).selectExpr("kind", "posexplode(x) as (i, v)").groupBy("kind").agg({"v": "stddev"}).withColumnRenamed("stddev(v)", "sd").collect()}
    assert set(kinds) == set(designs.RESIDUALS) and kinds["outliers"] > kinds["diagonal"]
