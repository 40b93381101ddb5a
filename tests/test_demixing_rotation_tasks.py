from collections import Counter

import numpy as np
import pytest

from lumenframe.plans import demixing_task, rotation_task
from lumenframe.plans.status import summarised


def figures(rows, scenario):
    made = summarised(rows.where(f"scenario = '{scenario}'"), ["scenario", "method", "metric"]).collect()
    return {(r["method"], r["metric"]): [r[c] for c in ("q10", "median", "q90")] for r in made}


def test_demixing(spark):
    rows = demixing_task.demixing_results(spark).cache()
    assert Counter(r["status"] for r in rows.collect()) == {"ok": 567, "inapplicable": 891, "invalid": 54}
    s = figures(rows, "balanced_reference")
    for key, want in {
        ("condition_mean", "stimulus_marginal_nmse"): (0.1808, 0.1995, 0.2691), ("pca", "stimulus_marginal_nmse"): (0.1187, 0.1251, 0.1362), ("marginal_pca", "stimulus_marginal_nmse"): (0.1278, 0.1368, 0.1496),
        ("selected_dpca", "stimulus_marginal_nmse"): (0.1787, 0.1789, 0.1934), ("selected_dpca", "decision_marginal_nmse"): (0.0925, 0.1045, 0.1302), ("selected_dpca", "stimulus_subspace_angle_degrees"): (5.0274, 5.2335, 7.9515),
        ("ridge_decoder", "stimulus_decoding_accuracy"): (1, 1, 1), ("shuffled_decoder_control", "stimulus_decoding_accuracy"): (0.4625, 0.4792, 0.5792), ("shuffled_dpca_control", "stimulus_marginal_nmse"): (0.7650, 0.8885, 1.0291),
    }.items():
        assert s[key] == pytest.approx(want, abs=6e-5), key
    assert figures(rows, "pseudo_population")["selected_dpca", "stimulus_marginal_nmse"][1] == pytest.approx(0.1917, abs=6e-5)
    assert figures(rows, "averaging_mismatch")["selected_dpca", "stimulus_marginal_nmse"][1] == pytest.approx(0.1819, abs=6e-5)
    rows.unpersist()


def test_rotation(spark):
    rows = rotation_task.rotation_results(spark).cache()
    assert Counter(r["status"] for r in rows.collect()) == {"ok": 474, "inapplicable": 726}
    s = figures(rows, "clean_rotation")
    for key, want in {
        ("unrestricted_fit", "derivative_rmse"): (0.6680, 0.6844, 0.6926), ("skew_fit", "derivative_rmse"): (0.6726, 0.6872, 0.6948), ("symmetric_fit", "derivative_rmse"): (2.5650, 2.5741, 2.5858),
        ("pca_plane", "plane_angle_degrees"): (0.4619, 0.5389, 0.6176), ("skew_fit", "plane_angle_degrees"): (0.3565, 0.4838, 0.7605),
        ("skew_fit", "angular_rate_abs_error"): (0.0082, 0.0083, 0.0309), ("skew_fit", "tangential_velocity_ratio"): (0.9556, 0.9647, 0.9677),
    }.items():
        assert s[key] == pytest.approx(want, abs=6e-5), key
    assert figures(rows, "common_input")["input_aware_fit", "derivative_rmse"] == pytest.approx((0.6861, 0.6866, 0.6933), abs=6e-5)
    assert figures(rows, "covariance_control")["covariance_shuffle_control", "covariance_similarity"] == pytest.approx((0.999986, 0.999990, 0.999994), abs=1e-6)
    rows.unpersist()


def test_poisoned_test_trials_leave_the_fit_alone():
    (x, y), (vx, vy) = (demixing_task.draw("balanced_reference", 0, k) for k in (0, 1))
    a = demixing_task.choose((x, y), (vx, vy))
    b = demixing_task.choose((x, y), (vx, vy))
    c = demixing_task.choose((x + 5 * y[:, :1, None], y), (vx, vy))
    assert all(np.array_equal(a["maps"][k], b["maps"][k]) and not np.allclose(a["maps"][k], c["maps"][k]) for k in demixing_task.PARTS)
