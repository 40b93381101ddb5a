"""The linear-Gaussian benchmark: scenario x replicate x method x metric, one labelled row each.

The grid and what applies where are tables; one task draws a (scenario, replicate), picks parameters on its
train and validation sequences, runs the methods on the test ones and scores them. Every cell of the grid is
in the result: what doesn't apply is there with a reason and without a value.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.operators.fitted import condition
from lumenframe.plans.status import finite_or_invalid, summarised

#: Scenario: class, a, q, r, length, hidden block. Fixed values.
SCENARIOS = {
    "stable_low_a": ("transition_stability", 0.60, 0.10, 0.40, 60, None),
    "stable_moderate": ("transition_stability", 0.85, 0.10, 0.40, 60, None),
    "stable_high_a": ("transition_stability", 0.97, 0.10, 0.40, 60, None),
    "process_dominant": ("noise_ratio", 0.85, 0.40, 0.10, 60, None),
    "observation_dominant": ("noise_ratio", 0.85, 0.025, 0.80, 60, None),
    "short_sequence": ("sequence_length", 0.85, 0.10, 0.40, 24, None),
    "long_sequence": ("sequence_length", 0.85, 0.10, 0.40, 120, None),
    "missing_block": ("missing_blocks", 0.85, 0.10, 0.40, 80, (28, 48)),
    "wrong_parameters": ("wrong_parameters", 0.85, 0.10, 0.40, 60, None),
    "reset_boundary": ("reset_boundary_failure", 0.85, 0.10, 0.40, 60, None),
    "near_unit_root": ("near_unit_root_stress", 0.99, 0.02, 0.40, 120, None),
}
#: Method: kind, parameters, the only scenario it applies to, family, information set, parameter source, target. Fixed values.
METHODS = {
    "stationary_mean": ("point", "none", None, "stationary_mean", "fixed_reference", "none", "point_state"),
    "persistence": ("point", "none", None, "persistence_open_loop", "online_observation_history", "none", "point_state"),
    "open_loop": ("point", "known", None, "persistence_open_loop", "online_first_observation", "known_true", "point_state"),
    "known_kalman_filter": ("filter", "known", None, "known_parameter_kalman", "online_current_and_past", "known_true", "online_state"),
    "known_rts_smoother": ("smoother", "known", None, "fixed_interval_rts", "retrospective_full_interval", "known_true", "retrospective_state"),
    "batch_conditioning_oracle": ("smoother", "known", None, "direct_batch_conditioning", "oracle_retrospective_full_interval", "known_true", "retrospective_state"),
    "selected_kalman_filter": ("filter", "selected", None, "finite_grid_selected", "online_current_and_past", "selected_train_validation", "online_state"),
    "selected_rts_smoother": ("smoother", "selected", None, "finite_grid_selected", "retrospective_full_interval", "selected_train_validation", "retrospective_state"),
    "misspecified_kalman_filter": ("filter", "wrong", "wrong_parameters", "wrong_parameter_control", "online_current_and_past", "predeclared_wrong", "online_state"),
    "misspecified_rts_smoother": ("smoother", "wrong", "wrong_parameters", "wrong_parameter_control", "retrospective_full_interval", "predeclared_wrong", "retrospective_state"),
    "false_continuation_filter": ("filter", "known", "reset_boundary", "reset_boundary_negative_control", "invalid_cross_sequence_history", "known_true", "online_state"),
}
#: Targets of metrics that aren't a method's state. Fixed values.
TARGETS = {"predictive_nll": "one_step_observation_prediction", "selection_parameter_l1": "selected_parameter_tuple", "reset_first_state_abs_difference": "boundary_reset_diagnostic", "oracle_mean_discrepancy": "numerical_correctness_reference"}
METRICS = ("latent_rmse", "predictive_nll", "interval_95_coverage", "mean_posterior_variance", "inside_missing_block_rmse", "outside_missing_block_rmse", "selection_parameter_l1", "oracle_mean_discrepancy", "reset_first_state_abs_difference")
#: Wrong parameters, the grid, seed and sizes; the reasons in ``reason_against`` are fixed values, too.
WRONG = (0.60, 0.025, 0.80)
GRID = [(a, q, r) for a in (0.60, 0.85, 0.97) for q in (0.025, 0.10, 0.40) for r in (0.10, 0.40, 0.80)]
SEED, REPLICATES, SEQUENCES = 20260820, 5, 2
SCHEMA = (
    "scenario string, scenario_class string, replicate int, split string, method string, method_family string, information_set string, parameter_source string, target string, metric string, value double, status string, reason string, "
    "seed_id string, true_a double, true_q double, true_r double, sequence_length int, missing_start int, missing_end int, selected_a double, selected_q double, selected_r double, inference_a double, inference_q double, inference_r double"
)


def _code(scenario: str) -> int:
    return int.from_bytes(hashlib.sha256(scenario.encode()).digest()[:4], "big")


def draw(scenario: str, replicate: int, split: int) -> tuple[np.ndarray, np.ndarray]:
    """(latent, observed), a row for each sequence; every step takes a state and an observation deviate."""
    _, a, q, r, length, _ = SCENARIOS[scenario]
    code = _code(scenario)
    e = np.stack([np.random.Generator(np.random.PCG64(np.random.SeedSequence((SEED, code, replicate, split, k)))).standard_normal((length, 2)) for k in range(SEQUENCES)])
    z = e[:, :, 0] * np.sqrt(q)
    z[:, 0] = e[:, 0, 0] * np.sqrt(q / (1 - a * a))
    for t in range(1, length):
        z[:, t] += a * z[:, t - 1]
    return z, z + e[:, :, 1] * np.sqrt(r)


def run_filter(x: np.ndarray, seen: np.ndarray, a, q, r) -> dict[str, np.ndarray]:
    """All sequences (and, with arrays a, q, r on a leading axis, all parameters) side by side."""
    shape = np.broadcast_shapes(np.shape(a)[:-1] + x.shape[:1] if np.ndim(a) else x.shape[:1]) + x.shape[1:]
    out = {k: np.empty(shape) for k in ("pm", "pv", "mean", "var", "nll")}
    for t in range(x.shape[-1]):
        pm, pv = (a * m, a * a * v + q) if t else (np.zeros(shape[:-1]), np.broadcast_to(q / (1 - a * a), shape[:-1]))
        s = pv + r
        gain = np.where(seen[t], pv / s, 0.0)
        m, v = pm + gain * (x[:, t] - pm), (1 - gain) * pv
        for k, value in (("pm", pm), ("pv", pv), ("mean", m), ("var", v), ("nll", np.where(seen[t], 0.5 * (np.log(2 * np.pi * s) + (x[:, t] - pm) ** 2 / s), np.nan))):
            out[k][..., t] = value
    return out


def run_smoother(f: dict[str, np.ndarray], a: float) -> dict[str, np.ndarray]:
    m, v = f["mean"].copy(), f["var"].copy()
    for t in range(m.shape[-1] - 2, -1, -1):
        back = f["var"][..., t] * a / f["pv"][..., t + 1]
        m[..., t] += back * (m[..., t + 1] - f["pm"][..., t + 1])
        v[..., t] += back * back * (v[..., t + 1] - f["pv"][..., t + 1])
    return {"mean": m, "var": v}


def batch(x: np.ndarray, seen: np.ndarray, a: float, q: float, r: float) -> dict[str, np.ndarray]:
    n = x.shape[1]
    t = np.arange(n)
    prior = q / (1 - a * a) * a ** np.abs(t[:, None] - t[None, :])
    made = [condition(np.zeros(n), prior, np.full(n, r), row, seen) for row in x]
    return {"mean": np.stack([m for m, _, _ in made]), "var": np.stack([np.diag(c) for _, c, _ in made])}


def infer(method: str, x: np.ndarray, seen: np.ndarray, p: tuple[float, float, float]) -> dict[str, np.ndarray]:
    a, q, r = p
    t = np.arange(x.shape[1])
    if method == "stationary_mean":
        return {"mean": np.zeros_like(x)}
    if method == "persistence":
        last = np.maximum.accumulate(np.where(seen, t, -1))
        return {"mean": np.where(last >= 0, x[:, np.maximum(last, 0)], 0.0)}
    if method == "open_loop":
        first, p0 = int(np.argmax(seen)), q / (1 - a * a)
        return {"mean": np.where(t >= first, a ** np.maximum(t - first, 0) * (p0 / (p0 + r)) * x[:, [first]], 0.0) * seen.any()}
    if method == "batch_conditioning_oracle":
        return batch(x, seen, a, q, r)
    if method == "false_continuation_filter":
        one = run_filter(x.reshape(1, -1), np.tile(seen, len(x)), a, q, r)
        return {k: v.reshape(x.shape) for k, v in one.items()}
    f = run_filter(x, seen, a, q, r)
    return run_smoother(f, a) if method.endswith("smoother") else f


def reason_against(scenario: str, method: str, metric: str) -> str | None:
    """Why a cell doesn't apply, before anything is worked out."""
    kind, source, only = METHODS[method][:3]
    if only and scenario != only:
        return "wrong-parameter control is predeclared only for wrong_parameters" if source == "wrong" else "false continuation is predeclared only for reset_boundary"
    return {
        "predictive_nll": None if kind == "filter" else "method does not return online predictive densities",
        "interval_95_coverage": None if kind != "point" else "point reference has no posterior variance",
        "mean_posterior_variance": None if kind != "point" else "point reference has no posterior variance",
        "inside_missing_block_rmse": None if SCENARIOS[scenario][5] else "scenario has no predeclared missing block",
        "outside_missing_block_rmse": None if SCENARIOS[scenario][5] else "scenario has no predeclared missing block",
        "selection_parameter_l1": None if source == "selected" else "method does not select parameters",
        "oracle_mean_discrepancy": None if method in ("known_kalman_filter", "known_rts_smoother", "batch_conditioning_oracle") else "metric is reserved for known recursion versus batch oracle",
        "reset_first_state_abs_difference": None if method == "false_continuation_filter" else "metric is reserved for reset-boundary negative control",
    }.get(metric)


def evaluate(scenario: str, replicate: int) -> pd.DataFrame:
    name, a, q, r, length, block = SCENARIOS[scenario]
    t = np.arange(length)
    hidden = (t >= block[0]) & (t < block[1]) if block else np.zeros(length, bool)
    seen, truth = ~hidden, (a, q, r)
    grid = np.array(GRID)[:, :, None]
    scores = sum(np.nanmean(run_filter(draw(scenario, replicate, k)[1], seen, *(grid[:, i] for i in range(3)))["nll"], axis=(1, 2)) for k in (1, 2))
    selected = min(zip(scores.tolist(), GRID, strict=True))[1]
    z, x = draw(scenario, replicate, 3)
    params = {"none": truth, "known": truth, "selected": selected, "wrong": WRONG}
    known = infer("known_kalman_filter", x, seen, truth)
    rows = []
    for method, (_, source, _, *about, state) in METHODS.items():
        out = None
        for metric in METRICS:
            reason, value = reason_against(scenario, method, metric), None
            if reason is None:
                out = out or infer(method, x, seen, params[source])
                error = out["mean"] - z
                rmse = lambda o: float(np.sqrt(np.mean(error[:, o] ** 2)))  # noqa: B023, E731
                if metric == "latent_rmse":
                    value = rmse(slice(None))
                elif metric == "predictive_nll":
                    value = float(out["nll"][:, seen].mean())
                elif metric == "interval_95_coverage":
                    value = float((np.abs(error) <= 1.959963984540054 * np.sqrt(out["var"])).mean())
                elif metric == "mean_posterior_variance":
                    value = float(out["var"].mean())
                elif metric.endswith("block_rmse"):
                    value = rmse(hidden if metric.startswith("inside") else seen)
                elif metric == "selection_parameter_l1":
                    value = float(sum(abs(u - v) for u, v in zip(selected, truth, strict=True)))
                elif metric == "reset_first_state_abs_difference":
                    value = float(abs(out["mean"][1, 0] - known["mean"][1, 0]))
                elif method == "known_kalman_filter":
                    value = max(float(np.abs(out["mean"][:, k] - batch(x[:, : k + 1], seen[: k + 1], *truth)["mean"][:, -1]).max()) for k in range(length))
                else:
                    value = float(np.abs(out["mean"] - batch(x, seen, *truth)["mean"]).max())
            used = (None, None, None) if source == "none" else params[source]
            rows.append((scenario, name, replicate, "test", method, *about, TARGETS.get(metric, state), metric, value, "ok" if reason is None else "inapplicable", reason, f"pcg64:{SEED}:{_code(scenario)}:{replicate}", a, q, r, length, *(block or (None, None)), *selected, *used))
    made = pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")])
    return made.astype({"missing_start": "Int32", "missing_end": "Int32", **{f"inference_{c}": "float64" for c in "aqr"}})


def linear_gaussian_results(spark, sf_dir) -> DataFrame:
    seeds = spark.createDataFrame([(s, k) for s in SCENARIOS for k in range(REPLICATES)], "scenario string, replicate int")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return evaluate(pdf["scenario"].iloc[0], int(pdf["replicate"].iloc[0]))

    rows = finite_or_invalid(seeds.groupBy("scenario", "replicate").applyInPandas(run, SCHEMA))
    return rows.withColumn("row_key", F.concat_ws("|", "scenario", F.col("replicate").cast("string"), "split", "method", "metric"))


def linear_gaussian_summary(spark, sf_dir) -> DataFrame:
    """q10, median, q90 over ok rows and rates over all rows by scenario, method, metric."""
    return summarised(linear_gaussian_results(spark, sf_dir), ["scenario", "method", "metric"])


QUERIES = {f.__name__: f for f in (linear_gaussian_results, linear_gaussian_summary)}
ORACLES: dict[str, str] = {}
