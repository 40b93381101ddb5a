"""The demixing benchmark: scenario x replicate x method x metric, one labelled row each.

One task draws a (scenario, replicate) of labelled trials, fits maps and decoders on training trials, chooses penalties on
validation trials and scores test trials. A design with an empty cell makes what needs all cells ``invalid``.
"""

from __future__ import annotations

import hashlib
import json

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.operators.dynamics import plane_error
from lumenframe.plans.status import summarised
from lumenframe.session import prepare

#: Scenario: class, trials a cell to train, validate and test on, what is particular about it. Fixed values.
SCENARIOS = {
    "balanced_reference": ("balanced_reference", (20, 10, 12), ""),
    "near_collinear": ("near_collinear_subspaces", (20, 10, 12), "collinear"),
    "missing_cell": ("missing_unbalanced_cells", (20, 10, 12), "missing"),
    "unbalanced_cells": ("missing_unbalanced_cells", (20, 10, 12), "unbalanced"),
    "label_shuffle": ("label_shuffle", (20, 10, 12), "shuffle"),
    "pseudo_population": ("pseudo_population", (20, 10, 12), "pseudo"),
    "averaging_mismatch": ("averaging_mismatch", (20, 10, 12), "shift"),
    "small_sample": ("sample_size", (5, 4, 12), ""),
    "large_sample": ("sample_size", (45, 18, 18), ""),
}
#: Method: family, parameter source, information set. Fixed values.
METHODS = {
    "condition_mean": ("condition_mean", "train_labels", "supervised_train"),
    "pca": ("pca", "train_fit", "supervised_train"),
    "marginal_pca": ("marginal_pca", "train_labels", "supervised_train"),
    "selected_dpca": ("regularized_dpca", "train_validation", "supervised_train_validation"),
    "ridge_decoder": ("decoder", "train_validation", "supervised_train_validation"),
    "shuffled_dpca_control": ("label_shuffle_control", "permuted_train_labels", "permuted_train_validation_labels"),
    "shuffled_decoder_control": ("label_shuffle_control", "permuted_train_validation_labels", "permuted_train_validation_labels"),
    "factorial_design_diagnostic": ("design_diagnostic", "train_labels", "design_diagnostic"),
}
#: Metric: target. Fixed values.
METRICS = {
    "stimulus_marginal_nmse": "stimulus_marginal_reconstruction",
    "decision_marginal_nmse": "decision_marginal_reconstruction",
    "stimulus_subspace_angle_degrees": "stimulus_marginal_subspace",
    "decision_subspace_angle_degrees": "decision_marginal_subspace",
    "stimulus_decoding_accuracy": "stimulus_label_decoding",
    "decision_decoding_accuracy": "decision_label_decoding",
    "factorial_design_rank": "factorial_design_identification",
}
SEED, REPLICATES, STEPS, CHANNELS = 20260820, 3, 12, 8
LAMBDAS = (1e-4, 0.01, 0.1, 1.0)
DIRECTIONS = [[1, 0.2, -0.4, 0.1, 0.5, -0.2, 0.3, 0.1], [-0.2, 0.9, 0.2, -0.4, 0.1, 0.5, -0.1, 0.3]]
SPLITS = ("train", "validation", "test")
PARTS = ("stimulus", "decision")
SCHEMA = (
    "task string, scenario string, scenario_class string, replicate int, seed_id string, provenance string, split string, evaluation_stage string, method string, method_family string, information_set string, parameter_source string, target string, metric string, "
    "status string, reason string, value double, train_cell_counts string, validation_cell_counts string, test_cell_counts string, n_train_total int, n_validation_total int, n_test_total int, selected_hyperparameter double, design_rank int, control_match_status string, control_proposal int"
)
NAMES = [c.split()[0] for c in SCHEMA.split(", ")]


def code(text: str) -> int:
    return int.from_bytes(hashlib.sha256(text.encode()).digest()[:4], "little")


def stream(task: str, scenario: str, replicate: int, stage: int, split: int, index: int = 0) -> np.random.Generator:
    """``split``: 1 to 3, and 4 for diagnostics."""
    return np.random.Generator(np.random.PCG64(np.random.SeedSequence((SEED, code(task), code(scenario), replicate, stage, split, index))))


def seed_id(task: str, scenario: str, replicate: int) -> str:
    return f"pcg64:{SEED}:{code(task)}:{code(scenario)}:{replicate}"


def shift_steps(x: np.ndarray, by: int) -> np.ndarray:
    """Along the first axis, the edge repeated."""
    return x[np.clip(np.arange(len(x)) - by, 0, len(x) - 1)]


def cell_counts(scenario: str, split: int) -> np.ndarray:
    _, sizes, kind = SCENARIOS[scenario]
    n = sizes[split]
    if split == 0 and kind == "missing":
        return np.array([[n, n], [n, 0]])
    if split == 0 and kind == "unbalanced":
        return np.array([[2 * n, max(2, n // 4)], [max(2, n // 3), n]])
    return np.full((2, 2), n)


def truth(scenario: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(time course, direction and course of each factor): steps x channels, channels x 2, steps x 2."""
    raw = np.array(DIRECTIONS, float).T
    unit = lambda v: v / np.linalg.norm(v)
    if SCENARIOS[scenario][2] == "collinear":
        axes = np.column_stack([unit(raw[:, 0]), unit(unit(raw[:, 0] + 0.12 * raw[:, 1]))])
    else:
        axes = np.linalg.qr(raw)[0]
    t = np.linspace(-1, 1, STEPS)
    time = 0.35 * np.sin(np.pi * (t + 1))[:, None] * unit(np.arange(1.0, CHANNELS + 1))
    return time, axes, np.column_stack([0.9 * np.exp(-(((t + 0.2) / 0.42) ** 2)), 0.75 * np.tanh(2.2 * t)])


def draw(scenario: str, replicate: int, split: int) -> tuple[np.ndarray, np.ndarray]:
    """(trials, labels of two columns) of a split, counted from 0."""
    kind, (time, axes, course) = SCENARIOS[scenario][2], truth(scenario)
    at = lambda stage, index: stream("demix", scenario, replicate, stage, split + 1, index)
    x, labels = [], []
    for s, d in np.ndindex(2, 2):
        signal = time + (2 * s - 1) * np.outer(course[:, 0], axes[:, 0]) + (2 * d - 1) * np.outer(course[:, 1], axes[:, 1])
        for j in range(cell_counts(scenario, split)[s, d]):
            own = shift_steps(signal, int(at(9, j + 20 * s + 10 * d).choice((-1, 0, 1)))) if kind == "shift" else signal
            x.append(own + at(10, j + 100 * s + 10 * d).normal(scale=0.42, size=signal.shape))
            labels.append((s, d))
    x, labels = np.array(x), np.array(labels)
    if kind == "pseudo":  # a channel's trials change places within their cell
        whole = x.copy()
        for s, d in np.ndindex(2, 2):
            own = np.flatnonzero((labels == (s, d)).all(1))
            for p in range(CHANNELS):
                x[own, :, p] = whole[own[at(11, 100 * s + 10 * d + p).permutation(len(own))], :, p]
    return x, labels


def cell_means(x: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """2 x 2 x steps x channels; an empty cell has the mean of all trials."""
    out = np.empty((2, 2, STEPS, CHANNELS))
    for s, d in np.ndindex(2, 2):
        own = (labels == (s, d)).all(1)
        out[s, d] = x[own].mean(0) if own.any() else x.mean(0)
    return out


def marginals(means: np.ndarray) -> dict[str, np.ndarray]:
    """Rows of each factor's marginal, as many as of the means."""
    grand = means.mean((0, 1))
    parts = {"stimulus": means.mean(1, keepdims=True) - grand, "decision": means.mean(0, keepdims=True) - grand}
    return {k: np.broadcast_to(v, means.shape).reshape(-1, CHANNELS) for k, v in parts.items()}


def leading(rows: np.ndarray, k: int) -> np.ndarray:
    return np.linalg.svd(rows - rows.mean(0), full_matrices=False)[2][:k].T


def rank_one_map(x: np.ndarray, target: np.ndarray, lam: float) -> np.ndarray:
    """The ridge map, seen through the leading direction of what it fits."""
    full = np.linalg.solve(x.T @ x + lam * np.eye(x.shape[1]), x.T @ target)
    v = np.linalg.svd(x @ full, full_matrices=False)[2][:1]
    return full @ v.T @ v


def thirds(x: np.ndarray) -> np.ndarray:
    """An intercept, and the channels' means over thirds of the steps."""
    return np.column_stack([np.ones(len(x)), *(x[:, own].mean(1) for own in np.array_split(np.arange(STEPS), 3))])


def choose(train: tuple, validation: tuple) -> dict:
    """Maps by validation error over both marginals, decoders by validation mistakes; then the smaller penalty."""
    (x, y), (vx, vy) = train, validation
    means, vmeans = cell_means(x, y), cell_means(vx, vy)
    parts, vparts = marginals(means), marginals(vmeans)
    rows, vrows = means.reshape(-1, CHANNELS), vmeans.reshape(-1, CHANNELS)
    maps = {lam: {k: rank_one_map(rows, v, lam) for k, v in parts.items()} for lam in LAMBDAS}
    lam = min(LAMBDAS, key=lambda a: (sum(((vrows @ maps[a][k] - vparts[k]) ** 2).mean() for k in PARTS), a))
    f, vf = thirds(x), thirds(vx)
    decoders, penalties = {}, {}
    for c, name in enumerate(PARTS):
        fits = {a: np.linalg.solve(f.T @ f + a * np.eye(f.shape[1]), f.T @ (2 * y[:, c] - 1)) for a in LAMBDAS}
        penalties[name] = min(LAMBDAS, key=lambda a: (((vf @ fits[a] >= 0) != vy[:, c]).mean(), a))
        decoders[name] = fits[penalties[name]]
    return {"parts": parts, "rows": rows, "maps": maps[lam], "lam": lam, "decoders": decoders, "penalties": penalties}


def applies(method: str, metric: str) -> bool:
    if metric == "factorial_design_rank":
        return method == "factorial_design_diagnostic"
    if metric.endswith("accuracy"):
        return method in ("ridge_decoder", "shuffled_decoder_control")
    return method in ("pca", "marginal_pca", "selected_dpca", "shuffled_dpca_control", *(("condition_mean",) if metric.endswith("nmse") else ()))


def evaluate(scenario: str, replicate: int) -> pd.DataFrame:
    name, _, kind = SCENARIOS[scenario]
    (x, y), (vx, vy), (tx, ty) = (draw(scenario, replicate, k) for k in range(3))
    order = lambda n, stage: stream("demix", scenario, replicate, stage, 4).permutation(n)
    own = choose((x, y[order(len(y), 31)] if kind == "shuffle" else y), (vx, vy))
    null = choose((x, y[order(len(y), 32)]), (vx, vy[order(len(vy), 33)]))
    signs = 2 * y - 1
    rank = int(np.linalg.matrix_rank(np.column_stack([np.ones(len(y)), signs, signs.prod(1)])))
    means = cell_means(tx, ty)
    target, rows, f, axes = marginals(means), means.reshape(-1, CHANNELS), thirds(tx), truth(scenario)[1]
    plane = leading(own["rows"], 2)

    def made(method: str, part: str) -> np.ndarray:
        if method == "condition_mean":
            return own["parts"][part]
        if method in ("selected_dpca", "shuffled_dpca_control"):
            return rows @ (own if method == "selected_dpca" else null)["maps"][part]
        b = plane if method == "pca" else leading(own["parts"][part], 1)
        return target[part] @ b @ b.T

    def score(method: str, metric: str) -> float:
        if metric == "factorial_design_rank":
            return float(rank)
        part = metric.split("_")[0]
        if metric.endswith("accuracy"):
            w = (own if method == "ridge_decoder" else null)["decoders"][part]
            return float(((f @ w >= 0) == ty[:, PARTS.index(part)]).mean())
        rebuilt = made(method, part)
        if metric.endswith("nmse"):
            return float(((rebuilt - target[part]) ** 2).mean() / max((target[part] ** 2).mean(), 1e-12))
        return plane_error(leading(rebuilt, 1), axes[:, [PARTS.index(part)]])["max_angle"]

    counts = [cell_counts(scenario, k) for k in range(3)]
    about = (*(json.dumps(c.tolist(), separators=(",", ":")) for c in counts), *(int(c.sum()) for c in counts))
    out = []
    for method, (family, source, information) in METHODS.items():
        for metric, goal in METRICS.items():
            part = metric.split("_")[0]
            value, status, reason = None, "inapplicable", "method_metric_inapplicable"
            if applies(method, metric):
                if rank < 4 and not metric.endswith(("accuracy", "rank")):
                    status, reason = "invalid", f"incomplete_factorial_design_rank_{rank}_of_4"
                else:
                    value, status, reason = score(method, metric), "ok", None
                    if not np.isfinite(value):
                        value, status, reason = None, "invalid", "ValueError:nonfinite_score"
            where = ("training_design", "design_diagnostic", "identification_diagnostic") if metric.endswith("rank") else ("heldout_test", "test", "heldout_scoring")
            chosen = {"selected_dpca": own["lam"], "shuffled_dpca_control": null["lam"], "ridge_decoder": own["penalties"].get(part, own["penalties"]["decision"]), "shuffled_decoder_control": null["penalties"].get(part, null["penalties"]["decision"])}.get(method)
            out.append(("demixing", scenario, name, replicate, seed_id("demixing", scenario, replicate), *where, method, family, information, source, goal, metric, status, reason, value, *about, chosen, rank, None, None))
    return pd.DataFrame(out, columns=NAMES).astype({"control_proposal": "Int32"})


def keyed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("row_key", F.concat_ws("|", "task", "scenario", F.col("replicate").cast("string"), "method", "metric"))


def demixing_results(spark, sf_dir=None) -> DataFrame:
    seeds = prepare(spark).createDataFrame([(s, k) for s in SCENARIOS for k in range(REPLICATES)], "scenario string, replicate int")
    return keyed(seeds.repartition(len(SCENARIOS) * REPLICATES).groupBy("scenario", "replicate").applyInPandas(lambda pdf: evaluate(pdf["scenario"].iloc[0], int(pdf["replicate"].iloc[0])), SCHEMA))


def demixing_summary(spark, sf_dir=None) -> DataFrame:
    """q10, median, q90 over ok rows and rates over all rows by scenario, method, metric."""
    return summarised(demixing_results(spark, sf_dir), ["scenario", "method", "metric"])


QUERIES = {f.__name__: f for f in (demixing_results, demixing_summary)}
ORACLES: dict[str, str] = {}
