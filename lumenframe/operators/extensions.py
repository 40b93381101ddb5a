"""Extensions to new points, null distributions and controls, over the same tables and simulated inputs."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenframe.operators.fitted import constrained_map, ridge_decoder
from lumenframe.operators.graph import EPSILON, classical_scaling, dense, knn_edges, shortest_paths, small_labels
from lumenframe.operators.moments import FA_FLOORS, covariance, eigen, expected_nll, factor_analysis, vectors
from lumenframe.sources import generators as g


def _square(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T, 0)


def diffusion_model(x: np.ndarray, epsilon: float = EPSILON) -> dict:
    """Density-normalised operator with its eigenpairs, largest first; functions have unit weight under pi."""
    w = np.exp(-_square(x, x) / epsilon)
    density = w.sum(1)
    k = w / np.outer(density, density)
    degree = k.sum(1)
    values, basis = eigen(k / np.sqrt(np.outer(degree, degree)))
    return {"x": x, "density": density, "p": k / degree[:, None], "pi": degree / degree.sum(), "values": values, "psi": basis * np.sqrt(degree.sum() / degree)[:, None]}


def extend(model: dict, new: np.ndarray, epsilon: float = EPSILON) -> np.ndarray:
    """Eigenfunctions at new points: the transition row of each times the functions, over the eigenvalue."""
    w = np.exp(-_square(new, model["x"]) / epsilon)
    k = w / np.outer(w.sum(1), model["density"])
    values = np.where(np.abs(model["values"]) > 1e-14, model["values"], 1.0)
    return (k / k.sum(1, keepdims=True)) @ model["psi"] / values


def diffusion_distances(spark, sf_dir):
    """Spectral and direct diffusion distances agree; error of keeping two modes. All pairs of a label at once: larger labels are ``inapplicable``."""

    def fit(pdf):
        m = diffusion_model(np.stack(pdf.sort_values("vec_id")["x"].to_numpy()))
        z = m["psi"][:, 1:] * m["values"][1:]
        pairs = np.triu_indices(len(z), 1)
        spectral, direct, short = (np.sqrt(_square(v, v))[pairs] for v in (z, m["p"] / np.sqrt(m["pi"]), z[:, :2]))
        return pd.DataFrame([(int(pdf["label"].iloc[0]), round(float(np.abs(spectral - direct).max()), 6), round(float(np.sqrt(((short - spectral) ** 2).mean() / (spectral**2).mean())), 6))], columns=["label", "max_gap", "truncation"])

    made = dense(vectors(spark, sf_dir), spark, sf_dir).groupBy("label").applyInPandas(fit, "label int, max_gap double, truncation double")
    refused = small_labels(spark, sf_dir)[1].select("label", *(F.lit(None).cast("double") for _ in range(2)), F.lit("inapplicable"))
    return made.withColumn("status", F.lit("ok")).union(refused)


def gower(d2: np.ndarray, coordinates: np.ndarray, new: np.ndarray) -> np.ndarray:
    """Points at squared distances ``new`` (rows) from scaled ones whose squared distances are ``d2``."""
    scale = (coordinates**2).sum(0)
    return 0.5 * (d2.mean(0) - new) @ coordinates / np.where(scale > 1e-12, scale, 1.0)


def isomap_extend(spark, sf_dir):
    """Each vector of a connected graph placed from its path lengths alone lands where scaling put it."""

    def fit(pdf):
        ids = np.unique(np.concatenate([pdf["src"], pdf["dst"]]))
        d = shortest_paths(len(ids), np.searchsorted(ids, pdf["src"]), np.searchsorted(ids, pdf["dst"]), pdf["w"].to_numpy())
        label = int(pdf["label"].iloc[0])
        if not np.isfinite(d).all():
            return pd.DataFrame([(label, len(ids), None, "inapplicable")], columns=["label", "n", "max_gap", "status"])
        x, _ = classical_scaling(d)
        return pd.DataFrame([(label, len(ids), round(float(np.abs(gower(d**2, x, d**2) - x).max()), 9), "ok")], columns=["label", "n", "max_gap", "status"])

    made = dense(knn_edges(spark, sf_dir), spark, sf_dir).groupBy("label").applyInPandas(fit, "label int, n int, max_gap double, status string")
    return made.union(small_labels(spark, sf_dir)[1].select("label", F.col("n").cast("int"), F.lit(None).cast("double"), F.lit("inapplicable")))


def label_shuffle_null(spark, sf_dir, shuffles: int = 32):
    """Decoder accuracy on simulated trials against shuffled labels: one task a shuffle, 0 is unshuffled."""
    trials = g.factorial_trials(g.units(spark, 1, 1, 40)).groupBy("unit", "stimulus").agg(F.array_sort(F.collect_list(F.struct("t", "p", "x"))).alias("s"))
    flat = trials.select("unit", "stimulus", F.transform("s", lambda v: v["x"]).alias("x"), F.explode(F.sequence(F.lit(0), F.lit(shuffles))).alias("shuffle"))

    def fit(pdf):
        pdf = pdf.sort_values("unit")
        k = int(pdf["shuffle"].iloc[0])
        x, y = np.stack(pdf["x"].to_numpy()), pdf["stimulus"].to_numpy(float)
        train = np.arange(len(x)) // 4 % 4 < 3
        if k:
            order = g.stream(44, k)
            y = np.where(train, order.permutation(y[train])[np.cumsum(train) - 1], y)
        w, c = ridge_decoder(x[train], y[train], 0.1)
        return pd.DataFrame([(k, round(float((np.where(x[~train] @ w + c >= 0, 1, -1) == y[~train]).mean()), 6))], columns=["shuffle", "accuracy"])

    one = flat.groupBy("shuffle").applyInPandas(fit, "shuffle int, accuracy double")
    real = F.max(F.when(F.col("shuffle") == 0, F.col("accuracy")))
    null = F.when(F.col("shuffle") > 0, F.col("accuracy"))
    q = one.agg(real.alias("accuracy"), F.percentile(null, F.array(F.lit(0.025), F.lit(0.5), F.lit(0.975))).alias("q"), F.collect_list(null).alias("null"))  # a value for each shuffle
    return q.select("accuracy", *(F.round(F.col("q")[k], 6).alias(n) for k, n in enumerate(("null_low", "null_median", "null_high"))), F.size(F.filter("null", lambda v: v >= F.col("accuracy"))).alias("exceeding"))


def covariance_shuffles(spark, sf_dir, shuffles: int = 24):
    """Negative control for turning: cyclic time shifts of each trajectory; likeness of covariance and the R2 of the skew map."""
    rows = g.limit_cycles(g.units(spark, 1, 1, 12)).groupBy("unit").agg(F.array_sort(F.collect_list(F.struct("t", "x", "y"))).alias("s"))
    tries = rows.select("unit", "s", F.explode(F.sequence(F.lit(0), F.lit(shuffles))).alias("shuffle"))

    def fit(pdf):
        k = int(pdf["shuffle"].iloc[0])
        paths = [np.array([[v["x"], v["y"]] for v in s]) for s in pdf.sort_values("unit")["s"]]
        rng = g.stream(54, k)
        moved = [np.stack([np.roll(p[:, c], rng.integers(1, len(p))) for c in range(2)], 1) if k else p for p in paths]
        x, dx = np.concatenate([(p[2:] + p[:-2]) / 2 for p in moved]), np.concatenate([(p[2:] - p[:-2]) / 0.1 for p in moved])
        a, b = np.cov(np.concatenate(paths).T, ddof=0), np.cov(np.concatenate(moved).T, ddof=0)
        m = constrained_map(x, dx, "skew")
        r2 = 1 - ((dx - x @ m.T) ** 2).sum() / ((dx - dx.mean(0)) ** 2).sum()
        return pd.DataFrame([(k, round(float(1 - ((a - b) ** 2).sum() / (a**2).sum()), 6), round(float(r2), 6))], columns=["shuffle", "similarity", "r2"])

    one = tries.groupBy("shuffle").applyInPandas(fit, "shuffle int, similarity double, r2 double")
    return one.withColumn("rank", F.when(F.col("shuffle") > 0, F.row_number().over(W.orderBy((F.col("shuffle") == 0).cast("int"), F.desc("similarity"), "shuffle"))))  # a row for each shuffle


def factor_restarts(spark, sf_dir, restarts: int = 3):
    """Factor analysis on even ids from two floors and three starts each, chosen by likelihood on odd ids, then by
    floor and start."""
    halves = covariance(vectors(spark, sf_dir).withColumn("half", (F.col("vec_id") % 2).cast("int")), "x", ["label", "half"])

    def fit(pdf):
        mats = {}
        for h, part in pdf.groupby("half"):
            p = int(part["i"].max()) + 1
            c = np.zeros((p, p))
            c[part["i"], part["j"]] = c[part["j"], part["i"]] = part["cov"]
            mats[int(h)] = c
        tried = []
        for floor in FA_FLOORS:
            for start in range(restarts):
                fa = factor_analysis(mats[0], floor=floor, restart=start)
                tried.append((expected_nll(mats[1], fa["loading"] @ fa["loading"].T + np.diag(fa["unique"])), floor, start, fa))
        nll, floor, start, fa = min(tried, key=lambda v: v[:3])
        return pd.DataFrame([(int(pdf["label"].iloc[0]), floor, start, round(float(fa["nll"]), 6), round(float(nll), 6), fa["rounds"], "ok" if fa["settled"] else "nonconvergence")], columns=["label", "floor", "restart", "train_nll", "validation_nll", "rounds", "status"])

    return halves.groupBy("label").applyInPandas(fit, "label int, floor double, restart int, train_nll double, validation_nll double, rounds int, status string")


QUERIES = {f.__name__: f for f in (diffusion_distances, isomap_extend, label_shuffle_null, covariance_shuffles, factor_restarts)}
ORACLES: dict[str, str] = {}
