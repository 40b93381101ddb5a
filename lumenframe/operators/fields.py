"""Polynomial vector fields of delayed states over ``events``: fits from sums of products, and rollouts in fourth-order steps.

A state is (x_t, x_t+1) of a user's standardised sequence; a pair of states gives its midpoint and difference quotient.
Sequences are cut into blocks of ``BLOCK`` steps, of which three in five train, one validates and one tests; pairs that
reach over a block's end are left out, so no split sees another's values. A condition is ``user_id`` modulo ``CONDITIONS``,
and has a field of its own. All splits' sums come from one pass; penalties are chosen from the validation split's sums.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenframe.operators.dynamics import CONDITIONS, pairs
from lumenframe.operators.fitted import monomials
from lumenframe.operators.moments import product_sums
from lumenframe.operators.sequence import STANDARD, standard

BLOCK, HORIZON = 8, 6
TERMS = ("1", "x", "y", "xx", "xy", "yy", "xxx", "xxy", "xyy", "yyy")
#: Terms that a model has.
MODELS = {"affine": 3, "cubic": 10}
LAMBDAS = (1e-4, 0.01, 1.0)
#: Steps of the rollout in one step of the sequence, and the radius at which it has failed.
SUBSTEPS, RADIUS = 4, 4.0


def split_of(t):
    """0 trains, 1 validates, 2 tests: by the block that a step is in."""
    k = F.floor(t / BLOCK) % 5
    return F.when(k < 3, 0).otherwise(k - 2).cast("long")


def field_pairs(spark, sf_dir) -> DataFrame:
    """condition, split, f: the ten monomials of a midpoint and its two difference quotients."""
    kept = pairs(spark, sf_dir).where((F.col("t") % BLOCK <= BLOCK - 3) & F.col("user_id").isNotNull())
    terms = [F.lit(1.0), *(F.expr(" * ".join({"x": "a", "y": "b"}[c] for c in m)) for m in TERMS[1:])]
    return kept.select("condition", split_of(F.col("t")).alias("split"), F.array(*terms, "da", "db").alias("f"))


def field_sums(spark, sf_dir):
    """The normal equations of every condition and split: sums of products of terms and targets."""
    sums = product_sums(field_pairs(spark, sf_dir), "f", ["condition", "split"])
    return sums.select("condition", "split", F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), F.round("p", 4).alias("s"))


def _matrix(own: pd.DataFrame, size: int) -> np.ndarray:
    m = np.zeros((size, size))
    m[own["i"], own["j"]] = own["p"]
    return m + np.triu(m, 1).T


def solve_field(gram: np.ndarray, terms: int, lam: float) -> np.ndarray:
    """Weights (terms x 2) from sums of products of ``TERMS`` and two targets: ridge on terms of unit variance, the
    constant not penalised; ``lam`` is a share of the rows. Terms that don't vary get no weight."""
    n, mean = gram[0, 0], gram[0, 1:terms] / gram[0, 0]
    cov = gram[1:terms, 1:terms] / n - np.outer(mean, mean)
    centre = gram[0, -2:] / n
    cross = gram[1:terms, -2:] / n - np.outer(mean, centre)
    sd = np.sqrt(np.maximum(np.diag(cov), 0))
    used = sd > 1e-12
    w = np.zeros((terms, 2))
    scale = sd[used]
    w[1:][used] = np.linalg.solve(cov[np.ix_(used, used)] / np.outer(scale, scale) + lam * np.eye(len(scale)), cross[used] / scale[:, None]) / scale[:, None]
    w[0] = centre - mean @ w[1:]
    return w


def field_error(gram: np.ndarray, w: np.ndarray) -> float:
    """Squared error over the targets' spread about their mean, from a split's sums; NaN without rows or spread."""
    k, n = len(w), gram[0, 0]
    if n == 0:
        return np.nan
    left = np.trace(gram[-2:, -2:]) - 2 * (w * gram[:k, -2:]).sum() + (w * (gram[:k, :k] @ w)).sum()
    spread = np.trace(gram[-2:, -2:]) - (gram[0, -2:] ** 2).sum() / n
    return float(left / spread) if spread > 1e-12 else np.nan


def fields(spark, sf_dir) -> DataFrame:
    """condition, model, lam, w (terms x 2, row by row), validation, test, chosen, status: every model at every penalty. The
    penalty with the smallest validation error is chosen, then the smallest. A condition without training pairs is ``inapplicable``."""
    size = len(TERMS) + 2

    def fit(pdf):
        grams = [_matrix(pdf[pdf["split"] == k], size) for k in range(3)]
        out = []
        for model, terms in MODELS.items():
            tried = []
            for lam in LAMBDAS:
                ok = grams[0][0, 0] > terms
                w = solve_field(grams[0], terms, lam) if ok else np.full((terms, 2), np.nan)
                tried.append((lam, w, field_error(grams[1], w), field_error(grams[2], w), ok))
            best = min(range(len(tried)), key=lambda k: (np.inf if np.isnan(tried[k][2]) else tried[k][2], tried[k][0]))
            plain = lambda v: None if np.isnan(v) else v
            for k, (lam, w, validation, test, ok) in enumerate(tried):
                out.append((int(pdf["condition"].iloc[0]), model, lam, w.ravel() if ok else None, plain(validation), plain(test), ok and k == best, "ok" if ok else "inapplicable"))
        return pd.DataFrame(out, columns=["condition", "model", "lam", "w", "validation", "test", "chosen", "status"])

    sums = product_sums(field_pairs(spark, sf_dir), "f", ["condition", "split"])  # a condition's are 3 x 78 rows
    return sums.groupBy("condition").applyInPandas(fit, "condition long, model string, lam double, w array<double>, validation double, test double, chosen boolean, status string")


def field_selection(spark, sf_dir):
    """Validation and test error of each model and penalty, and which is chosen."""
    return fields(spark, sf_dir).select("condition", "model", "lam", F.round("validation", 6).alias("validation"), F.round("test", 6).alias("test"), "chosen", "status")


def field_coefficients(spark, sf_dir):
    """The chosen fields' coefficients by term, for the change of both coordinates."""
    rows = fields(spark, sf_dir).where("chosen").select("condition", "model", F.posexplode(F.sequence(F.lit(0), (F.size("w") / 2 - 1).cast("int"))).alias("k", "__k"), "w")
    names = F.array(*(F.lit(t) for t in TERMS))
    return rows.select("condition", "model", names[F.col("k")].alias("term"), F.round(F.col("w")[F.col("k") * 2], 6).alias("d_x"), F.round(F.col("w")[F.col("k") * 2 + 1], 6).alias("d_y"))


def advance(w: np.ndarray, z: np.ndarray, substeps: int = SUBSTEPS, radius: float = RADIUS) -> np.ndarray:
    """States (rows) one step of the sequence on, in fourth-order steps; NaN from where a state leaves the radius."""
    h = 1.0 / substeps
    field = lambda v: monomials(v[:, 0], v[:, 1])[:, : len(w)] @ w
    with np.errstate(all="ignore"):
        for _ in range(substeps):
            a = field(z)
            b = field(z + h / 2 * a)
            c = field(z + h / 2 * b)
            z = z + h / 6 * (a + 2 * b + 2 * c + field(z + h * c))
            z = np.where(np.linalg.norm(z, axis=1, keepdims=True) <= radius, z, np.nan)
    return z


def field_rollouts(spark, sf_dir):
    """Every state of the test blocks rolled out by the chosen fields, up to HORIZON steps and its block's end: by
    condition, model and step the rollouts that had a state to compare with, those that had failed by then (left the
    radius), the error of the others, and that of staying at the start."""
    by_time = W.partitionBy("user_id").orderBy("t")
    x = standard(spark, sf_dir).select("user_id", "t", F.array("x", *(F.when(F.col("t") % BLOCK + k < BLOCK, F.lead("x", k).over(by_time)) for k in range(1, HORIZON + 2))).alias("x"))
    starts = x.where((split_of(F.col("t")) == 2) & F.col("x")[2].isNotNull() & F.col("user_id").isNotNull()).select((F.col("user_id") % CONDITIONS).alias("condition"), "x")
    chosen = fields(spark, sf_dir).where("chosen").select("condition", "model", "w")  # CONDITIONS x models rows

    def run(frames):
        for pdf in frames:
            for (condition, model), own in pdf.groupby(["condition", "model"], sort=False):
                x = np.stack(own["x"].to_numpy()).astype(float)
                w = np.asarray(own["w"].iloc[0], float).reshape(-1, 2)
                z = start = x[:, :2]
                out = []
                for h in range(1, HORIZON + 1):
                    z = advance(w, z)
                    truth = x[:, h : h + 2]
                    seen = ~np.isnan(truth).any(1)
                    there = seen & ~np.isnan(z).any(1)
                    out.append((condition, model, h, int(seen.sum()), int((seen & ~there).sum()), float(((z - truth)[there] ** 2).sum()), float(((start - truth)[seen] ** 2).sum())))
                yield pd.DataFrame(out, columns=["condition", "model", "step", "n", "failed", "se", "stay"])

    parts = starts.join(F.broadcast(chosen), "condition").mapInPandas(run, "condition long, model string, step long, n long, failed long, se double, stay double")
    sums = parts.groupBy("condition", "model", "step").agg(*(F.sum(c).alias(c) for c in ("n", "failed", "se", "stay"))).where("n > 0")
    rmse = F.when(F.col("n") > F.col("failed"), F.sqrt(F.col("se") / (2 * (F.col("n") - F.col("failed")))))
    return sums.select("condition", "model", "step", "n", "failed", F.round(rmse, 6).alias("rmse"), F.round(F.sqrt(F.col("stay") / (2 * F.col("n"))), 6).alias("stay_rmse"))


QUERIES = {f.__name__: f for f in (field_sums, field_selection, field_coefficients, field_rollouts)}

_F = [*("1.0" if m == "1" else " * ".join({"x": "a", "y": "b"}[c] for c in m) for m in TERMS), "da", "db"]
_SUMS = ", ".join(f"sum(({_F[i]}) * ({_F[j]})) AS s_{i}_{j}" for i in range(len(_F)) for j in range(i, len(_F)))

ORACLES = {
    "field_sums": f"WITH {STANDARD}, w AS (SELECT user_id, t, x, lead(x) OVER o AS y, lead(x, 2) OVER o AS z FROM z WINDOW o AS (PARTITION BY user_id ORDER BY t)), p AS (SELECT user_id % {CONDITIONS} AS condition, CASE WHEN t // {BLOCK} % 5 < 3 THEN 0 ELSE t // {BLOCK} % 5 - 2 END AS split, (x + y) / 2 AS a, (y + z) / 2 AS b, y - x AS da, z - y AS db FROM w WHERE z IS NOT NULL AND user_id IS NOT NULL AND t % {BLOCK} <= {BLOCK - 3}), s AS (SELECT condition, split, {_SUMS} FROM p GROUP BY condition, split), u AS (UNPIVOT s ON COLUMNS('s_') INTO NAME k VALUE v) SELECT condition, split, split_part(k, '_', 2)::BIGINT AS i, split_part(k, '_', 3)::BIGINT AS j, round(v, 4) AS s FROM u",
}
