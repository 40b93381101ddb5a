"""Condition paths in few dimensions over ``events``: fitted on one half of the users, applied to the other.

A state is ``DIMS`` values of a user's sequence that follow each other. Paths are a condition's means over users at the steps of a
window, smoothed over three steps (ends as they are). The fit is the training paths' mean over conditions at each step, their
centre after that, and the leading directions of what is left, from sums of products; the test users' paths are taken
through the same fit, and give it nothing.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenframe.operators.dynamics import CONDITIONS
from lumenframe.operators.moments import product_sums
from lumenframe.operators.sequence import STANDARD, standard

DIMS, KEPT, WINDOW = 6, 3, 40
_X = [f"x{k}" for k in range(DIMS)]


def smooth_paths(spark, sf_dir) -> DataFrame:
    """half (0 trains), condition, t, x0, ...: smoothed means over users."""
    by_time = W.partitionBy("user_id").orderBy("t")
    x = standard(spark, sf_dir).select("user_id", "t", *((F.lead("x", k).over(by_time) if k else F.col("x")).alias(c) for k, c in enumerate(_X)))
    kept = x.where((F.col("t") < WINDOW) & F.col(_X[-1]).isNotNull() & F.col("user_id").isNotNull())
    half, condition = (F.floor(F.col("user_id") / CONDITIONS) % 2).cast("long"), F.col("user_id") % CONDITIONS
    means = kept.groupBy(half.alias("half"), condition.alias("condition"), "t").agg(*(F.avg(c).alias(c) for c in _X))
    w = W.partitionBy("half", "condition").orderBy("t")  # WINDOW rows
    return means.select("half", "condition", "t", *(F.coalesce((F.lag(c).over(w) + F.col(c) + F.lead(c).over(w)) / 3, F.col(c)).alias(c) for c in _X))


def centred_paths(spark, sf_dir) -> DataFrame:
    """``smooth_paths`` less the training paths' mean at each step and their centre. Steps that no training path has are left out."""
    paths = smooth_paths(spark, sf_dir)
    at = paths.where("half = 0").groupBy("t").agg(*(F.avg(c).alias(f"at_{c}") for c in _X))  # WINDOW rows
    left = paths.join(F.broadcast(at), "t").select("half", "condition", "t", *((F.col(c) - F.col(f"at_{c}")).alias(c) for c in _X))
    centre = left.where("half = 0").agg(*(F.avg(c).alias(f"c_{c}") for c in _X))  # one row
    return left.crossJoin(F.broadcast(centre)).select("half", "condition", "t", *((F.col(c) - F.col(f"c_{c}")).alias(c) for c in _X))


def path_values(spark, sf_dir):
    """The centred paths by entry, of both halves."""
    rows = centred_paths(spark, sf_dir).select("half", "condition", "t", F.posexplode(F.array(*_X)).alias("i", "v"))
    return rows.select("half", "condition", "t", F.col("i").cast("long").alias("i"), F.round(F.col("v") + 1e-11, 6).alias("v"))


def _basis(paths: DataFrame) -> DataFrame:
    """axis, share, b: the training paths' leading directions, the largest entry positive, and their share of the energy."""

    def solve(pdf):
        m = np.zeros((DIMS, DIMS))
        m[pdf["i"], pdf["j"]] = pdf["p"]
        values, turn = np.linalg.eigh(m + np.triu(m, 1).T)
        lead = turn[:, ::-1][:, :KEPT].T
        lead = lead * np.where(lead[np.arange(KEPT), np.abs(lead).argmax(1)] >= 0, 1.0, -1.0)[:, None]
        return pd.DataFrame({"axis": np.arange(KEPT), "share": values[::-1][:KEPT] / max(values.sum(), 1e-15), "b": list(lead)})

    sums = product_sums(paths.where("half = 0").select("half", F.array(*_X).alias("v")), "v", ["half"])  # DIMS (DIMS + 1) / 2 rows
    return sums.groupBy("half").applyInPandas(solve, "axis long, share double, b array<double>")


def path_axes(spark, sf_dir):
    """The axes' entries, and each axis's share of the training paths' energy."""
    rows = _basis(centred_paths(spark, sf_dir)).select("axis", "share", F.posexplode("b").alias("i", "w"))
    return rows.select("axis", F.col("i").cast("long").alias("i"), F.round("w", 6).alias("w"), F.round("share", 6).alias("share"))


def path_scores(spark, sf_dir):
    """Paths of test users on the training paths' axes: a score an axis for every condition and step."""
    paths = centred_paths(spark, sf_dir)
    scored = paths.where("half = 1").crossJoin(F.broadcast(_basis(paths)))  # KEPT rows
    return scored.select("condition", "t", "axis", F.round(sum((F.col(c) * F.col("b")[k] for k, c in enumerate(_X)), F.lit(0.0)), 6).alias("score"))


QUERIES = {f.__name__: f for f in (path_values, path_axes, path_scores)}

_LEADS = ", ".join(f"lead(x, {k}) OVER o AS x{k}" for k in range(1, DIMS))
_EACH = lambda e: ", ".join(e.replace("#", c) for c in _X)

ORACLES = {
    "path_values": f"WITH {STANDARD}, w AS (SELECT user_id, t, x AS x0, {_LEADS} FROM z WINDOW o AS (PARTITION BY user_id ORDER BY t)), m AS (SELECT user_id // {CONDITIONS} % 2 AS half, user_id % {CONDITIONS} AS condition, t, {_EACH('avg(#) AS #')} FROM w WHERE t < {WINDOW} AND {_X[-1]} IS NOT NULL AND user_id IS NOT NULL GROUP BY ALL), s AS (SELECT half, condition, t, {_EACH('coalesce((lag(#) OVER o + # + lead(#) OVER o) / 3, #) AS #')} FROM m WINDOW o AS (PARTITION BY half, condition ORDER BY t)), a AS (SELECT t, {_EACH('avg(#) AS a#')} FROM s WHERE half = 0 GROUP BY t), l AS (SELECT half, condition, t, {_EACH('# - a# AS #')} FROM s JOIN a USING (t)), c AS (SELECT {_EACH('avg(#) AS c#')} FROM l WHERE half = 0), r AS (SELECT half, condition, t, {_EACH('# - c# AS #')} FROM l, c), u AS (UNPIVOT r ON COLUMNS('^x[0-9]') INTO NAME i VALUE v) SELECT half, condition, t, substr(i, 2)::BIGINT AS i, round(v + 1e-11, 6) AS v FROM u",
}
