"""Planar dynamics of sequences: preprocessing, constrained linear maps in closed form, plane metrics and controls.

The state at a step is (x, y) with y the value that follows; a pair of states gives its midpoint and difference
quotient. A condition is ``user_id`` modulo ``CONDITIONS``.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenframe.operators.linear import PLANAR, planar
from lumenframe.operators.sequence import STANDARD, let_wrapped, standard
from lumenframe.session import checkpoint

CONDITIONS, SHIFTS, ALIKE = 5, 24, 0.95
PERPENDICULAR = math.sin(math.radians(15))


def pairs(spark, sf_dir) -> DataFrame:
    """user_id, condition, t, (a, b) the midpoint, (da, db) the difference quotient of a state and the next."""
    half = lambda u, v: (F.col(u) + F.col(v)) / 2
    return planar(spark, sf_dir).select("user_id", (F.col("user_id") % CONDITIONS).alias("condition"), "t", half("x", "y").alias("a"), half("y", "z").alias("b"), (F.col("y") - F.col("x")).alias("da"), (F.col("z") - F.col("y")).alias("db"))


def preprocess(spark, sf_dir):
    """Condition means over time, smoothed over three steps (edges as they are), less the mean over conditions at
    each time, less each condition's centre."""
    m = standard(spark, sf_dir).groupBy((F.col("user_id") % CONDITIONS).alias("condition"), "t").agg(F.avg("x").alias("m"))
    w = W.partitionBy("condition").orderBy("t")
    smooth = m.select("condition", "t", F.coalesce((F.lag("m").over(w) + F.col("m") + F.lead("m").over(w)) / 3, F.col("m")).alias("m"))
    at = smooth.groupBy("t").agg(F.avg("m").alias("over"))
    left = smooth.join(at, "t").withColumn("m", F.col("m") - F.col("over"))
    centre = left.groupBy("condition").agg(F.avg("m").alias("centre"))
    return left.join(F.broadcast(centre), "condition").select("condition", "t", F.round(F.col("m") - F.col("centre") + 1e-11, 7).alias("value"))  # a row for each condition


def _sums(p: DataFrame, *key: str) -> DataFrame:
    s = lambda u, v: F.sum(F.col(u) * F.col(v))
    return p.groupBy(*key).agg(
        s("a", "a").alias("aa"), s("a", "b").alias("ab"), s("b", "b").alias("bb"), s("a", "da").alias("ada"), s("b", "da").alias("bda"), s("a", "db").alias("adb"), s("b", "db").alias("bdb"),
        s("da", "da").alias("dada"), s("db", "db").alias("dbdb"), F.sum("da").alias("da"), F.sum("db").alias("db"), F.count("*").alias("n"),
    )


#: Least squares of the differences on the midpoints, in the sums of ``_sums``. Entries of the free map, the rate of the
#: skew map, and what each leaves.
_DET = "(aa * bb - ab * ab)"
_FREE = {"m11": f"(bb * ada - ab * bda) / {_DET}", "m12": f"(aa * bda - ab * ada) / {_DET}", "m21": f"(bb * adb - ab * bdb) / {_DET}", "m22": f"(aa * bdb - ab * adb) / {_DET}"}
_SKEW = "(bda - adb) / (aa + bb)"
_TOTAL = "(dada - da * da / n + dbdb - db * db / n)"


def skew_map(spark, sf_dir):
    """Two estimators of a turning rate by user: least squares over skew maps, and the skew part of the free map;
    the share of the differences' variance that the free and the skew map explain."""
    m = _sums(pairs(spark, sf_dir), "user_id").withColumns({k: F.expr(e) for k, e in _FREE.items()}).withColumn("w", F.expr(_SKEW))
    free = F.expr(f"1 - (dada + dbdb - m11 * ada - m12 * bda - m21 * adb - m22 * bdb) / greatest({_TOTAL}, 1e-15D)")
    skew = F.expr(f"1 - (dada + dbdb - w * (bda - adb)) / greatest({_TOTAL}, 1e-15D)")
    return m.select("user_id", F.round("w", 6).alias("constrained"), F.round(F.expr("(m12 - m21) / 2"), 6).alias("skew_part"), F.round(free, 6).alias("free_r2"), F.round(skew, 6).alias("skew_r2"))


def plane_metrics(spark, sf_dir):
    """Tangential and radial energy, the share of steps within 15 degrees of perpendicular, span and signed rate."""
    w, run = W.partitionBy("user_id").orderBy("t"), W.partitionBy("user_id").orderBy("t").rowsBetween(W.unboundedPreceding, 0)
    r2, dot, cross = F.expr("a * a + b * b"), F.expr("a * da + b * db"), F.expr("a * db - b * da")
    p = pairs(spark, sf_dir).withColumns({"r2": r2, "dot": dot, "cross": cross, "speed": F.expr("sqrt(da * da + db * db)"), "angle": F.atan2("b", "a")}).where("r2 > 1e-16")
    turned = p.withColumn("step", F.coalesce(let_wrapped(F.col("angle") - F.lag("angle").over(w)), F.lit(0.0))).withColumn("unwrapped", F.sum("step").over(run))
    radial = F.pow("dot", 2) / F.col("r2")
    across = (F.abs("dot") / (F.sqrt("r2") * F.col("speed") + 1e-15) <= PERPENDICULAR).cast("double")
    return turned.groupBy("user_id").agg(
        F.round(F.avg(F.pow("cross", 2) / F.col("r2")), 6).alias("tangential"), F.round(F.avg(radial), 6).alias("radial"), F.round(F.avg(across), 6).alias("perpendicular"),
        F.round(F.max("unwrapped") - F.min("unwrapped"), 5).alias("span"), F.round(F.avg(F.col("cross") / F.col("r2")), 5).alias("rate"),
    )


def tangential_ratio(spark, sf_dir):
    """Share of the velocity's energy that is across the radius, by condition."""
    p = pairs(spark, sf_dir).where("a * a + b * b > 1e-16")
    return p.groupBy("condition").agg(F.round(F.sum(F.expr("pow(a * db - b * da, 2) / (a * a + b * b)")) / F.greatest(F.sum(F.expr("da * da + db * db")), F.lit(1e-15)), 6).alias("ratio"))


def leave_one_out(spark, sf_dir):
    """The turning rate without each condition, and how far it moves."""
    s = _sums(pairs(spark, sf_dir), "condition").select("condition", F.expr("bda - adb").alias("num"), F.expr("aa + bb").alias("den"))
    whole = s.agg(F.sum("num").alias("all_num"), F.sum("den").alias("all_den"))
    rate, all_rate = F.expr("(all_num - num) / (all_den - den)"), F.expr("all_num / all_den")
    return s.crossJoin(F.broadcast(whole)).select("condition", F.round(rate, 7).alias("rate"), F.round(F.abs(rate - all_rate), 7).alias("change"))  # one row


def permuted_derivatives(spark, sf_dir):
    """Control: each user's difference quotients in the order of a digest of their place; what the free map explains."""
    p = pairs(spark, sf_dir)
    own = W.partitionBy("user_id")  # a sequence
    moved = p.select("user_id", F.row_number().over(own.orderBy(F.md5(F.concat_ws(":", "user_id", "t")))).alias("k"), "da", "db")
    kept = p.select("user_id", F.row_number().over(own.orderBy("t")).alias("k"), "a", "b")
    m = _sums(kept.join(moved, ["user_id", "k"]), "user_id").withColumns({k: F.expr(e) for k, e in _FREE.items()})
    return m.select("user_id", F.round(F.expr(f"1 - (dada + dbdb - m11 * ada - m12 * bda - m21 * adb - m22 * bdb) / greatest({_TOTAL}, 1e-15D)"), 6).alias("free_r2"))


def shifted_covariance(spark, sf_dir):
    """Control: the second coordinate moved round its sequence by up to SHIFTS steps. Likeness of the states'
    covariance to the real one (less is a worse match), ranked; whether it is a match."""
    p = planar(spark, sf_dir).select("user_id", "t", "x", "y")
    n = p.groupBy("user_id").agg(F.count("*").alias("n"))
    tries = p.join(n, "user_id").select("user_id", "x", "t", "n", F.explode(F.sequence(F.lit(0), F.lit(SHIFTS))).alias("shift"))
    moved = tries.select("user_id", "x", "shift", ((F.col("t") + F.col("shift")) % F.col("n")).alias("t")).join(p.select("user_id", "t", "y"), ["user_id", "t"])
    cov = checkpoint(moved.groupBy("shift").agg(F.covar_samp("x", "x").alias("xx"), F.covar_samp("x", "y").alias("xy"), F.covar_samp("y", "y").alias("yy")))
    real = cov.where("shift = 0").select(F.col("xx").alias("axx"), F.col("xy").alias("axy"), F.col("yy").alias("ayy"))
    gap = F.expr("(pow(xx - axx, 2) + 2 * pow(xy - axy, 2) + pow(yy - ayy, 2)) / greatest(pow(axx, 2) + 2 * pow(axy, 2) + pow(ayy, 2), 1e-15D)")
    scored = cov.where("shift > 0").crossJoin(F.broadcast(real)).select(F.col("shift").cast("bigint").alias("shift"), F.round(1 - gap, 7).alias("similarity"))  # one row
    return scored.select("shift", "similarity", F.row_number().over(W.orderBy(F.desc("similarity"), "shift")).cast("bigint").alias("rank"), (F.col("similarity") >= ALIKE).alias("matched"))  # a row for each shift


# Planes in more dimensions


def skew_planes(m: np.ndarray, count: int = 2) -> list[dict]:
    """Planes of a skew map, fastest first: an orthonormal basis with a fixed orientation (the longest column of the
    plane's projector, its largest entry positive, then its image), and the signed rate."""
    square = -(m @ m)
    values, vectors = np.linalg.eigh((square + square.T) / 2)
    order = np.argsort(values)[::-1]
    out = []
    for k in range(count):
        own = vectors[:, order[2 * k : 2 * k + 2]]
        projector = own @ own.T
        size = np.linalg.norm(projector, axis=0)
        first = projector[:, size.argmax()] / size.max()
        first = first * (1.0 if first[np.abs(first).argmax()] >= 0 else -1.0)
        rate = math.sqrt(max(float(first @ square @ first), 0.0))
        second = m @ first / rate if rate > 1e-12 else own @ own.T @ np.roll(first, 1)
        second = second - first * (first @ second)
        second = second / max(np.linalg.norm(second), 1e-300)
        out.append({"basis": np.column_stack([first, second]), "rate": -float(first @ m @ second) if rate > 1e-12 else 0.0})
    return out


def imaginary_plane(m: np.ndarray) -> np.ndarray:
    """The plane of the eigenvalue pair with the largest imaginary part."""
    values, vectors = np.linalg.eig(m)
    v = vectors[:, values.imag.argmax()]
    return np.linalg.qr(np.column_stack([v.real, v.imag]))[0]


def plane_error(a: np.ndarray, b: np.ndarray) -> dict:
    qa, qb = np.linalg.qr(a)[0], np.linalg.qr(b)[0]
    angles = np.arccos(np.clip(np.linalg.svd(qa.T @ qb, compute_uv=False), -1, 1))
    return {"max_angle": float(np.degrees(angles.max())), "rms_sine": float(np.sqrt(np.mean(np.sin(angles) ** 2))), "projector": float(np.linalg.norm(qa @ qa.T - qb @ qb.T))}


def match_two_planes(found: list[np.ndarray], truth: list[np.ndarray]) -> tuple[tuple[int, int], float]:
    """Which true plane each found one is: the pairing with the smaller sum of largest angles, then the first."""
    tried = [(sum(plane_error(found[k], truth[order[k]])["max_angle"] for k in range(2)), order) for order in ((0, 1), (1, 0))]
    total, order = min(tried)
    return order, total


QUERIES = {f.__name__: f for f in (preprocess, skew_map, plane_metrics, tangential_ratio, leave_one_out, permuted_derivatives, shifted_covariance)}

_PAIRS = f"{PLANAR}, q AS (SELECT user_id, user_id % {CONDITIONS} AS condition, t, (x + y) / 2 AS a, (y + z) / 2 AS b, y - x AS da, z - y AS db FROM p)"


def _sql_sums(source: str, key: str) -> str:
    return f"SELECT {key}, sum(a * a) AS aa, sum(a * b) AS ab, sum(b * b) AS bb, sum(a * da) AS ada, sum(b * da) AS bda, sum(a * db) AS adb, sum(b * db) AS bdb, sum(da * da) AS dada, sum(db * db) AS dbdb, sum(da) AS da, sum(db) AS db, count(*) AS n FROM {source} GROUP BY {key}"


_MAPS = ", ".join(f"{e} AS {k}" for k, e in _FREE.items())
_FREE_R2 = f"1 - (dada + dbdb - m11 * ada - m12 * bda - m21 * adb - m22 * bdb) / greatest({_TOTAL}, 1e-15)"

ORACLES = {
    "preprocess": f"WITH {STANDARD}, m AS (SELECT user_id % {CONDITIONS} AS condition, t, avg(x) AS m FROM z GROUP BY ALL), s AS (SELECT condition, t, coalesce((lag(m) OVER w + m + lead(m) OVER w) / 3, m) AS m FROM m WINDOW w AS (PARTITION BY condition ORDER BY t)), l AS (SELECT condition, t, m - avg(m) OVER (PARTITION BY t) AS m FROM s) SELECT condition, t, round(m - avg(m) OVER (PARTITION BY condition) + 1e-11, 7) AS value FROM l",
    "skew_map": f"WITH {_PAIRS}, s AS ({_sql_sums('q', 'user_id')}), m AS (SELECT *, {_MAPS}, {_SKEW} AS w FROM s) SELECT user_id, round(w, 6) AS constrained, round((m12 - m21) / 2, 6) AS skew_part, round({_FREE_R2}, 6) AS free_r2, round(1 - (dada + dbdb - w * (bda - adb)) / greatest({_TOTAL}, 1e-15), 6) AS skew_r2 FROM m",
    "plane_metrics": f"WITH {_PAIRS}, g AS (SELECT *, a * a + b * b AS r2, a * da + b * db AS dot, a * db - b * da AS cx, sqrt(da * da + db * db) AS speed, atan2(b, a) AS angle FROM q WHERE a * a + b * b > 1e-16), h AS (SELECT *, angle - lag(angle) OVER (PARTITION BY user_id ORDER BY t) AS s FROM g), u AS (SELECT *, sum(coalesce(s - 2 * pi() * ceil((s - pi()) / (2 * pi())), 0)) OVER (PARTITION BY user_id ORDER BY t) AS u FROM h) SELECT user_id, round(avg(cx * cx / r2), 6) AS tangential, round(avg(dot * dot / r2), 6) AS radial, round(avg((abs(dot) / (sqrt(r2) * speed + 1e-15) <= {PERPENDICULAR!r})::INT), 6) AS perpendicular, round(max(u) - min(u), 5) AS span, round(avg(cx / r2), 5) AS rate FROM u GROUP BY user_id",
    "tangential_ratio": f"WITH {_PAIRS} SELECT condition, round(sum(pow(a * db - b * da, 2) / (a * a + b * b)) / greatest(sum(da * da + db * db), 1e-15), 6) AS ratio FROM q WHERE a * a + b * b > 1e-16 GROUP BY condition",
    "leave_one_out": f"WITH {_PAIRS}, s AS (SELECT condition, sum(b * da) - sum(a * db) AS num, sum(a * a) + sum(b * b) AS den FROM q GROUP BY condition), w AS (SELECT sum(num) AS an, sum(den) AS ad FROM s) SELECT condition, round((an - num) / (ad - den), 7) AS rate, round(abs((an - num) / (ad - den) - an / ad), 7) AS change FROM s, w",
    "permuted_derivatives": f"WITH {_PAIRS}, v AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY md5(user_id || ':' || t)) AS k, da, db FROM q), f AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY t) AS k, a, b FROM q), j AS (SELECT f.*, da, db FROM f JOIN v USING (user_id, k)), s AS ({_sql_sums('j', 'user_id')}), m AS (SELECT *, {_MAPS} FROM s) SELECT user_id, round({_FREE_R2}, 6) AS free_r2 FROM m",
    "shifted_covariance": f"WITH {PLANAR}, n AS (SELECT user_id, count(*) AS n FROM p GROUP BY user_id), m AS (SELECT shift, p.x, o.y FROM p JOIN n USING (user_id), range(0, {SHIFTS + 1}) r(shift), p o WHERE o.user_id = p.user_id AND o.t = (p.t + shift) % n), c AS (SELECT shift, covar_samp(x, x) AS xx, covar_samp(x, y) AS xy, covar_samp(y, y) AS yy FROM m GROUP BY shift), a AS (SELECT xx AS axx, xy AS axy, yy AS ayy FROM c WHERE shift = 0), s AS (SELECT shift, round(1 - (pow(xx - axx, 2) + 2 * pow(xy - axy, 2) + pow(yy - ayy, 2)) / greatest(pow(axx, 2) + 2 * pow(axy, 2) + pow(ayy, 2), 1e-15), 7) AS similarity FROM c, a WHERE shift > 0) SELECT shift, similarity, row_number() OVER (ORDER BY similarity DESC, shift) AS rank, similarity >= {ALIKE} AS matched FROM s",
}
