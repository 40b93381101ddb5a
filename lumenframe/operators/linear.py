"""Static linear models: regression in several columns, principal planes, projections, alignment and their checks.

Sums over rows are aggregates; what is solved is a matrix of a few columns for each group. Planar forms (two
columns) have closed solutions, which is what their SQL states; the code is that for any number of columns.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenframe.operators.moments import _matrix, covariance, eigen, expected_nll, factor_analysis, long_vectors, ppca, vectors
from lumenframe.operators.sequence import STANDARD, standard
from lumenframe.session import checkpoint
from lumenframe.sources.generators import stream
from lumenframe.sources.tables import table

RIDGE = 1e-4
#: Loadings of three models, six rows of two columns each. Fixed values.
LOADINGS = {
    "full": [(1.0, 0.25), (0.7, -0.45), (0.3, 0.9), (-0.65, 0.4), (0.8, 0.55), (-0.25, -0.75)],
    "one_weak_row": [(1.0, 0.0), (0.7, 0.0), (0.3, 0.0), (-0.65, 0.4), (0.8, 0.55), (0.0, 0.0)],
    "flat": [(1.0, 2.0), (0.5, 1.0), (0.25, 0.5), (-1.0, -2.0), (2.0, 4.0), (3.0, 6.0)],
}


def planar(spark, sf_dir) -> DataFrame:
    """user_id, t, x, y, z: three steps of a standardised sequence that follow each other."""
    w = W.partitionBy("user_id").orderBy("t")
    return standard(spark, sf_dir).select("user_id", "t", "x", F.lead("x").over(w).alias("y"), F.lead("x", 2).over(w).alias("z"), "seen").where("z is not null")


# Regression


def normal_equations(frame: DataFrame, y: str, xs: list[str], group: list[str], lam: float, schema: str) -> DataFrame:
    """Weights of standardised columns (population scale), the intercept not penalised, taken back to their units:
    group, w_<x>..., intercept. One matrix a group is solved."""
    rows = frame.select(*group, F.array(*(F.col(c).cast("double") for c in (*xs, y))).alias("v"))

    def fit(pdf):
        cov, _, _ = _matrix(pdf)
        mean = pdf.drop_duplicates("i").sort_values("i")["mean_i"].to_numpy()
        k = len(xs)
        scale = np.sqrt(np.diag(cov)[:k])
        scale = np.where(scale > 1e-12, scale, 1.0)
        gram = cov[:k, :k] / np.outer(scale, scale) + lam * np.eye(k)
        w = np.linalg.solve(gram, cov[:k, k] / scale) / scale
        return pd.DataFrame([(*(pdf[c].iloc[0] for c in group), *w, mean[k] - w @ mean[:k])], columns=[*group, *(f"w_{c}" for c in xs), "intercept"])

    return covariance(rows, "v", group).groupBy(*group).applyInPandas(fit, schema)


def ridge_three_features(spark, sf_dir):
    cols = ["quantity", "discount", "tax"]
    rows = table(spark, sf_dir, "lineitem").select("l_linestatus", "l_extendedprice", *(F.col(f"l_{c}").cast("double").alias(c) for c in cols))
    made = normal_equations(rows, "l_extendedprice", cols, ["l_linestatus"], RIDGE, "l_linestatus string, w_quantity double, w_discount double, w_tax double, intercept double")
    return made.select("l_linestatus", F.round("w_quantity", 3).alias("w_quantity"), F.round("w_discount", 1).alias("w_discount"), F.round("w_tax", 1).alias("w_tax"), F.round("intercept", 2).alias("intercept"))


def input_aware_fit(spark, sf_dir):
    """Least squares of the change on the state and an input, without intercept, by user."""
    p = planar(spark, sf_dir).select("user_id", "x", F.col("seen").cast("double").alias("u"), (F.col("y") - F.col("x")).alias("d"))
    s = lambda a, b: F.sum(F.col(a) * F.col(b))
    m = p.groupBy("user_id").agg(s("x", "x").alias("xx"), s("x", "u").alias("xu"), s("u", "u").alias("uu"), s("x", "d").alias("xd"), s("u", "d").alias("ud"))
    det = F.expr("xx * uu - xu * xu")
    ok = det > 1e-9 * F.col("xx") * F.greatest("uu", F.lit(1e-300))
    return m.select("user_id", F.round(F.when(ok, F.expr("(uu * xd - xu * ud)") / det), 6).alias("state"), F.round(F.when(ok, F.expr("(xx * ud - xu * xd)") / det), 6).alias("input"))


def mean_baseline(spark, sf_dir):
    """Error on held-out vectors of the mean of the others, by label."""
    rows = long_vectors(spark, sf_dir).withColumn("held", F.col("vec_id") % 4 == 0)
    means = rows.where("not held").groupBy("label", "i").agg(F.avg("v").alias("m"))
    test = rows.where("held").join(means, ["label", "i"])
    return test.groupBy("label").agg(F.round(F.avg(F.pow(F.col("v") - F.col("m"), 2)), 9).alias("mse"))


# Planes


def _planar_cov(spark, sf_dir, columns=("x", "y"), key: str = "user_id") -> DataFrame:
    return covariance(planar(spark, sf_dir).select(F.col(key), F.array(*columns).alias("v")), "v", [key])


def pca_planar(spark, sf_dir):
    """Eigenvalues of two successive steps and the direction of the first, as a doubled angle."""

    def fit(pdf):
        values, basis = eigen(_matrix(pdf)[0])
        c, s = basis[:, 0]
        return pd.DataFrame([(int(pdf["user_id"].iloc[0]), values[0], values[1], c * c - s * s, 2 * c * s)], columns=["user_id", "first", "second", "cos2", "sin2"])

    made = _planar_cov(spark, sf_dir).groupBy("user_id").applyInPandas(fit, "user_id long, first double, second double, cos2 double, sin2 double")
    return made.select("user_id", *(F.round(c, 6).alias(c) for c in ("first", "second", "cos2", "sin2")))


def posterior_operator(load: np.ndarray, residual: np.ndarray) -> np.ndarray:
    """Takes a centred row to its reconstruction from the posterior mean of its factors."""
    return load @ load.T @ np.linalg.inv(load @ load.T + residual)


def reconstruction_error(cov: np.ndarray, operator: np.ndarray) -> float:
    """Mean squared error over entries of centred rows with covariance ``cov``."""
    rest = np.eye(len(cov)) - operator
    return float(np.trace(rest @ cov @ rest.T) / len(cov))


def ppca_planar(spark, sf_dir):
    """Probabilistic PCA of one factor: noise, NLL, and the errors of projection and of the posterior mean."""

    def fit(pdf):
        cov, _, _ = _matrix(pdf)
        load, noise = ppca(cov, 1)
        basis = eigen(cov)[1][:, :1]
        values = (noise, expected_nll(cov, load @ load.T + noise * np.eye(2)), reconstruction_error(cov, basis @ basis.T), reconstruction_error(cov, posterior_operator(load, noise * np.eye(2))))
        return pd.DataFrame([(int(pdf["user_id"].iloc[0]), *values)], columns=["user_id", "noise", "nll", "projection_mse", "posterior_mse"])

    made = _planar_cov(spark, sf_dir).groupBy("user_id").applyInPandas(fit, "user_id long, noise double, nll double, projection_mse double, posterior_mse double")
    return made.select("user_id", *(F.round(c, 6).alias(c) for c in ("noise", "nll", "projection_mse", "posterior_mse")))


def direction_angles(spark, sf_dir):
    """Degrees between a user's leading direction and that of all users."""
    p = planar(spark, sf_dir)
    both = checkpoint(covariance(p.select(F.explode(F.array(F.col("user_id"), F.lit(-1).cast("long"))).alias("key"), F.array("x", "y").alias("v")), "v", ["key"]))
    whole = both.where("key = -1").agg(F.collect_list(F.struct("i", "j", "cov")).alias("pooled"))  # four entries

    def fit(pdf):
        pooled = np.zeros((2, 2))
        for e in pdf["pooled"].iloc[0]:
            pooled[e["i"], e["j"]] = pooled[e["j"], e["i"]] = e["cov"]
        a, b = eigen(_matrix(pdf)[0])[1][:, 0], eigen(pooled)[1][:, 0]
        return pd.DataFrame([(int(pdf["key"].iloc[0]), float(np.degrees(np.arctan2(abs(a[0] * b[1] - a[1] * b[0]), abs(a @ b)))))], columns=["user_id", "angle"])

    made = both.where("key >= 0").crossJoin(F.broadcast(whole)).groupBy("key").applyInPandas(fit, "user_id long, angle double")
    return made.select("user_id", F.round("angle", 4).alias("angle"))


def procrustes(cross: np.ndarray) -> tuple[np.ndarray, float]:
    """The orthogonal matrix that takes an estimate nearest to the truth, of their cross product, and the sum of
    its singular values."""
    u, s, vt = np.linalg.svd(cross)
    return u @ vt, float(s.sum())


def procrustes_planar(spark, sf_dir):
    """(x, y) turned onto (y, z) by user: the error left, the corner of the turn, and whether it mirrors."""
    p = planar(spark, sf_dir)
    s = lambda a, b: F.sum(F.col(a) * F.col(b))
    m = p.groupBy("user_id").agg(s("x", "y").alias("h00"), s("x", "z").alias("h01"), s("y", "y").alias("h10"), s("y", "z").alias("h11"), F.sum(F.expr("x * x + y * y + y * y + z * z")).alias("q"), F.count("*").alias("n"))

    def fit(pdf):
        rows = []
        for r in pdf.itertuples():
            turn, total = procrustes(np.array([[r.h00, r.h01], [r.h10, r.h11]]))
            rows.append((r.user_id, (r.q - 2 * total) / (2 * r.n), turn[0, 0], bool(np.linalg.det(turn) < 0)))
        return pd.DataFrame(rows, columns=["user_id", "mse", "corner", "mirrors"])

    made = m.mapInPandas(lambda frames: (fit(f) for f in frames), "user_id long, mse double, corner double, mirrors boolean")
    return made.select("user_id", F.round("mse", 6).alias("mse"), F.round("corner", 6).alias("corner"), "mirrors")


def covariance_gaps(spark, sf_dir):
    """Relative Frobenius distance and off-diagonal RMSE between a label's covariance and that of all vectors."""
    both = checkpoint(covariance(vectors(spark, sf_dir).withColumn("key", F.explode(F.array(F.col("label"), F.lit(-1)))), "x", ["key"]))
    whole = both.where("key = -1").select("i", "j", F.col("cov").alias("all"))
    e = both.where("key >= 0").join(F.broadcast(whole), ["i", "j"])  # a row for each pair of entries
    d2, off = F.pow(F.col("cov") - F.col("all"), 2), F.col("i") != F.col("j")
    weight = F.when(off, 2.0).otherwise(1.0)
    return e.groupBy(F.col("key").alias("label")).agg(F.round(F.sqrt(F.sum(weight * d2)) / F.greatest(F.sqrt(F.sum(weight * F.pow("all", 2))), F.lit(1e-15)), 6).alias("relative"), F.round(F.sqrt(F.avg(F.when(off, d2))), 9).alias("offdiagonal_rmse"))


# Projections


def fixed_projection(spark, sf_dir):
    """Error of vectors projected on the direction of equal entries, about their label's mean."""
    rows = long_vectors(spark, sf_dir)
    m = rows.groupBy("label", "i").agg(F.avg("v").alias("m"))
    d = rows.join(m, ["label", "i"]).select("label", "vec_id", (F.col("v") - F.col("m")).alias("d"))
    one = d.groupBy("label", "vec_id").agg(F.sum(F.pow("d", 2)).alias("q"), F.sum("d").alias("s"), F.count("*").alias("p"))
    return one.groupBy("label").agg(F.round(F.avg((F.col("q") - F.col("s") * F.col("s") / F.col("p")) / F.col("p")), 9).alias("mse"))


def random_basis(number: int, rows: int, k: int) -> np.ndarray:
    """Orthonormal columns, seeded by their number."""
    return np.linalg.qr(stream(40, number).normal(size=(rows, k)))[0]


def random_projections(spark, sf_dir):
    """Errors on seeded random planes beside those on the best plane, by label."""

    def fit(pdf):
        cov, _, _ = _matrix(pdf)
        best = eigen(cov)[1][:, :2]
        bases = [("best", best), *((f"random_{k}", random_basis(k, len(cov), 2)) for k in range(5))]
        return pd.DataFrame([(int(pdf["label"].iloc[0]), n, round(reconstruction_error(cov, b @ b.T), 9)) for n, b in bases], columns=["label", "basis", "mse"])

    return covariance(vectors(spark, sf_dir), "x", ["label"]).groupBy("label").applyInPandas(fit, "label int, basis string, mse double")


def scaled_pca_leak(spark, sf_dir):
    """One direction of two scaled columns, fitted on training rows, and on all rows (the leak): held-out error."""
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", F.col("l_quantity").cast("double").alias("a"), F.col("l_extendedprice").cast("double").alias("b"), (F.col("l_orderkey") % 4 == 0).alias("held"))
    kinds = rows.select("*", F.explode(F.when(F.col("held"), F.array(F.lit("leaked"))).otherwise(F.array(F.lit("lawful"), F.lit("leaked")))).alias("fit"))
    cov = covariance(kinds.select("l_returnflag", "fit", F.array("a", "b").alias("v")), "v", ["l_returnflag", "fit"])

    def fit(pdf):
        c, _, _ = _matrix(pdf)
        mean = pdf.drop_duplicates("i").sort_values("i")["mean_i"].to_numpy()
        scale = np.sqrt(np.diag(c))
        u = eigen(c / np.outer(scale, scale))[1][:, 0]
        return pd.DataFrame([(pdf["l_returnflag"].iloc[0], pdf["fit"].iloc[0], *mean, *scale, *u)], columns=["l_returnflag", "fit", "ma", "mb", "sa", "sb", "ua", "ub"])

    models = cov.groupBy("l_returnflag", "fit").applyInPandas(fit, "l_returnflag string, fit string, ma double, mb double, sa double, sb double, ua double, ub double")
    test = rows.where("held").join(F.broadcast(models), "l_returnflag")  # two rows a flag
    za, zb = (F.col("a") - F.col("ma")) / F.col("sa"), (F.col("b") - F.col("mb")) / F.col("sb")
    e2 = za * za + zb * zb - F.pow(za * F.col("ua") + zb * F.col("ub"), 2)
    return test.groupBy("l_returnflag", "fit").agg(F.round(F.avg(e2 / 2), 7).alias("mse"))


# Identification


def rank_condition(spark, sf_dir=None, loadings: dict | None = None):
    """After any one row of a loading matrix is deleted, two disjoint pairs of rows must each have rank two; the
    first such pairs in order, null where there are none."""
    rows = [(m, k, float(a), float(b)) for m, own in (loadings or LOADINGS).items() for k, (a, b) in enumerate(own)]
    load = spark.createDataFrame(rows, "model string, i long, a double, b double")  # rows of a loading matrix
    x, y = (load.select("model", *(F.col(c).alias(f"{c}{k}") for c in ("i", "a", "b"))) for k in (1, 2))
    pairs = x.join(y, "model").where("i1 < i2 and abs(a1 * b2 - a2 * b1) > 1e-12").select("model", "i1", "i2")
    other = pairs.select("model", F.col("i1").alias("j1"), F.col("i2").alias("j2"))
    two = pairs.join(other, "model").where("i1 <> j1 and i1 <> j2 and i2 <> j1 and i2 <> j2")
    deleted = load.select("model", F.col("i").alias("deleted"))
    free = deleted.join(two, "model").where("deleted not in (i1, i2, j1, j2)")
    best = free.groupBy("model", "deleted").agg(F.min(F.struct("i1", "i2", "j1", "j2")).alias("w"))
    return deleted.join(best, ["model", "deleted"], "left").select("model", "deleted", F.col("w.i1").alias("i1"), F.col("w.i2").alias("i2"), F.col("w.j1").alias("j1"), F.col("w.j2").alias("j2"), F.col("w").isNotNull().alias("passes"))


def rank_pairs(load: np.ndarray) -> list[bool]:
    """For each row of a small loading matrix of two columns: whether ``rank_condition`` holds without it."""
    from itertools import combinations

    def two(rows):
        good = [p for p in combinations(rows, 2) if abs(np.linalg.det(load[list(p)])) > 1e-12]
        return any(set(p).isdisjoint(q) for p, q in combinations(good, 2))

    return [two([r for r in range(len(load)) if r != k]) for k in range(len(load))]


def static_factor(spark, sf_dir):
    """A factor model read off the leading plane (loadings scaled by their eigenvalues, what is left on the
    diagonal) beside the one by EM: NLL by label, and the largest posterior variance of a factor."""

    def fit(pdf):
        cov, _, _ = _matrix(pdf)
        values, basis = eigen(cov)
        load = basis[:, :2] * np.sqrt(np.maximum(values[:2], 1e-9))
        left = np.diag(np.maximum(np.diag(cov - load @ load.T), 1e-5))
        fa = factor_analysis(cov)
        out = []
        for name, l, r in (("pca_factor", load, left), ("factor_analysis", fa["loading"], np.diag(fa["unique"]))):
            spread = np.eye(2) - l.T @ np.linalg.inv(l @ l.T + r) @ l
            out.append((int(pdf["label"].iloc[0]), name, round(expected_nll(cov, l @ l.T + r), 6), round(float(np.diag(spread).max()), 6)))
        return pd.DataFrame(out, columns=["label", "method", "nll", "posterior_var"])

    return covariance(vectors(spark, sf_dir), "x", ["label"]).groupBy("label").applyInPandas(fit, "label int, method string, nll double, posterior_var double")


QUERIES = {
    f.__name__: f
    for f in (
        ridge_three_features, input_aware_fit, mean_baseline, pca_planar, ppca_planar, direction_angles, procrustes_planar, covariance_gaps, fixed_projection, random_projections, scaled_pca_leak, rank_condition, static_factor,
    )
}

PLANAR = f"{STANDARD}, p AS (SELECT * FROM (SELECT user_id, t, x, lead(x) OVER w AS y, lead(x, 2) OVER w AS z, seen FROM z WINDOW w AS (PARTITION BY user_id ORDER BY t)) WHERE z IS NOT NULL)"
_EIGEN = f"{PLANAR}, c AS (SELECT user_id, var_pop(x) AS a, covar_pop(x, y) AS b, var_pop(y) AS c FROM p GROUP BY user_id), r AS (SELECT *, sqrt(pow((a - c) / 2, 2) + b * b) AS r FROM c), e AS (SELECT user_id, (a + c) / 2 + r AS l1, (a + c) / 2 - r AS l2, (a - c) / 2 / r AS cos2, b / r AS sin2 FROM r)"
_LONG = "v AS (SELECT vec_id, label, i - 1 AS i, embedding[i]::DOUBLE AS v FROM embeddings, range(1, 65) r(i))"
_VALUES = ", ".join(f"('{m}', {k}, {a}::DOUBLE, {b}::DOUBLE)" for m, own in LOADINGS.items() for k, (a, b) in enumerate(own))
_P = 1 + RIDGE

ORACLES = {
    "ridge_three_features": f"""WITH m AS (SELECT l_linestatus, avg(l_extendedprice) AS my, avg(l_quantity) AS m1, avg(l_discount) AS m2, avg(l_tax) AS m3, stddev_pop(l_quantity) AS s1, stddev_pop(l_discount) AS s2, stddev_pop(l_tax) AS s3,
  corr(l_quantity, l_discount) AS r12, corr(l_quantity, l_tax) AS r13, corr(l_discount, l_tax) AS r23, covar_pop(l_quantity, l_extendedprice) / stddev_pop(l_quantity) AS u1, covar_pop(l_discount, l_extendedprice) / stddev_pop(l_discount) AS u2, covar_pop(l_tax, l_extendedprice) / stddev_pop(l_tax) AS u3, {_P} AS p FROM lineitem GROUP BY l_linestatus),
d AS (SELECT *, p * (p * p - r23 * r23) - r12 * (r12 * p - r23 * r13) + r13 * (r12 * r23 - p * r13) AS det FROM m),
w AS (SELECT *, (u1 * (p * p - r23 * r23) - r12 * (u2 * p - r23 * u3) + r13 * (u2 * r23 - p * u3)) / det / s1 AS w1, (p * (u2 * p - u3 * r23) - u1 * (r12 * p - r23 * r13) + r13 * (r12 * u3 - u2 * r13)) / det / s2 AS w2, (p * (p * u3 - r23 * u2) - r12 * (r12 * u3 - u2 * r13) + u1 * (r12 * r23 - p * r13)) / det / s3 AS w3 FROM d)
SELECT l_linestatus, round(w1, 3) AS w_quantity, round(w2, 1) AS w_discount, round(w3, 1) AS w_tax, round(my - w1 * m1 - w2 * m2 - w3 * m3, 2) AS intercept FROM w""",
    "input_aware_fit": f"WITH {PLANAR}, s AS (SELECT user_id, sum(x * x) AS xx, sum(x * seen::INT) AS xu, sum(seen::INT)::DOUBLE AS uu, sum(x * (y - x)) AS xd, sum(seen::INT * (y - x)) AS ud FROM p GROUP BY user_id) SELECT user_id, CASE WHEN xx * uu - xu * xu > 1e-9 * xx * greatest(uu, 1e-300) THEN round((uu * xd - xu * ud) / (xx * uu - xu * xu), 6) END AS state, CASE WHEN xx * uu - xu * xu > 1e-9 * xx * greatest(uu, 1e-300) THEN round((xx * ud - xu * xd) / (xx * uu - xu * xu), 6) END AS input FROM s",
    "mean_baseline": f"WITH {_LONG}, m AS (SELECT label, i, avg(v) AS m FROM v WHERE vec_id % 4 <> 0 GROUP BY ALL) SELECT label, round(avg((v - m) * (v - m)), 9) AS mse FROM v JOIN m USING (label, i) WHERE vec_id % 4 = 0 GROUP BY label",
    "pca_planar": f"WITH {_EIGEN} SELECT user_id, round(l1, 6) AS first, round(l2, 6) AS second, round(cos2, 6) AS cos2, round(sin2, 6) AS sin2 FROM e",
    "ppca_planar": f"WITH {_EIGEN} SELECT user_id, round(greatest(l2, 1e-8), 6) AS noise, round(0.5 * (2 * ln(2 * pi()) + ln(l1) + ln(l2) + 2), 6) AS nll, round(l2 / 2, 6) AS projection_mse, round((l2 * l2 / l1 + l2) / 2, 6) AS posterior_mse FROM e",
    "direction_angles": f"WITH {PLANAR}, c AS (SELECT user_id, var_pop(x) AS a, covar_pop(x, y) AS b, var_pop(y) AS c FROM p GROUP BY user_id UNION ALL SELECT -1, var_pop(x), covar_pop(x, y), var_pop(y) FROM p), h AS (SELECT user_id, atan2(2 * b, a - c) / 2 AS h FROM c) SELECT user_id, round(degrees(atan2(abs(sin(h - g)), abs(cos(h - g)))), 4) AS angle FROM h, (SELECT h AS g FROM h WHERE user_id = -1) WHERE user_id >= 0",
    "procrustes_planar": f"WITH {PLANAR}, m AS (SELECT user_id, sum(x * y) AS h00, sum(x * z) AS h01, sum(y * y) AS h10, sum(y * z) AS h11, sum(x * x + y * y + y * y + z * z) AS q, count(*) AS n FROM p GROUP BY user_id), d AS (SELECT *, h00 * h11 - h01 * h10 < 0 AS mirrors, sqrt(pow(h00 + h11, 2) + pow(h10 - h01, 2)) AS s, sqrt(pow(h00 - h11, 2) + pow(h10 + h01, 2)) AS f FROM m) SELECT user_id, round((q - 2 * CASE WHEN mirrors THEN f ELSE s END) / (2 * n), 6) AS mse, round(CASE WHEN mirrors THEN (h00 - h11) / f ELSE (h00 + h11) / s END, 6) AS corner, mirrors FROM d",
    "covariance_gaps": f"WITH {_LONG}, c AS (SELECT a.label, a.i, b.i AS j, covar_pop(a.v, b.v) AS c FROM v a JOIN v b USING (vec_id) GROUP BY ALL), w AS (SELECT a.i, b.i AS j, covar_pop(a.v, b.v) AS w FROM v a JOIN v b USING (vec_id) GROUP BY ALL) SELECT label, round(sqrt(sum((c - w) * (c - w))) / greatest(sqrt(sum(w * w)), 1e-15), 6) AS relative, round(sqrt(avg((c - w) * (c - w)) FILTER (i <> j)), 9) AS offdiagonal_rmse FROM c JOIN w USING (i, j) GROUP BY label",
    "fixed_projection": f"WITH {_LONG}, d AS (SELECT label, vec_id, v - avg(v) OVER (PARTITION BY label, i) AS d FROM v), o AS (SELECT label, vec_id, (sum(d * d) - sum(d) * sum(d) / count(*)) / count(*) AS e FROM d GROUP BY ALL) SELECT label, round(avg(e), 9) AS mse FROM o GROUP BY label",
    "scaled_pca_leak": "WITH r AS (SELECT l_returnflag, l_quantity::DOUBLE AS a, l_extendedprice::DOUBLE AS b, l_orderkey % 4 = 0 AS held FROM lineitem), m AS (SELECT l_returnflag, 'lawful' AS fit, avg(a) AS ma, avg(b) AS mb, stddev_pop(a) AS sa, stddev_pop(b) AS sb, sign(corr(a, b)) AS s FROM r WHERE NOT held GROUP BY l_returnflag UNION ALL SELECT l_returnflag, 'leaked', avg(a), avg(b), stddev_pop(a), stddev_pop(b), sign(corr(a, b)) FROM r GROUP BY l_returnflag), z AS (SELECT r.l_returnflag, fit, (a - ma) / sa AS za, (b - mb) / sb AS zb, s FROM r JOIN m ON m.l_returnflag = r.l_returnflag WHERE held) SELECT l_returnflag, fit, round(avg((za - s * zb) * (za - s * zb) / 4), 7) AS mse FROM z GROUP BY ALL",
    "rank_condition": f"WITH l AS (SELECT * FROM (VALUES {_VALUES}) t(model, i, a, b)), p AS (SELECT x.model, x.i AS i1, y.i AS i2 FROM l x JOIN l y ON x.model = y.model AND x.i < y.i AND abs(x.a * y.b - y.a * x.b) > 1e-12), q AS (SELECT p.model, p.i1, p.i2, o.i1 AS j1, o.i2 AS j2 FROM p JOIN p o ON o.model = p.model AND p.i1 NOT IN (o.i1, o.i2) AND p.i2 NOT IN (o.i1, o.i2)), w AS (SELECT l.model, l.i AS deleted, i1, i2, j1, j2, row_number() OVER (PARTITION BY l.model, l.i ORDER BY i1, i2, j1, j2) AS k FROM l JOIN q ON q.model = l.model AND l.i NOT IN (i1, i2, j1, j2)) SELECT l.model, l.i::BIGINT AS deleted, i1::BIGINT AS i1, i2::BIGINT AS i2, j1::BIGINT AS j1, j2::BIGINT AS j2, k IS NOT NULL AS passes FROM l LEFT JOIN (SELECT * FROM w WHERE k = 1) w ON w.model = l.model AND w.deleted = l.i",
}
