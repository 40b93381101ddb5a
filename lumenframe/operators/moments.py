"""Moments and small linear models: standardising, covariance, regression, condition means, factor models.

Sums over rows are aggregates; what is left for linear algebra is a matrix of a few columns a side, solved in
one row of a grouped Arrow function, so that no raw rows leave the executors.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenframe.session import checkpoint
from lumenframe.sources.generators import stream
from lumenframe.sources.tables import table

DIMS = 64
FA_ROUNDS, FA_TOL, FA_FLOORS = 250, 1e-8, (1e-5, 1e-3)
RIDGE = 1e-4


def vectors(spark, sf_dir) -> DataFrame:
    """vec_id, label, x: all entries as doubles."""
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.transform("embedding", lambda v: v.cast("double")).alias("x"))


def long_vectors(spark, sf_dir) -> DataFrame:
    return vectors(spark, sf_dir).select("vec_id", "label", F.posexplode("x").alias("i", "v"))


def entry_moments(spark, sf_dir) -> DataFrame:
    """label, i, mean, scale: a row for each label and entry."""
    m = long_vectors(spark, sf_dir).groupBy("label", "i").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("sd"))
    return m.select("label", "i", "mean", F.when(F.col("sd") > 1e-12, F.col("sd")).otherwise(1.0).alias("scale"))


def standardize(spark, sf_dir):
    """Moments are aggregates that meet the rows again; no label's rows come together."""
    z = (F.col("v") - F.col("mean")) / F.col("scale")
    return long_vectors(spark, sf_dir).join(entry_moments(spark, sf_dir), ["label", "i"]).select("vec_id", F.col("i").cast("bigint").alias("i"), F.round(z, 5).alias("z"))


#: Groups whose sums a task holds before it hands them on.
HELD = 256


def product_sums(frame: DataFrame, array: str, group: list[str]) -> DataFrame:
    """group, i, j (i <= j), p, s_i, s_j, n: sums of products and of entries in coordinate form. Each task sums its
    products a group (a matrix product a batch), so that only such sums are shuffled."""

    def partial(frames):
        held: dict[tuple, list] = {}

        def rows():
            parts = []
            for key, (n, s, products) in held.items():
                i, j = np.triu_indices(len(s))
                part = pd.DataFrame({"i": i.astype(np.int32), "j": j.astype(np.int32), "p": products[i, j], "s_i": s[i], "s_j": s[j], "n": n})
                for name, value in zip(group, key, strict=True):
                    part[name] = value
                parts.append(part[[*group, "i", "j", "p", "s_i", "s_j", "n"]])
            held.clear()
            return parts

        for pdf in frames:
            for key, own in pdf.groupby(group, sort=False, dropna=False):
                x = np.stack(own[array].to_numpy())
                n, s, products = held.get(key, (0, 0.0, 0.0))
                held[key] = [n + len(x), s + x.sum(0), products + x.T @ x]
                if len(held) >= HELD:
                    yield from rows()
        yield from rows()

    kinds = ", ".join(f"{c} {frame.schema[c].dataType.simpleString()}" for c in group)
    sums = frame.select(*group, array).mapInPandas(partial, f"{kinds}, i int, j int, p double, s_i double, s_j double, n long")
    return sums.groupBy(*group, "i", "j").agg(*(F.sum(c).alias(c) for c in ("p", "s_i", "s_j", "n")))


def covariance(frame: DataFrame, array: str, group: list[str]) -> DataFrame:
    """group, i, j, cov, mean_i, n: population covariance in coordinate form."""
    m = product_sums(frame, array, group)
    return m.select(*group, "i", "j", (F.col("p") / F.col("n") - F.col("s_i") / F.col("n") * (F.col("s_j") / F.col("n"))).alias("cov"), (F.col("s_i") / F.col("n")).alias("mean_i"), "n")


def covariance_matrix(spark, sf_dir):
    return covariance(vectors(spark, sf_dir), "x", ["label"]).select("label", F.col("i").cast("bigint").alias("i"), F.col("j").cast("bigint").alias("j"), F.round("cov", 7).alias("cov"))


def regression_affine(spark, sf_dir):
    y, x = F.col("l_extendedprice"), F.col("l_quantity")
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.round(F.regr_slope(y, x), 4).alias("slope"), F.round(F.regr_intercept(y, x), 3).alias("intercept"), F.round(F.regr_r2(y, x), 6).alias("r2"))


def ridge_two_features(spark, sf_dir):
    """Price on quantity and discount, standardised, intercept not penalised; closed form of the 2 x 2 system."""
    rows = table(spark, sf_dir, "lineitem").select("l_linestatus", F.col("l_extendedprice").alias("y"), F.col("l_quantity").alias("a"), F.col("l_discount").alias("b"))
    m = rows.groupBy("l_linestatus").agg(
        F.count("*").alias("n"), F.avg("y").alias("my"), F.avg("a").alias("ma"), F.avg("b").alias("mb"), F.stddev_pop("a").alias("sa"), F.stddev_pop("b").alias("sb"),
        F.corr("a", "b").alias("c"), F.covar_pop("a", "y").alias("ay"), F.covar_pop("b", "y").alias("by"),
    )
    p = F.lit(1.0) + F.lit(RIDGE)
    u, v = F.col("ay") / F.col("sa"), F.col("by") / F.col("sb")
    det = p * p - F.col("c") * F.col("c")
    wa, wb = (p * u - F.col("c") * v) / det / F.col("sa"), (p * v - F.col("c") * u) / det / F.col("sb")
    return m.select("l_linestatus", F.round(wa, 4).alias("w_quantity"), F.round(wb, 3).alias("w_discount"), F.round(F.col("my") - wa * F.col("ma") - wb * F.col("mb"), 3).alias("intercept"))


def _factorial(spark, sf_dir):
    """documents with labels: quality and toxic as the two factors, language as the position."""
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").select("quality", "toxic", "lang", F.log1p(F.col("n_chars").cast("double")).alias("x"))


def cell_means(spark, sf_dir) -> DataFrame:
    """quality, toxic, lang, m, n: a mean for each cell of the full grid; an empty cell has the position's grand mean."""
    rows = _factorial(spark, sf_dir)
    seen = rows.groupBy("quality", "toxic", "lang").agg(F.avg("x").alias("m"), F.count("*").alias("n"))
    grid = rows.select("lang").distinct()
    for c in ("quality", "toxic"):  # labels of two values
        grid = grid.crossJoin(F.broadcast(rows.select(c).distinct()))
    full = grid.join(seen, ["quality", "toxic", "lang"], "left").join(rows.groupBy("lang").agg(F.avg("x").alias("grand")), "lang")
    return full.select("quality", "toxic", "lang", F.coalesce("m", "grand").alias("m"), F.coalesce("n", F.lit(0)).alias("n"))


def condition_means(spark, sf_dir):
    return cell_means(spark, sf_dir).withColumn("m", F.round("m", 6))


def marginals(spark, sf_dir) -> DataFrame:
    """Cell means as a sum of position, factor and interaction parts; the parts add up to the centred mean."""
    m = cell_means(spark, sf_dir)
    whole, pos = W.partitionBy(F.lit(0)), W.partitionBy("lang")  # a row for each cell
    grand, t = F.avg("m").over(whole), F.avg("m").over(pos)
    s, d = F.avg("m").over(W.partitionBy("lang", "quality")), F.avg("m").over(W.partitionBy("lang", "toxic"))
    return m.select("quality", "toxic", "lang", "m", (t - grand).alias("position"), (s - t).alias("stimulus"), (d - t).alias("decision"), (F.col("m") - s - d + t).alias("interaction"))


def marginal_decomposition(spark, sf_dir):
    """Rounded once, from means that aren't."""
    return marginals(spark, sf_dir).select("quality", "toxic", "lang", *(F.round(F.col(c) + 1e-12, 5).alias(c) for c in ("position", "stimulus", "decision", "interaction")))


def factorial_rank(spark, sf_dir):
    """Cells that occur, and the rank of [1, s, d, sd], which is their number."""
    cells = _factorial(spark, sf_dir).groupBy("lang").agg(F.count_distinct("quality", "toxic").alias("rank"), F.min("x").alias("low"))
    return cells.select("lang", "rank", F.when(F.col("rank") < 4, F.concat(F.lit("incomplete_factorial_design_rank_"), F.col("rank").cast("string"), F.lit("_of_4"))).otherwise("ok").alias("status"))


def normalized_errors(spark, sf_dir):
    """RMSE and NMSE of each vector's mean by label."""
    own = entry_moments(spark, sf_dir)
    whole = long_vectors(spark, sf_dir).groupBy("i").agg(F.avg("v").alias("g"))
    rows = long_vectors(spark, sf_dir).join(own.join(whole, "i"), ["label", "i"])
    se, total = F.avg(F.pow(F.col("v") - F.col("mean"), 2)), F.avg(F.pow(F.col("v") - F.col("g"), 2))
    return rows.groupBy("label").agg(F.round(F.sqrt(se), 6).alias("rmse"), F.round(se / F.greatest(total, F.lit(1e-15)), 6).alias("nmse"))


# Factor models: one matrix a group.


def _matrix(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, int]:
    p = int(pdf["i"].max()) + 1
    cov, mean = np.zeros((p, p)), np.zeros(p)
    i, j = pdf["i"].to_numpy(), pdf["j"].to_numpy()
    cov[i, j] = cov[j, i] = pdf["cov"]
    mean[i] = pdf["mean_i"]
    return cov, mean, int(pdf["n"].iloc[0])


def eigen(cov: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, largest first, and vectors whose largest entry is positive."""
    values, basis = np.linalg.eigh((cov + cov.T) / 2)
    values, basis = values[::-1], basis[:, ::-1]
    at = np.abs(basis).argmax(0)
    return values, basis * np.where(basis[at, np.arange(basis.shape[1])] < 0, -1.0, 1.0)


def expected_nll(sample: np.ndarray, model: np.ndarray) -> float:
    """Mean Gaussian NLL of rows with covariance ``sample`` about their mean; infinite if not positive definite."""
    sign, logdet = np.linalg.slogdet(model)
    if sign <= 0 or not np.isfinite(logdet):
        return float("inf")
    return 0.5 * (len(model) * np.log(2 * np.pi) + logdet + np.trace(np.linalg.solve(model, sample)))


def ppca(cov: np.ndarray, k: int = 2) -> tuple[np.ndarray, float]:
    values, basis = eigen(cov)
    noise = max(float(values[k:].mean()), 1e-8)
    return basis[:, :k] * np.sqrt(np.maximum(values[:k] - noise, 0)), noise


def factor_analysis(cov: np.ndarray, k: int = 2, floor: float = FA_FLOORS[0], restart: int = 0, rounds: int = FA_ROUNDS, tol: float = FA_TOL) -> dict:
    """EM on the covariance alone; the likelihood never falls. Start, update order and stopping rule are fixed, as
    numbers must agree: the leading directions less the trailing mean, moved by seeded noise on a restart."""
    values, basis = np.linalg.eigh((cov + cov.T) / 2)
    values, basis = values[::-1], basis[:, ::-1]  # signs as they come: seeded noise is added to them
    load = basis[:, :k] * np.sqrt(np.maximum(values[:k] - max(values[k:].mean(), floor), floor))
    if restart:
        load = load + stream(30, restart).normal(scale=0.08 * np.sqrt(max(values[0], floor)), size=load.shape)
    unique = np.maximum(np.diag(cov - load @ load.T), floor)
    history, before, settled = [], np.inf, False
    while len(history) < rounds and not settled:
        gain = np.linalg.solve(load @ load.T + np.diag(unique), load).T
        cross = cov @ gain.T
        load = cross @ np.linalg.inv(np.eye(k) - gain @ load + gain @ cross)
        unique = np.maximum(np.diag(cov - load @ (gain @ cov)), floor)
        history.append(expected_nll(cov, load @ load.T + np.diag(unique)))
        settled = np.isfinite(before) and abs(before - history[-1]) <= tol * max(1.0, abs(before))
        before = history[-1]
    return {"loading": load, "unique": unique, "nll": before, "rounds": len(history), "settled": bool(settled), "history": history}


def _by_label(spark, sf_dir, fit, schema: str) -> DataFrame:
    return covariance(vectors(spark, sf_dir), "x", ["label"]).groupBy("label").applyInPandas(fit, schema)


def pca(spark, sf_dir):
    """Explained share and entries of the two leading directions of each label."""

    def fit(pdf):
        cov, _, _ = _matrix(pdf)
        values, basis = eigen(cov)
        rows = [(int(pdf["label"].iloc[0]), k, i, round(float(values[k] / values.sum()), 6), round(float(basis[i, k]), 6)) for k in range(2) for i in range(len(cov))]
        return pd.DataFrame(rows, columns=["label", "component", "i", "share", "weight"])

    return _by_label(spark, sf_dir, fit, "label int, component int, i int, share double, weight double")


def factor_models(spark, sf_dir):
    """NLL of the diagonal Gaussian, PPCA and factor analysis (best floor, then the smallest) of each label."""

    def fit(pdf):
        cov, _, n = _matrix(pdf)
        load, noise = ppca(cov)
        fa = min((factor_analysis(cov, floor=f) | {"floor": f} for f in FA_FLOORS), key=lambda m: (m["nll"], m["floor"]))
        rows = [("diagonal", expected_nll(cov, np.diag(np.maximum(np.diag(cov), 1e-8))), 0, "ok"), ("ppca", expected_nll(cov, load @ load.T + noise * np.eye(len(cov))), 0, "ok"), ("factor_analysis", fa["nll"], fa["rounds"], "ok" if fa["settled"] else "nonconvergence")]
        return pd.DataFrame([(int(pdf["label"].iloc[0]), m, round(float(v), 6), r, s, n) for m, v, r, s in rows], columns=["label", "method", "nll", "rounds", "status", "n"])

    return _by_label(spark, sf_dir, fit, "label int, method string, nll double, rounds int, status string, n long")


def principal_angles(spark, sf_dir):
    """Degrees between each label's leading plane and the plane of all vectors."""
    both = checkpoint(covariance(vectors(spark, sf_dir).withColumn("group", F.explode(F.array(F.col("label"), F.lit(-1)))), "x", ["group"]))
    whole = both.where("group = -1").toPandas()  # a row for each pair of entries
    plane = eigen(_matrix(whole)[0])[1][:, :2]

    def fit(pdf):
        a = eigen(_matrix(pdf)[0])[1][:, :2]
        s = np.degrees(np.arccos(np.clip(np.linalg.svd(a.T @ plane, compute_uv=False), -1, 1)))
        return pd.DataFrame([(int(pdf["label"].iloc[0]), round(float(s[0]), 5), round(float(s[1]), 5))], columns=["label", "first", "second"])

    return both.where("group >= 0").withColumnRenamed("group", "label").groupBy("label").applyInPandas(fit, "label int, first double, second double")


QUERIES = {
    f.__name__: f
    for f in (standardize, covariance_matrix, regression_affine, ridge_two_features, condition_means, marginal_decomposition, factorial_rank, normalized_errors, pca, factor_models, principal_angles)
}

_LONG = f"v AS (SELECT vec_id, label, i - 1 AS i, embedding[i]::DOUBLE AS v FROM embeddings, range(1, {DIMS + 1}) r(i))"
_CELLS = """r AS (SELECT quality, toxic, lang, ln(1 + n_chars) AS x FROM documents JOIN labels USING (doc_id)), s AS (SELECT quality, toxic, lang, avg(x) AS m, count(*) AS n FROM r GROUP BY ALL),
g AS (SELECT lang, avg(x) AS grand FROM r GROUP BY lang), c AS (SELECT q.quality, t.toxic, g.lang, coalesce(m, grand) AS m, coalesce(n, 0) AS n FROM g CROSS JOIN (SELECT DISTINCT quality FROM r) q CROSS JOIN (SELECT DISTINCT toxic FROM r) t LEFT JOIN s ON s.quality = q.quality AND s.toxic = t.toxic AND s.lang = g.lang)"""

ORACLES = {
    "standardize": f"WITH {_LONG} SELECT vec_id, i, round((v - avg(v) OVER w) / CASE WHEN stddev_pop(v) OVER w > 1e-12 THEN stddev_pop(v) OVER w ELSE 1 END, 5) AS z FROM v WINDOW w AS (PARTITION BY label, i)",
    "covariance_matrix": f"WITH {_LONG} SELECT a.label, a.i, b.i AS j, round(covar_pop(a.v, b.v), 7) AS cov FROM v a JOIN v b ON a.vec_id = b.vec_id AND a.i <= b.i GROUP BY ALL",
    "regression_affine": "SELECT l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 3) AS intercept, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2 FROM lineitem GROUP BY l_returnflag",
    "ridge_two_features": f"WITH m AS (SELECT l_linestatus, avg(l_extendedprice) AS my, avg(l_quantity) AS ma, avg(l_discount) AS mb, stddev_pop(l_quantity) AS sa, stddev_pop(l_discount) AS sb, corr(l_quantity, l_discount) AS c, covar_pop(l_quantity, l_extendedprice) / stddev_pop(l_quantity) AS u, covar_pop(l_discount, l_extendedprice) / stddev_pop(l_discount) AS v FROM lineitem GROUP BY l_linestatus), w AS (SELECT *, ({1 + RIDGE} * u - c * v) / ({1 + RIDGE} * {1 + RIDGE} - c * c) / sa AS wa, ({1 + RIDGE} * v - c * u) / ({1 + RIDGE} * {1 + RIDGE} - c * c) / sb AS wb FROM m) SELECT l_linestatus, round(wa, 4) AS w_quantity, round(wb, 3) AS w_discount, round(my - wa * ma - wb * mb, 3) AS intercept FROM w",
    "condition_means": f"WITH {_CELLS} SELECT * REPLACE (round(m, 6) AS m) FROM c",
    "marginal_decomposition": f"WITH {_CELLS}, d AS (SELECT *, avg(m) OVER () AS grand, avg(m) OVER (PARTITION BY lang) AS t, avg(m) OVER (PARTITION BY lang, quality) AS s, avg(m) OVER (PARTITION BY lang, toxic) AS d FROM c) SELECT quality, toxic, lang, round(t - grand + 1e-12, 5) AS position, round(s - t + 1e-12, 5) AS stimulus, round(d - t + 1e-12, 5) AS decision, round(m - s - d + t + 1e-12, 5) AS interaction FROM d",
    "factorial_rank": "SELECT lang, count(DISTINCT quality * 2 + toxic) AS rank, CASE WHEN count(DISTINCT quality * 2 + toxic) < 4 THEN 'incomplete_factorial_design_rank_' || count(DISTINCT quality * 2 + toxic) || '_of_4' ELSE 'ok' END AS status FROM documents JOIN labels USING (doc_id) GROUP BY lang",
    "normalized_errors": f"WITH {_LONG}, w AS (SELECT label, v, avg(v) OVER (PARTITION BY label, i) AS m, avg(v) OVER (PARTITION BY i) AS g FROM v) SELECT label, round(sqrt(avg((v - m) * (v - m))), 6) AS rmse, round(avg((v - m) * (v - m)) / greatest(avg((v - g) * (v - g)), 1e-15), 6) AS nmse FROM w GROUP BY label",
}
