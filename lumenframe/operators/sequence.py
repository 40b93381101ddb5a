"""Sequence operators over ``events``: one sequence a user, ordered by time, values standardised by user.

Recursions run along the sorted rows of a partition with a state of fixed size (``functions.scans``); window
operators need no array at all.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenframe.functions.folds import open_loop_variance
from lumenframe.functions.scans import euler_steps, filter_steps, grid_nll, ordered, smoother_steps
from lumenframe.sources.tables import table

A, Q, R = 0.85, 0.1, 0.4
#: Rate, gain and step of the driven state.
DRIVEN = (-0.6, 0.8, 0.05)
#: The selection grid of (a, q, r). Fixed values.
GRID = [(a, q, r) for a in (0.70, 0.85, 0.95) for q in (0.05, 0.10, 0.20) for r in (0.20, 0.40, 0.80)]


def standard(spark, sf_dir) -> DataFrame:
    """user_id, t (from 0), x (standardised), seen (not an error event)."""
    own, by_time = W.partitionBy("user_id"), W.partitionBy("user_id").orderBy("ts", "event_id")
    scale = F.stddev_pop("value").over(own)
    return table(spark, sf_dir, "events").select(
        "user_id", (F.row_number().over(by_time) - 1).cast("bigint").alias("t"),
        F.round((F.col("value") - F.avg("value").over(own)) / F.when(scale > 1e-12, scale).otherwise(1.0), 6).alias("x"),
        (F.col("event_type") != "error").alias("seen"),
    )


def _in_order(events: DataFrame) -> DataFrame:
    """``standard`` has been dealt by user for its windows; only the order is left to make."""
    return ordered(events, "user_id", "t", dealt=True)


def _steps(spark, sf_dir) -> DataFrame:
    return filter_steps(_in_order(standard(spark, sf_dir)), "user_id", A, Q, R)


def kalman_filter_steps(spark, sf_dir):
    return _steps(spark, sf_dir).select("user_id", "t", *(F.round(c, 6).alias(c) for c in ("pm", "pv", "m", "v", "inn", "nll")))


def kalman_filter_final(spark, sf_dir):
    last = F.max(F.struct("t", "m", "v"))
    done = _steps(spark, sf_dir).groupBy("user_id").agg(F.count("*").alias("n_steps"), last.alias("last"), F.sum("nll").alias("nll"))
    return done.select("user_id", "n_steps", F.round("last.m", 6).alias("mean"), F.round("last.v", 6).alias("var"), F.round("nll", 5).alias("nll"))


def rts_smoother(spark, sf_dir):
    return smoother_steps(_steps(spark, sf_dir), "user_id", A).select("user_id", "t", F.round("sm", 6).alias("sm"), F.round("sv", 6).alias("sv"))


def lgssm_grid_select(spark, sf_dir):
    """Mean filter NLL over seen steps at each grid point, on the users of two splits; best first."""
    scored = grid_nll(_in_order(standard(spark, sf_dir).where("user_id % 3 < 2")), "user_id", GRID)
    grid = spark.createDataFrame([(k, *p) for k, p in enumerate(GRID)], "point int, a double, q double, r double")
    split = [F.sum(F.when(F.col("user_id") % 3 == k, F.col("nll"))) / F.sum(F.when(F.col("user_id") % 3 == k, F.col("n"))) for k in (0, 1)]
    means = scored.groupBy("point").agg(F.round(split[0], 6).alias("train_nll"), F.round(split[1], 6).alias("validation_nll"), F.round(split[0] + split[1], 6).alias("score"))
    named = means.join(F.broadcast(grid), "point").drop("point")  # a row for each grid point
    return named.withColumn("rank", F.row_number().over(W.orderBy("score", "a", "q", "r")).cast("bigint"))


def false_continuation(spark, sf_dir):
    """Negative control: pairs of users filtered as one sequence; the state at the second's first step."""
    pair = F.floor(F.col("user_id") / 2).cast("bigint")
    rows = standard(spark, sf_dir).select(pair.alias("pair"), (F.col("user_id") * (1 << 32) + F.col("t")).alias("t"), "x", "seen")  # users one after the other
    both = filter_steps(ordered(rows, "pair", "t"), "pair", A, Q, R).where(F.col("t") % (1 << 32) == 0)
    return both.select("pair", F.floor(F.col("t") / (1 << 32)).cast("bigint").alias("user_id"), F.round("pm", 6).alias("pm"), F.round("m", 6).alias("m"))


def input_rollout(spark, sf_dir):
    """A state driven by each sequence, in Euler steps."""
    return euler_steps(_in_order(standard(spark, sf_dir)).withColumnRenamed("x", "u"), "user_id", *DRIVEN).select("user_id", "t", F.round("z", 7).alias("z"))


def input_secants(spark, sf_dir):
    """Forward difference quotients with the state and the input at their left."""
    w = _by_time()
    made = standard(spark, sf_dir).select("user_id", "t", "x", F.round((F.lead("x").over(w) - F.col("x")) / 0.05, 7).alias("dx"), F.col("seen").cast("int").alias("u"))
    return made.where("dx is not null")


def stationary_mean(spark, sf_dir):
    """The baseline that predicts the stationary mean, 0, at every step: its error and NLL."""
    var = Q / (1 - A * A) + R
    nll = F.avg((F.log(F.lit(2 * math.pi * var)) + F.pow("x", 2) / var) * 0.5)
    return standard(spark, sf_dir).where("seen").groupBy("user_id").agg(F.round(F.sqrt(F.avg(F.pow("x", 2))), 6).alias("rmse"), F.round(nll, 6).alias("nll"))


def persistence(spark, sf_dir):
    w = W.partitionBy("user_id").orderBy("t").rowsBetween(W.unboundedPreceding, 0)
    last = F.last(F.when(F.col("seen"), F.col("x")), ignorenulls=True).over(w)
    return standard(spark, sf_dir).select("user_id", "t", F.coalesce(last, F.lit(0.0)).alias("x_hat"))


def open_loop(spark, sf_dir):
    own = W.partitionBy("user_id")
    t0 = F.min(F.when(F.col("seen"), F.col("t"))).over(own)
    x0 = F.min_by("x", F.when(F.col("seen"), F.col("t"))).over(own)
    p0 = Q / (1 - A * A)
    hat = F.when(F.col("t") >= t0, F.pow(F.lit(A), F.col("t") - t0) * (p0 / (p0 + R)) * x0).otherwise(0.0)
    return standard(spark, sf_dir).select("user_id", "t", F.round(hat, 6).alias("x_hat"))


def open_loop_variance_horizons(spark, sf_dir):
    users = standard(spark, sf_dir).select("user_id").distinct()
    rows = users.crossJoin(F.broadcast(spark.createDataFrame([(h,) for h in (1, 10, 50, 100, 200)], "h int")))
    return rows.select("user_id", F.col("h").cast("bigint").alias("h"), F.round(open_loop_variance(A, Q, 0.0, F.col("h")), 8).alias("var"))


def _by_time():
    return W.partitionBy("user_id").orderBy("t")


def moving_average3(spark, sf_dir):
    w = _by_time()
    before, after = F.lag("x").over(w), F.lead("x").over(w)
    return standard(spark, sf_dir).select("user_id", "t", F.round(F.coalesce((before + F.col("x") + after) / 3, F.col("x")), 6).alias("x3"))


def central_derivative(spark, sf_dir):
    w = _by_time()
    made = standard(spark, sf_dir).select("user_id", "t", F.round((F.lead("x").over(w) - F.lag("x").over(w)) / 2, 8).alias("dx"), F.round(F.lead("x").over(w) - F.col("x"), 6).alias("forward"))
    return made.where("dx is not null")


def savgol5(spark, sf_dir):
    """Five-point cubic smoothing and derivative; edges give no row."""
    w = _by_time()
    at = {k: F.col("x") if k == 0 else (F.lag if k < 0 else F.lead)("x", abs(k)).over(w) for k in range(-2, 3)}
    smooth = sum((at[k] * c for k, c in zip(range(-2, 3), (-3.0, 12.0, 17.0, 12.0, -3.0), strict=True)), F.lit(0.0)) / 35
    slope = sum((at[k] * c for k, c in zip(range(-2, 3), (1.0, -8.0, 0.0, 8.0, -1.0), strict=True)), F.lit(0.0)) / 12
    return standard(spark, sf_dir).select("user_id", "t", F.round(smooth, 8).alias("smooth"), F.round(slope, 8).alias("slope")).where("smooth is not null")


def lag1_autocorrelation(spark, sf_dir):
    """Null with fewer than two adjacent seen pairs or without spread."""
    w = _by_time()
    pairs = standard(spark, sf_dir).select("user_id", "x", "seen", F.lag("x").over(w).alias("px"), F.lag("seen").over(w).alias("pseen")).where("seen and pseen")
    spread = (F.stddev_pop("x") > 1e-12) & (F.stddev_pop("px") > 1e-12) & (F.count("*") >= 2)
    return pairs.groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.when(spread, F.corr("x", "px")), 6).alias("rho"))


def shift_edge(spark, sf_dir):
    """Values two steps later; before the beginning the first value."""
    w = _by_time()
    return standard(spark, sf_dir).select("user_id", "t", F.coalesce(F.lag("x", 2).over(w), F.first("x").over(w)).alias("x2"))


def interval_coverage(spark, sf_dir):
    """Share of seen steps inside the filter's 95 % predictive interval, mean variance, squared error."""
    steps = _steps(spark, sf_dir).where("inn is not null")
    inside = (F.abs("inn") <= 1.959963984540054 * F.sqrt("s")).cast("double")
    return steps.groupBy("user_id").agg(F.round(F.avg(inside), 6).alias("coverage"), F.round(F.sqrt(F.avg(F.col("inn") * F.col("inn"))), 6).alias("rmse"), F.round(F.avg("v"), 6).alias("mean_var"))


def unwrapped_span(spark, sf_dir):
    """Range of the unwrapped angle of (x, next x) along each user's sequence."""
    w, run = _by_time(), _by_time().rowsBetween(W.unboundedPreceding, 0)
    angle = standard(spark, sf_dir).select("user_id", "t", F.atan2("x", F.lead("x").over(w)).alias("a")).where("a is not null")
    step = F.col("a") - F.lag("a").over(w)
    wrapped = let_wrapped(step)
    turned = angle.select("user_id", "t", F.coalesce(wrapped, F.lit(0.0)).alias("d")).select("user_id", F.sum("d").over(run).alias("u"))
    return turned.groupBy("user_id").agg(F.round(F.max("u") - F.min("u"), 5).alias("span"))


def let_wrapped(step):
    """An angle difference moved into (-pi, pi]."""
    return step - 2 * math.pi * F.ceil((step - math.pi) / (2 * math.pi))


QUERIES = {
    f.__name__: f
    for f in (
        kalman_filter_final, kalman_filter_steps, rts_smoother, lgssm_grid_select, false_continuation, persistence, open_loop, open_loop_variance_horizons,
        moving_average3, central_derivative, savgol5, lag1_autocorrelation, shift_edge, interval_coverage, unwrapped_span, input_rollout, input_secants, stationary_mean,
    )
}

STANDARD = """
z AS MATERIALIZED (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS t,
  round((value - avg(value) OVER (PARTITION BY user_id)) / CASE WHEN stddev_pop(value) OVER (PARTITION BY user_id) > 1e-12 THEN stddev_pop(value) OVER (PARTITION BY user_id) ELSE 1 END, 6) AS x,
  event_type <> 'error' AS seen FROM events)"""


def _filter(source: str = "z", key: str = "user_id", keep: str = "", a: str = str(A), q: str = str(Q), r: str = str(R), seen: str = "seen") -> str:
    """Recursive filter CTE ``f`` over (key, t, x, seen)."""
    cols = f"{key}{keep}"
    pick = ", ".join(f"z.{c.strip()}" for c in cols.split(","))
    return f"""
f AS (
  SELECT {cols}, t, 0.0::DOUBLE AS pm, ({q}::DOUBLE / (1 - {a}::DOUBLE * {a}::DOUBLE)) AS pv, x, {seen} AS seen,
    CASE WHEN {seen} THEN ({q}::DOUBLE / (1 - {a}::DOUBLE * {a}::DOUBLE)) / (({q}::DOUBLE / (1 - {a}::DOUBLE * {a}::DOUBLE)) + {r}::DOUBLE) * x ELSE 0 END AS m,
    CASE WHEN {seen} THEN (1 - ({q}::DOUBLE / (1 - {a}::DOUBLE * {a}::DOUBLE)) / (({q}::DOUBLE / (1 - {a}::DOUBLE * {a}::DOUBLE)) + {r}::DOUBLE)) * ({q}::DOUBLE / (1 - {a}::DOUBLE * {a}::DOUBLE)) ELSE ({q}::DOUBLE / (1 - {a}::DOUBLE * {a}::DOUBLE)) END AS v
  FROM {source} AS z WHERE t = 0
  UNION ALL
  SELECT {cols}, t, pm, pv, x, seen, CASE WHEN seen THEN pm + pv / (pv + rr) * (x - pm) ELSE pm END, CASE WHEN seen THEN (1 - pv / (pv + rr)) * pv ELSE pv END
  FROM (SELECT {pick}, z.t, {a.replace('a', 'z.a') if a == 'a' else a + '::DOUBLE'} * f.m AS pm, {('z.a * z.a') if a == 'a' else a + '::DOUBLE * ' + a + '::DOUBLE'} * f.v + {('z.q') if q == 'q' else q + '::DOUBLE'} AS pv, {('z.r') if r == 'r' else r + '::DOUBLE'} AS rr, z.x, z.{seen} AS seen
        FROM f JOIN {source} AS z ON z.t = f.t + 1 AND {' AND '.join(f'z.{c.strip()} = f.{c.strip()}' for c in cols.split(','))})
)"""


_NLL = f"CASE WHEN seen THEN 0.5 * (ln(2 * pi() * (pv + {R})) + (x - pm) * (x - pm) / (pv + {R})) END"

ORACLES = {
    "kalman_filter_steps": f"WITH RECURSIVE {STANDARD}, {_filter()} SELECT user_id, t, round(pm, 6) AS pm, round(pv, 6) AS pv, round(m, 6) AS m, round(v, 6) AS v, CASE WHEN seen THEN round(x - pm, 6) END AS inn, round({_NLL}, 6) AS nll FROM f",
    "kalman_filter_final": f"WITH RECURSIVE {STANDARD}, {_filter()} SELECT user_id, count(*) AS n_steps, round(arg_max(m, t), 6) AS mean, round(arg_max(v, t), 6) AS var, round(sum({_NLL}), 5) AS nll FROM f GROUP BY user_id",
    "rts_smoother": f"""WITH RECURSIVE {STANDARD}, {_filter()}, n AS (SELECT user_id, max(t) AS last FROM f GROUP BY user_id), g AS (
  SELECT f.user_id, t, m AS sm, v AS sv, pm, pv FROM f JOIN n ON n.user_id = f.user_id AND f.t = last
  UNION ALL SELECT f.user_id, f.t, f.m + f.v * {A} / g.pv * (g.sm - g.pm), f.v + (f.v * {A} / g.pv) * (f.v * {A} / g.pv) * (g.sv - g.pv), f.pm, f.pv FROM g JOIN f ON f.user_id = g.user_id AND f.t = g.t - 1)
SELECT user_id, t, round(sm, 6) AS sm, round(sv, 6) AS sv FROM g""",
    "lgssm_grid_select": f"""WITH RECURSIVE {STANDARD}, c AS MATERIALIZED (SELECT z.user_id, z.t, z.x, z.seen, a, q, r FROM z, (SELECT unnest([0.70, 0.85, 0.95])::DOUBLE AS a), (SELECT unnest([0.05, 0.10, 0.20])::DOUBLE AS q), (SELECT unnest([0.20, 0.40, 0.80])::DOUBLE AS r) WHERE user_id % 3 < 2),
{_filter("c", "user_id", ", a, q, r", "a", "q", "r")}, s AS (SELECT a, q, r, user_id % 3 AS k, 0.5 * (ln(2 * pi() * (pv + r)) + (x - pm) * (x - pm) / (pv + r)) AS nll FROM f WHERE seen), w AS (SELECT a, q, r, avg(nll) FILTER (k = 0) AS tr, avg(nll) FILTER (k = 1) AS va FROM s GROUP BY a, q, r)
SELECT a, q, r, round(tr, 6) AS train_nll, round(va, 6) AS validation_nll, round(tr + va, 6) AS score, row_number() OVER (ORDER BY round(tr + va, 6), a, q, r) AS rank FROM w""",
    "false_continuation": f"WITH RECURSIVE {STANDARD}, c AS MATERIALIZED (SELECT user_id // 2 AS pair, user_id, t AS t0, row_number() OVER (PARTITION BY user_id // 2 ORDER BY user_id, t) - 1 AS t, x, seen FROM z), {_filter('c', 'pair')} SELECT c.pair, c.user_id, round(pm, 6) AS pm, round(m, 6) AS m FROM f JOIN c ON c.pair = f.pair AND c.t = f.t WHERE t0 = 0",
    "persistence": f"WITH {STANDARD} SELECT user_id, t, coalesce(last_value(CASE WHEN seen THEN x END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS x_hat FROM z",
    "open_loop": f"WITH {STANDARD}, s AS (SELECT user_id, min(t) AS t0, arg_min(x, t) AS x0 FROM z WHERE seen GROUP BY user_id) SELECT user_id, t, round(CASE WHEN t >= t0 THEN pow({A}, t - t0) * {Q / (1 - A * A)!r} / ({Q / (1 - A * A)!r} + {R}) * x0 ELSE 0 END, 6) AS x_hat FROM z LEFT JOIN s USING (user_id)",
    "open_loop_variance_horizons": f"SELECT user_id, h::BIGINT AS h, round({Q} * (1 - pow({A} * {A}, h)) / (1 - {A} * {A}), 8) AS var FROM (SELECT DISTINCT user_id FROM events), (SELECT unnest([1, 10, 50, 100, 200]) AS h)",
    "moving_average3": f"WITH {STANDARD} SELECT user_id, t, round(coalesce((lag(x) OVER w + x + lead(x) OVER w) / 3, x), 6) AS x3 FROM z WINDOW w AS (PARTITION BY user_id ORDER BY t)",
    "central_derivative": f"WITH {STANDARD}, d AS (SELECT user_id, t, round((lead(x) OVER w - lag(x) OVER w) / 2, 8) AS dx, round(lead(x) OVER w - x, 6) AS forward FROM z WINDOW w AS (PARTITION BY user_id ORDER BY t)) SELECT * FROM d WHERE dx IS NOT NULL",
    "savgol5": f"WITH {STANDARD}, d AS (SELECT user_id, t, round((-3 * lag(x, 2) OVER w + 12 * lag(x) OVER w + 17 * x + 12 * lead(x) OVER w - 3 * lead(x, 2) OVER w) / 35, 8) AS smooth, round((lag(x, 2) OVER w - 8 * lag(x) OVER w + 8 * lead(x) OVER w - lead(x, 2) OVER w) / 12, 8) AS slope FROM z WINDOW w AS (PARTITION BY user_id ORDER BY t)) SELECT * FROM d WHERE smooth IS NOT NULL",
    "lag1_autocorrelation": f"WITH {STANDARD}, d AS (SELECT user_id, x, seen, lag(x) OVER w AS px, lag(seen) OVER w AS pseen FROM z WINDOW w AS (PARTITION BY user_id ORDER BY t)) SELECT user_id, count(*) AS n, round(CASE WHEN stddev_pop(x) > 1e-12 AND stddev_pop(px) > 1e-12 AND count(*) >= 2 THEN corr(x, px) END, 6) AS rho FROM d WHERE seen AND pseen GROUP BY user_id",
    "shift_edge": f"WITH {STANDARD} SELECT user_id, t, coalesce(lag(x, 2) OVER w, first_value(x) OVER w) AS x2 FROM z WINDOW w AS (PARTITION BY user_id ORDER BY t)",
    "interval_coverage": f"WITH RECURSIVE {STANDARD}, {_filter()} SELECT user_id, round(avg((abs(x - pm) <= 1.959963984540054 * sqrt(pv + {R}))::INT), 6) AS coverage, round(sqrt(avg((x - pm) * (x - pm))), 6) AS rmse, round(avg(v), 6) AS mean_var FROM f WHERE seen GROUP BY user_id",
    "unwrapped_span": f"WITH {STANDARD}, a AS (SELECT user_id, t, atan2(x, lead(x) OVER (PARTITION BY user_id ORDER BY t)) AS a FROM z), d AS (SELECT user_id, t, a - lag(a) OVER (PARTITION BY user_id ORDER BY t) AS s FROM a WHERE a IS NOT NULL), u AS (SELECT user_id, sum(coalesce(s - 2 * pi() * ceil((s - pi()) / (2 * pi())), 0)) OVER (PARTITION BY user_id ORDER BY t) AS u FROM d) SELECT user_id, round(max(u) - min(u), 5) AS span FROM u GROUP BY user_id",
    "input_rollout": f"WITH RECURSIVE {STANDARD}, g AS (SELECT user_id, t, x, 0::DOUBLE AS z FROM z WHERE t = 0 UNION ALL SELECT z.user_id, z.t, z.x, g.z + {DRIVEN[2]}::DOUBLE * ({DRIVEN[0]}::DOUBLE * g.z + {DRIVEN[1]}::DOUBLE * g.x) FROM g JOIN z ON z.user_id = g.user_id AND z.t = g.t + 1) SELECT user_id, t, round(z, 7) AS z FROM g",
    "input_secants": f"WITH {STANDARD}, d AS (SELECT user_id, t, x, round((lead(x) OVER (PARTITION BY user_id ORDER BY t) - x) / 0.05::DOUBLE, 7) AS dx, seen::INT AS u FROM z) SELECT * FROM d WHERE dx IS NOT NULL",
    "stationary_mean": f"WITH {STANDARD} SELECT user_id, round(sqrt(avg(x * x)), 6) AS rmse, round(avg(0.5 * (ln(2 * pi() * {Q / (1 - A * A) + R!r}) + x * x / {Q / (1 - A * A) + R!r})), 6) AS nll FROM z WHERE seen GROUP BY user_id",
}
