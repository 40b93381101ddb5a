"""Multichannel sequences over ``events``: a step is a user's day, a channel an event type, its value the day's mean
standardised over the whole table; a type without events that day is masked. Gaps between days are the steps' gaps.

Filter, smoother and path covariance of the latents; the posterior and likelihood of hidden entries by precisions;
and the methods that infer hidden entries, side by side.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenframe.functions.scans import ordered
from lumenframe.functions.state_space import Model, channel_mean, channel_variance, eliminate_channels, filter_channels, smooth_channels, solve_channels
from lumenframe.sources.tables import table

CHANNELS = ("click", "error", "purchase", "signup", "view")
#: Two latents, one slow and one fast, by day.
MODEL = Model((0.9, 0.6), ((0.8, 0.3), (0.5, -0.6), (0.2, 0.7), (-0.6, 0.4), (0.7, 0.5)), (0.5, 0.6, 0.7, 0.8, 0.9))
LAGS = 3
Z95 = 1.959963984540054


def channel_steps(spark, sf_dir) -> DataFrame:
    """user_id, t (from 0), gap (days; 1 at the first), y: the channels' values, null where masked. Dealt by user and in order."""
    events = table(spark, sf_dir, "events").where("user_id is not null and ts is not null")
    of = [F.when(F.col("event_type") == c, F.col("value")) for c in CHANNELS]
    scale = events.agg(*(F.avg(v).alias(f"m{k}") for k, v in enumerate(of)), *(F.stddev_pop(v).alias(f"s{k}") for k, v in enumerate(of)))  # one row
    days = events.groupBy("user_id", F.to_date("ts").alias("day")).agg(*(F.avg(v).alias(f"v{k}") for k, v in enumerate(of)))
    by_day = W.partitionBy("user_id").orderBy("day")
    y = F.array(*(F.round((F.col(f"v{k}") - F.col(f"m{k}")) / F.when(F.col(f"s{k}") > 1e-12, F.col(f"s{k}")).otherwise(1.0), 6) for k in range(len(CHANNELS))))
    # Windows deal by user before the one row of scales is joined, which is sent to all tasks.
    steps = days.select("*", (F.row_number().over(by_day) - 1).cast("long").alias("t"), F.coalesce(F.datediff("day", F.lag("day").over(by_day)), F.lit(1)).cast("long").alias("gap"))
    return ordered(steps.crossJoin(F.broadcast(scale)).select("user_id", "t", "gap", y.alias("y")), "user_id", "t", dealt=True)


def hide(steps: DataFrame) -> DataFrame:
    """Adds ``seen``: y with entries hidden; of users with even ids blocks of three steps in eight, of the others one channel throughout."""
    own = F.pmod(F.floor(F.col("user_id") / 2), F.lit(len(CHANNELS)))
    gone = F.when(F.pmod("user_id", F.lit(2)) == 0, F.pmod("t", F.lit(8)).between(3, 5))
    kept = [F.when(~F.coalesce(gone, own == c), F.col("y")[c]) for c in range(len(CHANNELS))]
    return steps.withColumn("seen", F.array(*kept))


def _round(frame: DataFrame, keys: tuple[str, ...], digits: int = 6, **columns) -> DataFrame:
    return frame.select(*keys, *(F.round(c, digits).alias(n) for n, c in columns.items()))


def _moments(m: str, p: str) -> dict:
    return {"m1": F.col(m)[0], "m2": F.col(m)[1], "v1": F.col(p)[0], "v2": F.col(p)[3], "c12": F.col(p)[1]}


def multichannel_filter(spark, sf_dir):
    """Means and covariance of the latents given all up to a step, and the step's NLL."""
    done = filter_channels(channel_steps(spark, sf_dir), "user_id", MODEL)
    return _round(done, ("user_id", "t", "n_seen"), **_moments("m", "p"), nll=F.col("nll"))


def multichannel_smoother(spark, sf_dir):
    """Means and covariance of the latents given the whole sequence."""
    filtered = filter_channels(channel_steps(spark, sf_dir), "user_id", MODEL)
    return _round(smooth_channels(filtered, "user_id", MODEL), ("user_id", "t"), **_moments("sm", "sp"))


def path_covariance(spark, sf_dir):
    """Posterior covariance of a step's latents with those of up to LAGS steps later."""
    filtered = filter_channels(channel_steps(spark, sf_dir), "user_id", MODEL)
    rows = smooth_channels(filtered, "user_id", MODEL, LAGS).select("user_id", "t", F.posexplode("lags").alias("k", "c"))
    return _round(rows.withColumn("lag", (F.col("k") + 1).cast("long")), ("user_id", "t", "lag"), **{f"c{i + 1}{j + 1}": F.col("c")[i * 2 + j] for i in range(2) for j in range(2)})


def _posterior(steps: DataFrame, model: Model, y: str = "seen") -> DataFrame:
    """user_id, t, sm, sp given the entries in ``y``, by precisions."""
    return solve_channels(eliminate_channels(steps.select("user_id", "t", "gap", F.col(y).alias("y")), "user_id", model), "user_id", model)


def _hidden(steps: DataFrame, post: DataFrame, model: Model) -> DataFrame:
    """user_id, t, channel, region, x (the hidden value), mean, var of every hidden entry. Both sides are dealt by user."""
    at = F.posexplode(F.array(*(F.struct(F.col("y")[c].alias("x"), (F.col("y")[c].isNotNull() & F.col("seen")[c].isNull()).alias("gone"), channel_mean(model, c).alias("mean"), channel_variance(model, c).alias("var")) for c in range(len(model.noise))))).alias("channel", "e")
    rows = steps.select("user_id", "t", "y", "seen").join(post, ["user_id", "t"]).select("user_id", "t", at).where("e.gone")
    region = F.when(F.pmod("user_id", F.lit(2)) == 0, "block").otherwise("channel").alias("region")
    return rows.select("user_id", "t", "channel", region, "e.x", "e.mean", "e.var")


def hidden_posterior(spark, sf_dir):
    """Mean and variance of each hidden entry given the seen ones of its whole sequence."""
    steps = hide(channel_steps(spark, sf_dir))
    rows = _hidden(steps, _posterior(steps, MODEL), MODEL)
    names = F.element_at(F.array(*(F.lit(c) for c in CHANNELS)), F.col("channel") + 1)
    return _round(rows.withColumn("event_type", names), ("user_id", "t", "event_type", "region", "x"), mean=F.col("mean"), var=F.col("var"))


def sequence_nll(steps: DataFrame, model: Model, y: str) -> DataFrame:
    """user_id and the NLL of its values in ``y``, by precisions."""
    done = eliminate_channels(steps.select("user_id", "t", "gap", F.col(y).alias("y")), "user_id", model)
    return done.groupBy("user_id").agg((F.sum("part") + F.max_by("tail", "t")).alias("nll"))


def hidden_nll(spark, sf_dir):
    """NLL of a user's hidden entries given the seen ones: that of all less that of the seen."""
    steps = hide(channel_steps(spark, sf_dir))
    counts = lambda c: F.sum(F.size(F.filter(c, lambda x: x.isNotNull()))).cast("long")
    n = steps.groupBy("user_id").agg(counts("y").alias("n"), counts("seen").alias("n_seen"))
    both = n.join(sequence_nll(steps, MODEL, "y").withColumnRenamed("nll", "every"), "user_id").join(sequence_nll(steps, MODEL, "seen").withColumnRenamed("nll", "seen"), "user_id")
    return _round(both, ("user_id", "n", "n_seen"), 5, nll_all=F.col("every"), nll_seen=F.col("seen"), nll_hidden=F.col("every") - F.col("seen"))


def _alone(model: Model, rate: float) -> Model:
    """Each channel as a process of its own with the channel's signal variance."""
    n = len(model.noise)
    size = [math.sqrt(sum(w * w for w in h)) for h in model.loading]
    return Model((rate,) * n, tuple(tuple(size[c] if c == j else 0.0 for j in range(n)) for c in range(n)), model.noise)


def _independent(model: Model) -> Model:
    """No latents: a channel's mean 0 and its whole variance."""
    return Model((0.0,), tuple((0.0,) for _ in model.noise), tuple(r + sum(w * w for w in h) for r, h in zip(model.noise, model.loading, strict=True)))


#: The same inference under other models: right, one common rate, rates in the wrong order, no memory (a static
#: factor model: a step's own channels only), each channel alone, and each channel's mean and variance.
METHODS = {
    "known": MODEL, "common_rate": MODEL._replace(rates=(0.75, 0.75)), "wrong_rates": MODEL._replace(rates=MODEL.rates[::-1]), "static_factor": MODEL._replace(rates=(0.0, 0.0)),
    "independent_channel": _alone(MODEL, 0.8), "mean_diagonal": _independent(MODEL),
}


def two_stage(steps: DataFrame, model: Model, rate: float = 0.8) -> DataFrame:
    """user_id, t, sm (channels): each channel smoothed alone, then brought onto the factors and back."""
    alone = _alone(model, rate)
    load = np.array(model.loading)
    back = load @ load.T @ np.linalg.inv(load @ load.T + np.diag(model.noise))  # channels x channels
    smooth = _posterior(steps, alone)
    signal = [channel_mean(alone, c) for c in range(len(model.noise))]
    return smooth.select("user_id", "t", F.array(*(sum((s * float(w) for s, w in zip(signal, row, strict=True)), F.lit(0.0)) for row in back)).alias("sm"))


def hidden_methods(spark, sf_dir):
    """Hidden entries inferred by each method: error, share inside the 95 % interval, mean variance, mean NLL of an
    entry by itself, by region. The two-stage method has no variance."""
    steps = hide(channel_steps(spark, sf_dir))
    parts = [_hidden(steps, _posterior(steps, m), m).withColumn("method", F.lit(name)) for name, m in METHODS.items()]
    flat = Model((0.0,) * len(CHANNELS), tuple(tuple(float(i == j) for j in range(len(CHANNELS))) for i in range(len(CHANNELS))), (0.0,) * len(CHANNELS))
    staged = two_stage(steps, MODEL).withColumn("sp", F.array_repeat(F.lit(None).cast("double"), len(CHANNELS) ** 2))
    parts.append(_hidden(steps, staged, flat).withColumn("method", F.lit("two_stage")))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    e = F.col("x") - F.col("mean")
    inside = F.when(F.col("var").isNotNull(), (F.abs(e) <= Z95 * F.sqrt("var")).cast("double"))
    g = every.groupBy("method", "region").agg(F.count("*").alias("n"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(inside).alias("coverage"), F.avg("var").alias("mean_var"), F.avg((F.log(2 * math.pi * F.col("var")) + e * e / F.col("var")) * 0.5).alias("nll"))
    return _round(g, ("method", "region", "n"), rmse=F.col("rmse"), coverage=F.col("coverage"), mean_var=F.col("mean_var"), nll=F.col("nll"))


QUERIES = {f.__name__: f for f in (multichannel_filter, multichannel_smoother, path_covariance, hidden_posterior, hidden_nll, hidden_methods)}

# SQL: the same by recursion over rows, two latents written out.

_N = range(len(CHANNELS))
STEPS_SQL = f"""
e AS (SELECT *, CAST(ts AS DATE) AS day FROM events),
q AS (SELECT {", ".join(f"avg(value) FILTER (event_type = '{c}') AS m{k}, stddev_pop(value) FILTER (event_type = '{c}') AS s{k}" for k, c in enumerate(CHANNELS))} FROM e),
v AS (SELECT user_id, day, {", ".join(f"avg(value) FILTER (event_type = '{c}') AS v{k}" for k, c in enumerate(CHANNELS))} FROM e GROUP BY user_id, day),
y AS MATERIALIZED (SELECT user_id, row_number() OVER w - 1 AS t, coalesce(day - lag(day) OVER w, 1) AS gap, {", ".join(f"round((v{k} - m{k}) / CASE WHEN s{k} > 1e-12 THEN s{k} ELSE 1 END, 6) AS y{k}" for k in _N)} FROM v, q WINDOW w AS (PARTITION BY user_id ORDER BY day))"""
HIDDEN_SQL = f"""
x AS MATERIALIZED (SELECT user_id, t, gap, {", ".join(f"CASE WHEN (user_id % 2 = 0 AND t % 8 BETWEEN 3 AND 5) OR (user_id % 2 = 1 AND (user_id // 2) % {len(CHANNELS)} = {k} ) THEN NULL ELSE y{k} END AS y{k}" for k in _N)} FROM y)"""


def _filter_sql(source: str, name: str, model: Model) -> str:
    (r1, r2), ys = model.rates, ", ".join(f"y{k}" for k in _N)

    def made(prior: str) -> str:
        """Channel after channel, each two nested selects: DuckDB would write a name's expression out wherever it is used."""
        sql = f"SELECT *, pm1 AS m1, pm2 AS m2, pa AS a, pb AS b, pd AS d, 0::DOUBLE AS nll FROM ({prior})"
        for k, ((h1, h2), r) in enumerate(zip(model.loading, model.noise, strict=True)):
            sql = f"SELECT *, a * ({h1}) + b * ({h2}) AS u1, b * ({h1}) + d * ({h2}) AS u2, y{k} - ({h1}) * m1 - ({h2}) * m2 AS e FROM ({sql})"
            sql = f"SELECT *, ({h1}) * u1 + ({h2}) * u2 + {r} AS s FROM ({sql})"
            new = ", ".join(f"CASE WHEN y{k} IS NULL THEN {c} ELSE {c} {change} END AS {c}" for c, change in (("m1", "+ u1 / s * e"), ("m2", "+ u2 / s * e"), ("a", "- u1 * u1 / s"), ("b", "- u1 * u2 / s"), ("d", "- u2 * u2 / s"), ("nll", "+ 0.5 * (ln(2 * pi() * s) + e * e / s)")))
            sql = f"SELECT * EXCLUDE (u1, u2, s, e) REPLACE ({new}) FROM ({sql})"
        return f"SELECT user_id, t, gap, {ys}, pm1, pm2, pa, pb, pd, m1, m2, a, b, d, nll FROM ({sql})"

    z = ", ".join(f"z.y{k}" for k in _N)
    return f"""{name} AS (
  {made(f"SELECT user_id, t, gap, {ys}, 0::DOUBLE AS pm1, 0::DOUBLE AS pm2, 1::DOUBLE AS pa, 0::DOUBLE AS pb, 1::DOUBLE AS pd FROM {source} WHERE t = 0")}
  UNION ALL
  {made(f"""SELECT z.user_id, z.t, z.gap, {z}, pow({r1}::DOUBLE, z.gap) * m1 AS pm1, pow({r2}::DOUBLE, z.gap) * m2 AS pm2, pow({r1}::DOUBLE, 2 * z.gap) * a + 1 - pow({r1}::DOUBLE, 2 * z.gap) AS pa,
    pow({r1 * r2}::DOUBLE, z.gap) * b AS pb, pow({r2}::DOUBLE, 2 * z.gap) * d + 1 - pow({r2}::DOUBLE, 2 * z.gap) AS pd FROM {name} JOIN {source} z ON z.user_id = {name}.user_id AND z.t = {name}.t + 1""")})"""


def _smoother_sql(filtered: str, name: str, model: Model) -> str:
    r1, r2 = model.rates
    return f"""{name} AS (
  SELECT user_id, t, gap, pm1, pm2, pa, pb, pd, m1 AS s1, m2 AS s2, a AS sa, b AS sb, d AS sd, 0::DOUBLE AS j11, 0::DOUBLE AS j12, 0::DOUBLE AS j21, 0::DOUBLE AS j22 FROM {filtered} JOIN (SELECT user_id, max(t) AS t FROM {filtered} GROUP BY user_id) USING (user_id, t)
  UNION ALL
  SELECT user_id, t, gap, pm1, pm2, pa, pb, pd, m1 + j11 * (o1 - om1) + j12 * (o2 - om2), m2 + j21 * (o1 - om1) + j22 * (o2 - om2),
    a + (j11 * ea + j12 * eb) * j11 + (j11 * eb + j12 * ed) * j12, b + (j11 * ea + j12 * eb) * j21 + (j11 * eb + j12 * ed) * j22, d + (j21 * ea + j22 * eb) * j21 + (j21 * eb + j22 * ed) * j22, j11, j12, j21, j22
  FROM (SELECT f.*, pow({r1}::DOUBLE, g.gap) AS w1, pow({r2}::DOUBLE, g.gap) AS w2, g.pa * g.pd - g.pb * g.pb AS det, g.s1 AS o1, g.s2 AS o2, g.pm1 AS om1, g.pm2 AS om2, g.sa - g.pa AS ea, g.sb - g.pb AS eb, g.sd - g.pd AS ed,
    (f.a * w1 * g.pd - f.b * w2 * g.pb) / det AS j11, (f.b * w2 * g.pa - f.a * w1 * g.pb) / det AS j12, (f.b * w1 * g.pd - f.d * w2 * g.pb) / det AS j21, (f.d * w2 * g.pa - f.b * w1 * g.pb) / det AS j22
    FROM {name} g JOIN {filtered} f ON f.user_id = g.user_id AND f.t = g.t - 1))"""


def _lag_sql(k: int) -> str:
    """Of lag k from lag k - 1: the step's gain times the covariance of the next step with the one k - 1 after it."""
    before = "SELECT user_id, t, sa AS c11, sb AS c12, sb AS c21, sd AS c22 FROM s" if k == 1 else f"SELECT * FROM k{k - 1}"
    return f"k{k} AS (SELECT s.user_id, s.t, j11 * c11 + j12 * c21 AS c11, j11 * c12 + j12 * c22 AS c12, j21 * c11 + j22 * c21 AS c21, j21 * c12 + j22 * c22 AS c22 FROM s JOIN ({before}) o ON o.user_id = s.user_id AND o.t = s.t + 1)"


_KEEP = "round(s1, 6) AS m1, round(s2, 6) AS m2, round(sa, 6) AS v1, round(sd, 6) AS v2, round(sb, 6) AS c12"
_ENTRIES = " UNION ALL ".join(
    f"SELECT s.user_id, s.t, '{c}' AS event_type, CASE WHEN s.user_id % 2 = 0 THEN 'block' ELSE 'channel' END AS region, y.y{k} AS x, ({h1}) * s1 + ({h2}) * s2 AS mean, ({h1 * h1}) * sa + 2 * ({h1 * h2}) * sb + ({h2 * h2}) * sd + {r} AS var FROM s JOIN y USING (user_id, t) JOIN x USING (user_id, t) WHERE y.y{k} IS NOT NULL AND x.y{k} IS NULL"
    for k, (c, (h1, h2), r) in enumerate(zip(CHANNELS, MODEL.loading, MODEL.noise, strict=True))
)
_COUNT = lambda t: " + ".join(f"({t}.y{k} IS NOT NULL)::INT" for k in _N)

ORACLES = {
    "multichannel_filter": f"WITH RECURSIVE {STEPS_SQL}, {_filter_sql('y', 'f', MODEL)} SELECT user_id, t, ({_COUNT('f')})::INT AS n_seen, round(m1, 6) AS m1, round(m2, 6) AS m2, round(a, 6) AS v1, round(d, 6) AS v2, round(b, 6) AS c12, round(nll, 6) AS nll FROM f",
    "multichannel_smoother": f"WITH RECURSIVE {STEPS_SQL}, {_filter_sql('y', 'f', MODEL)}, {_smoother_sql('f', 's', MODEL)} SELECT user_id, t, {_KEEP} FROM s",
    "path_covariance": f"WITH RECURSIVE {STEPS_SQL}, {_filter_sql('y', 'f', MODEL)}, {_smoother_sql('f', 's', MODEL)}, {', '.join(_lag_sql(k + 1) for k in range(LAGS))} "
    + " UNION ALL ".join(f"SELECT user_id, t, {k + 1}::BIGINT AS lag, round(c11, 6) AS c11, round(c12, 6) AS c12, round(c21, 6) AS c21, round(c22, 6) AS c22 FROM k{k + 1}" for k in range(LAGS)),
    "hidden_posterior": f"WITH RECURSIVE {STEPS_SQL}, {HIDDEN_SQL}, {_filter_sql('x', 'f', MODEL)}, {_smoother_sql('f', 's', MODEL)} SELECT user_id, t, event_type, region, x, round(mean, 6) AS mean, round(var, 6) AS var FROM ({_ENTRIES})",
    "hidden_nll": f"WITH RECURSIVE {STEPS_SQL}, {HIDDEN_SQL}, {_filter_sql('x', 'f', MODEL)}, {_filter_sql('y', 'g', MODEL)} SELECT user_id, n::BIGINT AS n, n_seen::BIGINT AS n_seen, round(every, 5) AS nll_all, round(seen, 5) AS nll_seen, round(every - seen, 5) AS nll_hidden FROM (SELECT user_id, sum(nll) AS every, sum({_COUNT('g')}) AS n FROM g GROUP BY user_id) JOIN (SELECT user_id, sum(nll) AS seen, sum({_COUNT('f')}) AS n_seen FROM f GROUP BY user_id) USING (user_id)",
}
