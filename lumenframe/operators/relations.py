"""Scalar expressions, keyed joins, set checks and grouped reports, each with its SQL.

Sequences are the standardised ones of ``sequence.standard``; result rows are those of ``plans.status``.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenframe.functions.ranks import row_numbers, value_ranks
from lumenframe.operators.graph import _TOP, pairwise_topk
from lumenframe.operators.moments import DIMS, long_vectors
from lumenframe.operators.sequence import STANDARD, persistence, standard
from lumenframe.operators.summary import _RATES, synthesis_rates
from lumenframe.plans.status import RESULTS, results
from lumenframe.sources.tables import table

BLOCK = (20, 35)
AFFINE = (2.5, -0.75)
TAU, NUGGET, LAGS = 5.0, 0.02, 24


# Scalar expressions


def affine_apply(spark, sf_dir):
    a, b = AFFINE
    return standard(spark, sf_dir).select("user_id", "t", F.round(F.col("x") * a + b, 9).alias("y"))


def inverse_standardize(spark, sf_dir):
    """Standardised entries taken back; the largest gap to what they were, by label."""
    rows = long_vectors(spark, sf_dir)
    m = rows.groupBy("label", "i").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("sd"))
    scale = F.when(F.col("sd") > 1e-12, F.col("sd")).otherwise(1.0)
    z = rows.join(m, ["label", "i"]).withColumn("z", (F.col("v") - F.col("mean")) / scale)
    back = F.col("z") * scale + F.col("mean")
    return z.groupBy("label").agg(F.round(F.avg(back), 7).alias("mean"), F.max(F.abs(back - F.col("v")) < 1e-9).alias("equal"))


def unit_vectors(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda e: e.cast("double")).alias("x"))
    norm = F.sqrt(F.aggregate("x", F.lit(0.0), lambda s, e: s + e * e))
    return v.select("vec_id", F.posexplode(F.transform("x", lambda e: e / norm)).alias("i", "u")).select("vec_id", F.col("i").cast("bigint").alias("i"), F.round("u", 7).alias("u"))


def label_angles(spark, sf_dir):
    """Degrees between a label's mean vector and the mean of all vectors."""
    rows = long_vectors(spark, sf_dir)
    own, whole = rows.groupBy("label", "i").agg(F.avg("v").alias("a")), rows.groupBy("i").agg(F.avg("v").alias("b"))
    cos = F.sum(F.col("a") * F.col("b")) / F.sqrt(F.sum(F.col("a") * F.col("a")) * F.sum(F.col("b") * F.col("b")))
    return own.join(F.broadcast(whole), "i").groupBy("label").agg(F.round(F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cos)))), 5).alias("angle"))


def kernels(spark, sf_dir):
    """Squared-exponential kernel with a nugget, and its first-order form, over lags of a short grid."""
    n = spark.range(LAGS)
    rho = (1 - NUGGET) * F.exp(F.lit(-0.5 / TAU**2))
    lag = F.abs(F.col("i") - F.col("j"))
    pairs = n.select(F.col("id").alias("i")).crossJoin(F.broadcast(n.select(F.col("id").alias("j"))))  # a grid of LAGS points
    se = (1 - NUGGET) * F.exp(-0.5 * F.pow(lag / TAU, 2)) + F.when(lag == 0, NUGGET).otherwise(0.0)
    return pairs.select("i", "j", F.round(se, 9).alias("se"), F.round(F.pow(rho, lag), 9).alias("ar"))


def time_third_means(spark, sf_dir):
    """Means over thirds of each sequence; the first thirds take what is left over."""
    s = standard(spark, sf_dir)
    n = s.groupBy("user_id").agg(F.count("*").alias("n"))
    q, r, t = F.expr("n div 3"), F.col("n") % 3, F.col("t")
    third = F.when(t < (q + 1) * r, F.floor(t / (q + 1))).otherwise(r + F.floor((t - (q + 1) * r) / q))
    return s.join(n, "user_id").groupBy("user_id", third.cast("bigint").alias("third")).agg(F.round(F.avg("x"), 8).alias("mean"), F.count("*").alias("n"))


def region_errors(spark, sf_dir):
    """Persistence error inside a block of steps, a half-open interval, and outside it."""
    a, b = BLOCK
    made = persistence(spark, sf_dir).join(standard(spark, sf_dir), ["user_id", "t"])
    region = F.when((F.col("t") >= a) & (F.col("t") < b), "inside").otherwise("outside")
    return made.groupBy("user_id", region.alias("region")).agg(F.count("*").alias("n"), F.round(F.sqrt(F.avg(F.pow(F.col("x_hat") - F.col("x"), 2))), 6).alias("rmse"))


def observation_masks(spark, sf_dir):
    """Steps that a mask hides, by user: a block, every fifth, the last third, the largest 28 %, large magnitudes."""
    s = standard(spark, sf_dir)
    q = s.groupBy("user_id").agg(F.percentile("x", 0.72).alias("q"), F.count("*").alias("n"))
    m = s.join(q, "user_id")
    hide = {"block": F.col("t").between(BLOCK[0], BLOCK[1] - 1), "strided": F.col("t") % 5 == 4, "late": F.col("t") * 3 >= F.col("n") * 2, "informative": F.col("x") > F.col("q") + 1e-9, "magnitude": F.abs("x") > 1.5}
    return m.groupBy("user_id").agg(*(F.count_if(c).alias(k) for k, c in hide.items()))


def counts_json(spark, sf_dir):
    """Rows of each status as compact JSON, in the order of the vocabulary."""
    from lumenframe.plans.status import STATUSES

    return results(spark, sf_dir).groupBy("task").agg(F.to_json(F.array(*(F.count_if(F.col("status") == s) for s in STATUSES))).alias("counts"))


# Keyed joins


def score_join(spark, sf_dir):
    """A frozen prediction of each step meets the step that follows, one to one."""
    truth = standard(spark, sf_dir).select("user_id", (F.col("t") - 1).alias("t"), F.col("x").alias("truth"), "seen")
    joined = persistence(spark, sf_dir).join(truth.where("seen"), ["user_id", "t"])
    return joined.groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.sqrt(F.avg(F.pow(F.col("x_hat") - F.col("truth"), 2))), 6).alias("rmse"))


def pooled_means(spark, sf_dir):
    """Errors pooled over sequences by method: sums over sums, so that long sequences weigh more."""
    one = standard(spark, sf_dir).where("seen").groupBy("user_id").agg(F.sum(F.pow("x", 2)).alias("sse"), F.count("*").alias("n"))
    return one.groupBy((F.col("user_id") % 5).alias("method")).agg(F.round(F.sqrt(F.sum("sse") / F.sum("n")), 6).alias("pooled"), F.round(F.avg(F.sqrt(F.col("sse") / F.col("n"))), 6).alias("unweighted"))


def array_discrepancy(spark, sf_dir):
    """Two builds of a series by key: the largest gap, and how often only one has a value."""
    s = standard(spark, sf_dir)
    a = s.select("user_id", "t", F.when(F.col("seen"), F.col("x")).alias("a"))
    b = s.where("t % 13 <> 5").select("user_id", "t", F.when(F.col("seen") & (F.col("t") % 11 != 3), F.col("x") + F.when(F.col("t") % 7 == 2, 0.001).otherwise(0.0)).alias("b"))
    both = a.join(b, ["user_id", "t"], "full")
    return both.groupBy("user_id").agg(F.round(F.max(F.abs(F.col("a") - F.col("b"))), 8).alias("max_gap"), F.count_if(F.col("a").isNull() != F.col("b").isNull()).alias("pattern_gaps"))


def record_type_counts(spark, sf_dir):
    """Rows of the synthesis by record type and dimension."""
    rates = synthesis_rates(spark, sf_dir).select(F.when(F.col("dimension") == "applicability_rate", "applicability_pattern").otherwise("failure_pattern").alias("record_type"), "dimension")
    rows = results(spark, sf_dir)
    tall = rows.select("task", F.expr("stack(2, 'scenario', scenario, 'method', method) as (dimension, member)")).distinct()
    return rates.union(tall.select(F.lit("inventory"), "dimension")).groupBy("record_type", "dimension").agg(F.count("*").alias("n"))


def lookup_rows(spark, sf_dir):
    """Of each scenario the first ok row of one method."""
    own = results(spark, sf_dir).where("method = 'm2' and status = 'ok'")
    return own.groupBy("scenario").agg(F.min("event_id").alias("event_id"), F.min_by("value", "event_id").alias("value"), F.min_by("task", "event_id").alias("task"))


def resume_merge(spark, sf_dir):
    """A stored row takes the place of the fresh one of its key; keys that no fresh row has are left out."""
    k = F.col("o_orderkey")
    fresh = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").alias("fresh"))
    stored = table(spark, sf_dir, "orders").where(k % 19 != 0).select(F.when(k % 23 == 0, -k).otherwise(k).alias("o_orderkey"), F.when(k % 17 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")).alias("stored"))
    merged = fresh.join(stored, "o_orderkey", "left")
    return merged.select("o_orderkey", F.coalesce("stored", "fresh").alias("value"), F.when(F.col("stored").isNull(), "fresh").otherwise("stored").alias("origin"))


def grouped_concat(spark, sf_dir):
    """Rows of several tasks under one schema."""
    parts = [table(spark, sf_dir, "orders").select(F.lit("orders").alias("task"), F.col("o_orderkey").alias("key"), F.col("o_totalprice").cast("double").alias("value")), table(spark, sf_dir, "customer").select(F.lit("customers").alias("task"), F.col("c_custkey").alias("key"), F.col("c_acctbal").cast("double").alias("value"))]
    return parts[0].unionByName(parts[1])


# Sets


def subset_test(spark, sf_dir):
    """Whether the keys that one table names are all in another."""
    t = lambda n, c: table(spark, sf_dir, n).select(F.col(c).alias("k")).distinct()
    out = None
    for name, (a, ca), (b, cb) in (("orders_in_customers", ("orders", "o_custkey"), ("customer", "c_custkey")), ("customers_in_orders", ("customer", "c_custkey"), ("orders", "o_custkey"))):
        one = t(a, ca).join(t(b, cb), "k", "left_anti").agg(F.count("*").alias("missing")).select(F.lit(name).alias("test"), "missing", (F.col("missing") == 0).alias("subset"))
        out = one if out is None else out.union(one)
    return out


def split_overlaps(spark, sf_dir):
    """Keys that are in two of three splits; the third split takes in some keys of the first."""
    e = table(spark, sf_dir, "events").select("user_id").distinct()
    split = {"train": e.where("user_id % 3 = 0"), "validation": e.where("user_id % 3 = 1"), "test": e.where("user_id % 3 = 2 or user_id % 15 = 0")}
    out = None
    for a, b in (("train", "validation"), ("train", "test"), ("validation", "test")):
        one = split[a].intersect(split[b]).agg(F.count("*").alias("shared")).select(F.lit(a).alias("first"), F.lit(b).alias("second"), "shared", (F.col("shared") == 0).alias("disjoint"))
        out = one if out is None else out.union(one)
    return out


def edge_difference(spark, sf_dir):
    """Undirected edges that only one of two neighbour graphs has (three and four neighbours)."""
    top = pairwise_topk(spark, sf_dir).select("label", F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "rank")
    own = top.groupBy("label", "src", "dst").agg(F.min("rank").alias("rank"))
    a, b = own.where("rank <= 3").select("label", "src", "dst", F.lit(1).alias("a")), own.select("label", "src", "dst", F.lit(1).alias("b"))
    return a.join(b, ["label", "src", "dst"], "full").where("a is null or b is null").select("label", "src", "dst", F.when(F.col("a").isNull(), "second").otherwise("first").alias("side"))


def unique_starts(spark, sf_dir):
    """Distinct first states of sequences, rounded."""
    w = W.partitionBy("user_id").orderBy("t")
    first = standard(spark, sf_dir).select("user_id", "t", "x", F.lead("x").over(w).alias("y")).where("t = 0")
    return first.agg(F.count("*").alias("n"), F.count_distinct(F.struct(F.round("x", 14), F.round("y", 14))).alias("distinct_starts"))


def ordinal_spearman(spark, sf_dir):
    """Absolute rank correlation with ties ranked by position, 0 where a column is constant."""
    rows = table(spark, sf_dir, "lineitem").select("l_linenumber", "l_quantity", "l_extendedprice", "l_orderkey")
    ranked = row_numbers(rows, ["l_linenumber"], ["l_quantity", "l_orderkey", "l_extendedprice"], "a")
    ranked = row_numbers(ranked, ["l_linenumber"], ["l_extendedprice", "l_orderkey", "l_quantity", "a"], "b")
    return ranked.groupBy("l_linenumber").agg(F.round(F.coalesce(F.abs(F.corr("a", "b")), F.lit(0.0)), 6).alias("rho"))


# Grouped reports and functions


def cube_report(spark, sf_dir):
    """All groupings of two columns, with the number that says which columns are summed over."""
    return table(spark, sf_dir, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.grouping_id().cast("bigint").alias("level"), F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


def rollup_report(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.year("o_orderdate").cast("bigint").alias("year"), "o_orderpriority", "o_totalprice")
    return o.rollup("year", "o_orderpriority").agg(F.count("*").alias("n"), F.round(F.avg("o_totalprice"), 3).alias("mean"))


def grouping_sets_report(spark, sf_dir):
    table(spark, sf_dir, "lineitem").createOrReplaceTempView("grouping_sets_lineitem")
    return spark.sql("SELECT l_linenumber, l_returnflag, count(*) AS n, round(sum(l_discount), 4) AS discount FROM grouping_sets_lineitem GROUP BY GROUPING SETS ((l_linenumber), (l_returnflag), ())")


def map_lookups(spark, sf_dir):
    """Counts of a task as a map from status; a key that isn't there gives null."""
    n = results(spark, sf_dir).groupBy("task", "status").agg(F.count("*").alias("n"))
    m = n.groupBy("task").agg(F.map_from_entries(F.collect_list(F.struct("status", "n"))).alias("m"))  # a row for each status
    return m.select("task", F.try_element_at("m", F.lit("ok")).alias("ok"), F.try_element_at("m", F.lit("unheard")).alias("unheard"), F.size("m").cast("bigint").alias("n_keys"), F.array_join(F.array_sort(F.map_keys("m")), ";").alias("keys"))


def json_paths(spark, sf_dir):
    """Fields of a document by path, with fallbacks over layouts."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.to_json(F.struct(F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderstatus")).alias("object_id"), F.struct(F.col("o_orderpriority").alias("id"), F.array("o_custkey", "o_orderkey").alias("keys")).alias("artifact"))).alias("doc"))
    at = lambda p: F.get_json_object("doc", p)
    return o.select("o_orderkey", F.coalesce(at("$.object_id"), at("$.artifact.id")).alias("name"), at("$.artifact.keys[0]").cast("bigint").alias("first_key"), at("$.nothing.here").alias("absent"))


def date_parts(spark, sf_dir):
    d = F.col("o_orderdate").cast("date")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", F.date_format(F.trunc(d, "month"), "yyyy-MM-dd").alias("month"), F.date_format(F.last_day(d), "yyyy-MM-dd").alias("month_end"), F.datediff(F.last_day(d), d).cast("bigint").alias("days_left"),
        F.date_format(F.date_add(d, 90), "yyyy-MM-dd").alias("due"), F.quarter(d).cast("bigint").alias("quarter"),
    )


def approximate_counts(spark, sf_dir):
    """Sketches beside exact values: within five parts in a hundred. Each has a grouping of its own: beside a distinct count,
    sketches would be kept for each key; the median comes from ranks of counted values, as a group may hold any number of them."""
    rows = table(spark, sf_dir, "lineitem").select(F.struct("l_returnflag").alias("g"), "l_orderkey", "l_extendedprice")  # a null flag inside is a group that joins
    exact = rows.select("g", "l_orderkey").distinct().groupBy("g").agg(F.count("l_orderkey").alias("exact"))
    near = rows.groupBy("g").agg(F.approx_count_distinct("l_orderkey", 0.01).alias("near"), F.percentile_approx("l_extendedprice", 0.5, 10_000).alias("near_median"), (F.count("l_extendedprice") - 1).alias("last"))
    ranked = value_ranks(rows.where("l_extendedprice is not null"), ["g"], "l_extendedprice").join(F.broadcast(near.select("g", "last")), "g")
    holds = lambda at: (F.col("before") <= at) & (at < F.col("before") + F.col("n"))
    low, high = F.floor(F.col("last") / 2), F.ceil(F.col("last") / 2)
    median = ranked.where(holds(low) | holds(high)).groupBy("g").agg(((F.min("l_extendedprice") + F.max("l_extendedprice")) / 2).alias("median"))  # one value or two
    close = lambda a, b: F.abs(F.col(a) - F.col(b)) <= 0.05 * F.col(b)
    made = exact.join(near, "g").join(median, "g", "left")
    return made.select("g.l_returnflag", "exact", close("near", "exact").alias("count_close"), close("near_median", "median").alias("median_close"))


def scaled_mean(values: pd.Series, weights: pd.Series) -> float:
    return float((values * weights).sum() / weights.sum())


def python_functions(spark, sf_dir):
    """A vectorised scalar function, a grouped one and a table function, by name as methods are."""
    squash = F.pandas_udf(lambda v: v / (1 + v.abs()), T.DoubleType())
    mean = F.pandas_udf(scaled_mean, T.DoubleType())

    @F.udtf(returnType="step bigint, factor double")
    class Steps:
        def eval(self, n: int):
            for k in range(n):
                yield k, 0.5**k

    own = table(spark, sf_dir, "lineitem").select("l_linenumber", F.col("l_discount").cast("double").alias("d"), F.col("l_quantity").cast("double").alias("q"))
    one = own.select("l_linenumber", squash("d").alias("s"), "q").groupBy("l_linenumber").agg(mean("s", "q").alias("m"))
    return one.crossJoin(F.broadcast(Steps(F.lit(3)))).select("l_linenumber", "step", F.round(F.col("m") * F.col("factor"), 8).alias("value"))


def windowed_counts(events: DataFrame, size: str = "6 hours", slide: str | None = None, session: str | None = None, late: str | None = None) -> DataFrame:
    """start, event_type, n over tumbling, sliding or session windows of ``ts``; with ``late``, a stream's rows
    later than that are dropped."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    rows = rows.withWatermark("ts", late) if late else rows
    span: Column = F.session_window("ts", session) if session else F.window("ts", size, slide) if slide else F.window("ts", size)
    return rows.groupBy(span.alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def _epoch(frame: DataFrame) -> DataFrame:
    return frame.select(F.unix_timestamp("start").alias("start"), "event_type", "n")


def tumbling_windows(spark, sf_dir):
    return _epoch(windowed_counts(table(spark, sf_dir, "events")))


def sliding_windows(spark, sf_dir):
    return _epoch(windowed_counts(table(spark, sf_dir, "events"), "6 hours", "2 hours"))


def session_windows(spark, sf_dir):
    """Runs of a type's events with less than ten minutes between them."""
    return _epoch(windowed_counts(table(spark, sf_dir, "events"), session="10 minutes"))


QUERIES = {
    f.__name__: f
    for f in (
        affine_apply, inverse_standardize, unit_vectors, label_angles, kernels, time_third_means, region_errors, observation_masks, counts_json, score_join, pooled_means, array_discrepancy, record_type_counts,
        lookup_rows, resume_merge, grouped_concat, subset_test, split_overlaps, edge_difference, unique_starts, ordinal_spearman, cube_report, rollup_report, grouping_sets_report, map_lookups, json_paths,
        date_parts, approximate_counts, python_functions, tumbling_windows, sliding_windows, session_windows,
    )
}

_V = f"v AS (SELECT vec_id, label, i - 1 AS i, embedding[i]::DOUBLE AS v FROM embeddings, range(1, {DIMS + 1}) r(i))"
_PERSIST = "p AS (SELECT user_id, t, x, seen, coalesce(last_value(CASE WHEN seen THEN x END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS x_hat FROM z)"
_RHO = f"(1 - {NUGGET}) * exp({-0.5 / TAU**2}::DOUBLE)"
_STORED = "s AS (SELECT CASE WHEN o_orderkey % 23 = 0 THEN -o_orderkey ELSE o_orderkey END AS k, CASE WHEN o_orderkey % 17 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS stored FROM orders WHERE o_orderkey % 19 <> 0)"
_NAIVE = "floor(epoch(ts))::BIGINT"

ORACLES = {
    "affine_apply": f"WITH {STANDARD} SELECT user_id, t, round(x * {AFFINE[0]} + {AFFINE[1]}, 9) AS y FROM z",
    "inverse_standardize": f"WITH {_V} SELECT label, round(avg(v), 7) AS mean, true AS equal FROM v GROUP BY label",
    "unit_vectors": "WITH v AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings) SELECT vec_id, i, round(v / sqrt(sum(v * v) OVER (PARTITION BY vec_id)), 7) AS u FROM v",
    "label_angles": f"WITH {_V}, a AS (SELECT label, i, avg(v) AS a FROM v GROUP BY ALL), b AS (SELECT i, avg(v) AS b FROM v GROUP BY i) SELECT label, round(degrees(acos(greatest(-1, least(1, sum(a * b) / sqrt(sum(a * a) * sum(b * b)))))), 5) AS angle FROM a JOIN b USING (i) GROUP BY label",
    "kernels": f"SELECT i, j, round((1 - {NUGGET}) * exp(-0.5 * pow(abs(i - j) / {TAU}, 2)) + CASE WHEN i = j THEN {NUGGET} ELSE 0 END, 9) AS se, round(pow({_RHO}, abs(i - j)), 9) AS ar FROM range({LAGS}) a(i), range({LAGS}) b(j)",
    "time_third_means": f"WITH {STANDARD}, n AS (SELECT *, count(*) OVER (PARTITION BY user_id) // 3 AS q, count(*) OVER (PARTITION BY user_id) % 3 AS r FROM z) SELECT user_id, CASE WHEN t < (q + 1) * r THEN t // (q + 1) ELSE r + (t - (q + 1) * r) // q END AS third, round(avg(x), 8) AS mean, count(*) AS n FROM n GROUP BY 1, 2",
    "region_errors": f"WITH {STANDARD}, {_PERSIST} SELECT user_id, CASE WHEN t >= {BLOCK[0]} AND t < {BLOCK[1]} THEN 'inside' ELSE 'outside' END AS region, count(*) AS n, round(sqrt(avg((x_hat - x) * (x_hat - x))), 6) AS rmse FROM p GROUP BY 1, 2",
    "observation_masks": f"WITH {STANDARD}, q AS (SELECT user_id, quantile_cont(x, 0.72) AS q, count(*) AS n FROM z GROUP BY user_id) SELECT user_id, count(*) FILTER (t BETWEEN {BLOCK[0]} AND {BLOCK[1] - 1}) AS block, count(*) FILTER (t % 5 = 4) AS strided, count(*) FILTER (t * 3 >= n * 2) AS late, count(*) FILTER (x > q + 1e-9) AS informative, count(*) FILTER (abs(x) > 1.5) AS magnitude FROM z JOIN q USING (user_id) GROUP BY user_id",
    "counts_json": f"WITH {RESULTS} SELECT task, '[' || count(*) FILTER (status = 'ok') || ',' || count(*) FILTER (status = 'nonconvergence') || ',' || count(*) FILTER (status = 'invalid') || ',' || count(*) FILTER (status = 'inapplicable') || ']' AS counts FROM x GROUP BY task",
    "score_join": f"WITH {STANDARD}, {_PERSIST} SELECT p.user_id, count(*) AS n, round(sqrt(avg((p.x_hat - z.x) * (p.x_hat - z.x))), 6) AS rmse FROM p JOIN z ON z.user_id = p.user_id AND z.t = p.t + 1 AND z.seen GROUP BY p.user_id",
    "pooled_means": f"WITH {STANDARD}, o AS (SELECT user_id, sum(x * x) AS sse, count(*) AS n FROM z WHERE seen GROUP BY user_id) SELECT user_id % 5 AS method, round(sqrt(sum(sse) / sum(n)), 6) AS pooled, round(avg(sqrt(sse / n)), 6) AS unweighted FROM o GROUP BY 1",
    "array_discrepancy": f"WITH {STANDARD}, a AS (SELECT user_id, t, CASE WHEN seen THEN x END AS a FROM z), b AS (SELECT user_id, t, CASE WHEN seen AND t % 11 <> 3 THEN x + CASE WHEN t % 7 = 2 THEN 0.001::DOUBLE ELSE 0 END END AS b FROM z WHERE t % 13 <> 5) SELECT user_id, round(max(abs(a - b)), 8) AS max_gap, count(*) FILTER ((a IS NULL) <> (b IS NULL)) AS pattern_gaps FROM a FULL JOIN b USING (user_id, t) GROUP BY user_id",
    "record_type_counts": f"WITH {_RATES}, i AS (SELECT DISTINCT task, 'scenario' AS dimension, scenario AS m FROM x UNION ALL SELECT DISTINCT task, 'method', method FROM x) SELECT CASE WHEN dimension = 'applicability_rate' THEN 'applicability_pattern' ELSE 'failure_pattern' END AS record_type, dimension, count(*) AS n FROM s GROUP BY ALL UNION ALL SELECT 'inventory', dimension, count(*) FROM i GROUP BY dimension",
    "lookup_rows": f"WITH {RESULTS} SELECT scenario, min(event_id) AS event_id, arg_min(value, event_id) AS value, arg_min(task, event_id) AS task FROM x WHERE method = 'm2' AND status = 'ok' GROUP BY scenario",
    "resume_merge": f"WITH {_STORED} SELECT o_orderkey, coalesce(stored, o_totalprice) AS value, CASE WHEN stored IS NULL THEN 'fresh' ELSE 'stored' END AS origin FROM orders LEFT JOIN s ON k = o_orderkey",
    "grouped_concat": "SELECT 'orders' AS task, o_orderkey AS key, o_totalprice::DOUBLE AS value FROM orders UNION ALL SELECT 'customers', c_custkey, c_acctbal::DOUBLE FROM customer",
    "subset_test": "SELECT 'orders_in_customers' AS test, count(*) AS missing, count(*) = 0 AS subset FROM (SELECT DISTINCT o_custkey AS k FROM orders) WHERE k NOT IN (SELECT c_custkey FROM customer) UNION ALL SELECT 'customers_in_orders', count(*), count(*) = 0 FROM (SELECT DISTINCT c_custkey AS k FROM customer) WHERE k NOT IN (SELECT o_custkey FROM orders)",
    "split_overlaps": "WITH e AS (SELECT DISTINCT user_id FROM events), s AS (SELECT 'train' AS s, user_id FROM e WHERE user_id % 3 = 0 UNION ALL SELECT 'validation', user_id FROM e WHERE user_id % 3 = 1 UNION ALL SELECT 'test', user_id FROM e WHERE user_id % 3 = 2 OR user_id % 15 = 0), p AS (SELECT * FROM (VALUES ('train', 'validation'), ('train', 'test'), ('validation', 'test')) v(a, b)) SELECT a AS first, b AS second, (SELECT count(*) FROM s x JOIN s y USING (user_id) WHERE x.s = a AND y.s = b) AS shared, (SELECT count(*) FROM s x JOIN s y USING (user_id) WHERE x.s = a AND y.s = b) = 0 AS disjoint FROM p",
    "edge_difference": f"WITH {_TOP}, o AS (SELECT label, least(src, dst) AS src, greatest(src, dst) AS dst, min(rank) AS rank FROM t GROUP BY ALL) SELECT label, src, dst, 'second' AS side FROM o WHERE rank > 3",
    "unique_starts": f"WITH {STANDARD}, f AS (SELECT user_id, t, x, lead(x) OVER (PARTITION BY user_id ORDER BY t) AS y FROM z) SELECT count(*) AS n, count(DISTINCT (x, y)) AS distinct_starts FROM f WHERE t = 0",
    "ordinal_spearman": "WITH r AS (SELECT l_linenumber, row_number() OVER (PARTITION BY l_linenumber ORDER BY l_quantity, l_orderkey, l_extendedprice) AS a, row_number() OVER (PARTITION BY l_linenumber ORDER BY l_extendedprice, l_orderkey, l_quantity) AS b FROM lineitem) SELECT l_linenumber, round(coalesce(abs(corr(a, b)), 0), 6) AS rho FROM r GROUP BY l_linenumber",
    "cube_report": "SELECT l_returnflag, l_linestatus, grouping(l_returnflag, l_linestatus)::BIGINT AS level, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)",
    "rollup_report": "SELECT year(o_orderdate) AS year, o_orderpriority, count(*) AS n, round(avg(o_totalprice), 3) AS mean FROM orders GROUP BY ROLLUP (year(o_orderdate), o_orderpriority)",
    "grouping_sets_report": "SELECT l_linenumber, l_returnflag, count(*) AS n, round(sum(l_discount), 4) AS discount FROM lineitem GROUP BY GROUPING SETS ((l_linenumber), (l_returnflag), ())",
    "map_lookups": f"WITH {RESULTS} SELECT task, nullif(count(*) FILTER (status = 'ok'), 0) AS ok, NULL::BIGINT AS unheard, count(DISTINCT status) AS n_keys, array_to_string(list_sort(list(DISTINCT status)), ';') AS keys FROM x GROUP BY task",
    "json_paths": "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus ELSE o_orderpriority END AS name, o_custkey AS first_key, NULL::VARCHAR AS absent FROM orders",
    "date_parts": "SELECT o_orderkey, strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS month, strftime(last_day(o_orderdate), '%Y-%m-%d') AS month_end, datediff('day', o_orderdate::DATE, last_day(o_orderdate)) AS days_left, strftime(o_orderdate::DATE + INTERVAL 90 DAY, '%Y-%m-%d') AS due, quarter(o_orderdate) AS quarter FROM orders",
    "approximate_counts": "SELECT l_returnflag, count(DISTINCT l_orderkey) AS exact, true AS count_close, true AS median_close FROM lineitem GROUP BY l_returnflag",
    "python_functions": "WITH m AS (SELECT l_linenumber, sum(l_discount::DOUBLE / (1 + abs(l_discount::DOUBLE)) * l_quantity::DOUBLE) / sum(l_quantity::DOUBLE) AS m FROM lineitem GROUP BY l_linenumber) SELECT l_linenumber, step, round(m * pow(0.5, step), 8) AS value FROM m, range(3) s(step)",
    "tumbling_windows": f"SELECT {_NAIVE} // 21600 * 21600 AS start, event_type, count(*) AS n FROM events GROUP BY ALL",
    "sliding_windows": f"WITH s AS (SELECT event_type, ({_NAIVE} // 7200 - k) * 7200 AS start FROM events, range(3) r(k)) SELECT start, event_type, count(*) AS n FROM s GROUP BY ALL",
    "session_windows": "WITH g AS (SELECT event_type, ts, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER w) < 600000000 THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts)), s AS (SELECT event_type, ts, sum(fresh) OVER (PARTITION BY event_type ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT floor(epoch(min(ts)))::BIGINT AS start, event_type, count(*) AS n FROM s GROUP BY event_type, k",
}
