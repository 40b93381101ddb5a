"""Summaries of result rows, rates, rankings, cross-suite synthesis, set checks and validation."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenframe.functions.ranks import value_ranks
from lumenframe.plans.status import RESULTS, STATUSES, results, row_key
from lumenframe.session import written
from lumenframe.sources.tables import table


def _share(condition):
    return F.round(F.avg(condition.cast("double")), 6)


def _is(*statuses):
    return F.col("status").isin(*statuses)


def summary_quantiles(spark, sf_dir):
    """q10, median, q90 over ok rows; rates over all rows; null where no row is ok."""
    q = F.percentile("value", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9)))
    made = results(spark, sf_dir).groupBy("scenario", "method").agg(
        F.count("*").alias("n_rows"), F.count("value").alias("n_ok"), q.alias("q"), _share(_is("ok")).alias("ok_rate"),
        _share(_is("nonconvergence", "invalid")).alias("failure_rate"), _share(~_is("inapplicable")).alias("applicability_rate"),
    )
    return made.select("*", *(F.round(F.col("q")[k], 5).alias(n) for k, n in enumerate(("q10", "median", "q90")))).drop("q")


def status_counts(spark, sf_dir):
    """Each status of the vocabulary for each task, zero where it doesn't occur."""
    rows = results(spark, sf_dir)
    words = spark.createDataFrame([(s,) for s in STATUSES], "status string")
    full = rows.select("task").distinct().crossJoin(F.broadcast(words))
    return full.join(rows.groupBy("task", "status").agg(F.count("*").alias("n")), ["task", "status"], "left").na.fill(0, ["n"])


def two_level_median(spark, sf_dir):
    one = results(spark, sf_dir).where("value is not null").groupBy("task", "replicate").agg(F.median("value").alias("m"))
    return one.groupBy("task").agg(F.round(F.median("m"), 5).alias("median"), F.count("*").alias("replicates"))


def nearest_rank_quantile(spark, sf_dir):
    """The value at position round-half-even(p (n-1)) of a group in order."""
    rows = results(spark, sf_dir).where("value is not null").select("task", "scenario", "value")
    total = rows.groupBy("task", "scenario").agg(F.count("*").alias("of"))
    ranked = value_ranks(rows, ["task", "scenario"], "value").join(total, ["task", "scenario"])
    k = lambda p: F.bround(F.lit(p) * (F.col("of") - 1)).cast("long")
    at = lambda p: F.max(F.when((F.col("before") <= k(p)) & (k(p) < F.col("before") + F.col("n")), F.col("value")))
    return ranked.groupBy("task", "scenario").agg(at(0.1).alias("q10"), at(0.5).alias("q50"), at(0.9).alias("q90"))


def seed_distribution(spark, sf_dir):
    v = F.col("value")
    return results(spark, sf_dir).groupBy("method").agg(F.round(F.avg(v), 5).alias("mean"), F.round(F.stddev_pop(v), 5).alias("std"), F.min(v).alias("low"), F.max(v).alias("high"))


def synthesis_inventory(spark, sf_dir):
    """Distinct members of each dimension of each task, and its raw row count."""
    rows = results(spark, sf_dir)
    dims = ("scenario", "method", "status")
    wide = rows.groupBy("task").agg(F.count("*").alias("n"), *(F.concat_ws(";", F.sort_array(F.collect_set(d))).alias(d) for d in dims), *(F.count_distinct(d).alias(f"n_{d}") for d in dims))
    tall = wide.select("task", "n", F.expr("stack(3, 'scenario', scenario, n_scenario, 'method', method, n_method, 'status', status, n_status) as (dimension, members, n_members)"))
    return tall.select("task", "dimension", "members", "n_members", F.col("n").alias("denominator"))


def synthesis_rates(spark, sf_dir):
    """Applicability and failure patterns by (task, scenario, method), long form, with keys; a conditional
    rate without a denominator is kept as ``inapplicable`` with no numbers."""
    g = results(spark, sf_dir).groupBy("task", "scenario", "method").agg(
        F.count("*").alias("n"), F.count_if(~_is("inapplicable")).alias("usable"), F.count_if(_is("invalid", "nonconvergence")).alias("failed")
    )
    tall = g.select("task", "scenario", "method", F.expr("stack(3, 'applicability_rate', usable, n, 'raw_failure_fraction', failed, n, 'conditional_failure_rate', failed, usable) as (dimension, numerator, denominator)"))
    usable = F.col("denominator") > 0
    return tall.select(
        row_key("task", "scenario", "method", "dimension").alias("key"), "task", "scenario", "method", "dimension", F.when(usable, F.col("numerator")).alias("numerator"),
        F.when(usable, F.col("denominator")).alias("denominator"), F.round(F.try_divide("numerator", "denominator"), 6).alias("rate"), F.when(usable, "ok").otherwise("inapplicable").alias("status"),
    )


def synthesis_coverage(spark, sf_dir):
    """Scenarios of each task with an ok row, against all scenarios of the suite."""
    rows = results(spark, sf_dir)
    every = rows.agg(F.count_distinct("scenario").alias("denominator"))
    return rows.groupBy("task").agg(F.count_distinct(F.when(_is("ok"), F.col("scenario"))).alias("numerator")).crossJoin(F.broadcast(every)).withColumn("rate", F.round(F.col("numerator") / F.col("denominator"), 6))


def task_inventory_pivot(spark, sf_dir):
    return results(spark, sf_dir).groupBy("task").pivot("status", list(STATUSES)).agg(F.count(F.lit(1))).na.fill(0)


def resume_verdicts(spark, sf_dir):
    """Stored rows (here a changed copy of ``orders``) against fresh ones: equal, stale, missing, unknown, duplicate."""
    fresh = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").alias("fresh"))
    k = F.col("o_orderkey")
    price = F.when(k % 17 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice"))
    stored = table(spark, sf_dir, "orders").where(k % 19 != 0).select(F.when(k % 23 == 0, -k).otherwise(k).alias("o_orderkey"), price.alias("stored"), F.explode(F.when(k % 29 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy"))
    one = stored.groupBy("o_orderkey").agg(F.max("stored").alias("stored"), F.count("*").alias("copies"))
    both = fresh.join(one, "o_orderkey", "full")
    verdict = F.when(F.col("copies") > 1, "duplicate").when(F.col("fresh").isNull(), "unknown").when(F.col("stored").isNull(), "missing").when(F.col("fresh") != F.col("stored"), "stale").otherwise("equal")
    return both.groupBy(verdict.alias("verdict")).agg(F.count("*").alias("n"))


def row_invariants(spark, sf_dir):
    """Rows of ``synthesis_rates`` that break 0 <= numerator <= denominator, the rate, or the key: none."""
    rows = synthesis_rates(spark, sf_dir)
    broken = (F.col("numerator") < 0) | (F.col("numerator") > F.col("denominator")) | (F.abs(F.col("rate") - F.col("numerator") / F.col("denominator")) > 1e-6) | (F.col("key") != row_key("task", "scenario", "method", "dimension"))
    return rows.agg(F.count("*").alias("n_rows"), F.count_if(broken).alias("broken"), (F.count("*") - F.count_distinct("key")).alias("repeated_keys"))


def missing_cells(spark, sf_dir):
    """(task, scenario, method) cells of the full grid that have no ok row."""
    rows = results(spark, sf_dir)
    grid = rows.select("task").distinct()
    for c in ("scenario", "method"):
        grid = grid.crossJoin(F.broadcast(rows.select(c).distinct()))
    return grid.join(rows.where(_is("ok")), ["task", "scenario", "method"], "left_anti")


def root_comparison(spark, sf_dir):
    """Rows of one build that another lacks, both ways; the second build drops and changes some rows."""
    a = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size")
    b = a.where("p_partkey % 31 <> 0").withColumn("p_size", F.when(F.col("p_partkey") % 37 == 0, F.lit(0)).otherwise(F.col("p_size")))
    return a.exceptAll(b).withColumn("side", F.lit("first")).union(b.exceptAll(a).withColumn("side", F.lit("second")))


def learned_minus_known(spark, sf_dir):
    """Difference of two methods' medians by scenario."""
    m = lambda k: F.median(F.when(F.col("method") == k, F.col("value")))
    return results(spark, sf_dir).groupBy("scenario").agg(F.round(m("m1") - m("m0"), 5).alias("gap"))


def weighted_correlation(a: str, b: str, n: str):
    """Correlation of two columns whose rows occur ``n`` times, about their means to keep digits."""
    total = F.sum(n)
    mean = lambda c: F.sum(F.col(c) * F.col(n)) / total
    part = lambda c, d: F.sum(F.col(c) * F.col(d) * F.col(n)) / total - mean(c) * mean(d)
    return part(a, b) / F.sqrt(part(a, a) * part(b, b))


def spearman(spark, sf_dir):
    """Rank correlation of quantity and price by line number, mean ranks for ties. Equal pairs are counted once, and
    both columns are ranked from the counts."""
    pairs = written(table(spark, sf_dir, "lineitem").groupBy("l_linenumber", "l_quantity", "l_extendedprice").agg(F.count("*").alias("rows")))
    ranked = pairs
    for column, out in (("l_quantity", "a"), ("l_extendedprice", "b")):
        ranks = value_ranks(pairs, ["l_linenumber"], column, "rows")
        ranked = ranked.join(ranks.select("l_linenumber", column, (F.col("before") + (F.col("n") + 1) / 2).alias(out)), ["l_linenumber", column])
    return ranked.groupBy("l_linenumber").agg(F.round(weighted_correlation("a", "b", "rows"), 6).alias("rho"))


QUERIES = {
    f.__name__: f
    for f in (
        summary_quantiles, status_counts, two_level_median, nearest_rank_quantile, seed_distribution, synthesis_inventory, synthesis_rates, synthesis_coverage,
        task_inventory_pivot, resume_verdicts, row_invariants, missing_cells, root_comparison, learned_minus_known, spearman,
    )
}

_RATES = f"""{RESULTS}, g AS (SELECT task, scenario, method, count(*) AS n, count(*) FILTER (status <> 'inapplicable') AS usable, count(*) FILTER (status IN ('invalid', 'nonconvergence')) AS failed FROM x GROUP BY ALL),
t AS (SELECT task, scenario, method, 'applicability_rate' AS dimension, usable AS num, n AS den FROM g UNION ALL SELECT task, scenario, method, 'raw_failure_fraction', failed, n FROM g UNION ALL SELECT task, scenario, method, 'conditional_failure_rate', failed, usable FROM g),
s AS (SELECT task || '|' || scenario || '|' || method || '|' || dimension AS key, task, scenario, method, dimension, CASE WHEN den > 0 THEN num END AS numerator, CASE WHEN den > 0 THEN den END AS denominator, CASE WHEN den > 0 THEN round(num / den, 6) END AS rate, CASE WHEN den > 0 THEN 'ok' ELSE 'inapplicable' END AS status FROM t)"""

ORACLES = {
    "summary_quantiles": f"WITH {RESULTS} SELECT scenario, method, count(*) AS n_rows, count(value) AS n_ok, round(quantile_cont(value, 0.1), 5) AS q10, round(quantile_cont(value, 0.5), 5) AS median, round(quantile_cont(value, 0.9), 5) AS q90, round(avg((status = 'ok')::INT), 6) AS ok_rate, round(avg((status IN ('nonconvergence', 'invalid'))::INT), 6) AS failure_rate, round(avg((status <> 'inapplicable')::INT), 6) AS applicability_rate FROM x GROUP BY scenario, method",
    "status_counts": f"WITH {RESULTS} SELECT t.task, s.status, count(x.task) AS n FROM (SELECT DISTINCT task FROM x) t CROSS JOIN (SELECT unnest({list(STATUSES)}) AS status) s LEFT JOIN x ON x.task = t.task AND x.status = s.status GROUP BY ALL",
    "two_level_median": f"WITH {RESULTS}, m AS (SELECT task, replicate, median(value) AS m FROM x WHERE value IS NOT NULL GROUP BY ALL) SELECT task, round(median(m), 5) AS median, count(*) AS replicates FROM m GROUP BY task",
    "nearest_rank_quantile": f"WITH {RESULTS}, k AS (SELECT task, scenario, value, row_number() OVER (PARTITION BY task, scenario ORDER BY value, event_id) - 1 AS k, count(*) OVER (PARTITION BY task, scenario) AS n FROM x WHERE value IS NOT NULL) SELECT task, scenario, max(value) FILTER (k = round_even(0.1::DOUBLE * (n - 1), 0)) AS q10, max(value) FILTER (k = round_even(0.5::DOUBLE * (n - 1), 0)) AS q50, max(value) FILTER (k = round_even(0.9::DOUBLE * (n - 1), 0)) AS q90 FROM k GROUP BY ALL",
    "seed_distribution": f"WITH {RESULTS} SELECT method, round(avg(value), 5) AS mean, round(stddev_pop(value), 5) AS std, min(value) AS low, max(value) AS high FROM x GROUP BY method",
    "synthesis_inventory": f"WITH {RESULTS}, d AS (SELECT task, 'scenario' AS dimension, scenario AS v FROM x UNION ALL SELECT task, 'method', method FROM x UNION ALL SELECT task, 'status', status FROM x) SELECT task, dimension, array_to_string(list_sort(list(DISTINCT v)), ';') AS members, count(DISTINCT v) AS n_members, count(*) AS denominator FROM d GROUP BY task, dimension",
    "synthesis_rates": f"WITH {_RATES} SELECT * FROM s",
    "synthesis_coverage": f"WITH {RESULTS} SELECT task, count(DISTINCT scenario) FILTER (status = 'ok') AS numerator, (SELECT count(DISTINCT scenario) FROM x) AS denominator, round(count(DISTINCT scenario) FILTER (status = 'ok') / (SELECT count(DISTINCT scenario) FROM x), 6) AS rate FROM x GROUP BY task",
    "task_inventory_pivot": f"WITH {RESULTS} SELECT task, " + ", ".join(f"count(*) FILTER (status = '{s}') AS {s}" for s in STATUSES) + " FROM x GROUP BY task",
    "resume_verdicts": "WITH f AS (SELECT o_orderkey AS k, o_totalprice AS fresh FROM orders), s AS (SELECT CASE WHEN o_orderkey % 23 = 0 THEN -o_orderkey ELSE o_orderkey END AS k, CASE WHEN o_orderkey % 17 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS stored, CASE WHEN o_orderkey % 29 = 0 THEN 2 ELSE 1 END AS copies FROM orders WHERE o_orderkey % 19 <> 0) SELECT CASE WHEN copies > 1 THEN 'duplicate' WHEN fresh IS NULL THEN 'unknown' WHEN stored IS NULL THEN 'missing' WHEN fresh <> stored THEN 'stale' ELSE 'equal' END AS verdict, count(*) AS n FROM f FULL JOIN s ON f.k = s.k GROUP BY 1",
    "row_invariants": f"WITH {_RATES} SELECT count(*) AS n_rows, count(*) FILTER (numerator < 0 OR numerator > denominator) AS broken, count(*) - count(DISTINCT key) AS repeated_keys FROM s",
    "missing_cells": f"WITH {RESULTS} SELECT t.task, s.scenario, m.method FROM (SELECT DISTINCT task FROM x) t, (SELECT DISTINCT scenario FROM x) s, (SELECT DISTINCT method FROM x) m WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.task = t.task AND x.scenario = s.scenario AND x.method = m.method AND x.status = 'ok')",
    "root_comparison": "WITH a AS (SELECT p_partkey, p_name, p_size FROM part), b AS (SELECT p_partkey, p_name, CASE WHEN p_partkey % 37 = 0 THEN 0 ELSE p_size END AS p_size FROM part WHERE p_partkey % 31 <> 0) SELECT *, 'first' AS side FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT *, 'second' FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)",
    "learned_minus_known": f"WITH {RESULTS} SELECT scenario, round(median(value) FILTER (method = 'm1') - median(value) FILTER (method = 'm0'), 5) AS gap FROM x GROUP BY scenario",
    "spearman": "WITH r AS (SELECT l_linenumber, rank() OVER (PARTITION BY l_linenumber ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_linenumber, l_quantity) - 1) / 2 AS a, rank() OVER (PARTITION BY l_linenumber ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_linenumber, l_extendedprice) - 1) / 2 AS b FROM lineitem) SELECT l_linenumber, round(corr(a, b), 6) AS rho FROM r GROUP BY l_linenumber",
}
