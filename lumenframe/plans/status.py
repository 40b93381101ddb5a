"""The status vocabulary of result rows, their keys, and a stand-in result table over ``events``.

A row is ``ok`` with a finite value, or carries one of the other statuses, a reason and no value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenframe.sources.tables import table

#: Fixed values.
STATUSES = ("ok", "nonconvergence", "invalid", "inapplicable")


def row_key(*parts: str) -> Column:
    return F.concat_ws("|", *(F.col(p).cast("string") for p in parts))


def finite_or_invalid(frame: DataFrame) -> DataFrame:
    """Turn an ``ok`` row whose value isn't finite into an ``invalid`` one with a reason."""
    bad = (F.col("status") == "ok") & (F.col("value").isNull() | F.isnan("value") | (F.abs("value") == F.lit(float("inf"))))
    return frame.withColumns({
        "reason": F.when(bad, "nonfinite_metric_value").otherwise(F.col("reason")),
        "value": F.when(bad | (F.col("status") != "ok"), None).otherwise(F.col("value")),
        "status": F.when(bad, "invalid").otherwise(F.col("status")),
    })


def summarised(rows: DataFrame, keys: list[str]) -> DataFrame:
    """q10, median and q90 over ok rows (null without any), rates over all rows, by ``keys``."""
    share = lambda c: F.avg(c.cast("double"))
    ok = F.col("status") == "ok"
    q = F.percentile(F.when(ok, F.col("value")), F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9)))
    made = rows.groupBy(*keys).agg(
        F.count("*").alias("n_rows"), F.count_if(ok).alias("n_ok"), q.alias("q"), share(ok).alias("ok_rate"),
        share(F.col("status").isin("invalid", "nonconvergence")).alias("failure_rate"), share(F.col("status") != "inapplicable").alias("applicability_rate"),
    )
    return made.select(row_key(*keys).alias("key"), "*", *(F.round(F.col("q")[k], 6).alias(n) for k, n in enumerate(("q10", "median", "q90")))).drop("q")


def results(spark, sf_dir) -> DataFrame:
    """``events`` read as result rows: task = event type, scenario = day of week, method = user mod 5."""
    e = table(spark, sf_dir, "events")
    status = F.when(F.col("event_id") % 11 == 0, "inapplicable").when(F.col("event_id") % 13 == 0, "nonconvergence").when(F.col("value") < 2, "invalid").otherwise("ok")
    rows = e.select(
        F.col("event_id"), F.col("event_type").alias("task"), F.concat(F.lit("day"), F.dayofweek("ts").cast("string")).alias("scenario"),
        F.concat(F.lit("m"), (F.col("user_id") % 5).cast("string")).alias("method"), F.col("user_id").alias("replicate"), "ts",
        status.alias("status"), F.when(status == "ok", F.col("value")).alias("value"),
    )
    return rows.withColumn("reason", F.when(F.col("status") != "ok", F.concat(F.col("status"), F.lit("_row"))))


RESULTS = """r AS (SELECT event_id, event_type AS task, 'day' || (dayofweek(ts) + 1) AS scenario, 'm' || (user_id % 5) AS method, user_id AS replicate, ts,
  CASE WHEN event_id % 11 = 0 THEN 'inapplicable' WHEN event_id % 13 = 0 THEN 'nonconvergence' WHEN value < 2 THEN 'invalid' ELSE 'ok' END AS status, value AS raw FROM events),
x AS (SELECT * EXCLUDE raw, CASE WHEN status = 'ok' THEN raw END AS value FROM r)"""
