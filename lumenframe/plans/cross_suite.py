"""The synthesis over the benchmark tasks: what occurs, applies, fails and is covered. Counts and rates only; no
metric value is taken over. Also the checks of result rows against their registries, and of a resumed run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenframe.plans import demixing_task, gaussian_task, rotation_task, static_task
from lumenframe.plans.status import STATUSES
from lumenframe.session import checkpoint

#: Benchmark, and its task where rows don't name one. Fixed values.
SOURCES = (
    ("linear-gaussian-robustness", "linear_gaussian_inference", gaussian_task.linear_gaussian_results),
    ("static-linear-latent-robustness", "static_linear_latent_recovery", static_task.static_linear_results),
    ("demixing-rotational-robustness", None, demixing_task.demixing_results),
    ("demixing-rotational-robustness", None, rotation_task.rotation_results),
)
COLUMNS = ("scenario", "scenario_class", "replicate", "method", "metric", "target", "information_set", "status", "reason", "value", "row_key")
FIELDS = ("record_type", "benchmark", "task", "scenario", "scenario_class", "method", "dimension", "value_label", "numerator", "denominator", "rate", "status", "stress_class", "applicable_target_families", "source_reference", "notes")
#: Notes of each kind of record. Fixed values.
NOTES = {
    "count": "task-specific inventory count; no source metric values imported",
    "member": "namespaced task vocabulary member",
    "status": "rate denominator is the task-specific source raw-row count",
    "applicability_rate": "applicable means source status is not inapplicable; denominator is task/scenario/method raw Cartesian rows",
    "raw_cartesian_failure_label_fraction": "failures are invalid plus nonconvergence; denominator is all task/scenario/method raw Cartesian rows",
    "conditional_failure_rate": "failures are invalid plus nonconvergence; denominator is ok plus invalid plus nonconvergence rows",
    "zero": "conditional denominator is zero because every source row is inapplicable; numerator, denominator, and rate are blank",
    "coverage": "scenario-level inventory of target families with at least one non-inapplicable source row; no direction or effect implication",
}


def all_results(spark, sf_dir=None) -> DataFrame:
    """Rows of every task under one schema: benchmark, task, provenance and COLUMNS."""
    out = None
    for benchmark, task, rows in SOURCES:
        own = rows(spark, sf_dir)
        where = F.col("provenance") if "provenance" in own.columns else F.concat(F.lit("split:"), "split")
        one = own.select(F.lit(benchmark).alias("benchmark"), (F.lit(task) if task else F.col("task")).alias("task"), where.alias("provenance"), *COLUMNS)
        out = one if out is None else out.unionByName(one)
    return out


def _record(kind: str, **columns: Column | str) -> list[Column]:
    given = {"record_type": F.lit(kind), "source_reference": F.concat("benchmark", F.lit("/results.csv")), "benchmark": F.col("benchmark"), "task": F.col("task"), "status": F.lit("ok")}
    given |= {k: F.lit(v) if isinstance(v, str) else v for k, v in columns.items()}
    kinds = {"numerator": "long", "denominator": "long", "rate": "double"}
    return [given.get(c, F.lit(None)).cast(kinds.get(c, "string")).alias(c) for c in FIELDS]


def synthesis(rows: DataFrame) -> DataFrame:
    """One row a fact, with its key, over rows of ``all_results``."""
    task = ["benchmark", "task"]
    n = rows.groupBy(*task).agg(
        F.count("*").alias("source_row_count"), *(F.count_distinct(c).alias(f"{k}_count") for k, c in (("scenario", "scenario"), ("replicate", "replicate"), ("method", "method"), ("metric", "metric"), ("target", "target"), ("information_set", "information_set"), ("provenance", "provenance"))),
        *(F.count_if(F.col("status") == s).alias(f"status_{s}") for s in STATUSES), *(F.collect_set(c).alias(f"{c}_member") for c in ("method", "metric", "target", "information_set", "provenance")),
    )
    counts = [c for c in n.columns if c.endswith("_count")]
    stacked = n.select(*task, F.expr(f"stack({len(counts)}, " + ", ".join(f"'{c}', {c}" for c in counts) + ") as (d, k)"))
    inventory = stacked.select(*_record("inventory", dimension=F.col("d"), numerator=F.col("k"), denominator=F.col("k"), rate=F.lit(1.0), notes=NOTES["count"]))
    members = [f"{c}_member" for c in ("method", "metric", "target", "information_set", "provenance")]
    one = n.select(*task, F.expr(f"stack({len(members)}, " + ", ".join(f"'{c}', {c}" for c in members) + ") as (d, v)")).select(*task, "d", F.explode("v").alias("v"))
    member = one.select(*_record("inventory", dimension=F.col("d"), value_label=F.col("v"), numerator=F.lit(1), denominator=F.lit(1), rate=F.lit(1.0), notes=NOTES["member"]))
    said = n.select(*task, "source_row_count", F.expr(f"stack({len(STATUSES)}, " + ", ".join(f"'{s}', status_{s}" for s in STATUSES) + ") as (v, k)"))
    status = said.select(*_record("inventory", dimension="status_count", value_label=F.col("v"), numerator=F.col("k"), denominator=F.col("source_row_count"), rate=F.col("k") / F.col("source_row_count"), notes=NOTES["status"]))
    classes = F.concat_ws(";", F.sort_array(F.collect_set("scenario_class")))
    pair = rows.groupBy(*task, "scenario", "method").agg(classes.alias("c"), F.count("*").alias("n"), F.count_if(F.col("status") != "inapplicable").alias("usable"), F.count_if(F.col("status").isin("invalid", "nonconvergence")).alias("failed"))
    own = {"scenario": F.col("scenario"), "scenario_class": F.col("c"), "method": F.col("method")}
    applies = pair.select(*_record("applicability_pattern", dimension="applicability_rate", numerator=F.col("usable"), denominator=F.col("n"), rate=F.col("usable") / F.col("n"), notes=NOTES["applicability_rate"], **own))
    raw = pair.select(*_record("failure_pattern", dimension="raw_cartesian_failure_label_fraction", numerator=F.col("failed"), denominator=F.col("n"), rate=F.col("failed") / F.col("n"), notes=NOTES["raw_cartesian_failure_label_fraction"], **own))
    some = F.col("usable") > 0
    given = pair.select(*_record("failure_pattern", dimension="conditional_failure_rate", numerator=F.when(some, F.col("failed")), denominator=F.when(some, F.col("usable")), rate=F.try_divide("failed", "usable"), status=F.when(some, "ok").otherwise("inapplicable"), notes=F.when(some, NOTES["conditional_failure_rate"]).otherwise(NOTES["zero"]), **own))
    reached = rows.groupBy(*task, "scenario").agg(classes.alias("c"), F.sort_array(F.collect_set(F.when(F.col("status") != "inapplicable", F.col("target")))).alias("t"))
    k = F.when(F.size("t") > 0, F.size("t"))
    covered = reached.select(*_record("scenario_target_coverage", scenario=F.col("scenario"), scenario_class=F.col("c"), dimension="applicable_target_family_inventory", status=F.when(F.size("t") > 0, "ok").otherwise("inapplicable"), stress_class=F.col("c"), applicable_target_families=F.concat_ws(";", "t"), numerator=k, denominator=k, rate=F.when(F.size("t") > 0, 1.0), notes=NOTES["coverage"]))
    out = inventory
    for part in (member, status, applies, raw, given, covered):
        out = out.unionByName(part)
    key = ("record_type", "benchmark", "task", "scenario", "method", "dimension", "value_label")
    return out.withColumn("row_key", F.concat_ws("|", *(F.coalesce(F.col(c), F.lit("")) for c in key)))


def cross_suite_synthesis(spark, sf_dir=None) -> DataFrame:
    return synthesis(checkpoint(all_results(spark, sf_dir)))


def invalid_rows(rows: DataFrame, grid: DataFrame) -> DataFrame:
    """row_key, problem of result rows: a status outside the vocabulary, an ok row without a finite value, another
    without a reason, a key that occurs again, that the task grid (row_key) lacks, or that is missing from the rows."""
    finite = F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") < float("inf"))
    ok = F.col("status") == "ok"
    problem = F.when(~F.col("status").isin(*STATUSES), "unknown_status").when(ok & ~finite, "value_missing").when(~ok & (F.coalesce("reason", F.lit("")) == ""), "reason_missing")
    own = rows.select("row_key", problem.alias("problem")).where("problem is not null")
    again = rows.groupBy("row_key").agg(F.count("*").alias("n")).where("n > 1").select("row_key", F.lit("repeated_key").alias("problem"))
    unknown = rows.select("row_key").join(grid, "row_key", "left_anti").distinct().select("row_key", F.lit("unknown_key").alias("problem"))
    missing = grid.join(rows.select("row_key"), "row_key", "left_anti").select("row_key", F.lit("missing_key").alias("problem"))
    return own.union(again).union(unknown).union(missing)


def resume(fresh: DataFrame, stored: DataFrame) -> DataFrame:
    """Fresh rows with stored ones in their place. A stored row that repeats, is unknown or differs in what it says of
    itself (status, reason, value to 1e-12) is an error of the resumed run: its row has a ``verdict`` and stays fresh."""
    names = ("status", "reason", "value")
    one = stored.groupBy("row_key").agg(F.count("*").alias("copies"), *(F.first(c).alias(f"stored_{c}") for c in names))
    both = fresh.select("row_key", *names).join(one, "row_key", "full")
    alike = F.col("status").eqNullSafe(F.col("stored_status")) & F.col("reason").eqNullSafe(F.col("stored_reason")) & (F.col("value").eqNullSafe(F.col("stored_value")) | (F.abs(F.col("value") - F.col("stored_value")) <= 1e-12))
    verdict = F.when(F.col("status").isNull(), "unknown").when(F.col("copies").isNull(), "fresh").when(F.col("copies") > 1, "duplicate").when(alike, "stored").otherwise("stale")
    return both.select("row_key", *names, verdict.alias("verdict"))


QUERIES = {"cross_suite_synthesis": cross_suite_synthesis}
ORACLES: dict[str, str] = {}
