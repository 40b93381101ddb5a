from collections import Counter

import pytest

from lumenframe.plans import cross_suite
from lumenframe.session import checkpoint


@pytest.fixture(scope="module")
def rows(spark):
    return checkpoint(cross_suite.all_results(spark))


def test_counts_of_all_records(rows):
    made = cross_suite.synthesis(rows).collect()
    pairs, scenarios = (rows.select(*c).distinct().count() for c in (("benchmark", "task", "scenario", "method"), ("benchmark", "task", "scenario")))
    found = Counter(r["record_type"] for r in made)
    assert found["applicability_pattern"] == pairs and found["failure_pattern"] == 2 * pairs and found["scenario_target_coverage"] == scenarios and found["inventory"] > 100
    assert len({r["row_key"] for r in made}) == len(made)
    assert all(r["status"] == "inapplicable" if r["rate"] is None else r["rate"] == pytest.approx(r["numerator"] / r["denominator"]) and 0 <= r["numerator"] <= r["denominator"] for r in made)


def test_order_does_not_matter(rows):
    again = cross_suite.synthesis(rows.orderBy("value", "row_key").repartition(3))
    assert sorted(map(tuple, cross_suite.synthesis(rows).collect()), key=str) == sorted(map(tuple, again.collect()), key=str)


def test_validation_and_resume(spark, rows):
    own = rows.where("task = 'rotation'")
    grid = own.select("row_key")
    assert cross_suite.invalid_rows(own, grid).count() == 0
    kept = own.select("row_key", "status", "reason", "value").collect()
    ok = next(r["row_key"] for r in kept if r["status"] == "ok")
    bad = [(r["row_key"], r["status"], None if r["row_key"] != ok else "x", None if r["row_key"] == ok else r["value"]) for r in kept[1:]] + [("odd", "great", "r", 1.0), (kept[2]["row_key"], *kept[2][1:])]
    found = Counter(r["problem"] for r in cross_suite.invalid_rows(spark.createDataFrame(bad, "row_key string, status string, reason string, value double"), grid).collect())
    assert found["unknown_status"] == found["unknown_key"] == found["repeated_key"] == 1 and found["reason_missing"] > 100 and found["missing_key"] >= 1
    stored = [(ok, "ok", None, -1.0), ("odd", "ok", None, 1.0), *[tuple(r) for r in kept if r["row_key"] != ok][:5]]
    verdicts = Counter(r["verdict"] for r in cross_suite.resume(own, spark.createDataFrame(stored, "row_key string, status string, reason string, value double")).collect())
    assert verdicts["unknown"] == verdicts["stale"] == 1 and verdicts["fresh"] > 1000
