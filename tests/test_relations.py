"""Counts beside sketches: groups, nulls and what is kept for a key."""

import contextlib
import io

from lumenframe.operators import relations


def made(spark, tmp_path, rows):
    spark.createDataFrame(rows, "l_returnflag string, l_orderkey long, l_extendedprice double").write.parquet(f"{tmp_path}/lineitem.parquet")
    return relations.approximate_counts(spark, str(tmp_path))


def test_sketches_are_not_kept_for_each_key(spark, tmp_path):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        made(spark, tmp_path, [("A", k, 1.0 + k) for k in range(9)]).explain("formatted")
    steps = [x for x in out.getvalue().split("\n\n") if "Keys" in x]
    assert steps and not [x for x in steps if "l_orderkey" in x.split("Keys", 1)[1].split("\n")[0] and ("approx" in x or "percentile" in x)]


def test_medians_and_null_groups(spark, tmp_path):
    """Even and odd groups, a group without prices, one without keys, one without a name; close values are close to the exact ones."""
    rows = [("A", k // 2, float(k)) for k in range(1, 102)] + [("B", 1, 4.0), ("B", 1, 4.0), ("C", 3, None), ("D", None, 2.0), (None, 8, 5.0), (None, 9, 5.2)]
    got = {r["l_returnflag"]: tuple(r)[1:] for r in made(spark, tmp_path, rows).collect()}
    assert got == {"A": (51, True, True), "B": (1, True, True), "C": (1, True, None), "D": (0, True, True), None: (2, True, True)}


def test_median_lies_between_far_values(spark, tmp_path):
    """The exact median of two values is their mean, and the sketch gives one of them."""
    assert made(spark, tmp_path, [("A", 1, 1.0), ("A", 2, 9.0)]).collect()[0]["median_close"] is False
