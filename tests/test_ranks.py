import random

import pytest

from lumenframe.functions import ranks


@pytest.mark.parametrize("size", [50_000, 7])
def test_value_ranks(spark, size):
    """One range or many, hot values and groups of one row."""
    rng = random.Random(1)
    rows = [("a", float(rng.choice([1, 1, 1, *range(60)])), rng.randint(1, 3)) for _ in range(400)] + [("b", 5.0, 2)]
    frame = spark.createDataFrame(rows, "k string, v double, w long")
    for weight in (None, "w"):
        got = {(r["k"], r["v"]): (r["n"], r["before"]) for r in ranks.value_ranks(frame, ["k"], "v", weight, size).collect()}
        count = lambda k, keep, weight=weight: sum(w if weight else 1 for g, v, w in rows if g == k and keep(v))
        assert got == {(k, v): (count(k, lambda x, v=v: x == v), count(k, lambda x, v=v: x < v)) for k, v, _ in rows}


def test_row_numbers(spark):
    """A group over many partitions, small groups, nulls first, equal rows."""
    rng = random.Random(2)
    rows = [("a" if i % 5 else f"g{i % 7}", rng.choice([None, 1, 2, 3]), i // 2) for i in range(500)]
    got = sorted(map(tuple, ranks.row_numbers(spark.createDataFrame(rows, "k string, x int, y int"), ["k"], ["x", "y"], "place").collect()), key=lambda r: (r[0], r[3]))
    order = sorted(rows, key=lambda r: (r[0], r[1] is not None, r[1] or 0, r[2]))
    want, at = [], {}
    for k, x, y in order:
        at[k] = at.get(k, 0) + 1
        want.append((k, x, y, at[k]))
    assert got == want
    assert ranks.row_numbers(spark.createDataFrame([], "k string, x int"), ["k"], ["x"], "n").count() == 0
