"""Ranks inside groups that may be large: equal values are counted first, and a group is cut into ranges of values that
grow in number with the values, so that no group comes to one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenframe.session import written

#: Values that a range should hold, about, and ranges at most for each of a group's cuts.
RANGE_VALUES, MOST = 50_000, 10_000


def value_ranks(frame: DataFrame, key: list[str], value: str, weight: str | None = None, range_values: int = RANGE_VALUES) -> DataFrame:
    """key, value, n (rows of that value, or their ``weight``), before (those of smaller ones)."""
    n = written(frame.groupBy(*key, value).agg((F.sum(weight) if weight else F.count("*")).alias("n")))
    ranges = min(MOST, -(-n.count() // range_values))
    if ranges > 1:
        cuts = n.groupBy(*key).agg(F.percentile_approx(value, [k / ranges for k in range(1, ranges)], 2 * MOST).alias("__cuts"))
        parted = n.join(cuts, key).withColumn("__part", F.size(F.filter("__cuts", lambda c: c < F.col(value)))).drop("__cuts")
    else:
        parted = n.withColumn("__part", F.lit(0))
    sums = parted.groupBy(*key, "__part").agg(F.sum("n").alias("__rows"))
    earlier = W.partitionBy(*key).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)  # a row a range
    starts = sums.select(*key, "__part", F.coalesce(F.sum("__rows").over(earlier), F.lit(0)).alias("__start"))
    inside = W.partitionBy(*key, "__part").orderBy(value).rowsBetween(W.unboundedPreceding, -1)
    ranked = parted.withColumn("__in", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    return ranked.join(starts, [*key, "__part"]).select(*key, value, "n", (F.col("__start") + F.col("__in")).alias("before"))


def row_numbers(frame: DataFrame, key: list[str], order: list[str], out: str) -> DataFrame:
    """The number, from 1, of each row of a group in ``order``, which should tell rows apart (equal ones come in any order). Rows are
    put in order by range over the whole table, a partition numbers its own, and partitions start where those before them end."""
    spark = frame.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = frame.repartitionByRange(parts, *key, *order).sortWithinPartitions(*key, *order)
    own = written(dealt.withColumn("__id", F.monotonically_increasing_id()))  # the partition's number, then the row's
    part = F.shiftright("__id", 33).cast("int")
    counts = {r["p"]: r["n"] for r in own.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()}  # a row a partition
    starts = spark.createDataFrame([(p, sum(n for q, n in counts.items() if q < p)) for p in sorted(counts)], "__part int, __start long")
    placed = own.withColumn("__part", part).join(F.broadcast(starts), "__part").withColumn("__at", F.col("__start") + F.col("__id").bitwiseAND((1 << 33) - 1))
    first = placed.groupBy(*key).agg(F.min("__at").alias("__first"))
    return placed.join(first, key).withColumn(out, F.col("__at") - F.col("__first") + 1).drop("__id", "__part", "__start", "__at", "__first")
