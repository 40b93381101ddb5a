"""Shared pieces of the text operators: table access, checkpoints, worker paths, id splitting."""

from __future__ import annotations

import functools
import os
import re
import tempfile
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run without space, tab, LF, VT, FF or CR.
WORD = r"[^\x20\x09-\x0D]+"


def prepare(spark: SparkSession) -> SparkSession:
    """Make Python workers find this package and make sure that a checkpoint folder is set.

    A cluster names its shared folder in ``spark.checkpoint.dir``; it is left alone then. Only where
    it is unset and all runs in one process, as in tests, a folder of this machine is taken.
    """
    sc = spark.sparkContext
    root = str(Path(__file__).resolve().parents[2])
    known = sc.environment.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        sc.environment["PYTHONPATH"] = os.pathsep.join(x for x in (root, known) if x)
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the whole cluster shares")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="checkpoints-"))
    return spark


def unused(columns: Iterable[str], *wanted: str) -> list[str]:
    """Names like those wanted that are no columns, whatever their case."""
    taken, out = {c.lower() for c in columns}, []
    for name in wanted:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


#: A key with at least one row in so many is hot; there are at most so many hot keys.
HOT = 1000


def hot_join(rows: DataFrame, small: DataFrame, key: str, total: int) -> DataFrame:
    """``rows`` joined with ``small`` (one row a key; ``n``: how many of the ``total`` rows have the key).

    Rows of hot keys stay where they are and meet at most HOT broadcast rows; the others are shuffled.
    """
    at_least = F.lit(max(2, total // HOT))
    hot = small.where(F.col("n") >= at_least)
    return rows.join(F.broadcast(hot), key).unionByName(rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(small.where(F.col("n") < at_least), key))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


#: Spark's setting by which an action's shuffle files go when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def removing_shuffles(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """For functions of a frame that take many checkpointed steps: each step's shuffle files go when it ends. Else they stay
    until the driver happens to collect its garbage, three small files a task and exchange. The session's setting comes back."""

    @functools.wraps(f)
    def run(docs: DataFrame, *args, **named) -> DataFrame:
        conf = docs.sparkSession.conf
        before = conf.get(CLEANUP, "false")
        conf.set(CLEANUP, "true")
        try:
            return f(docs, *args, **named)
        finally:
            conf.set(CLEANUP, before)

    return run


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder in whatever store it lies."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def documents(docs: DataFrame) -> DataFrame:
    """``doc_id`` as long and ``text`` with null read as empty; any other column is left out."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def per_batch(make: Callable[[], Callable[[pa.RecordBatch], Iterable[pa.RecordBatch]]]):
    """A function for ``mapInArrow``: ``make`` runs once a task, what it returns once a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            if batch.num_rows:
                yield from step(batch)

    return run


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def numbered(frame: DataFrame, group: str, order: list[str], out: str = "rank") -> DataFrame:
    """Add the rank (from 0) of each row within ``group``, in no stated order between salts, without
    bringing a group to one task: rows are ranked within (group, salt), the salts' counts are summed
    up, and each salt starts where the salts before it end. ``order`` must tell rows apart, so that a
    task that runs again ranks alike; equal rows are alike and their order doesn't matter.
    """
    from pyspark.sql import Window

    n = partitions(frame.sparkSession)
    salted = frame.withColumn("__salt", F.pmod(F.xxhash64(*order), F.lit(n)).cast("int"))
    counts = salted.groupBy(group, "__salt").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(group).orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(group, "__salt", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    within = Window.partitionBy(group, "__salt").orderBy(*order)
    ranked = salted.withColumn("__rank", F.row_number().over(within) - 1)
    return ranked.join(starts, [group, "__salt"]).withColumn(out, F.col("__rank") + F.col("__start")).drop("__salt", "__rank", "__start")


#: Bits of a bitmap that goes to all tasks (2 MB, whatever the corpus). More values than that only make it useless.
BITS = 1 << 24


def bitmap(keys: DataFrame, bits: int = BITS) -> bytes:
    """Bits that the values of the one column of ``keys`` set, by their remainder. ``bits`` / 8 bytes reach the driver."""
    x = F.pmod(F.col(keys.columns[0]).cast("long"), F.lit(bits).cast("long")) + 1
    parts = keys.select(x.alias("x")).groupBy(F.bitmap_bucket_number("x").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("x")).alias("bits"))
    out = bytearray(bits // 8)
    for r in parts.collect():  # at most bits / 32768 rows
        at = (r["b"] - 1) * 4096
        out[at : at + 4096] = r["bits"]
    return bytes(out)


def is_set(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = np.mod(keys, len(bits) * 8)
    return (bits[at >> 3] >> (at & 7) & 1).astype(bool)
