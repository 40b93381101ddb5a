"""What every query needs of a session: workers that find this package, and a shared checkpoint folder."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def prepare(spark: SparkSession) -> SparkSession:
    """A cluster names its shared folder in ``spark.checkpoint.dir``; only where all runs in one process, as in
    tests, a folder of this machine is taken."""
    sc = spark.sparkContext
    root = str(Path(__file__).resolve().parents[1])
    known = sc.environment.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        sc.environment["PYTHONPATH"] = os.pathsep.join(x for x in (root, known) if x)
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared or re.fullmatch(r"local(\[.*\])?", sc.master):
            sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="checkpoints-"))
    return spark


def checkpoint(frame: DataFrame) -> DataFrame:
    """Cut the lineage in the shared folder; a cluster without one is an error."""
    if prepare(frame.sparkSession).sparkContext.getCheckpointDir() is None:
        raise ValueError("spark.checkpoint.dir must name a folder that the whole cluster shares")
    return frame.checkpoint()


def written(frame: DataFrame) -> DataFrame:
    """As ``checkpoint``, by a table in the shared folder: for loops, as a checkpoint's plan keeps all that was known of
    its columns, and in a loop of joins the optimizer's work on that multiplies."""
    spark = prepare(frame.sparkSession)
    if spark.sparkContext.getCheckpointDir() is None:
        raise ValueError("spark.checkpoint.dir must name a folder that the whole cluster shares")
    path = f"{spark.sparkContext.getCheckpointDir()}/tables-{uuid.uuid4().hex}"
    frame.write.parquet(path)
    return spark.read.parquet(path)
