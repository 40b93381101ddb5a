"""A text pipeline of five stages, each run over all that the stage before it kept.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame that is
written as Parquet and read again as the next stage's ``docs``. All but the last return the columns of
``documents``. Null and empty texts, repeated rows and further columns are as the stages' operators define.
"""

from __future__ import annotations

import functools
import uuid

from lumenframe.llm import copies, lines, mixing, packing, quality
from lumenframe.llm.common import prepare, remove, table

#: Spark's bound on the bytes of a batch that goes to Python, and what the stages set it to. Spark's own bounds let 10,000
#: texts of any length lie in one batch, in the JVM and in Python, in each task. An Arrow batch holds whole rows.
BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


def small_batches(stage):
    """The stage with batches of about BATCH_BYTES, unless the session has a bound of its own. The setting stays, as what a
    stage returns runs later."""

    @functools.wraps(stage)
    def run(spark, docs, sf_dir):
        if BATCH not in spark.conf.getAll:
            spark.conf.set(BATCH, str(BATCH_BYTES))
        return stage(spark, docs, sf_dir)

    return run


@small_batches
def reject_low_quality(spark, docs, sf_dir):
    """Documents that the additive model scores under one half go."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


@small_batches
def remove_repeated_lines(spark, docs, sf_dir):
    """Repeated runs of lines go from the texts; each document stays."""
    return lines.remove_repeats(docs)


@small_batches
def drop_near_copies(spark, docs, sf_dir):
    """Of each group of near copies (0.8 of their five-word shingles or more) the document with the smallest id stays.
    SimHash's Golay keys find most of them; pairs beyond their bits are found by the sets' first shingles."""
    return copies.keep_one(docs)


@small_batches
def mix_sources(spark, docs, sf_dir):
    """Documents are repeated so that sources reach their weights; none is left out."""
    return mixing.apply(docs)


@small_batches
def pack_sequences(spark, docs, sf_dir):
    """Token pieces with their place in sequences."""
    return packing.pack(docs)


STAGES = [
    ("quality_classifier", reject_low_quality),
    ("line_dedup", remove_repeated_lines),
    ("simhash_near_dedup", drop_near_copies),
    ("source_mixing", mix_sources),
    ("best_fit_packing", pack_sequences),
]

#: The classifier's training and the tokenizer have no SQL form; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark, sf_dir):
    """The stages over ``documents``, written between stages to the shared checkpoint folder."""
    prepare(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/stages-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{k}")
            docs = spark.read.parquet(f"{folder}/{k}")
        if 0 < k < len(STAGES) - 1:  # the last stage may read its input again; what lies before it is done with
            remove(spark, f"{folder}/{k - 1}")
    return docs
