"""Best-fit packing of token pieces into sequences, planned on the histogram of piece lengths.

Only the histogram (one count for each length up to the capacity) comes to the driver. The plan is
made on counts: bins that look alike are one entry with a range of sequence numbers. Pieces then take
the planned slots by joining on (length, rank within length).

Defined results: null text counts as empty; an empty text is the end token alone; an empty table gives
no rows; a text of any length is encoded whole and only its pieces are cut; of bins with equal room the one that
was opened first is filled, pieces of one length take slots in order of a hash, then id and piece; repeated rows
are packed as often as they occur; columns other than ``doc_id`` and ``text``
are ignored; a null ``doc_id`` is kept as null.
"""

from __future__ import annotations

import base64
import zlib
from bisect import bisect_left, insort
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.llm.common import documents, numbered, per_batch, prepare

CAPACITY = 2048
END_ID = 0
TOKENIZER = "byte_bpe_50k.json"
SPECIAL = {"<|endoftext|>": 50256}


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=2)
def _encoder(path: str):
    """text -> uint32 ids, as the library ``tokenizers`` gives for ``path`` without added special tokens.

    Where the same vocabulary lies beside it as ranks, those are used, which is several times faster
    and gives the same ids (tested on every text of a table and on long ones). The other library merges a
    run without spaces in quadratic time and may give up on odd texts, so texts of 200,000 characters or more,
    and those that it refuses, are encoded from the JSON file itself.
    """
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    state = {}

    def plain(text: str) -> np.ndarray:
        if "full" not in state:
            from tokenizers import Tokenizer

            state["full"] = Tokenizer.from_file(path)
        return np.array(state["full"].encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    ranks = path.removesuffix(".json") + ".tiktoken"
    if not os.path.exists(ranks):
        return plain
    import public_tokenizers
    import tiktoken

    with open(ranks, "rb") as lines:
        table = {base64.b64decode(k): int(v) for k, v in map(bytes.split, lines)}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens=SPECIAL)

    def encode(text: str) -> np.ndarray:
        if len(text) < 200_000:
            try:
                return fast.encode_to_numpy(text, allowed_special="all")
            except Exception as error:  # the regex engine's own limits, on odd texts
                if isinstance(error, (MemoryError, KeyboardInterrupt)):
                    raise
        return plain(text)

    return encode


def cut(n: int, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the pieces of n ids: whole sequences, the first piece takes the rest."""
    if n <= capacity:
        return np.zeros(1, np.int64), np.array([n], np.int64)
    head = n % capacity or capacity
    starts = np.concatenate([[0], np.arange(head, n, capacity)])
    return starts, np.diff(np.append(starts, n))


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, if asked for, the ids of each piece."""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * keep_ids

    def make():
        encode = _encoder(path)

        def step(batch: pa.RecordBatch):
            rows: list[list] = [[], [], [], [], [], []]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.append(encode(text.as_py()), np.uint32(end_id)).astype("<u4")
                for k, (start, length) in enumerate(zip(*cut(len(ids), capacity), strict=True)):
                    part = ids[start : start + length]
                    for column, value in zip(rows, (doc_id, k, start, length, zlib.crc32(part.tobytes()), part if keep_ids else None), strict=True):
                        column.append(value)
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())][: 5 + keep_ids]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds, strict=False)], names=names[: 5 + keep_ids])

        return step

    return documents(docs).mapInArrow(per_batch(make), schema)


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Best fit over counts, longest first: (length, first rank, end rank, first sequence, pieces a bin, offset).

    Entries are at most a few for each length: a length changes whole ranges of alike bins, splits one
    range, and opens at most two new ones.
    """
    open_bins: list[tuple[int, int, int]] = []  # (room, first sequence, bins), sorted by room
    out, fresh = [], 0
    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            at = bisect_left(open_bins, (length, -1, -1))
            if at < len(open_bins):
                room, first, bins = open_bins.pop(at)
            else:
                per = capacity // length
                room, first, bins = capacity, fresh, -(-left // per)
                fresh += bins
            per = room // length
            full = min(bins, left // per)
            for use, each, start in ((full, per, first), (int(full < bins and left - full * per > 0), left - full * per, first + full)):
                if use:
                    out.append((length, rank, rank + use * each, start, each, capacity - room))
                    rank, left = rank + use * each, left - use * each
                    if room - each * length:
                        insort(open_bins, (room - each * length, start, use))
                    first, bins = start + use, bins - use
            if bins:
                insort(open_bins, (room, first, bins))
    return out


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """Pack ``docs`` into sequences of at most ``capacity`` tokens.

    Returns one row a piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset; with
    ``keep_ids`` also the ids, from which a sequence is read back by ordering its pieces by offset.
    """
    spark = prepare(docs.sparkSession)
    made = pieces(docs, path or tokenizer_path(), capacity, end_id, keep_ids).checkpoint()
    histogram = {r["length"]: r["n"] for r in made.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    slots = spark.createDataFrame(plan(histogram, capacity), "length long, r0 long, r1 long, s0 long, per long, o0 long")
    ranked = numbered(made, "length", ["doc_id", "piece", "ids_crc32"])
    place = F.col("rank") - F.col("r0")
    return (
        ranked.join(F.broadcast(slots), "length")  # bounded by the capacity, not by the corpus
        .where((F.col("rank") >= F.col("r0")) & (F.col("rank") < F.col("r1")))
        .select(
            *(c for c in made.columns),
            (F.col("s0") + F.floor(place / F.col("per"))).cast("long").alias("sequence_id"),
            (F.col("o0") + place % F.col("per") * F.col("length")).cast("long").alias("offset"),
        )
    )
