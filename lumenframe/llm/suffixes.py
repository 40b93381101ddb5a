"""Repeated passages by a sparse suffix array over words.

1. Of each document only the suffixes at minimisers are retained: the smallest hash of ``GRAM`` words in
   each run of ``SPAN`` such hashes. Equal runs choose equal places, so any two equal passages of ``WORDS``
   words share a retained place not more than SPAN - 1 words from their beginning.
2. Suffixes whose first ``RUN`` = WORDS - SPAN + 1 words occur again are found by counting hashes, packed by
   bucket, with repeats inside a task combined first.
3. These are sorted over the cluster by their run and the words after it; a suffix's longest match to the
   right is with a neighbour. Sorting by the run and the words before it, read backwards, gives the longest
   match to the left. Range partitions split a run that is very frequent; the two suffixes where partitions
   meet are compared afterwards. SPAN words either way are enough, as a longer match has another retained
   place further on.
4. A document's matches are merged; passages of at least WORDS words are returned.

So each word of a passage of WORDS words that occurs twice, in one document or in two, is in a returned
passage, and each returned word is in a run of at least RUN words that occurs elsewhere. ``n_later`` counts
the passage's words in runs that also occur earlier (by doc_id and place), which a removal takes out.

Runs are compared by 64-bit hashes of their words, words beside them by 32-bit ones.

``n_later`` counts runs alone, without the words by which matches go on left and right: the least that a removal
takes out. The table of matches lies in the checkpoint folder until that is cleared.

Defined results: of equal hashes in a span the first is the minimiser; a text of any length is taken whole, its
suffixes ``SLICE`` at a time; null and empty texts, and texts of less than WORDS words, have no passage; rows that
repeat both id and text count as one document and give its passages once; a null doc_id is the largest and
comes back as null; an empty table gives no rows; columns other than ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.llm.common import documents, per_batch, prepare
from lumenframe.llm.windows import LAST, PACKED, STARTS, bucket_of, by_document, by_part, pack, sizes, unpack
from lumenframe.llm.words import Words, chunks, mix, rolling

WORDS, SPAN, GRAM = 50, 20, 3
#: What suffixes are sorted by.
ORDER = ["way", "h", "context", "doc", "mark", "place"]
FLUSH = 400_000
#: Suffixes whose words beside them are laid out at once.
SLICE = 20_000
BUCKET = 600_000


def retained(words: Words, span: int = SPAN, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """(text, word) numbers of the minimisers of a chunk, word numbers counted in the chunk."""
    n = len(words.hash)
    none = np.zeros(0, np.int64)
    if n < span + gram - 1:
        return none, none
    owner = np.repeat(np.arange(len(words.first) - 1), np.diff(words.first))
    grams = rolling(words.hash, gram)
    reach = span + gram - 2
    inside = np.flatnonzero(owner[: n - reach] == owner[reach:])
    at = np.unique(inside + np.lib.stride_tricks.sliding_window_view(grams, span)[inside].argmin(axis=1))
    return owner[at], at


def _in_order(h: np.ndarray, doc: np.ndarray, mark: np.ndarray, pos: np.ndarray, below: int = 0):
    """The rows by (hash, doc, mark, place), each once (the lowest ``below`` bits apart), with whether each is its hash's first and how many
    the hash has."""
    order = np.lexsort((pos, mark, doc, h))
    h, doc, mark, pos = h[order], doc[order], mark[order], pos[order]
    fresh = np.concatenate([[True], h[1:] != h[:-1]])
    own = fresh.copy()
    own[1:] |= (doc[1:] != doc[:-1]) | (mark[1:] != mark[:-1]) | (pos[1:] >> below != pos[:-1] >> below)
    h, doc, mark, pos, fresh = h[own], doc[own], mark[own], pos[own], fresh[own]
    count = np.diff(np.append(np.flatnonzero(fresh), len(h)))
    return h, doc, mark, pos, fresh, np.repeat(count, count)


def _sample(run: int, span: int, gram: int, buckets: int):
    """Packed rows of retained suffixes. Later ones of a hash within a flush go to the buckets below 0; the
    first goes to its hash's bucket, its place doubled, plus one if it was alone there."""

    def flush(parts):
        h, doc, mark, pos, first, many = _in_order(*(np.concatenate(x) for x in zip(*parts, strict=True)))
        place = np.lexsort((pos, mark, doc))  # packs well
        h, doc, mark, pos, first, many = (x[place] for x in (h, doc, mark, pos, first, many))
        later = ~first
        yield from pack(-1 - bucket_of(mix(doc[later].astype(np.uint64)), buckets), None, doc[later], mark[later], pos[later] * 2 + 1)
        yield from pack(bucket_of(h[first], buckets), h[first], doc[first], mark[first], pos[first] * 2 + (many[first] == 1))

    def task(batches):
        parts, size = [], 0
        for batch in batches:
            ids, marks = np.asarray(batch.column(0).fill_null(LAST)), np.asarray(batch.column(2))
            for row, words in chunks(batch.column(1)):
                owner, at = retained(words, span, gram)
                fits = at + run <= words.first[owner + 1] if len(at) else np.zeros(0, bool)
                owner, at = owner[fits], at[fits]
                if len(at):
                    parts.append((rolling(words.hash, run)[at], ids[row + owner], marks[row + owner], (at - words.first[owner]).astype(np.int32)))
                    size += len(at)
                if size >= FLUSH:
                    yield from flush(parts)
                    parts, size = [], 0
        if parts:
            yield from flush(parts)

    return task


def _repeated(parts: int):
    """Of one bucket: the suffixes whose run occurs again, as twice the place, plus one if an earlier suffix
    has the run."""

    def repeated(table: pa.Table) -> pa.Table:
        h, doc, mark, pos = unpack(table)
        if table["bucket"][0].as_py() >= 0:
            _, doc, mark, pos, first, many = _in_order(h, doc, mark, pos, below=1)
            again = (many > 1) | (pos & 1 == 0)
            doc, mark, pos = doc[again], mark[again], ((pos >> 1) * 2 + ~first)[again]
        return by_part(doc, mark, pos, parts)

    return repeated


def _contexts(run: int, span: int):
    """Over (doc, mark, text, starts): for each suffix a row with the words after its run (way 0) and one with
    the words before it, backwards (way 1)."""

    def step(batch: pa.RecordBatch):
        for row, words in chunks(batch.column(2)):
            short = (words.hash >> np.uint64(32)).astype(np.uint32)
            short[short == 0] = 1
            sizes = np.diff(words.first)
            rows, places = [], []
            for i in range(len(sizes)):
                own = np.frombuffer(batch.column(3)[row + i].as_py(), "<i4")
                rows.append(np.full(len(own), i))
                places.append(own)
            every, all_places, runs = np.concatenate(rows), np.concatenate(places).astype(np.int64), rolling(words.hash, run)
            for first in range(0, len(every), SLICE):
                owner, place = every[first : first + SLICE], all_places[first : first + SLICE]
                yield from lay_out(batch, row, words, short, runs, owner, place)

    def lay_out(batch, row, words, short, runs, owner, place):
        at = (place >> 1) + words.first[owner]
        lo, hi = words.first[owner][:, None], words.first[owner + 1][:, None]
        after = at[:, None] + run + np.arange(span)
        before = at[:, None] - 1 - np.arange(span)
        top = len(short) - 1
        right = np.where(after < hi, short[np.minimum(after, top)], 0).astype(">u4")
        left = np.where(before >= lo, short[np.maximum(before, 0)], 0).astype(">u4")
        h = runs[at].view(np.int64)
        text = pa.array(row + owner)
        for way, x in enumerate((right, left)):
            context = pa.FixedSizeBinaryArray.from_buffers(pa.binary(4 * span), len(x), [None, pa.py_buffer(np.ascontiguousarray(x))]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), way, np.int32)), pa.array(h), context, batch.column(0).take(text), batch.column(1).take(text), pa.array(place.astype(np.int32))], names=ORDER)

    return step


def _common(way: np.ndarray, h: np.ndarray, words: np.ndarray) -> np.ndarray:
    """How many words each row has in common with the one before it (row 0: none)."""
    same = (words[1:] == words[:-1]) & (words[1:] != 0)
    length = np.where(same.all(axis=1), words.shape[1], same.argmin(axis=1))
    return np.concatenate([[0], np.where((h[1:] == h[:-1]) & (way[1:] == way[:-1]), length, 0)])


_MATCH = pa.schema([("way", pa.int32()), ("doc", pa.int64()), ("mark", pa.int64()), ("place", pa.int32()), ("match", pa.int32()), ("part", pa.int32()), ("h", pa.int64()), ("context", pa.binary())])


def _match_rows(held: pa.Table, match: np.ndarray, is_edge: bool) -> list[pa.RecordBatch]:
    """Rows with their matches; if the first is the first or last of its partition, also with what it takes
    to compare it with another partition's."""
    n = len(match)
    edge = np.arange(n) == (0 if is_edge else -1)
    part = pa.array(np.full(n, TaskContext.get().partitionId(), np.int32), mask=~edge)
    context = pa.array([held["context"][0].as_py() if e else None for e in edge] if is_edge else [None] * n, pa.binary())
    columns = [*(held[c].combine_chunks() for c in ("way", "doc", "mark", "place")), pa.array(match, pa.int32()), part, pa.array(held["h"].to_numpy(), mask=~edge), context]
    return pa.table(columns, schema=_MATCH).to_batches()


def _compare_neighbours(span: int):
    """For mapInArrow over a sorted partition. One row is kept back from batch to batch."""

    def task(batches):
        held, kept_match, begun = None, 0, False
        for batch in batches:
            if not batch.num_rows:
                continue
            now = pa.Table.from_batches([batch])
            rows = now if held is None else pa.concat_tables([held, now])
            words = np.frombuffer(b"".join(rows["context"].to_pylist()), ">u4").reshape(len(rows), span)
            back = _common(rows["way"].to_numpy(), rows["h"].to_numpy(), words)
            back[0] = kept_match
            match = np.maximum(back, np.append(back[1:], 0))
            if len(rows) > 1:
                yield from _match_rows(rows.slice(0, len(rows) - 1), match[:-1], not begun)
                begun = True
            held, kept_match = rows.slice(len(rows) - 1), int(back[-1])
        if held is not None:
            yield from _match_rows(held, np.array([kept_match]), True)

    return task


def neighbour_matches(suffixes: DataFrame, span: int = SPAN) -> DataFrame:
    """(way, doc, mark, place, match): the most words of ``context`` that a suffix shares with another of its run."""
    spark = suffixes.sparkSession
    found = suffixes.select(*ORDER).repartitionByRange(*ORDER).sortWithinPartitions(*ORDER).mapInArrow(_compare_neighbours(span), "way int, doc long, mark long, place int, match int, part int, h long, context binary")
    folder = f"{spark.sparkContext.getCheckpointDir()}/matches-{uuid.uuid4().hex}"
    found.write.parquet(folder)
    saved = spark.read.parquet(folder)
    # where partitions meet: at most two rows of each
    edges = sorted(saved.where("part is not null").collect(), key=lambda r: (r["part"], r["way"], r["h"], bytes(r["context"]), r["doc"], r["mark"], r["place"]))
    more = []
    for a, b in zip(edges, edges[1:], strict=False):
        if a["part"] != b["part"]:
            words = np.frombuffer(bytes(a["context"]) + bytes(b["context"]), ">u4").reshape(2, span)
            n = int(_common(np.array([a["way"], b["way"]]), np.array([a["h"], b["h"]]), words)[1])
            more += [(x["way"], x["doc"], x["mark"], x["place"], n) for x in (a, b) if n]
    out = saved.select("way", "doc", "mark", "place", "match")
    return out.union(spark.createDataFrame(more, "way int, doc long, mark long, place int, match int")) if more else out


def passages(docs: DataFrame, words: int = WORDS, span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """doc_id, start_word, end_word, n_words, n_later of each repeated passage of at least ``words`` words."""
    prepare(docs.sparkSession)
    run = words - span + 1
    plain = documents(docs).select(F.coalesce("doc_id", F.lit(LAST)).alias("doc"), "text", F.xxhash64("text").alias("mark"))
    size, shared_ids, repeated_rows = sizes(plain)
    if not shared_ids:
        plain = plain.withColumn("mark", F.lit(0).cast("long"))
    buckets = max(1, -(-2 * size // ((span + 1) * BUCKET)))  # two places are retained of span + 1
    packed = plain.select("doc", "text", "mark").mapInArrow(_sample(run, span, gram, buckets), PACKED)
    by_doc = packed.groupBy("bucket").applyInArrow(_repeated(buckets), PACKED).groupBy("bucket").applyInArrow(by_document, STARTS)
    found = plain.join(by_doc.hint("shuffle_hash"), ["doc", "mark"])
    if repeated_rows:
        found = found.dropDuplicates(["doc", "mark"])
    suffixes = found.select("doc", "mark", "text", "starts").mapInArrow(per_batch(lambda: _contexts(run, span)), "way int, h long, context binary, doc long, mark long, place int")
    at, right = F.expr("place >> 1"), F.col("way") == 0
    spans = (
        neighbour_matches(suffixes, span)
        .select("doc", "mark", F.when(right, at).otherwise(at - F.col("match")).alias("a"), F.when(right, at + run + F.col("match")).otherwise(at + run).alias("b"), (right & (F.col("place") % 2 == 1)).alias("later"))
        .groupBy("doc", "mark").agg(F.collect_list(F.struct("a", "b", "later")).alias("spans"))  # of one document
    )

    def make():
        def step(batch: pa.RecordBatch):
            out = []
            for doc, own in zip(batch.column(0).to_pylist(), batch.column(2), strict=True):
                own = own.values
                a, b, later = (own.field(k).to_numpy(zero_copy_only=False) for k in range(3))
                change, runs = np.zeros(b.max() + 1, np.int64), np.zeros(b.max() + 1, np.int64)
                np.add.at(change, a, 1)
                np.add.at(change, b, -1)
                np.add.at(runs, a[later], 1)
                np.add.at(runs, a[later] + run, -1)
                again = np.cumsum(runs) > 0
                for s, e in np.flatnonzero(np.diff(np.cumsum(change) > 0, prepend=False, append=False)).reshape(-1, 2).tolist():
                    if e - s >= words:
                        out.append((None if doc == LAST else doc, s, e, e - s, int(again[s:e].sum())))
            if out:
                kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["doc_id", "start_word", "end_word", "n_words", "n_later"])

        return step

    return spans.mapInArrow(per_batch(make), "doc_id long, start_word int, end_word int, n_words int, n_later int")
