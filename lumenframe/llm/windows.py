"""Removal of repeated passages by Rabin-Karp hashes of every window of a fixed number of words.

1. Each task hashes every window of its documents. Within a run of about ``FLUSH`` windows it combines:
   of each hash only the occurrences in the smallest document go on, the others are known to be repeated.
2. Hashes are counted in Spark by bucket of the hash. A bucket holds a bounded number of windows, however
   often one of them occurs, as a hot window comes once from each run only. Windows travel as packed
   arrays, a row for each bucket and run.
3. The starts of repeated windows come together by part of the documents, also packed, then by document;
   they are merged into maximal intervals, and the words inside are dropped.

A window's bucket comes from a second, independent hash, so windows count as equal if 64 bits of the first
and the bucket of the second are. With W windows in all, W / BUCKET buckets, about W * BUCKET / 3.7e19 pairs
of different windows are taken for equal: 0.000003 over 110 million windows, 0.5 over 2e13 (some 100 TB).

Defined results: null text has no words; a text of any length is hashed whole, in several runs; a document with fewer words than a window keeps all; repeats
within one document are kept unless an earlier document has them; rows with the same ``doc_id`` don't
remove from each other; a null ``doc_id`` counts as larger than any other and comes back as null; an empty
table gives no rows; columns other than ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.llm.common import documents, prepare
from lumenframe.llm.words import chunks, mix, rolling, second

WINDOW = 50
FLUSH = 500_000
#: Windows that a bucket holds, as counted before.
BUCKET = 1_000_000
LAST = (1 << 63) - 1

_PACKED = pa.schema([("bucket", pa.int32()), ("hash", pa.binary()), ("doc", pa.binary()), ("count", pa.binary()), ("pos", pa.binary())])
_STARTS = pa.schema([("doc", pa.int64()), ("mark", pa.int64()), ("starts", pa.binary())])


def bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int32)


def _turns(*columns: np.ndarray) -> np.ndarray:
    """Where any of the columns differs from the row before, and row 0."""
    if not len(columns[0]):
        return np.zeros(0, np.int64)
    differs = np.ones(len(columns[0]), bool)
    differs[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return np.flatnonzero(differs)


def _parts(*columns: np.ndarray) -> list[tuple[int, int]]:
    """Ranges of rows that are alike in all columns."""
    edges = _turns(*columns).tolist()
    return list(zip(edges, [*edges[1:], len(columns[0])], strict=False))


def _planes(x: np.ndarray) -> bytes:
    """First the lowest bytes of all values, then the next ones: small values then compress well."""
    return np.ascontiguousarray(x).view(np.uint8).reshape(len(x), -1).T.tobytes()


def _unplanes(data: bytes, kind: str) -> np.ndarray:
    kind = np.dtype(kind)
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(kind.itemsize, -1).T).view(kind).ravel()


def pack(bucket: np.ndarray, h: np.ndarray | None, doc: np.ndarray, mark: np.ndarray, pos: np.ndarray):
    """One row for each bucket; within it, rows stay as they come, a document's beside each other once, ids
    and places as differences."""
    order = np.argsort(bucket, kind="stable")
    bucket, doc, mark, pos = bucket[order], doc[order], mark[order], pos[order].astype("<i4")
    h = None if h is None else h[order]
    rows: list[list] = [[], [], [], [], []]
    for a, b in _parts(bucket):
        turn = _turns(doc[a:b], mark[a:b])
        ids, count = np.stack([np.diff(doc[a:b][turn], prepend=0), mark[a:b][turn]]), np.diff(np.append(turn, b - a))
        step = np.diff(pos[a:b], prepend=0)
        step[turn] = pos[a:b][turn]
        for column, value in zip(rows, (bucket[a], None if h is None else h[a:b].tobytes(), _planes(ids.ravel()), _planes(count), _planes(step.astype("<i4"))), strict=True):
            column.append(value)
    if rows[0]:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, _PACKED, strict=True)], schema=_PACKED)


def unpack(table: pa.Table) -> tuple[np.ndarray | None, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, doc, mark, pos) of all rows of packed ones."""
    out: list[list[np.ndarray]] = [[], [], [], []]
    for h, doc, count, pos in zip(*(table[c].to_pylist() for c in ("hash", "doc", "count", "pos")), strict=True):
        ids, marks = _unplanes(doc, "<i8").reshape(2, -1)
        n = _unplanes(count, "<i8")
        step = _unplanes(pos, "<i4").astype(np.int64)
        total, turn = np.cumsum(step), np.cumsum(n) - n
        values = None if h is None else np.frombuffer(h, np.uint64), np.repeat(np.cumsum(ids), n), np.repeat(marks, n), total - np.repeat(total[turn] - step[turn], n)
        for column, value in zip(out, values, strict=True):
            column.append(value)
    return tuple(None if x[0] is None else np.concatenate(x) for x in out)


def by_part(doc: np.ndarray, mark: np.ndarray, pos: np.ndarray, parts: int) -> pa.Table:
    """Packed rows by a part of the documents."""
    order = np.lexsort((pos, mark, doc))
    doc, mark, pos = doc[order], mark[order], pos[order]
    return pa.Table.from_batches(list(pack(bucket_of(mix(doc.astype(np.uint64)), parts), None, doc, mark, pos)), _PACKED)


def by_document(table: pa.Table) -> pa.Table:
    """Of one part: a row (doc, mark, starts) for each document, starts in order and once each."""
    _, doc, mark, pos = unpack(table)
    order = np.lexsort((pos, mark, doc))
    doc, mark, pos = doc[order], mark[order], pos[order].astype("<i4")
    keep = np.zeros(len(doc), bool)
    keep[_turns(doc, mark, pos)] = True
    doc, mark, pos = doc[keep], mark[keep], pos[keep]
    starts = [pos[a:b].tobytes() for a, b in _parts(doc, mark)]
    edges = _turns(doc, mark)
    return pa.table([pa.array(doc[edges]), pa.array(mark[edges]), pa.array(starts, pa.binary())], schema=_STARTS)


PACKED = "bucket int, hash binary, doc binary, count binary, pos binary"
STARTS = "doc long, mark long, starts binary"


def _smallest(hashes: np.ndarray, docs: np.ndarray, bucket: np.ndarray | None = None) -> np.ndarray:
    """For each row, the smallest document of its hash (and bucket)."""
    order = np.argsort(hashes, kind="stable")
    h = hashes[order]
    edges = _turns(h)
    if bucket is not None and len(_turns(h, bucket[order])) != len(edges):  # two windows of one hash
        order = np.lexsort((bucket, hashes))
        h = hashes[order]
        edges = _turns(h, bucket[order])
    out = np.empty(len(h), np.int64)
    if len(h):
        out[order] = np.repeat(np.minimum.reduceat(docs[order], edges), np.diff(np.append(edges, len(h))))
    return out


def _hash_windows(window: int, buckets: int):
    """For mapInArrow: packed windows by bucket, in buckets below 0, by document, those already known to be repeated."""

    def flush(parts: list[tuple[np.ndarray, ...]]):
        h, bucket, doc, mark, pos = (np.concatenate(x) for x in zip(*parts, strict=True))
        parts.clear()
        known = doc > _smallest(h, doc, bucket)
        yield from pack(-1 - bucket_of(mix(doc[known].astype(np.uint64)), buckets), None, doc[known], mark[known], pos[known])
        fresh = ~known
        yield from pack(bucket[fresh], h[fresh], doc[fresh], mark[fresh], pos[fresh])

    def run(batches):
        parts, size = [], 0
        for batch in batches:
            ids = np.asarray(batch.column(0).fill_null(LAST))
            marks = np.asarray(batch.column(2))
            for row, words in chunks(batch.column(1)):
                counts = np.diff(words.first)
                full = np.maximum(counts - window + 1, 0)
                if not full.any():
                    continue
                first, other = rolling(words.hash, window), bucket_of(second(words.hash, window), buckets)
                ends = np.cumsum(full)
                for a in range(0, int(ends[-1]), FLUSH):  # a very long text takes several flushes
                    n = np.arange(a, min(a + FLUSH, int(ends[-1])))
                    owner = np.searchsorted(ends, n, side="right")
                    pos = n - (ends - full)[owner]
                    at = words.first[:-1][owner] + pos
                    parts.append((first[at], other[at], ids[row + owner], marks[row + owner], pos.astype(np.int32)))
                    size += len(n)
                    if size >= FLUSH:
                        yield from flush(parts)
                        size = 0
        if parts:
            yield from flush(parts)

    return run


def _count(parts: int):
    """Of one bucket: the starts of windows that also occur in a smaller document."""

    def count(table: pa.Table) -> pa.Table:
        h, doc, mark, pos = unpack(table)
        again = doc > _smallest(h, doc) if table["bucket"][0].as_py() >= 0 else np.ones(len(doc), bool)
        return by_part(doc[again], mark[again], pos[again], parts)

    return count


def word_bound(text: F.Column) -> F.Column:
    """A text's words at most: its spaces and one."""
    rest = text
    for space in " \n\t\r\v\f":
        rest = F.replace(rest, F.lit(space), F.lit(""))
    return F.octet_length(text) - F.octet_length(rest) + 1


def sizes(docs: DataFrame) -> tuple[int, bool, bool]:
    """Words of all texts at most, whether a doc repeats, whether (doc, mark) does. ``docs``: doc, text, mark."""
    by_text = docs.groupBy("doc", "mark").agg(F.count("*").alias("n"), F.max(word_bound(F.col("text"))).cast("long").alias("size"))
    by_doc = by_text.groupBy("doc").agg(F.count("*").alias("texts"), F.max("n").alias("n"), F.sum(F.col("n") * F.col("size")).alias("size"))
    r = by_doc.agg(F.sum("size"), F.max("texts"), F.max("n")).first()
    return int(r[0] or 0), (r[1] or 0) > 1, (r[2] or 0) > 1


def repeated_starts(docs: DataFrame, size: int, window: int = WINDOW) -> DataFrame:
    """``docs``: doc_id, text, mark -> a row (doc, mark, starts) for each document that has repeated windows,
    starts packed as int32. ``size``: words of all texts at most."""
    buckets = max(1, -(-size // BUCKET))
    packed = docs.mapInArrow(_hash_windows(window, buckets), PACKED)
    return packed.groupBy("bucket").applyInArrow(_count(buckets), PACKED).groupBy("bucket").applyInArrow(by_document, STARTS)


def covered(n: int, starts: np.ndarray, window: int) -> np.ndarray:
    """Which of n words a window from one of ``starts`` covers."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + window, -1)
    return np.cumsum(change[:n]) > 0


def remove_repeats(docs: DataFrame, window: int = WINDOW, texts: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of each row; with ``texts`` also the kept text and the
    removed intervals of words as an array of (start, end)."""
    prepare(docs.sparkSession)
    plain = documents(docs).withColumns({"doc": F.coalesce("doc_id", F.lit(LAST)), "mark": F.xxhash64("text")})
    size, shared_ids, _ = sizes(plain)
    if not shared_ids:  # then an id tells its text, and a constant packs to nothing
        plain = plain.withColumn("mark", F.lit(0).cast("long"))
    starts = repeated_starts(plain.select("doc_id", "text", "mark"), size, window)
    joined = plain.join(starts.hint("shuffle_hash"), ["doc", "mark"], "left").select("doc_id", "text", "starts")
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept string, removed array<struct<start:int,end:int>>" * texts

    def run(batches):
        for batch in batches:
            for row, words in chunks(batch.column(1)):
                out: list[list] = [[], [], [], [], []]
                data = words.data.tobytes()
                for i in range(len(words.first) - 1):
                    a, b = words.first[i], words.first[i + 1]
                    packed = batch.column(2)[row + i].as_py()
                    gone = covered(b - a, np.frombuffer(packed, "<i4").astype(np.int64), window) if packed else np.zeros(b - a, bool)
                    kept = b" ".join(data[s:e] for s, e in zip(words.start[a:b][~gone].tolist(), words.end[a:b][~gone].tolist(), strict=True))
                    turn = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]])))
                    for column, value in zip(out, (b - a, gone.sum(), hashlib.sha256(kept).hexdigest(), kept.decode(), [{"start": s, "end": e} for s, e in turn.reshape(-1, 2).tolist()]), strict=True):
                        column.append(value)
                n = len(words.first) - 1
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))]
                columns = [pa.array(c, k) for c, k in zip(out, kinds, strict=True)][: 3 + 2 * texts]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, n), *columns], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept", "removed"][: 4 + 2 * texts])

    return joined.mapInArrow(run, schema)
