"""SimHash near-duplicates found by Golay-code fuzzy keys.

A 64-bit fingerprint is cut into three segments of 22, 21 and 21 bits. If two fingerprints differ in at
most 4 bits, the two segments other than the worst one differ in at most 2 bits together. Take those two
as one word of up to 43 bits: words within 2 bits have a word between them that is within 1 bit of each.
Each fingerprint therefore flips each single bit of a segment pair, decodes both segments with the
perfect (23,12) Golay code, and keeps the distinct pairs of 12-bit codeword indices as keys; any two
fingerprints within 4 bits share a key. Candidates with a common key are verified on all 64 bits.

Keys are joined on distinct fingerprints only, so that copies of a text cost one row; see
``graph.link_by_keys`` for how large groups of near copies are kept from giving all their pairs.

Defined results: null text counts as empty; a text without words has fingerprint zero and links like any
other; a text with fewer than four words has its word sequence as its one shingle; a text of any length is
taken whole; a bit set in exactly half of the shingles is 0; repeated rows stay repeated; an empty table gives
no rows; columns other than ``doc_id`` and ``text`` are ignored; rows with a null ``doc_id`` take part and take
the smallest non-null ``doc_id`` of their component (null if none).
"""

from __future__ import annotations

import re
import string
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenframe.llm.common import WORD, documents, hot_join, is_set, per_batch, prepare
from lumenframe.llm.graph import link_by_keys

SHINGLE = 4
SEED = 42
MAX_BITS = 4
SEGMENTS = ((0, 22), (22, 21), (43, 21))  # (first bit, bits)
#: The generator polynomial of the (23,12) Golay code, x^11+x^10+x^6+x^5+x^4+x^2+1. Fixed value.
GOLAY = 0b110001110101

_lower = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
_words = re.compile(WORD).findall


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """Majority bits over the XXH64 of all word shingles, repeats included."""
    words = _words(text.translate(_lower))
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    hashed = xxhash.xxh64_intdigest
    grams = map(" ".join, zip(*(words[i:] for i in range(shingle)), strict=False)) if len(words) >= shingle else (" ".join(words),)
    h = np.fromiter((hashed(g, SEED) for g in grams), dtype="<u8", count=n)
    bits = np.unpackbits(h.view(np.uint8), bitorder="little").reshape(n, 64)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 255):  # sums of bytes that can't overflow are several times faster
        ones += np.add.reduce(bits[at : at + 255], axis=0, dtype=np.uint8)
    return int.from_bytes(np.packbits(ones * 2 > n, bitorder="little").tobytes(), "little")


@lru_cache(maxsize=1)
def decoder() -> np.ndarray:
    """For each 23-bit word the 12-bit index of the one codeword within 3 bits of it."""
    index = np.arange(1 << 12, dtype=np.uint32)
    words = np.zeros(1 << 12, np.uint32)
    for bit in range(12):
        words ^= np.where(index >> bit & 1, np.uint32(GOLAY << bit), np.uint32(0))
    one = np.uint32(1) << np.arange(23, dtype=np.uint32)
    errors = [np.zeros(1, np.uint32), one]
    i, j = np.triu_indices(23, 1)
    errors.append(one[i] | one[j])
    errors.append(np.array([one[a] | one[b] | one[c] for a in range(23) for b in range(a + 1, 23) for c in range(b + 1, 23)], np.uint32))
    table = np.empty(1 << 23, np.uint16)
    for e in np.concatenate(errors):
        table[words ^ e] = index
    return table


def golay_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) for the distinct keys of each fingerprint; a key names its pair of segments."""
    table = decoder()
    parts = [((fps >> np.uint64(a)) & np.uint64((1 << n) - 1)).astype(np.uint32) for a, n in SEGMENTS]
    own = [table[p].astype(np.int64) for p in parts]
    near = [np.concatenate([o[:, None], table[p[:, None] ^ (np.uint32(1) << np.arange(n, dtype=np.uint32))]], axis=1).astype(np.int64) for p, o, (_, n) in zip(parts, own, SEGMENTS, strict=True)]
    rows, keys = [], []
    for pair, (a, b) in enumerate(((0, 1), (0, 2), (1, 2))):
        k = np.concatenate([near[a] << 12 | own[b][:, None], own[a][:, None] << 12 | near[b]], axis=1)
        k.sort(axis=1)
        fresh = np.ones(k.shape, bool)
        fresh[:, 1:] = k[:, 1:] != k[:, :-1]
        r, c = np.nonzero(fresh)
        rows.append(r)
        keys.append(k[r, c] | pair << 24)
    return np.concatenate(rows), np.concatenate(keys)


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long)."""

    def make():
        def step(batch: pa.RecordBatch):
            fp = np.array([fingerprint(t.as_py(), shingle) for t in batch.column(1)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp)], names=["doc_id", "fp"])

        return step

    return documents(docs).mapInArrow(per_batch(make), "doc_id long, fp long")


#: Keys are smaller than this.
KEYS = 3 << 24


def bucket_keys(fps: DataFrame, bits: bytes | None = None) -> DataFrame:
    """fp -> its rows (fp, key); with ``bits`` only keys whose bit is set."""

    def make():
        wanted = None if bits is None else np.frombuffer(bits, np.uint8)

        def step(batch: pa.RecordBatch):
            own = batch.column(0).to_numpy()
            for at in range(0, len(own), 1 << 14):
                part = own[at : at + (1 << 14)]
                rows, keys = golay_keys(part.view(np.uint64))
                if wanted is not None:
                    on = is_set(wanted, keys)
                    rows, keys = rows[on], keys[on]
                yield pa.RecordBatch.from_arrays([pa.array(part[rows]), pa.array(keys.astype(np.int32))], names=["fp", "key"])

        return step

    return fps.mapInArrow(per_batch(make), "fp long, key int")


def majority(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Of the hashes from bounds[i] to bounds[i + 1] (one at least) the bits set in over half, as signed longs."""
    bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    ones = np.add.reduceat(bits, bounds[:-1], axis=0, dtype=np.int32)
    return np.packbits(ones * 2 > np.diff(bounds)[:, None], axis=1, bitorder="little").view("<i8").ravel()


def near(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= MAX_BITS


def linked(fps: DataFrame) -> DataFrame:
    """Distinct ``fp`` -> (fp, root): the smallest fp (signed) of its component; fps alone are left out."""
    return link_by_keys(bucket_keys(fps).withColumnRenamed("fp", "node"), near=near).select(F.col("node").alias("fp"), F.col("component").alias("root"))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable) for each row."""
    prepare(docs.sparkSession)
    own = fingerprints(docs, shingle).checkpoint()
    distinct = own.groupBy("fp").agg(F.min("doc_id").alias("low"), F.count("*").alias("n")).checkpoint()
    roots = linked(distinct.select("fp"))
    classes = distinct.join(roots, "fp", "left").select("fp", "low", "n", F.coalesce("root", "fp").alias("root")).checkpoint()
    ids = classes.groupBy("root").agg(F.min("low").alias("component_id"), F.count("*").alias("n"))
    named = hot_join(classes.withColumnRenamed("n", "rows"), ids, "root", classes.count()).select("fp", "component_id", F.col("rows").alias("n")).checkpoint()
    return hot_join(own, named, "fp", own.count()).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
