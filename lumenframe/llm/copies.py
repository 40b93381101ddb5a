"""Near copies by the Jaccard coefficient of word shingles: SimHash finds the near ones, prefixes the rest.

Texts at a coefficient of 0.8 differ in some 10 of 64 fingerprint bits, beyond what Golay keys find
(``simhash.MAX_BITS``), so SimHash alone would leave such copies in. Links are therefore found in two steps:

1. A text's shingles are the distinct runs of ``SHINGLE`` words (ASCII letters lower-cased). Equal sets are
   one node. A node's fingerprint has the majority bits of its shingles' hashes, repeats included.
2. Fingerprints share Golay keys (``simhash.bucket_keys``). Each node is paired with the node that it shares most
   keys with among the smallest and largest of its keys, if they are within ``simhash.MAX_BITS``.
3. What is left: shingles have one order for all texts, common ones last, else by hash. Two sets of n and m
   shingles that are alike share one of the first n - ceil(0.8 n) + 1 and m - ceil(0.8 m) + 1 in that order,
   whatever the order is. By these keys each node is again paired with one other, if they aren't yet in one
   component: of a key's nodes the one with the fewest shingles before it, which in a group made from one text is
   the nearest to that. Then nodes of different components that share a key meet, but only if the first shingle
   that they share can be this one: the more shingles a set has before its key, the smaller a partner must be
   (``_in_reach``). No pair is left out. Common are shingles that more than ``CROWD`` texts have among their first
   ones by hash alone, and any that more than ``CROWD`` texts have of which at least half of the first ones are
   common. Both are counted over all texts and kept in a bitmap; a shingle that shares a bit with a common one
   counts as such, which changes no result.
4. Every pair is verified before it is a link. Of each set it is known how many of its shingles are in each of
   some n / 4 parts of the hashes. The smaller counts add up to the most that two sets can have in common;
   pairs for which this is too few go before any set is moved. For the others the sets themselves are compared.

Sets are made again only for texts that a pair names; a bitmap of a fixed size says which those may be. Equal
sets and keys are told by 64-bit hashes, shingles of a pair by 32 bits: of n, some n * n / 4e9 match by accident.

Defined results: null text counts as empty; texts without words are copies of each other; a text with fewer
than ``SHINGLE`` words has its word sequence as its one shingle; texts are taken whole, however long; a null
``doc_id`` counts as the largest and names no component; rows that repeat both id and text are one document;
rows that share an id only are ordered by a hash of the text; an empty table gives no rows; columns other than
``doc_id`` and ``text`` come back from ``keep_one`` unchanged, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.llm import simhash
from lumenframe.llm.common import bitmap, documents, hot_join, is_set, per_batch, prepare, removing_shuffles, unused
from lumenframe.llm.graph import best_stars, components, key_ends, link_by_keys, star_edges
from lumenframe.llm.windows import _planes, _unplanes
from lumenframe.llm.words import chunks, mix, rolling

SHINGLE = 5
#: The least Jaccard coefficient of near copies, as a fraction.
ALIKE = (4, 5)
#: Texts that make a shingle common, bits of the bitmap of common ones (16 MB).
CROWD, COMMON_BITS = 16, 1 << 27
FLUSH, BUCKET = 500_000, 1_000_000
#: Parts of the hashes, at least and at most, a power of two. Counts are bytes; one that is FULL bounds nothing.
LEAST_PARTS, MOST_PARTS, FULL = 64, 8192, 255
#: Ranks are kept in two bytes; a larger one counts as this, which lets more pairs through.
MOST_RANK = (1 << 16) - 1
LAST = (1 << 63) - 1


def shingles(column: pa.Array, k: int = SHINGLE, prints: bool = False):
    """(first row, owner, hash, bounds, fingerprints) for runs of rows: each text's distinct shingles by hash, text
    i's from bounds[i] to bounds[i + 1]. Each text has at least one."""
    for row, words in chunks(pc.ascii_lower(column)):
        size = np.diff(words.first)
        texts = len(size)
        owner = np.repeat(np.arange(texts), size)
        h = rolling(words.hash, k)
        inside = np.flatnonzero(owner[: len(h)] == owner[k - 1 :]) if len(h) else np.zeros(0, np.int64)
        few = np.flatnonzero(size < k)
        short = np.array([rolling(words.hash[words.first[i] : words.first[i + 1]], size[i])[0] if size[i] else 0 for i in few], np.uint64)
        owner, h = np.concatenate([owner[inside], few]), np.concatenate([h[inside], short])
        order = np.lexsort((h, owner))
        owner, h = owner[order], h[order]
        fps = simhash.majority(h, np.searchsorted(owner, np.arange(texts + 1))) if prints else None
        fresh = np.ones(len(h), bool)
        fresh[1:] = (owner[1:] != owner[:-1]) | (h[1:] != h[:-1])
        owner, h = owner[fresh], h[fresh]
        yield row, owner, h, np.searchsorted(owner, np.arange(texts + 1)), fps


def node_of(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A number for each set, whatever its order."""
    return mix(np.add.reduceat(mix(h), bounds[:-1]) ^ np.diff(bounds).astype(np.uint64)).view(np.int64)


def first_keys(owner: np.ndarray, h: np.ndarray, bounds: np.ndarray, common: np.ndarray | None, alike=ALIKE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, hash, rank from 0) of the shingles one of which two sets that are alike share: the first by hash, those
    whose bit in ``common`` is set last."""
    order = np.arange(len(h)) if common is None else np.lexsort((h, is_set(common, h.view(np.int64)), owner))
    n = np.diff(bounds)
    rank = np.arange(len(h)) - bounds[owner]
    taken = rank < (n - -(-n * alike[0] // alike[1]) + 1)[owner]
    return owner[taken], h[order][taken], rank[taken]


def in_crowds(owner: np.ndarray, h: np.ndarray, bounds: np.ndarray, common: np.ndarray) -> np.ndarray:
    """The hashes of the sets of which at least half of the first ones by hash are set in ``common``."""
    at, keys, _ = first_keys(owner, h, bounds, None)
    texts = len(bounds) - 1
    often = np.bincount(at, is_set(common, keys.view(np.int64)), texts)
    return h[(often * 2 >= np.bincount(at, minlength=texts))[owner]]


def part_counts(h: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    """For each set its shingles in each part of the hashes, by their upper bits."""
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        bits = min(max(b - a - 1, 0).bit_length() - 2, MOST_PARTS.bit_length() - 1)
        bits = max(bits, LEAST_PARTS.bit_length() - 1)
        counts = np.bincount((h[a:b] >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
        out.append(np.minimum(counts, FULL).astype(np.uint8).tobytes())
    return out


def most_common(a: bytes, b: bytes) -> int:
    """The most shingles that two sets can share; if a count is full, all."""
    x, y = np.frombuffer(a, np.uint8).astype(np.int64), np.frombuffer(b, np.uint8).astype(np.int64)
    if (x == FULL).any() or (y == FULL).any():
        return 1 << 62
    n = min(len(x), len(y))  # the finer one's parts are those of the coarser, cut further
    return int(np.minimum(x.reshape(n, -1).sum(1), y.reshape(n, -1).sum(1)).sum())


def _may_be_alike(batch: pa.RecordBatch):
    """Over (src, dst, n_a, n_b, counts_a, counts_b, mark_a, mark_b): the pairs whose counts allow ALIKE."""
    n_a, n_b = (batch.column(k).to_numpy().astype(np.int64) for k in (2, 3))
    most = [most_common(a.as_buffer(), b.as_buffer()) for a, b in zip(batch.column(4), batch.column(5), strict=True)]  # no copies
    may = [m * sum(ALIKE) >= int(n) * ALIKE[0] for m, n in zip(most, n_a + n_b, strict=True)]
    yield batch.select([0, 1, 2, 3, 6, 7]).filter(pa.array(may, pa.bool_()))


def _are_alike(batch: pa.RecordBatch):
    """Over (src, dst, n_a, n_b, set_a, set_b): the pairs whose sets reach ALIKE."""
    p, q = ALIKE
    keep = []
    for n_a, n_b, a, b in zip(*(batch.column(k).to_pylist() for k in (2, 3)), batch.column(4), batch.column(5), strict=True):  # sets one at a time
        common = len(np.intersect1d(_unplanes(a.as_py(), "<u4"), _unplanes(b.as_py(), "<u4"), assume_unique=False))
        keep.append(common * q >= (n_a + n_b - common) * p)
    yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))


def _counted(k: int, buckets: int, common: bytes | None = None):
    """Over texts: packed (key, texts) of first shingles by hash, or with ``common`` of all shingles of texts in crowds,
    combined within a flush."""
    marked = None if common is None else np.frombuffer(common, np.uint8)

    def flush(parts):
        keys, n = np.unique(np.concatenate(parts), return_counts=True)
        bucket = (mix(keys) % np.uint64(buckets)).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        keys, n, bucket = keys[order], np.minimum(n[order], 255).astype(np.uint8), bucket[order]
        cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
        ends = np.append(cuts[1:], len(keys))
        yield pa.RecordBatch.from_arrays([pa.array(bucket[cuts]), pa.array([keys[a:b].tobytes() for a, b in zip(cuts, ends, strict=True)], pa.binary()), pa.array([n[a:b].tobytes() for a, b in zip(cuts, ends, strict=True)], pa.binary())], names=["bucket", "keys", "n"])

    def task(batches):
        parts, size = [], 0
        for batch in batches:
            for _, owner, h, bounds, _ in shingles(batch.column(0), k):
                parts.append(first_keys(owner, h, bounds, None)[1] if marked is None else in_crowds(owner, h, bounds, marked))
                size += len(parts[-1])
                if size >= FLUSH:
                    yield from flush(parts)
                    parts, size = [], 0
        if size:
            yield from flush(parts)

    return task


def _crowded(table: pa.Table) -> pa.Table:
    """Of one bucket: the keys of more than CROWD texts."""
    keys = np.frombuffer(b"".join(table["keys"].to_pylist()), np.uint64)
    n = np.frombuffer(b"".join(table["n"].to_pylist()), np.uint8).astype(np.int64)
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    total = np.add.reduceat(n, first) if len(keys) else n
    return pa.table({"key": keys[first][total > CROWD].view(np.int64)})


def _named(k: int):
    def make():
        def step(batch: pa.RecordBatch):
            for row, owner, h, bounds, fps in shingles(batch.column(2), k, prints=True):
                own = batch.slice(row, len(bounds) - 1)
                size = np.diff(bounds).astype(np.int32)
                yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), pa.array(node_of(h, bounds)), pa.array(size), pa.array(part_counts(h, bounds), pa.binary()), pa.array(fps)], names=["doc_id", "mark", "node", "n", "counts", "fp"])

        return step

    return make


def _distinct(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, fresh): an order by key and node, and which of the rows in it aren't as the one before."""
    order = np.lexsort((rows[:, 1], rows[:, 0]))
    rows = rows[order]
    fresh = np.ones(len(rows), bool)
    fresh[1:] = (rows[1:] != rows[:-1]).any(axis=1)
    return order, fresh


def _key_rows(k: int, buckets: int, common: bytes):
    """Packed (key, node) rows: bucket, keys and nodes as bytes, ranks of the keys in their sets (MOST_RANK at most)."""
    marked = np.frombuffer(common, np.uint8)

    def flush(parts):
        rows, ranks = (np.concatenate(x) for x in zip(*parts, strict=True))
        order, fresh = _distinct(rows)
        rows, ranks = rows[order][fresh], ranks[order][fresh]
        bucket = (mix(rows[:, 0].copy()) % np.uint64(buckets)).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        rows, ranks, bucket = rows[order], ranks[order], bucket[order]
        cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
        ends = np.append(cuts[1:], len(rows))
        yield pa.RecordBatch.from_arrays([pa.array(bucket[cuts]), pa.array([rows[a:b].tobytes() for a, b in zip(cuts, ends, strict=True)], pa.binary()), pa.array([ranks[a:b].tobytes() for a, b in zip(cuts, ends, strict=True)], pa.binary())], names=["bucket", "rows", "ranks"])

    def task(batches):
        parts, size = [], 0
        for batch in batches:
            for _, owner, h, bounds, _ in shingles(batch.column(0), k):
                node = node_of(h, bounds).view(np.uint64)
                at, keys, rank = first_keys(owner, h, bounds, marked)
                parts.append((np.stack([keys, node[at]], axis=1), np.minimum(rank, MOST_RANK).astype("<u2")))
                size += len(keys)
                if size >= FLUSH:
                    yield from flush(parts)
                    parts, size = [], 0
        if size:
            yield from flush(parts)

    return task


def _shared(table: pa.Table) -> pa.Table:
    """Of one bucket: (node, key, rank) of the keys that several nodes have, each once."""
    rows = np.frombuffer(b"".join(table["rows"].to_pylist()), np.uint64).reshape(-1, 2)
    ranks = np.frombuffer(b"".join(table["ranks"].to_pylist()), "<u2")
    order, fresh = _distinct(rows)
    rows, ranks = rows[order][fresh], ranks[order][fresh]
    same = rows[1:, 0] == rows[:-1, 0]
    several = np.append(same, False) | np.insert(same, 0, False)
    return pa.table({"node": rows[several, 1].view(np.int64), "key": rows[several, 0].view(np.int64), "rank": ranks[several].astype(np.int32)})


def _size_class(n: str) -> str:
    """SQL for the class of a size: its five upper bits and how many follow. Larger sizes have no smaller class."""
    k = f"greatest(length(bin({n})) - 5, 0)"
    return f"cast({k} * 16 + shiftright({n}, {k}) as int)"


def _in_reach(minor: DataFrame, other: DataFrame) -> DataFrame:
    """Joins (src_key, src, src_own, src_rank, src_n) with (key, dst, dst_own, dst_rank, dst_n, major) for pairs whose
    first shared shingle can be the key. Sets of n and m that are alike share at least (n + m) p / (p + q), all of them
    from the key's rank on, so n - rank and m - rank of the other are no fewer: a rank allows partners of ``least`` to
    ``most`` shingles. Keys are joined by classes of sizes, so that a row meets none that is far out of its reach."""
    p, q = ALIKE

    def reach(rows: DataFrame, x: str) -> DataFrame:
        n, rank = f"cast({x}_n as long)", f"{x}_rank"
        sized = rows.withColumns({f"{x}_least": F.expr(f"ceil({n} * {p} / {q})"), f"{x}_most": F.expr(f"(({p} + {q}) * ({n} - {rank})) div {p} - {n}")})
        return sized.where(f"{x}_most >= {x}_least")

    asked = reach(minor, "src").withColumn("src_class", F.expr(f"explode(sequence({_size_class('src_least')}, {_size_class('src_most')}))"))
    there = reach(other, "dst").withColumn("dst_class", F.expr(_size_class("cast(dst_n as long)")))
    return asked.join(there, F.expr("src_key = key and src_class = dst_class and src_own <> dst_own and (dst_own = major or src < dst) and dst_n between src_least and src_most and src_n between dst_least and dst_most"))


def _sets(k: int, marks: bytes):
    """Over (mark, text): node and hashes of the texts whose mark may be asked for, each once a task."""

    def make():
        bits, seen = np.frombuffer(marks, np.uint8), set()

        def step(batch: pa.RecordBatch):
            own = batch.column(0).to_numpy()
            fresh = is_set(bits, own)
            for i in np.flatnonzero(fresh).tolist():
                fresh[i] = own[i] not in seen
                seen.add(own[i])
            if not fresh.any():
                return
            for _, _, h, bounds, _ in shingles(batch.column(1).filter(pa.array(fresh)), k):
                short = (h >> np.uint64(32)).astype("<u4")  # still in order, so that planes pack well
                sets = [_planes(short[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(node_of(h, bounds)), pa.array(sets, pa.binary())], names=["node", "shingles"])

        return step

    return make


def near_copies(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, component_id (smallest doc_id reached by links of a coefficient of ALIKE or more) for each row."""
    return classes(docs, shingle).select("doc_id", F.when(F.col("first.doc") != LAST, F.col("first.doc")).alias("component_id"))


@removing_shuffles
def classes(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, mark (hash of the text), first (doc, mark): the smallest document of its component, a null id last."""
    prepare(docs.sparkSession)
    text = documents(docs).withColumn("mark", F.xxhash64("text"))
    known = text.select("doc_id", "mark", "text").mapInArrow(per_batch(_named(shingle)), "doc_id long, mark long, node long, n int, counts binary, fp long").checkpoint()
    own = known.select("doc_id", "mark", "node")
    size = text.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    nodes = known.groupBy("node").agg(F.min("mark").alias("mark"), F.first("n").alias("n"), F.first("counts").alias("counts"), F.min("fp").alias("fp"), F.count("*").alias("rows"), F.min(F.struct(F.coalesce("doc_id", F.lit(LAST)).alias("doc"), F.col("mark"))).alias("low")).checkpoint()
    p, q = ALIKE

    def verify(pairs: DataFrame) -> DataFrame:
        a, b = (nodes.select(F.col("node").alias(e), F.col("n").alias(f"n_{x}"), F.col("counts").alias(f"counts_{x}"), F.col("mark").alias(f"mark_{x}")) for e, x in (("src", "a"), ("dst", "b")))
        sized = pairs.join(a.drop("counts_a", "mark_a"), "src").join(b.drop("counts_b", "mark_b"), "dst").where(F.least("n_a", "n_b") * q >= F.greatest("n_a", "n_b") * p).select("src", "dst")
        counted = sized.join(a, "src").join(b, "dst").select("src", "dst", "n_a", "n_b", "counts_a", "counts_b", "mark_a", "mark_b")
        left = counted.mapInArrow(per_batch(lambda: _may_be_alike), "src long, dst long, n_a int, n_b int, mark_a long, mark_b long").checkpoint()
        marks = bitmap(left.select(F.explode(F.array("mark_a", "mark_b")).alias("mark")))
        sets = text.select("mark", "text").mapInArrow(per_batch(_sets(shingle, marks)), "node long, shingles binary").groupBy("node").agg(F.first("shingles").alias("shingles"))
        a, b = (sets.select(F.col("node").alias(e), F.col("shingles").alias(f"set_{x}")) for e, x in (("src", "a"), ("dst", "b")))  # one exchange, used twice
        both = left.select("src", "dst", "n_a", "n_b").join(a, "src").join(b, "dst").select("src", "dst", "n_a", "n_b", "set_a", "set_b")
        return both.mapInArrow(per_batch(lambda: _are_alike), "src long, dst long").checkpoint()

    # near fingerprints: keys are small numbers, those that occur once are told by a bitmap and not moved again
    by_print = nodes.groupBy("fp").agg(F.min("node").alias("node")).checkpoint()
    prints = by_print.select("fp")
    ends = key_ends(simhash.bucket_keys(prints).withColumnRenamed("fp", "node"), simhash.near).checkpoint()
    shared = simhash.bucket_keys(prints, bitmap(ends.select("key"), simhash.KEYS)).withColumnRenamed("fp", "node")
    near = best_stars(shared, ends, near=simhash.near)
    named = by_print.select("fp", F.col("node").alias("of"))
    met = near.join(named.toDF("src", "a"), "src").join(named.toDF("dst", "b"), "dst").select(F.col("a").alias("src"), F.col("b").alias("dst"))
    same = nodes.join(named, "fp").where("node <> of").select(F.col("node").alias("src"), F.col("of").alias("dst"))
    links = verify(met.union(same).distinct())
    # the rest, by first shingles
    buckets = max(1, -(-size // (25 * BUCKET)))  # a key to five words

    def crowded(buckets: int, common: bytes | None = None) -> DataFrame:
        return text.select("text").mapInArrow(_counted(shingle, buckets, common), "bucket int, keys binary, n binary").groupBy("bucket").applyInArrow(_crowded, "key long")

    firsts = crowded(buckets).checkpoint()
    every = crowded(max(1, -(-size // (5 * BUCKET))), bitmap(firsts, COMMON_BITS))
    packed = text.select("text").mapInArrow(_key_rows(shingle, buckets, bitmap(firsts.union(every), COMMON_BITS)), "bucket int, rows binary, ranks binary")
    keys = packed.groupBy("bucket").applyInArrow(_shared, "node long, key long, rank int").checkpoint()
    found = components(links)
    owned = keys.join(found.withColumnRenamed("component", "known"), "node", "left").select("key", "node", F.coalesce("known", "node").alias("own"))
    links = star_edges(found).union(verify(best_stars(owned, key_ends(keys)))).checkpoint()
    roots = link_by_keys(keys, verify, stars=links, sizes=nodes.select("node", "n"), meet=_in_reach).withColumnRenamed("component", "root")
    placed = nodes.select("node", "low", "rows").join(roots, "node", "left").select("node", "low", "rows", F.coalesce("root", "node").alias("root")).checkpoint()
    firsts = placed.groupBy("root").agg(F.min("low").alias("first"), F.count("*").alias("n"))
    named = hot_join(placed, firsts, "root", placed.count()).select("node", "first", F.col("rows").alias("n")).checkpoint()
    return hot_join(own, named, "node", own.count()).select("doc_id", "mark", "first")


@removing_shuffles
def keep_one(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """The first document of each component, all columns. Most rows stay where they are: only those whose bit in a
    bitmap of what goes, or occurs again, is set are dealt out and looked up."""
    found = classes(docs, shingle).select(F.coalesce("doc_id", F.lit(LAST)).alias("doc"), "mark", "first")
    doc, mark, key = unused(docs.columns, "doc", "mark", "key")
    one = found.groupBy("doc", "mark").agg(F.count("*").alias("n"), F.min("first").alias("first")).where("n > 1 or first.doc <> doc or first.mark <> mark")
    gone = one.select(F.col("doc").alias(doc), F.col("mark").alias(mark), F.expr("first.doc = doc and first.mark = mark").alias(key)).checkpoint()
    bits = bitmap(gone.select(F.xxhash64(doc, mark).alias(key)))
    text = F.coalesce(F.col("text"), F.lit(""))
    marked = docs.withColumns({doc: F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)), mark: F.xxhash64(text)}).withColumn(key, F.xxhash64(doc, mark))
    width = len(docs.columns)

    def part(asked: bool):
        def make():
            own = np.frombuffer(bits, np.uint8)

            def step(batch: pa.RecordBatch):
                yield batch.filter(pa.array(is_set(own, batch.column(width + 2).to_numpy()) == asked))

            return step

        return marked.mapInArrow(per_batch(make), marked.schema)

    clear = part(False).select(*docs.columns)
    looked = part(True).drop(key).join(gone, [doc, mark], "left").where(F.coalesce(key, F.lit(True))).dropDuplicates([doc, mark])
    return clear.union(looked.select(*docs.columns))
