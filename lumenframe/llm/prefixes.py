"""The prefix trie of conversations: chained cryptographic prefix digests, one node for each digest.

Turns are put in order by range over the whole table, so a conversation may go over many partitions: a
partition numbers its own rows, and the few conversations that go over a partition's end get the rows before
them added. A turn's place is met by SHA-256 of its role and text, cut to 128 bits; a prefix digest chains
the turn's digest to the prefix digest before it. Chains run in stretches of ``STRETCH`` turns, each a group of its own; the
stretches' last digests are chained on their own and put before the digests of later stretches, so not even
one conversation with most of the turns is a chain in one task (but for a digest each ``STRETCH`` turns).

Every prefix of every conversation is a row; rows of one digest are a node, named by its smallest member and
its depth. A node adds what it counts to all its ancestors by exploding into them. That would be the square
of a conversation's length, so depths are taken in blocks of ``BLOCK``: a node explodes into its ancestors in its
block, block tops into the tops above them in the same way, and, from the top down, each block's total into the block
before it. Rows made are at most ``BLOCK`` for a node whatever the lengths, and levels grow with the
logarithm of the longest conversation; up to ``BLOCK`` turns there is one level, which is the plain explosion.

Which ids end at a node is hashed over their whole sorted list, as SHA-256 asks for: ids are put in order by
range, written as text in pieces, and a node's pieces are hashed one after the other without being gathered.

Defined results: rows with a null conv_id belong to no conversation and are left out; a null role or text
is empty; a null turn comes first; turns of one number are ordered by the digest of role and text, so equal
rows are further turns; a text may have any length; a conversation without turns left is a member of the
root only; an empty table has no nodes; other columns aren't looked at, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.llm.common import hot_join, partitions, prepare

#: A conversation takes at most so many turns from the head of its group's first, which are the ids that end in two zeros.
HEAD, GROUP = 5, 100
STRETCH = 4096
BLOCK = 32
#: Ids that are hashed from one row.
PIECE = 4096


def turns(conversations: DataFrame) -> DataFrame:
    """conv, turn, dig (of role and text), chars."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    told = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary")
    digest = F.unhex(F.substring(F.sha2(told, 256), 1, 32))
    return conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv"), F.col("turn"), digest.alias("dig"), F.length(text).cast("long").alias("chars"))


def _count_runs(batches):
    """Number each run of equal ``conv`` from 0, over batches."""
    last, n = None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        conv = np.asarray(batch.column(0))
        first = np.flatnonzero(np.concatenate([[True], conv[1:] != conv[:-1]]))
        at = np.arange(len(conv)) - np.repeat(first, np.diff(np.append(first, len(conv))))
        if last is not None and conv[0] == last:
            at[: first[1] if len(first) > 1 else len(conv)] += n
        last, n = conv[-1], at[-1] + 1
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at)], names=["conv", "dig", "chars", "part", "at"])


def placed(spark, rows: DataFrame) -> DataFrame:
    """conv, at (from 0, in the order of turns), dig, chars; checkpointed."""
    n = partitions(spark)
    sorted_rows = rows.repartitionByRange(n, "conv", "turn", "dig").sortWithinPartitions("conv", "turn", "dig").select("conv", "dig", "chars", F.spark_partition_id().alias("part"))
    own = sorted_rows.mapInArrow(_count_runs, "conv long, dig binary, chars long, part int, at long").checkpoint()
    ends = own.groupBy("part").agg(F.min(F.struct("conv", -F.col("at"))).alias("low"), F.max(F.struct("conv", "at")).alias("high")).orderBy("part").collect()  # a row a partition
    carried, last, n_last = [], None, 0
    for r in ends:
        low, high = r["low"], r["high"]
        before = n_last if low[0] == last else 0
        if before:
            carried.append((r["part"], low[0], before))
        last, n_last = high[0], high[1] + 1 + (before if high[0] == low[0] else 0)
    starts = spark.createDataFrame(carried, "part int, conv long, before long")  # at most a row a partition
    return own.join(F.broadcast(starts), ["part", "conv"], "left").select("conv", (F.col("at") + F.coalesce("before", F.lit(0))).alias("at"), "dig", "chars")


def _chain(key: int):
    """Rows with columns (``key`` columns of the group, place, dig, others): dig becomes the chain's digest."""

    def run(batches):
        last, held = None, b""
        for batch in batches:
            if not batch.num_rows:
                continue
            groups, out = zip(*(batch.column(k).to_pylist() for k in range(key)), strict=True), []
            for group, dig in zip(groups, batch.column(key + 1).to_pylist(), strict=True):
                held = hashlib.sha256((held if group == last else b"") + dig).digest()[:16]
                last = group
                out.append(held)
            yield pa.RecordBatch.from_arrays([*batch.columns[: key + 1], pa.array(out, pa.binary()), *batch.columns[key + 2 :]], names=batch.schema.names)

    return run


def prefix_digests(rebuilt: DataFrame, deepest: int, stretch: int = STRETCH) -> DataFrame:
    """``rebuilt``: conv, p (place from 0), dig, chars -> the same with prefix digests."""
    by = F.floor(F.col("p") / stretch).cast("long").alias("part")
    rows = rebuilt.select("conv", by, "p", "dig", "chars").repartition("conv", "part").sortWithinPartitions("conv", "part", "p")
    own = rows.mapInArrow(_chain(2), "conv long, part long, p long, dig binary, chars long")
    if deepest <= stretch:
        return own.drop("part")
    own = own.checkpoint()
    ends = own.where(F.col("p") % stretch == stretch - 1).select("conv", "part", "dig").repartition("conv").sortWithinPartitions("conv", "part")
    before = ends.mapInArrow(_chain(1), "conv long, part long, dig binary").select("conv", (F.col("part") + 1).alias("part"), F.col("dig").alias("before"))
    later = own.where("part > 0").join(before, ["conv", "part"])
    joined = F.unhex(F.substring(F.sha2(F.concat("before", "dig"), 256), 1, 32))
    return own.where("part = 0").drop("part").unionByName(later.select("conv", "p", joined.alias("dig"), "chars"))


def _pieces(batches):
    """Rows (conv, p, id) in order -> (conv, p, first id, ids as text, joined by commas)."""
    key, ids = None, []
    out = []

    def close():
        if ids:
            out.append((*key, ids[0], ",".join(map(str, ids)).encode()))

    for batch in batches:
        for *own, i in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if own != key or len(ids) == PIECE:
                close()
                key, ids = own, []
            ids.append(i)
        if out:
            yield _as_batch(out, ["rep", "p", "first", "ids"])
            out = []
    close()
    if out:
        yield _as_batch(out, ["rep", "p", "first", "ids"])


def _as_batch(rows, names):
    return pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=names)


def _hashes(batches):
    key, state, out = None, None, []
    for batch in batches:
        for rep, p, _, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (rep, p) == key:
                state.update(b",")
            else:
                if key is not None:
                    out.append((*key, state.hexdigest()))
                key, state = (rep, p), hashlib.sha256()
            state.update(ids)
        if out:
            yield _as_batch(out, ["rep", "p", "ends_sha256"])
            out = []
    if key is not None:
        yield _as_batch([(*key, state.hexdigest())], ["rep", "p", "ends_sha256"])


def id_hashes(ends: DataFrame) -> DataFrame:
    """``ends``: rep, p, conv -> rep, p and the SHA-256 of the sorted ids."""
    n = partitions(ends.sparkSession)
    pieces = ends.select("rep", "p", "conv").repartitionByRange(n, "rep", "p", "conv").sortWithinPartitions("rep", "p", "conv").mapInArrow(_pieces, "rep long, p long, first long, ids binary")
    return pieces.repartition("rep", "p").sortWithinPartitions("rep", "p", "first").mapInArrow(_hashes, "rep long, p long, ends_sha256 string")


def _into(items: DataFrame, steps, names: DataFrame) -> DataFrame:
    """Sums of ``items`` (rep, p, n_leaves, saved_tokens) over the ancestors at the places ``steps``. ``names``: conv, p, rep of every prefix."""
    sums = [F.sum(c).alias(c) for c in ("n_leaves", "saved_tokens")]
    spread = items.select(F.col("rep").alias("conv"), F.explode(steps).alias("p"), "n_leaves", "saved_tokens").groupBy("conv", "p").agg(*sums)
    return spread.join(names, ["conv", "p"]).groupBy("rep", "p").agg(*sums)


def subtree_sums(nodes: DataFrame, names: DataFrame, deepest: int, block: int = BLOCK) -> DataFrame:
    """``nodes``: rep, p, n_leaves, saved_tokens of a node itself -> the sums over its subtree."""
    p, level, levels = F.col("p"), nodes, []
    width = 1
    while True:
        low = p - p % (width * block)
        own = _into(level, F.sequence(low, p, F.lit(width).cast("long")), names)
        if width > 1 or deepest > block:
            own = own.checkpoint()
        levels.append(own)
        width *= block
        if width >= deepest:
            break
        level = own.where(p % width == 0)
    total = levels.pop()
    while levels:
        tops, width = total.where(f"p > 0 and p % {width // block} = 0"), width // block
        inner = F.lit(width // block).cast("long")
        more = _into(tops, F.sequence(p - width, p - inner, inner), names)
        total = levels.pop().unionByName(more).groupBy("rep", "p").agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
    return total


def trie(conversations: DataFrame, head: int = HEAD, group: int = GROUP, stretch: int = STRETCH, block: int = BLOCK) -> DataFrame:
    """Nodes of the rebuilt conversations: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256. A conversation c is rebuilt from the first crc32(c) % (head + 1) turns of
    conversation c - c % group and its own turns after as many."""
    spark = prepare(conversations.sparkSession)
    own = placed(spark, turns(conversations))
    h = F.crc32(F.col("conv").cast("string").cast("binary")) % (head + 1)
    heads = own.where((F.col("conv") % group == 0) & (F.col("at") < head)).groupBy(F.col("conv").alias("base")).agg(F.sort_array(F.collect_list(F.struct("at", "dig", "chars"))).alias("head"))
    sizes = own.groupBy("conv").agg((F.max("at") + 1).alias("n")).withColumn("base", F.col("conv") - F.col("conv") % group)
    taken = F.coalesce(F.slice("head", 1, h.cast("int")), F.expr("array()").cast("array<struct<at:bigint,dig:binary,chars:bigint>>"))
    shape = sizes.join(heads, "base", "left").select("conv", "n", h.alias("h"), taken.alias("head")).checkpoint()
    grown = shape.select("conv", "n", F.size("head").cast("long").alias("m"), (F.size("head") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length"))
    facts = grown.agg(F.max("length"), F.sum("n"), F.min("conv"), F.count("*"), F.sum("length")).first()
    deepest, n_rows, root, n_convs, n_prefixes = facts
    if not n_convs:
        return spark.createDataFrame([], "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string")
    first = shape.select("conv", F.posexplode("head").alias("p", "t")).select("conv", F.col("p").cast("long").alias("p"), "t.dig", "t.chars")
    tails = hot_join(own.where(F.col("at") >= h), grown.select("conv", "n", "m"), "conv", n_rows).select("conv", (F.col("at") - h + F.col("m")).alias("p"), "dig", "chars")
    prefix = prefix_digests(first.unionByName(tails), deepest, stretch).checkpoint()
    found = prefix.groupBy("dig").agg(F.min("conv").alias("rep"), F.count("*").alias("n"))
    named = hot_join(prefix, found, "dig", n_prefixes).select("conv", "p", "rep", "n", "chars").checkpoint()

    names, nodes = named.select("conv", "p", "rep"), named.where("conv = rep")
    parents = nodes.where("p > 0").select("rep", "p").join(named.select(F.col("conv").alias("rep"), (F.col("p") + 1).alias("p"), F.col("rep").alias("parent")), ["rep", "p"])
    children = parents.groupBy(F.col("parent").alias("rep"), (F.col("p") - 1).alias("p")).agg(F.count("*").alias("n_children"))
    full = nodes.select("rep", "p", "n", "chars").join(parents, ["rep", "p"], "left").join(children, ["rep", "p"], "left").checkpoint()
    values = full.select("rep", "p", F.col("n_children").isNull().cast("long").alias("n_leaves"), ((F.col("n") - 1) * F.col("chars")).alias("saved_tokens"))
    sums = subtree_sums(values, names, max(deepest, 1), block)
    ends = grown.where("length > 0").select("conv", (F.col("length") - 1).alias("p")).join(names, ["conv", "p"]).unionByName(grown.where("length = 0").select("conv", F.lit(-1).cast("long").alias("p"), F.lit(root).alias("rep")))
    hashes = id_hashes(ends)
    top = full.where("p = 0").agg(F.count("*").alias("n_children")).crossJoin(values.agg(F.greatest(F.coalesce(F.sum("n_leaves"), F.lit(0)), F.lit(1)).alias("n_leaves"), F.coalesce(F.sum("saved_tokens"), F.lit(0)).alias("saved_tokens")))  # a row each
    top = top.select(F.lit(root).alias("rep"), F.lit(-1).cast("long").alias("p"), F.lit(None).cast("long").alias("parent"), F.lit(n_convs).alias("n"), "n_children", "n_leaves", "saved_tokens")
    every = full.join(sums, ["rep", "p"]).select("rep", "p", F.when(F.col("p") == 0, F.lit(root)).otherwise(F.col("parent")).alias("parent"), "n", F.coalesce("n_children", F.lit(0)).alias("n_children"), "n_leaves", "saved_tokens").unionByName(top)
    nothing = hashlib.sha256().hexdigest()
    return every.join(hashes, ["rep", "p"], "left").select(
        F.col("rep").cast("long").alias("conv_id"), (F.col("p") + 1).cast("long").alias("depth"), F.col("parent").cast("long").alias("parent_conv_id"), F.col("n").cast("long").alias("n_convs"), F.col("n_children").cast("long").alias("n_children"),
        F.col("n_leaves").cast("long").alias("n_leaves"), F.col("saved_tokens").cast("long").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(nothing)).alias("ends_sha256"),
    )


#: CRC-32 of the decimal id, bit by bit: SQL has no function for it.
_CRC = "xor(list_reduce(list_concat([4294967295], list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda s: CAST(ascii(s) AS BIGINT))), lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"

ORACLE = f"""
WITH t AS MATERIALIZED (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS i,
    sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS dig, length(coalesce(text, '')) AS chars
  FROM conversations WHERE conv_id IS NOT NULL),
c AS MATERIALIZED (SELECT conv_id, conv_id - conv_id % 100 AS base, CAST({_CRC} AS BIGINT) % 6 AS h FROM (SELECT DISTINCT conv_id FROM t)),
r AS MATERIALIZED (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY own, i) AS d, dig, chars FROM (
    SELECT c.conv_id, 0 AS own, t.i, dig, chars FROM c JOIN t ON t.conv_id = c.base AND t.i < c.h
    UNION ALL SELECT c.conv_id, 1, t.i, dig, chars FROM c JOIN t ON t.conv_id = c.conv_id AND t.i >= c.h)),
x AS MATERIALIZED (
  SELECT conv_id, d, chars, sha256(string_agg(dig, '') OVER (PARTITION BY conv_id ORDER BY d)) AS k FROM r
  UNION ALL SELECT conv_id, 0, 0, 'root' FROM c),
n AS MATERIALIZED (SELECT k, d, min(conv_id) AS conv_id, count(*) AS n_convs, max(chars) AS chars FROM x GROUP BY k, d),
up AS MATERIALIZED (SELECT n.k, a.k AS above, a.d FROM n JOIN x a ON a.conv_id = n.conv_id AND a.d <= n.d),
kids AS (SELECT up.above AS k, count(*) AS n_children FROM up JOIN n USING (k) WHERE n.d = up.d + 1 GROUP BY up.above),
own AS MATERIALIZED (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN kids USING (k)),
sums AS (SELECT above AS k, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((n_convs - 1) * chars) AS saved FROM up JOIN own USING (k) GROUP BY above),
ends AS (SELECT k, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) AS ids FROM (SELECT conv_id, arg_max(k, d) AS k FROM x GROUP BY conv_id) GROUP BY k),
par AS (SELECT up.k, p.conv_id AS parent FROM up JOIN n ON n.k = up.k JOIN n p ON p.k = up.above WHERE up.d = n.d - 1)
SELECT own.conv_id, own.d AS depth, parent AS parent_conv_id, n_convs, n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens,
  sha256(coalesce(ids, '')) AS ends_sha256
FROM own JOIN sums USING (k) LEFT JOIN ends USING (k) LEFT JOIN par USING (k)
"""
