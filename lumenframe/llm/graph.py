"""Connected components of an edge table, by alternating large-star and small-star steps.

Everything stays distributed: neighbourhoods are reduced to their smallest node by partial aggregation
and joined back. The edges of a node of very high degree meet their one row by a sort-merge join, whose large
partitions Spark splits; they are never collected. Each round is written to the shared checkpoint folder,
which cuts lineage and survives lost executors.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenframe.llm.common import prepare


#: Edges that a task takes at least, so that rounds over few edges don't take as many tasks as the session has partitions.
EDGES = 1 << 15


def _star(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    both = edges.union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    low = both.groupBy("src").agg(F.least(F.min("dst"), F.first("src")).alias("low"))
    return both, low


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``edges`` (src, dst; any order, repeats and loops allowed) -> (node, component).

    ``component`` is the smallest node reachable. Nodes without an edge to another node are left out.
    """
    prepare(edges.sparkSession)
    work = (
        edges.where("src <> dst")
        .select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst"))
        .distinct()
        .checkpoint()
    )

    def state(edges: DataFrame) -> tuple:
        return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first())

    seen = state(work)
    tasks = max(1, -(-seen[0] // EDGES))  # no round makes more edges than it gets
    for _ in range(max_rounds):
        # large star: each larger neighbour of a node is tied to the smallest of its neighbourhood
        both, low = _star(work)
        large = both.where("dst > src").join(low, "src").select(F.col("dst").alias("src"), F.col("low").alias("dst")).where("src <> dst").distinct()
        # small star: each smaller neighbour, and the node itself, is tied to the smallest one
        least = large.groupBy("src").agg(F.min("dst").alias("low"))
        small = (
            large.join(least, "src").select(F.col("dst").alias("src"), F.col("low").alias("dst"))
            .union(least.select("src", F.col("low").alias("dst")))
            .where("src <> dst").distinct()
        )
        work = small.coalesce(tasks).checkpoint()
        now = state(work)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = work.select(F.col("dst").alias("node")).distinct()
    return work.select(F.col("src").alias("node"), F.col("dst").alias("component")).union(roots.select("node", F.col("node").alias("component")))


def star_edges(placed: DataFrame) -> DataFrame:
    """(node, component) as edges (src, dst): the same components, which take one round to find again."""
    return placed.toDF("src", "dst").where("src <> dst")


def key_ends(keys: DataFrame, near: Callable[[str, str], Column] | None = None) -> DataFrame:
    """key, low, high (its smallest and largest node), n of the keys that several nodes have; with ``near`` (for keys whose
    (node, key) rows are distinct) without those of two nodes that aren't: no pair of theirs is. If ``keys`` have a
    ``rank``, a node of the least one is both ends."""
    ends = keys.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high"), F.count("*").alias("n"), *([F.min(F.struct("rank", "node")).alias("first")] if "rank" in keys.columns else [])).where("low <> high")
    if "rank" in keys.columns:
        ends = ends.select("key", F.col("first.node").alias("low"), F.col("first.node").alias("high"), "n")
    return ends if near is None else ends.where((F.col("n") > 2) | near("low", "high"))


def _meets_end(near: Callable[[str, str], Column]) -> Column:
    """A node has another one at an end of its key that is ``near``. Part of the join, so that keys shared by chance make no rows."""
    return ((F.col("node") != F.col("low")) & near("node", "low")) | ((F.col("node") != F.col("high")) & near("node", "high"))


def key_stars(keys: DataFrame, near: Callable[[str, str], Column] | None = None, ends: DataFrame | None = None) -> DataFrame:
    """Distinct (src, dst): each node with the smallest and the largest node of its keys, where ``near`` holds."""
    near = near or (lambda a, b: F.lit(True))
    if ends is None:
        keys = keys.checkpoint()
        ends = key_ends(keys)
    met = keys.withColumnRenamed("key", "own_key").join(ends, (F.col("own_key") == F.col("key")) & _meets_end(near))
    stars = met.select(F.col("node").alias("src"), F.explode(F.array("low", "high")).alias("dst")).where((F.col("src") != F.col("dst")) & near("src", "dst"))
    return stars.distinct()


def best_stars(keys: DataFrame, ends: DataFrame, near: Callable[[str, str], Column] | None = None) -> DataFrame:
    """(src, dst): for each node the one of its keys' smallest and largest nodes that it has most keys with, where
    ``near`` holds; one row a node at most. ``keys`` may have ``own``, a component: ends in the same one don't count."""
    near = near or (lambda a, b: F.lit(True))
    asked = [c for c in keys.columns if c != "key"]
    met = keys.withColumnRenamed("key", "own_key").join(ends.select("key", "low", "high"), (F.col("own_key") == F.col("key")) & _meets_end(near))
    met = met.select(*asked, F.explode(F.array_distinct(F.array("low", "high"))).alias("dst")).where((F.col("node") != F.col("dst")) & near("node", "dst"))
    if "own" in keys.columns:
        of = keys.select(F.col("node").alias("dst"), F.col("own").alias("dst_own")).join(ends.select(F.explode(F.array("low", "high")).alias("dst")).distinct(), "dst", "left_semi").distinct()
        met = met.join(of, "dst").where("own <> dst_own")
    n = met.groupBy(F.col("node").alias("src"), "dst").agg(F.count("*").alias("n"))
    return n.groupBy("src").agg(F.max(F.struct("n", "dst")).alias("top")).select("src", F.col("top.dst").alias("dst"))


def link_by_keys(keys: DataFrame, verify: Callable[[DataFrame], DataFrame] | None = None, near: Callable[[str, str], Column] | None = None, stars: DataFrame | None = None, sizes: DataFrame | None = None, meet: Callable[[DataFrame, DataFrame], DataFrame] | None = None) -> DataFrame:
    """(node, key) rows -> (node, component) over links between nodes with a common key.

    ``near`` gives a condition on two node columns that joins apply to candidates; ``verify`` takes the
    candidate pairs (src, dst) left and returns those that are links. ``stars`` are links that are known; without
    them each node first meets the smallest and the largest node of its keys, which is linear in the rows and
    settles keys of up to three nodes. Once components of those links are known, only nodes outside a larger key's
    most frequent component meet the nodes of that key, so that a large group of near copies does not give all its
    pairs; no link between components is left out.

    With ``stars`` (and checkpointed keys, then) ``keys`` may have a ``rank``, ``sizes`` an ``n`` a node, and ``meet`` join
    what is left by these, from (src_key, src, src_own, src_rank, src_n) and (key, dst, dst_own, dst_rank, dst_n, major).
    """
    near = near or (lambda a, b: F.lit(True))
    verify = verify or (lambda pairs: pairs)
    keys = keys if stars is not None else keys.checkpoint()
    ends = key_ends(keys).checkpoint()
    least = 1 if stars is not None else 3
    stars = stars if stars is not None else verify(key_stars(keys, near, ends)).checkpoint()
    found = components(stars)
    first = found.withColumnRenamed("component", "known")
    large = keys.join(ends.where(F.col("n") > least).select("key"), "key")
    more = [c for c in keys.columns if c not in ("node", "key")]
    placed = large.join(first, "node", "left").select("key", "node", F.coalesce("known", "node").alias("own"), *more)
    by_own = placed.groupBy("key", "own").agg(F.count("*").alias("n"))
    major = by_own.groupBy("key").agg(F.max(F.struct("n", "own")).alias("top"), F.count("*").alias("owns")).where("owns > 1").select("key", F.col("top.own").alias("major"))
    mixed = placed.join(major, "key")
    if sizes is not None:
        mixed, more = mixed.join(sizes, "node"), [*more, "n"]
    mixed = mixed.checkpoint()
    minor = mixed.where("own <> major").select(F.col("key").alias("src_key"), F.col("node").alias("src"), F.col("own").alias("src_own"), *(F.col(c).alias(f"src_{c}") for c in more))
    other = mixed.select("key", F.col("node").alias("dst"), F.col("own").alias("dst_own"), "major", *(F.col(c).alias(f"dst_{c}") for c in more))
    meets = meet(minor, other) if meet else minor.join(other, F.expr("src_key = key and src_own <> dst_own and (dst_own = major or src < dst)") & near("src", "dst"))
    meets = meets.select("src", "dst")
    return components(star_edges(found).union(verify(meets.distinct())))
