"""Neighbour graphs and diffusion operators over ``embeddings``, one graph a label.

Neighbours are looked for inside a label. Vectors are dealt to blocks of bounded size and blocks meet block by
block, as matrix products, so that a large label is many tasks; the square of a label's size is what an exact
neighbour graph costs. ``isomap`` here is the dense form for labels of at most ``DENSE`` vectors, larger ones are
``inapplicable``; ``landmarks`` and ``spectral`` have forms for labels of any size.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenframe.operators.moments import vectors
from lumenframe.session import checkpoint

K, EPSILON = 4, 0.8
#: Vectors that a block holds, about; vectors of a dense matrix at most.
BLOCK, DENSE = 256, 4000


def block_pairs(a: DataFrame, b: DataFrame, emit, schema: str, carry: tuple[str, ...] = (), squared: bool = False) -> DataFrame:
    """``emit(label, a, b, w)`` gives a record batch for each pair of blocks of a label; a, b: arrays of the blocks' rows by name (vec_id, x and
    ``carry``: numbers or arrays of numbers); w: distances, rounded. ``a`` and ``b``: label, vec_id, x and ``carry``. A label has as many blocks as its size asks for."""
    row = F.struct("vec_id", "x", *carry)

    def dealt(v):
        blocks = v.groupBy("label").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
        own = v.join(blocks, "label").withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int"))
        return own.groupBy("label", "blocks", "block").agg(F.sort_array(F.collect_list(row)).alias("rows"))  # about BLOCK vectors

    right = dealt(b).select("label", "block", F.col("rows").alias("b"), "blocks")
    counts = b.groupBy("label").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("others"))
    left = dealt(a).join(counts, "label").select("label", F.col("rows").alias("a"), F.explode(F.sequence(F.lit(0), F.col("others") - 1)).alias("block"))
    return met(left.join(right, ["label", "block"]).select("label", "a", "b"), emit, schema, carry, squared)


def met(pairs: DataFrame, emit, schema: str, carry: tuple[str, ...] = (), squared: bool = False) -> DataFrame:
    """``block_pairs`` for given pairs: label, a, b, the latter arrays of vec_id, x and ``carry``. With ``squared``, w has squared distances, unrounded."""

    def unpack(cell):
        own = cell.values
        out = {}
        for name in ("vec_id", "x", *carry):
            field = own.field(name)
            out[name] = field.flatten().to_numpy(zero_copy_only=False).reshape(len(own), -1) if pa.types.is_list(field.type) else field.to_numpy(zero_copy_only=False)
        return out

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                one, other = unpack(batch.column(1)[k]), unpack(batch.column(2)[k])
                d2 = (one["x"] ** 2).sum(1)[:, None] + (other["x"] ** 2).sum(1) - 2 * one["x"] @ other["x"].T
                w = np.maximum(d2, 0, out=d2)
                w = w if squared else np.round(np.sqrt(w), 6)
                w[one["vec_id"][:, None] == other["vec_id"]] = 0.0
                yield emit(batch.column(0)[k].as_py(), one, other, w)

    return pairs.mapInArrow(run, schema)


def _rows(label, **columns) -> pa.RecordBatch:
    n = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([pa.array(np.full(n, label, np.int32)), *(pa.array(c) for c in columns.values())], names=["label", *columns])


def distances(spark, sf_dir) -> DataFrame:
    """label, src, dst, w for all ordered pairs of a label."""

    def emit(label, a, b, w):
        src, dst = np.repeat(a["vec_id"], len(b["vec_id"])), np.tile(b["vec_id"], len(a["vec_id"]))
        other = src != dst
        return _rows(label, src=src[other], dst=dst[other], w=w.ravel()[other])

    v = vectors(spark, sf_dir)
    return block_pairs(v, v, emit, "label int, src long, dst long, w double")


def nearest(a: DataFrame, b: DataFrame, k: int = K) -> DataFrame:
    """label, src, dst, w, rank: the ``k`` nearest in ``b`` of each vector of ``a``, not counting itself; ties go to
    the smaller id. A pair of blocks hands on ``k`` a vector."""

    return ranked(block_pairs(a, b, nearest_of_block(k), NEAR), k)


NEAR = "label int, src long, dst long, w double"


def nearest_of_block(k: int):
    def emit(label, a, b, w):
        w = np.where(a["vec_id"][:, None] == b["vec_id"], np.inf, w)
        near = np.argsort(w, axis=1, kind="stable")[:, :k]  # ids rise, so ties go to the smaller
        src, dst, d = np.repeat(a["vec_id"], near.shape[1]), b["vec_id"][near].ravel(), np.take_along_axis(w, near, 1).ravel()
        return _rows(label, src=src[np.isfinite(d)], dst=dst[np.isfinite(d)], w=d[np.isfinite(d)])

    return emit


def ranked(top: DataFrame, k: int) -> DataFrame:
    """The ``k`` nearest of what all blocks gave."""
    by_distance = W.partitionBy("label", "src").orderBy("w", "dst")
    return top.withColumn("rank", F.row_number().over(by_distance).cast("bigint")).where(F.col("rank") <= k)


def pairwise_topk(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return nearest(v, v)


def union_edges(top: DataFrame) -> DataFrame:
    """Symmetric union of neighbour lists, each edge once with its smallest weight."""
    return top.groupBy("label", F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(F.min("w").alias("w"))


def knn_edges(spark, sf_dir) -> DataFrame:
    return union_edges(pairwise_topk(spark, sf_dir))


def components(edges: DataFrame, nodes: DataFrame, rounds: int = 64) -> DataFrame:
    """label, node, component: the smallest node reachable, by hashing to the minimum with pointer jumps. It is an
    error if ``rounds`` don't settle it."""
    both = checkpoint(edges.select("label", "src", "dst").union(edges.select("label", F.col("dst"), F.col("src"))))
    now = nodes.select("label", "node", F.col("node").alias("component"))
    for _ in range(rounds):
        heard = both.join(now.withColumnRenamed("node", "dst"), ["label", "dst"]).select("label", F.col("src").alias("node"), "component")
        low = now.union(heard).groupBy("label", "node").agg(F.min("component").alias("component"))
        jump = low.select("label", F.col("node").alias("component"), F.col("component").alias("root"))
        new = checkpoint(low.join(jump, ["label", "component"]).select("label", "node", F.col("root").alias("component")))
        if new.join(now.withColumnRenamed("component", "before"), ["label", "node"]).where("component <> before").isEmpty():
            return new
        now = new
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def knn_components(spark, sf_dir):
    nodes = vectors(spark, sf_dir).select("label", F.col("vec_id").alias("node"))
    return components(knn_edges(spark, sf_dir), nodes)


def graph_diagnostics(spark, sf_dir):
    """Edges, mean and largest weight, long edges, pairs without a path (all pairs less pairs inside a component)."""
    e = knn_edges(spark, sf_dir).groupBy("label").agg(F.count("*").alias("edges"), F.round(F.avg("w"), 5).alias("mean_w"), F.max("w").alias("max_w"), F.count_if(F.col("w") > 0.7).alias("long_edges"))
    c = knn_components(spark, sf_dir).groupBy("label", "component").agg(F.count("*").alias("n"))
    c = c.groupBy("label").agg(F.count("*").alias("components"), F.sum("n").alias("n"), F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("inside"))
    return e.join(c, "label").select("label", "edges", "mean_w", "max_w", "long_edges", "components", (F.col("n") * (F.col("n") - 1) / 2 - F.col("inside")).cast("bigint").alias("infinite_pairs"))


def block_sums(a: DataFrame, b: DataFrame, columns: int, cells, carry: tuple[str, ...] = (), squared: bool = False) -> DataFrame:
    """label, vec_id, c0, c1, ...: sums over all of ``b`` for each vector of ``a``. ``cells(a, b, w)`` gives the sums over a block, one column each; pairs never become rows."""

    def emit(label, a, b, w):
        made = cells(a, b, w)
        return _rows(label, vec_id=a["vec_id"], **{f"c{j}": np.ascontiguousarray(made[:, j]) for j in range(columns)})

    parts = block_pairs(a, b, emit, "label int, vec_id long, " + ", ".join(f"c{j} double" for j in range(columns)), carry, squared)
    return parts.groupBy("label", "vec_id").agg(*(F.sum(f"c{j}").alias(f"c{j}") for j in range(columns)))


def double_center(spark, sf_dir):
    """-1/2 of squared distances, centred by row, column and whole. Row sums are one pass over pairs of blocks, the
    centred values another that has the means at hand; as distances are symmetric, a column's mean is its row's."""
    v = vectors(spark, sf_dir)
    sums = block_sums(v, v, 2, lambda a, b, w: np.stack([(w * w).sum(1), np.full(len(w), float(w.shape[1]))], 1))
    means = checkpoint(sums.select("label", "vec_id", (F.col("c0") / F.col("c1")).alias("m")))
    whole = means.groupBy("label").agg(F.avg("m").alias("g"))
    at_hand = v.join(means, ["label", "vec_id"]).join(whole, "label")

    def emit(label, a, b, w):
        src, dst = np.repeat(a["vec_id"], len(b["vec_id"])), np.tile(b["vec_id"], len(a["vec_id"]))
        return _rows(label, src=src, dst=dst, b=((w * w - a["m"][:, None] - b["m"] + a["g"][:, None]) * -0.5 + 1e-12).ravel())

    return block_pairs(at_hand, at_hand, emit, "label int, src long, dst long, b double", ("m", "g")).withColumn("b", F.round("b", 5))


def with_density(v: DataFrame) -> DataFrame:
    """Adds ``q``, the sum of a vector's kernel row."""
    sums = block_sums(v, v, 1, lambda a, b, w: np.exp(-w * w / EPSILON).sum(1)[:, None])
    return v.join(checkpoint(sums.withColumnRenamed("c0", "q")), ["label", "vec_id"])


def _normalised(a, b, w):
    return np.exp(-w * w / EPSILON) / np.outer(a["q"], b["q"])


def diffusion_markov(spark, sf_dir):
    """Row-stochastic operator after density normalisation; its rows' sums, diagonal and entropy."""
    v = with_density(vectors(spark, sf_dir))

    def cells(a, b, w):
        k = _normalised(a, b, w)
        return np.stack([k.sum(1), (k * np.log(k)).sum(1), np.where(a["vec_id"][:, None] == b["vec_id"], k, 0.0).sum(1)], 1)

    r = block_sums(v, v, 3, cells, ("q",))
    return r.select("label", F.col("vec_id").alias("src"), F.round(F.col("c0") / F.col("c0"), 6).alias("total"), F.round(F.col("c2") / F.col("c0"), 6).alias("stay"), F.round(F.log("c0") - F.col("c1") / F.col("c0"), 5).alias("entropy"))


def degrees(v: DataFrame) -> DataFrame:
    """label, vec_id, d: row sums of the normalised kernel. ``v`` has densities."""
    return block_sums(v, v, 1, lambda a, b, w: _normalised(a, b, w).sum(1)[:, None], ("q",)).withColumnRenamed("c0", "d")


def diffusion_stationary(spark, sf_dir):
    d = checkpoint(degrees(with_density(vectors(spark, sf_dir))))
    return d.join(d.groupBy("label").agg(F.sum("d").alias("total")), "label").select("label", F.col("vec_id").alias("src"), F.round(F.col("d") / F.col("total"), 8).alias("pi"))


def collision_rate(spark, sf_dir):
    """Share of near pairs in the first coordinate whose vectors lie far apart; coordinates meet by buckets of
    the width, each with its neighbour, not pair by pair."""
    v = vectors(spark, sf_dir).select("label", "vec_id", F.col("x")[0].alias("c"), F.slice("x", 2, 63).alias("y"))
    width = 0.05
    a = v.withColumn("b", F.floor(F.col("c") / width))
    left = a.select("label", F.explode(F.array(F.col("b") - 1, F.col("b"), F.col("b") + 1)).alias("b"), F.col("vec_id").alias("i"), F.col("c").alias("ci"), F.col("y").alias("yi"))
    pairs = left.join(a, ["label", "b"]).where((F.col("i") < F.col("vec_id")) & (F.abs(F.col("ci") - F.col("c")) <= width))
    far = F.sqrt(F.aggregate(F.zip_with("yi", "y", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, d: s + d)) > 0.5
    return pairs.groupBy("label").agg(F.count("*").alias("near"), F.count_if(far).alias("far")).withColumn("rate", F.round(F.col("far") / F.col("near"), 6))


# Dense forms: a matrix for each label, in a grouped function.


def small_labels(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Labels of at most DENSE vectors, and the others."""
    n = vectors(spark, sf_dir).groupBy("label").agg(F.count("*").alias("n"))
    return n.where(F.col("n") <= DENSE).select("label"), n.where(F.col("n") > DENSE)


def dense(frame: DataFrame, spark, sf_dir) -> DataFrame:
    """The rows of labels that a dense matrix can hold."""
    return frame.join(small_labels(spark, sf_dir)[0], "label", "left_semi")


def shortest_paths(n: int, src, dst, w) -> np.ndarray:
    """All-pairs path lengths by allowing one more node between at a time; infinite without a path."""
    d = np.full((n, n), np.inf)
    np.fill_diagonal(d, 0.0)
    np.minimum.at(d, (src, dst), w)
    np.minimum.at(d, (dst, src), w)
    for k in range(n):
        np.minimum(d, d[:, k, None] + d[None, k, :], out=d)
    return d


def classical_scaling(d: np.ndarray, k: int = 2) -> tuple[np.ndarray, float]:
    """Coordinates of the leading directions (largest entry positive), share of negative eigenvalues."""
    s = d**2
    b = -0.5 * (s - s.mean(0) - s.mean(1)[:, None] + s.mean())
    values, basis = np.linalg.eigh((b + b.T) / 2)
    values, basis = values[::-1], basis[:, ::-1][:, :k]
    basis = basis * np.where(basis[np.abs(basis).argmax(0), np.arange(k)] < 0, -1.0, 1.0)
    return basis * np.sqrt(np.maximum(values[:k], 0)), float(-values[values < 0].sum() / np.abs(values).sum())


def isomap(spark, sf_dir):
    """Two coordinates of each vector of a connected graph; a disconnected one is ``inapplicable``."""

    def fit(pdf):
        ids = np.unique(np.concatenate([pdf["src"], pdf["dst"]]))
        d = shortest_paths(len(ids), np.searchsorted(ids, pdf["src"]), np.searchsorted(ids, pdf["dst"]), pdf["w"].to_numpy())
        label = int(pdf["label"].iloc[0])
        if not np.isfinite(d).all():
            return pd.DataFrame({"label": label, "vec_id": ids, "a": None, "b": None, "status": "inapplicable"})
        x, _ = classical_scaling(d)
        return pd.DataFrame({"label": label, "vec_id": ids, "a": x[:, 0].round(6), "b": x[:, 1].round(6), "status": "ok"})

    made = dense(knn_edges(spark, sf_dir), spark, sf_dir).groupBy("label").applyInPandas(fit, "label int, vec_id long, a double, b double, status string")
    large = vectors(spark, sf_dir).join(small_labels(spark, sf_dir)[1], "label", "left_semi")
    return made.union(large.select("label", "vec_id", F.lit(None).cast("double"), F.lit(None).cast("double"), F.lit("inapplicable")))


QUERIES = {
    f.__name__: f
    for f in (pairwise_topk, knn_edges, knn_components, graph_diagnostics, double_center, diffusion_markov, diffusion_stationary, collision_rate, isomap)
}

_DIST = "e AS MATERIALIZED (SELECT label, vec_id, list_transform(embedding, lambda v: v::DOUBLE) AS x FROM embeddings), d AS MATERIALIZED (SELECT a.label, a.vec_id AS src, b.vec_id AS dst, round(list_distance(a.x, b.x), 6) AS w FROM e a JOIN e b ON a.label = b.label AND a.vec_id <> b.vec_id)"
_TOP = f"{_DIST}, t AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY label, src ORDER BY w, dst) AS rank FROM d) WHERE rank <= {K}), k AS MATERIALIZED (SELECT label, least(src, dst) AS src, greatest(src, dst) AS dst, min(w) AS w FROM t GROUP BY ALL)"
_COMP = f"{_TOP}, b AS MATERIALIZED (SELECT label, src, dst FROM k UNION ALL SELECT label, dst, src FROM k), c AS (SELECT label, vec_id AS node, vec_id AS root FROM e UNION SELECT c.label, b.dst, c.root FROM c JOIN b ON b.label = c.label AND b.src = c.node WHERE c.root < b.dst), cc AS (SELECT label, node, min(root) AS component FROM c GROUP BY ALL)"
_FULL = f"{_DIST}, f AS (SELECT label, src, dst, w FROM d UNION ALL SELECT label, vec_id, vec_id, 0 FROM e)"
_KERNEL = f"{_FULL}, a AS (SELECT label, src, dst, exp(-w * w / {EPSILON}) AS a FROM f), kk AS MATERIALIZED (SELECT label, src, dst, a / (sum(a) OVER (PARTITION BY label, src) * sum(a) OVER (PARTITION BY label, dst)) AS k FROM a)"

NEIGHBOURS = f"WITH {_TOP} SELECT * FROM t"
ORACLES = {
    "pairwise_topk": NEIGHBOURS,
    "knn_edges": f"WITH {_TOP} SELECT * FROM k",
    "knn_components": f"WITH RECURSIVE {_COMP} SELECT * FROM cc",
    "graph_diagnostics": f"WITH RECURSIVE {_COMP}, g AS (SELECT label, count(*) AS edges, round(avg(w), 5) AS mean_w, max(w) AS max_w, count(*) FILTER (w > 0.7) AS long_edges FROM k GROUP BY label), n AS (SELECT label, component, count(*) AS n FROM cc GROUP BY ALL) SELECT g.*, count(*) AS components, (sum(n) * (sum(n) - 1) / 2 - sum(n * (n - 1) / 2))::BIGINT AS infinite_pairs FROM g JOIN n USING (label) GROUP BY ALL",
    "double_center": f"WITH {_FULL} SELECT label, src, dst, round(-0.5 * (w * w - avg(w * w) OVER (PARTITION BY label, src) - avg(w * w) OVER (PARTITION BY label, dst) + avg(w * w) OVER (PARTITION BY label)) + 1e-12, 5) AS b FROM f",
    "diffusion_markov": f"WITH {_KERNEL}, p AS (SELECT label, src, dst, k / sum(k) OVER (PARTITION BY label, src) AS p FROM kk) SELECT label, src, round(sum(p), 6) AS total, round(max(p) FILTER (src = dst), 6) AS stay, round(sum(-p * ln(p)), 5) AS entropy FROM p GROUP BY ALL",
    "diffusion_stationary": f"WITH {_KERNEL}, s AS (SELECT label, src, sum(k) AS d FROM kk GROUP BY ALL) SELECT label, src, round(d / sum(d) OVER (PARTITION BY label), 8) AS pi FROM s",
    "collision_rate": "WITH e AS (SELECT label, vec_id, embedding[1]::DOUBLE AS c, list_transform(embedding[2:], lambda v: v::DOUBLE) AS y FROM embeddings) SELECT a.label, count(*) AS near, count(*) FILTER (list_distance(a.y, b.y) > 0.5) AS far, round(count(*) FILTER (list_distance(a.y, b.y) > 0.5) / count(*), 6) AS rate FROM e a JOIN e b ON a.label = b.label AND a.vec_id < b.vec_id AND abs(a.c - b.c) <= 0.05 GROUP BY a.label",
}
