"""Ball k-means over integer vectors, exact.

A cluster is a ball: a centroid and a radius that no member exceeds. Another ball can take a member only if
its centroid lies within twice the radius (a neighbour); half the distances to the neighbours cut the ball
into a stable core, whose members are compared with nothing, and annuli, whose members are compared exactly
with the neighbours whose half distance they reach. A ball that did not move and whose neighbours did not
move keeps its members without a distance worked out. All tests are on whole numbers (4 |x - c|^2 against
|c - c'|^2), so pruning never changes a result; ties go to the smaller number.

One pass over the table a round. A task adds up counts, component sums and the largest distance of each
cluster, so a shuffle has a row a task, cluster and component, and the driver gets a row a cluster and
component. The next radius is at most the largest distance plus the centroid's shift, and needs no pass.
Nothing a vector has is stored between rounds: a task replays the rounds so far from the centroids it is
sent, and a lost executor costs its running tasks only. Every ``REPLAY`` rounds the clusters reached are
written to the checkpoint folder with the vectors, so that replays stay short.

Defined results: vectors that are null, have another length, or a null, infinite or undefined component are left
out, and so are those with a component of ``RANGE`` or more in absolute value, whose squared distances
would not fit a long; equal ids are separate vectors, equal starting hashes are ordered by components; a
null id hashes as the empty string; with fewer vectors than clusters each vector starts one; a cluster
that has no member keeps its centroid; an empty table gives no rows; other columns aren't looked at.
"""

from __future__ import annotations

import hashlib
import math
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.llm.common import prepare

K, ROUNDS, SIZE, SCALE, SEED = 8, 10, 64, 1024, 3
#: A component must be less than that; its integer is below 2^25, and four squared distances below 2^63.
RANGE = 32768
#: Rounds that a task replays at most.
REPLAY = 16


class Step(NamedTuple):
    """The centroids of a round; for each ball its neighbours (number, squared distance of the centroids),
    nearest first; whether the ball or a neighbour moved; whether the ball moved."""

    centroids: np.ndarray
    near: list[list[tuple[int, int]]]
    stirred: list[bool]
    moved: np.ndarray


def _apart(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    diff = v - c
    return np.einsum("ij,ij->i", diff, diff)


def make_step(centroids: np.ndarray, before: np.ndarray | None, far: list[int] | None) -> Step:
    """``far``: the largest squared distance of a member from the centroid before (-1: no member)."""
    k = len(centroids)
    moved = np.ones(k, bool) if before is None else (centroids != before).any(1)
    near = []
    for i in range(k):
        gaps = sorted((int(d), j) for j, d in enumerate(_apart(centroids, centroids[i])) if j != i)
        if far is not None and before is not None:
            shift = math.sqrt(int(_apart(centroids[i : i + 1], before[i])[0]))
            reach = 2 * (math.sqrt(max(far[i], 0)) + shift) * (1 + 1e-9) + 1  # rounding can only add a neighbour
            gaps = [(d, j) for d, j in gaps if far[i] >= 0 and d <= reach * reach]
        near.append([(j, d) for d, j in gaps])
    return Step(centroids, near, [bool(moved[i] or any(moved[j] for j, _ in near[i])) for i in range(k)], moved)


def settle(v: np.ndarray, label: np.ndarray | None, steps: list[Step]) -> tuple[np.ndarray, np.ndarray, int]:
    """Clusters, squared distances and the number of distances worked out after ``steps``. ``label``: the clusters before them."""
    own, tried = np.zeros(len(v), np.int64), 0
    stale = np.ones(len(v), bool)
    label = np.zeros(len(v), np.int64) if label is None else label.astype(np.int64)
    for step in steps:
        before = label.copy()
        for i in range(len(step.centroids)):
            rows = np.flatnonzero(before == i)
            again = rows[stale[rows] | step.moved[i]]
            if len(again):
                own[again] = _apart(v[again], step.centroids[i])
                tried += len(again)
            if not step.stirred[i]:
                continue
            start = own[rows]
            best = start.copy()
            for j, gap in step.near[i]:
                reach = np.flatnonzero(4 * start >= gap)  # the annuli from this neighbour outwards
                if not len(reach):
                    break
                d = _apart(v[rows[reach]], step.centroids[j])
                tried += len(reach)
                better = (d < best[reach]) | ((d == best[reach]) & (j < label[rows[reach]]))
                best[reach[better]] = d[better]
                label[rows[reach[better]]] = j
            own[rows] = best
        stale[:] = False
    return label, own, tried


def _vectors(batch: pa.RecordBatch, size: int, scale: int) -> np.ndarray:
    flat = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.floor(flat * scale).astype(np.int64).reshape(-1, size)


def _totals(frame: DataFrame, steps: list[Step], size: int, scale: int) -> tuple[list[int], list[list[int]], list[int], list[int], int]:
    """Counts, component sums, largest and summed squared distances of each cluster after ``steps``; distances worked out."""
    k = len(steps[0].centroids)

    def run(batches):
        n, sums, far, spent, tried = np.zeros(k, np.int64), np.zeros((k, size), np.int64), np.full(k, -1), [0] * k, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            v = _vectors(batch, size, scale)
            label, own, more = settle(v, np.asarray(batch.column(2)) if batch.num_columns > 2 else None, steps)
            tried += more
            for i in np.unique(label):
                on = label == i
                n[i] += on.sum()
                sums[i] += v[on].sum(0)
                far[i] = max(far[i], own[on].max())
                spent[i] += sum(own[on].tolist())
        if n.any():
            spread = lambda a: np.repeat(np.asarray(a), size)
            yield pa.RecordBatch.from_arrays(
                [pa.array(spread(np.arange(k, dtype=np.int32))), pa.array(np.tile(np.arange(size, dtype=np.int32), k)), pa.array(spread(n)), pa.array(sums.ravel()), pa.array(spread(far)), pa.array([str(s) for s in spent for _ in range(size)]), pa.array(np.full(k * size, tried))],
                names=["cluster", "at", "n", "total", "far", "spent", "tried"],
            )

    parts = frame.mapInArrow(run, "cluster int, at int, n long, total long, far long, spent string, tried long")
    whole = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c)
    rows = parts.groupBy("cluster", "at").agg(F.sum("n").alias("n"), whole("total"), F.max("far").alias("far"), whole("spent"), F.sum("tried").alias("tried")).collect()  # k x size rows
    n, far, spent, sums = [0] * k, [-1] * k, [0] * k, [[0] * size for _ in range(k)]
    for r in rows:
        i = r["cluster"]
        n[i], far[i], spent[i], sums[i][r["at"]] = r["n"], r["far"], int(r["spent"]), int(r["total"])
    return n, sums, far, spent, rows[0]["tried"] if rows else 0


def kept(vectors: DataFrame, size: int = SIZE) -> DataFrame:
    """vec_id and embedding of the vectors that take part."""
    e = F.col("embedding")
    fits = (F.size(e) == size) & F.forall(e, lambda x: F.coalesce(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < RANGE), F.lit(False)))
    return vectors.where(F.coalesce(fits, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), e.cast("array<double>").alias("embedding"))


def cluster(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, size: int = SIZE, scale: int = SCALE, seed: int = SEED, replay: int = REPLAY, report: list | None = None) -> DataFrame:
    """vec_id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256 of each vector that takes part.
    ``report`` gets (distances worked out by the task's replays, balls that stayed as they were) a round."""
    prepare(vectors.sparkSession)
    frame = kept(vectors, size)
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))).cast("binary"), 256)
    first = frame.orderBy(key, "embedding").limit(k).collect()
    if not first:
        return frame.select("vec_id", *(F.lit(0).cast(t).alias(c) for c, t in (("cluster", "int"), ("distance", "long"), ("cluster_inertia", "long"), ("inertia", "long"), ("centroid_sha256", "string"))))
    steps = [make_step(np.array([[math.floor(x * scale) for x in r["embedding"]] for r in first], np.int64), None, None)]
    for _ in range(rounds):
        n, sums, far, _, tried = _totals(frame, steps, size, scale)
        old = steps[-1].centroids
        new = np.array([[s // n[i] for s in sums[i]] if n[i] else old[i].tolist() for i in range(len(old))], np.int64)
        if report is not None:
            report.append((tried, steps[-1].stirred.count(False)))
        if (new == old).all():  # so all further rounds are alike
            break
        if len(steps) == replay:
            frame, steps = frame.mapInArrow(_labels(steps, size, scale), "vec_id long, embedding array<double>, label int").checkpoint(), steps[:0]
        steps.append(make_step(new, old, far))
    _, _, _, spent, _ = _totals(frame, steps, size, scale)
    return frame.mapInArrow(_results(steps, size, scale, spent), "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")


def _before(batch: pa.RecordBatch) -> np.ndarray | None:
    return np.asarray(batch.column(2)) if batch.num_columns > 2 else None


def _labels(steps, size, scale):
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                label, _, _ = settle(_vectors(batch, size, scale), _before(batch), steps)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(label.astype(np.int32))], names=["vec_id", "embedding", "label"])

    return run


def _results(steps, size, scale, spent):
    digests = np.array([hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in steps[-1].centroids])

    def run(batches):
        own_sums, every = np.array(spent, np.int64), sum(spent)
        for batch in batches:
            if batch.num_rows:
                label, own, _ = settle(_vectors(batch, size, scale), _before(batch), steps)
                columns = [batch.column(0), pa.array(label.astype(np.int32)), pa.array(own), pa.array(own_sums[label]), pa.array(np.full(len(own), every)), pa.array(digests[label])]
                yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"])

    return run


def _oracle() -> str:
    """Plain rounds in SQL: every vector against every centroid."""
    parts = [
        f"""v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE len(embedding) = {SIZE} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x) AND abs(x) < {RANGE})) = {SIZE})""",
        f"parts AS MATERIALIZED (SELECT r, unnest(v) AS x, unnest(range({SIZE})) AS d FROM v)",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{SEED}:' || coalesce(CAST(vec_id AS VARCHAR), '')), v) - 1 AS c, v AS w FROM v QUALIFY c < {K})",
    ]
    for t in range(ROUNDS + 1):
        gap = "list_sum(list_transform(list_zip(v, w), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
        parts.append(f"a{t} AS MATERIALIZED (SELECT r, min((gap, c)) AS best FROM (SELECT r, c, CAST({gap} AS BIGINT) AS gap FROM v, c{t}) GROUP BY r)")
        if t < ROUNDS:
            parts.append(f"s{t} AS (SELECT best[2] AS c, d, CAST(sum(x) AS HUGEINT) AS s, count(*) AS n FROM a{t} JOIN parts USING (r) GROUP BY ALL)")
            parts.append(f"m{t} AS (SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY d) AS w FROM s{t} GROUP BY c)")
            parts.append(f"c{t + 1} AS MATERIALIZED (SELECT c, coalesce(m{t}.w, c{t}.w) AS w FROM c{t} LEFT JOIN m{t} USING (c))")
    return f"""WITH {", ".join(parts)}
SELECT vec_id, CAST(best[2] AS INT) AS cluster, best[1] AS distance, CAST(sum(best[1]) OVER (PARTITION BY best[2]) AS BIGINT) AS cluster_inertia,
  CAST(sum(best[1]) OVER () AS BIGINT) AS inertia, sha256(array_to_string(w, ',')) AS centroid_sha256
FROM a{ROUNDS} JOIN v USING (r) JOIN c{ROUNDS} ON c = best[2]"""


ORACLE = _oracle()
