"""Turning planes of delayed states in more dimensions over ``events``, and the matching of two sets of planes.

A state is ``DIMS`` values of a user's standardised sequence that follow each other. The skew map that least squares
gives for the states' differences on their midpoints is found from sums of products alone; its two fastest planes have
a fixed orientation. Sums are made where the sequence's windows are, by user and half (blocks of ``BLOCK`` steps, in
turn), and states that reach over a block's end are left out, so that halves share no value.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenframe.operators.dynamics import CONDITIONS, match_two_planes, plane_error, skew_planes
from lumenframe.operators.sequence import STANDARD, standard

DIMS, BLOCK = 6, 16
#: Pairs of states that a map asks for: each gives DIMS equations for DIMS (DIMS - 1) / 2 entries, so this is over four times as many.
LEAST = 2 * DIMS
_UPPER = [(i, j) for i in range(DIMS) for j in range(i, DIMS)]
_ALL = [(i, j) for i in range(DIMS) for j in range(DIMS)]


def delay_sums(spark, sf_dir) -> DataFrame:
    """user_id, half, n, states (midpoints by midpoints, upper part row by row), cross (differences by midpoints), speed."""
    by_time = W.partitionBy("user_id").orderBy("t")
    x = standard(spark, sf_dir).select("user_id", "t", *((F.lead("x", k).over(by_time) if k else F.col("x")).alias(f"x{k}") for k in range(DIMS + 1)))
    kept = x.where((F.col("t") % BLOCK < BLOCK - DIMS) & F.col(f"x{DIMS}").isNotNull() & F.col("user_id").isNotNull())
    p = kept.select("user_id", (F.floor(F.col("t") / BLOCK) % 2).cast("long").alias("half"), *(((F.col(f"x{k}") + F.col(f"x{k + 1}")) / 2).alias(f"m{k}") for k in range(DIMS)), *((F.col(f"x{k + 1}") - F.col(f"x{k}")).alias(f"d{k}") for k in range(DIMS)))
    dot = lambda a, b: F.sum(F.col(a) * F.col(b))
    return p.groupBy("user_id", "half").agg(
        F.count("*").alias("n"), F.array(*(dot(f"m{i}", f"m{j}") for i, j in _UPPER)).alias("states"),
        F.array(*(dot(f"d{i}", f"m{j}") for i, j in _ALL)).alias("cross"), F.sum(sum((F.col(f"d{k}") * F.col(f"d{k}") for k in range(DIMS)), F.lit(0.0))).alias("speed"),
    )


def delay_moments(spark, sf_dir):
    """The sums as rows: of the states' products, and of differences by states."""
    s = delay_sums(spark, sf_dir)
    rows = s.select("user_id", "half", "n", F.explode(F.array(*(F.struct(F.lit(kind).alias("kind"), F.lit(i).cast("long").alias("i"), F.lit(j).cast("long").alias("j"), F.col(kind)[k].alias("s")) for kind, of in (("states", _UPPER), ("cross", _ALL)) for k, (i, j) in enumerate(of)))).alias("e"))
    return rows.select("user_id", "half", "n", "e.kind", "e.i", "e.j", F.round("e.s", 5).alias("s"))


def skew_from_sums(states: np.ndarray, cross: np.ndarray) -> np.ndarray:
    """The skew M with least |D - X M'|^2 for X'X = ``states``, D'X = ``cross``: M S + S M is twice the skew part of
    ``cross``, which is a division where S is diagonal. Entries that the states say nothing on are 0."""
    values, turn = np.linalg.eigh((states + states.T) / 2)
    wanted = turn.T @ (cross - cross.T) @ turn
    over = values[:, None] + values
    told = over > 1e-12 * max(values.max(), 1e-300)
    m = turn @ np.where(told, wanted / np.where(told, over, 1.0), 0.0) @ turn.T
    return (m - m.T) / 2


def _square(upper) -> np.ndarray:
    m = np.zeros((DIMS, DIMS))
    m[tuple(np.transpose(_UPPER))] = upper
    return m + np.triu(m, 1).T


def _planes(states, cross) -> tuple[list[dict], np.ndarray, np.ndarray]:
    s = _square(states)
    m = skew_from_sums(s, np.asarray(cross, float).reshape(DIMS, DIMS))
    return skew_planes(m), s, m


def _totals(sums: DataFrame, *key: str) -> DataFrame:
    """Sums over further keys."""
    total = lambda c, size: F.array(*(F.sum(F.col(c)[k]) for k in range(size))).alias(c)
    return sums.groupBy(*key).agg(F.sum("n").alias("n"), total("states", len(_UPPER)), total("cross", len(_ALL)), F.sum("speed").alias("speed"))


def delay_planes(spark, sf_dir):
    """The two fastest planes of every user's skew map: signed rate, the share of the states' energy in the plane, what
    the whole map explains of the differences, and the plane's basis (u, v). Users with fewer than LEAST pairs of
    states are ``inapplicable``."""
    names = [f"{c}{k}" for c in "uv" for k in range(DIMS)]

    def run(frames: Iterable[pd.DataFrame]):
        for pdf in frames:
            out = []
            for user, n, states, cross, speed in pdf[["user_id", "n", "states", "cross", "speed"]].itertuples(index=False):
                if n < LEAST:
                    out += [(user, k, n, "inapplicable", *[None] * (3 + 2 * DIMS)) for k in (0, 1)]
                    continue
                planes, s, m = _planes(states, cross)
                left = speed - 2 * (m * np.asarray(cross, float).reshape(DIMS, DIMS)).sum() + np.trace(m @ s @ m.T)
                for k, p in enumerate(planes):
                    q = p["basis"]
                    out.append((user, k, n, "ok", p["rate"], np.trace(q.T @ s @ q) / max(np.trace(s), 1e-15), 1 - left / max(speed, 1e-15), *q.T.ravel()))
            yield pd.DataFrame(out, columns=["user_id", "plane", "n", "status", "rate", "share", "explained", *names])

    rows = _totals(delay_sums(spark, sf_dir), "user_id").mapInPandas(run, "user_id long, plane long, n long, status string, rate double, share double, explained double, " + ", ".join(f"{c} double" for c in names))
    return rows.select("user_id", "plane", "n", "status", *(F.round(c, 6).alias(c) for c in ("rate", "share", "explained", *names)))


#: How planes are compared: the columns of a match.
_MATCH = ("matched", "max_angle", "rms_sine", "projector")


def _matched(own: tuple, other: tuple) -> list[tuple]:
    found, truth = ([p["basis"] for p in _planes(*v)[0]] for v in (own, other))
    order, _ = match_two_planes(found, truth)
    return [(k, order[k], *(plane_error(found[k], truth[order[k]])[c] for c in _MATCH[1:])) for k in (0, 1)]


def _compare(rows: DataFrame, key: str) -> DataFrame:
    """``rows``: key, n, states, cross, other_n, other_states, other_cross."""

    def run(frames: Iterable[pd.DataFrame]):
        for pdf in frames:
            out = []
            for r in pdf.itertuples(index=False):
                if min(r.n, r.other_n) < LEAST:
                    out += [(r[0], k, "inapplicable", *[None] * 4) for k in (0, 1)]
                else:
                    out += [(r[0], m[0], "ok", *m[1:]) for m in _matched((r.states, r.cross), (r.other_states, r.other_cross))]
            made = pd.DataFrame(out, columns=[key, "plane", "status", *_MATCH])
            yield made.astype({"matched": "Int64"})

    done = rows.select(key, "n", "states", "cross", "other_n", "other_states", "other_cross").mapInPandas(run, f"{key} long, plane long, status string, matched long, max_angle double, rms_sine double, projector double")
    return done.select(key, "plane", "status", "matched", *(F.round(c, 5).alias(c) for c in _MATCH[1:]))


def plane_stability(spark, sf_dir):
    """A user's planes from one half of the blocks against those from the other, paired so that the sum of the largest angles is least."""
    s = delay_sums(spark, sf_dir)
    halves = s.groupBy("user_id").agg(*(F.first(F.when(F.col("half") == h, F.col(c)), ignorenulls=True).alias(n) for h, pre in ((0, ""), (1, "other_")) for c, n in ((c, pre + c) for c in ("n", "states", "cross"))))
    return _compare(halves.fillna(0, ["n", "other_n"]), "user_id")


def plane_match(spark, sf_dir):
    """A user's planes against those of all other users of its condition, whose sums are the condition's less its own."""
    own = _totals(delay_sums(spark, sf_dir), "user_id").withColumn("condition", F.col("user_id") % CONDITIONS)
    whole = _totals(own, "condition").select("condition", F.col("n").alias("w_n"), F.col("states").alias("w_states"), F.col("cross").alias("w_cross"))  # CONDITIONS rows
    less = lambda c: F.zip_with(f"w_{c}", c, lambda a, b: a - b).alias(f"other_{c}")
    rows = own.join(F.broadcast(whole), "condition").select("user_id", "n", "states", "cross", (F.col("w_n") - F.col("n")).alias("other_n"), less("states"), less("cross"))
    return _compare(rows, "user_id")


QUERIES = {f.__name__: f for f in (delay_moments, delay_planes, plane_stability, plane_match)}

_LEADS = ", ".join(f"lead(x, {k}) OVER o AS x{k}" for k in range(1, DIMS + 1))
_P = ", ".join(f"(x{k} + x{k + 1}) / 2 AS m{k}, x{k + 1} - x{k} AS d{k}" for k in range(DIMS))
_SUMS = ", ".join([*(f"sum(m{i} * m{j}) AS states_{i}_{j}" for i, j in _UPPER), *(f"sum(d{i} * m{j}) AS cross_{i}_{j}" for i, j in _ALL)])

ORACLES = {
    "delay_moments": f"WITH {STANDARD}, w AS (SELECT user_id, t, x AS x0, {_LEADS} FROM z WINDOW o AS (PARTITION BY user_id ORDER BY t)), p AS (SELECT user_id, t // {BLOCK} % 2 AS half, {_P} FROM w WHERE x{DIMS} IS NOT NULL AND user_id IS NOT NULL AND t % {BLOCK} < {BLOCK - DIMS}), s AS (SELECT user_id, half, count(*) AS n, {_SUMS} FROM p GROUP BY user_id, half), u AS (UNPIVOT s ON COLUMNS('states_|cross_') INTO NAME k VALUE v) SELECT user_id, half, n, split_part(k, '_', 1) AS kind, split_part(k, '_', 2)::BIGINT AS i, split_part(k, '_', 3)::BIGINT AS j, round(v, 5) AS s FROM u",
}
