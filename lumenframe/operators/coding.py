"""Autoencoders over ``embeddings`` by full-batch gradients that Spark sums.

All models (a method, a width and a seed each) train side by side: a round is one pass over the rows, in which each task sums
the models' gradients over its training rows and their errors over the others, and only these sums are shuffled, entry by
entry. The weights, some thousand numbers a model whatever the rows, are kept by the driver and go out with the next
round. Rows are standardised by the training rows' moments, and written once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.operators.decoding import part_of
from lumenframe.operators.fitted import layers, loss_and_gradients, predict_and_code
from lumenframe.operators.moments import vectors
from lumenframe.session import written
from lumenframe.sources.generators import stream

#: Method, hidden width (0: linear) and seed.
MODELS = (("linear", 0, 0), ("nonlinear", 8, 0), ("nonlinear", 8, 1), ("nonlinear", 8, 2), ("frozen", 8, 0))
ROUNDS, PATIENCE, RATE = 40, 10, 0.03


def coded_rows(spark, sf_dir) -> DataFrame:
    """vec_id, split, x: entries less the training rows' mean, over their spread. Vectors without an id, or shorter than the longest, are left out."""
    v = vectors(spark, sf_dir).where("vec_id is not null").select("vec_id", part_of(F.col("vec_id")).alias("split"), "x")
    width = v.agg(F.max(F.size("x"))).first()[0] or 0
    v = written(v.where(F.size("x") == width))
    if not width:
        return v.limit(0)
    train = v.where("split = 0").agg(*(f(F.col("x")[k]) for k in range(width) for f in (F.avg, F.stddev_pop))).first()  # two numbers an entry
    if train[0] is None:
        return v.limit(0)
    mean, scale = (F.array(*(F.lit(float(s)) for s in own)) for own in (train[::2], [s if s > 1e-12 else 1.0 for s in train[1::2]]))
    return written(v.select("vec_id", "split", F.zip_with(F.zip_with("x", mean, lambda a, b: a - b), scale, lambda a, b: a / b).alias("x")))


def _start(method: str, hidden: int, seed: int, width: int) -> list[np.ndarray]:
    rng = stream(61, seed, hidden)
    return [v for a, b in layers(width, hidden)[0] for v in (rng.normal(scale=1 / np.sqrt(a), size=(a, b)), np.zeros(b))]


def round_sums(rows: DataFrame, models: list[tuple], params: list[list[np.ndarray]], width: int) -> list[dict]:
    """For each model: ``grads`` and ``train``, sums over training rows, ``validation`` and ``test``, sums of squared errors; ``n``, rows a split."""
    sizes = [sum(v.size for v in own) for own in params]
    bent = [layers(width, hidden)[1] for _, hidden, _ in models]

    def task(batches):
        sums = [np.zeros(size + 6) for size in sizes]
        for batch in batches:
            if not batch.num_rows:
                continue
            split = np.asarray(batch.column(0))
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            for own, weights, b in zip(sums, params, bent, strict=True):
                for k in range(3):
                    part = x[split == k]
                    own[3 + k] += len(part)
                    if k == 0 and len(part):
                        loss, grads = loss_and_gradients(part, weights, b)
                        own[0] += loss * part.size
                        own[6:] += np.concatenate([g.ravel() for g in grads]) * part.size
                    elif len(part):
                        own[k] += ((predict_and_code(part, weights, b)[0] - part) ** 2).sum()
        for m, own in enumerate(sums):
            if own[3:6].any():
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), m, np.int32)), pa.array(np.arange(len(own), dtype=np.int32)), pa.array(own)], names=["m", "i", "v"])

    total = [np.zeros(size + 6) for size in sizes]
    for r in rows.select("split", "x").mapInArrow(task, "m int, i int, v double").groupBy("m", "i").agg(F.sum("v").alias("v")).collect():  # a row for each weight
        total[r["m"]][r["i"]] = r["v"]
    out = []
    for own, weights in zip(total, params, strict=True):
        ends = np.cumsum([v.size for v in weights])[:-1]
        out.append({"train": own[0], "validation": own[1], "test": own[2], "n": own[3:6], "grads": [g.reshape(v.shape) for g, v in zip(np.split(own[6:], ends), weights, strict=True)]})
    return out


def train(rows: DataFrame, models=MODELS, rounds: int = ROUNDS, patience: int = PATIENCE, rate: float = RATE) -> list[dict]:
    """Adam on the training rows' mean squared error; a model stops when its validation error has not fallen for ``patience``
    rounds, and keeps the weights of its best round. Per model: ``params``, ``validation``, ``test`` (mean squared errors there), ``rounds``.
    Without training and validation rows there is nothing to train: an empty list."""
    first = rows.select(F.size("x").alias("n")).first()
    if first is None:
        return []
    width, models = first["n"], list(models)
    params = [_start(*m, width) for m in models]
    m1, m2 = ([[np.zeros_like(v) for v in own] for own in params] for _ in range(2))
    best = [{"validation": np.inf, "wait": 0, "rounds": 0, "live": True} for _ in models]
    for step in range(rounds + 1):
        live = [k for k, b in enumerate(best) if b["live"]]
        if not live:
            break
        for k, s in zip(live, round_sums(rows, [models[k] for k in live], [params[k] for k in live], width), strict=True):
            own, n = best[k], s["n"] * width
            if not n[0] or not n[1]:
                return []
            loss = s["validation"] / n[1]
            if step and loss < own["validation"] - 1e-9:
                own.update(validation=loss, test=s["test"] / n[2] if n[2] else None, params=[v.copy() for v in params[k]], wait=0, rounds=step)
            elif step:
                own["wait"] += 1
            own["live"] = own["wait"] <= patience and step < rounds
            if not own["live"]:
                continue
            fixed = len(params[k]) // 2 if models[k][0] == "frozen" else 0
            for j in range(fixed, len(params[k])):
                g = s["grads"][j] / n[0]
                m1[k][j], m2[k][j] = 0.9 * m1[k][j] + 0.1 * g, 0.999 * m2[k][j] + 0.001 * g**2
                params[k][j] = params[k][j] - rate * (m1[k][j] / (1 - 0.9 ** (step + 1))) / (np.sqrt(m2[k][j] / (1 - 0.999 ** (step + 1))) + 1e-8)
    return best


def codes(rows: DataFrame, model: tuple, params: list[np.ndarray]) -> DataFrame:
    """vec_id, split, code, error: a row's code and its mean squared error."""
    width = params[0].shape[0]
    bent = layers(width, model[1])[1]

    def task(batches):
        for batch in batches:
            x = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            made, code = predict_and_code(x, params, bent)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(code[:, 0]), pa.array(((made - x) ** 2).mean(1))], names=["vec_id", "split", "code", "error"])

    return rows.select("vec_id", "split", "x").mapInArrow(task, "vec_id long, split long, code double, error double")


def _chosen(done: list[dict], method: str) -> int:
    """The seed with the least validation error, then the smallest."""
    return min((k for k, m in enumerate(MODELS) if m[0] == method), key=lambda k: (done[k]["validation"], MODELS[k][2]))


def embedding_autoencoders(spark, sf_dir):
    """Validation and test error of each model, the rounds that its best weights took, and the seed chosen for each method."""
    done = train(coded_rows(spark, sf_dir))
    out = [(m, h, s, b["rounds"], round(float(b["validation"]), 6), None if b["test"] is None else round(float(b["test"]), 6), k == _chosen(done, m)) for k, ((m, h, s), b) in enumerate(zip(MODELS, done))]
    return spark.createDataFrame(out, "method string, hidden int, seed int, rounds int, validation double, test double, chosen boolean")  # a row for each model


def embedding_codes(spark, sf_dir):
    """Every vector's code and error by the nonlinear model that validation chose."""
    rows = coded_rows(spark, sf_dir)
    done = train(rows)
    if not done:
        return spark.createDataFrame([], "vec_id long, split long, code double, error double")
    k = _chosen(done, "nonlinear")
    return codes(rows, MODELS[k], done[k]["params"]).withColumns({c: F.round(c, 5) for c in ("code", "error")})


QUERIES = {f.__name__: f for f in (embedding_autoencoders, embedding_codes)}
ORACLES: dict[str, str] = {}
