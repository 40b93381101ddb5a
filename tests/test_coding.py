"""Distributed training against the trainer that holds all rows."""

import duckdb
import numpy as np
import pandas as pd
import pytest

from lumenframe.operators import coding
from lumenframe.operators.fitted import layers, loss_and_gradients, predict_and_code, train_autoencoder

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def splits():
    v = pd.read_parquet(f"{FOLDER}/embeddings.parquet")
    part = duckdb.sql("SELECT ('0x' || substr(md5(vec_id::VARCHAR), 1, 6))::BIGINT % 5 AS k FROM v").df()["k"].map({3: 1, 4: 2}).fillna(0).to_numpy()
    x = np.stack(v["embedding"].to_numpy()).astype(float)
    own = x[part == 0]
    z = (x - own.mean(0)) / own.std(0)
    return [z[part == k] for k in range(3)], v["vec_id"].to_numpy()[np.argsort(part, kind="stable")]


@pytest.fixture(scope="module")
def rows(spark):
    return coding.coded_rows(spark, FOLDER)


def test_equal_to_training_on_all_rows(spark):
    """On rows that aren't centred: gradients of nearly nothing would make Adam's steps follow rounding."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(90, 6)) @ rng.normal(size=(6, 6)) + rng.normal(size=6)
    train, held, test = (x[k::3] for k in range(3))
    rows = spark.createDataFrame([(k, k % 3, v.tolist()) for k, v in enumerate(x)], "vec_id long, split long, x array<double>").repartition(5)
    done = coding.train(rows, rounds=25, patience=3, rate=0.05)
    for (method, hidden, seed), b in zip(coding.MODELS, done, strict=True):
        loss, params = train_autoencoder(train, held, hidden, seed, rounds=25, patience=3, rate=0.05, frozen=method == "frozen")
        assert b["validation"] == pytest.approx(loss, abs=1e-9)
        assert all(a == pytest.approx(w, abs=1e-7) for a, w in zip(b["params"], params, strict=True))
        made = predict_and_code(test, params, layers(6, hidden)[1])[0]
        assert b["test"] == pytest.approx(((made - test) ** 2).mean(), abs=1e-9)


def test_sums_of_the_table_equal_those_of_all_rows(rows, splits):
    parts, _ = splits
    width = parts[0].shape[1]
    params = [coding._start(*m, width) for m in coding.MODELS]
    for m, p, s in zip(coding.MODELS, params, coding.round_sums(rows, list(coding.MODELS), params, width), strict=True):
        loss, grads = loss_and_gradients(parts[0], p, layers(width, m[1])[1])
        assert s["train"] == pytest.approx(loss * parts[0].size) and s["n"].tolist() == [len(v) for v in parts]
        assert all(a == pytest.approx(g * parts[0].size, abs=1e-9) for a, g in zip(s["grads"], grads, strict=True))


def test_codes_by_row(rows, splits):
    parts, ids = splits
    params = coding._start("nonlinear", 8, 1, parts[0].shape[1])
    got = {r["vec_id"]: r for r in coding.codes(rows, ("nonlinear", 8, 1), params).collect()}
    x = np.concatenate(parts)
    made, code = predict_and_code(x, params, layers(x.shape[1], 8)[1])
    assert len(got) == len(x)
    assert [got[i]["code"] for i in ids] == pytest.approx(code[:, 0]) and [got[i]["error"] for i in ids] == pytest.approx(((made - x) ** 2).mean(1))


def test_a_line_is_learnt(spark, tmp_path):
    t = np.random.default_rng(1).normal(size=300)
    spark.createDataFrame([(k, [v, -2 * v, 0.5 * v + 1, 7.0], 0) for k, v in enumerate(t.tolist())], "vec_id long, embedding array<double>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    made = {(r["method"], r["seed"]): r for r in coding.embedding_autoencoders(spark, str(tmp_path)).collect()}
    assert len(made) == len(coding.MODELS) and made["linear", 0]["test"] < 0.05
    assert sum(r["chosen"] for r in made.values()) == 3  # one a method


def test_no_vectors(spark, tmp_path):
    spark.createDataFrame([], "vec_id long, embedding array<double>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert coding.embedding_autoencoders(spark, str(tmp_path)).count() == 0 and coding.embedding_codes(spark, str(tmp_path)).count() == 0
