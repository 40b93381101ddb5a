import zlib

import numpy as np

from lumenframe.llm import quality

SCHEMA = "doc_id long, text string, score string, lang int"


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    rows = quality.classify(docs, labels).collect()
    assert len(rows) == docs.count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    truth = {r["doc_id"]: r["quality"] for r in labels.collect()}
    held = [(truth[r["doc_id"]], r["predicted"], r["score"]) for r in rows if r["held_out"] and r["doc_id"] in truth]
    good = [p for t, p, _ in held if t == 1]
    poor = [p for t, p, _ in held if t == 0]
    print(len(held), sum(good) / len(good), 1 - sum(poor) / len(poor))
    assert sum(good) / len(good) > 0.98 and 1 - sum(poor) / len(poor) > 0.9


def test_tables_learn_single_and_pair_effects():
    rng = np.random.default_rng(0)
    x = rng.random((4000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality.fit(x, y)
    assert (0, 1) in [tuple(p) for p in model.pairs]
    assert ((model.score(x) >= 0.5) == y).mean() > 0.9
    again = quality.Model.loads(model.dumps())
    assert (again.score(x) == model.score(x)).all()
    one = np.array([again.base + sum(t[np.searchsorted(c, v)] for c, t, v in zip(again.cuts, again.tables, r, strict=True)) + sum(t[np.searchsorted(again.pair_cuts[f], r[f])][np.searchsorted(again.pair_cuts[g], r[g])] for (f, g), t in zip(again.pairs, again.pair_tables, strict=True)) for r in x[:50]])
    assert np.allclose(1 / (1 + np.exp(-one)), model.score(x[:50]))


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, "", "a", 1), (2, None, None, None), (3, "word " * 50_000, "s", 2), (3, "word " * 50_000, "s", 2), (None, "é!", "s", 3)], SCHEMA)
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (2, None, 0), (3, 0, 0), (3, 1, 1), (99, 1, 0), (None, 0, 0)], "doc_id long, quality int, toxic int")
    rows = quality.classify(docs, labels).collect()
    assert sorted((r["doc_id"] or 0) for r in rows) == [0, 1, 2, 3, 3]
    none = quality.classify(docs, labels.limit(0)).collect()
    assert all(r["score"] > 0.99 for r in none)
    assert quality.classify(docs.limit(0), labels).collect() == []
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.count() == 5
