from lumenframe.operators import extensions

FOLDER = "/root/testdata/sf0.001"


def test_extensions_agree_with_the_fit(spark):
    assert all(r["max_gap"] < 1e-4 and r["status"] == "ok" for r in extensions.diffusion_distances(spark, FOLDER).collect())
    placed = extensions.isomap_extend(spark, FOLDER).collect()
    assert placed and all(r["status"] == "inapplicable" or r["max_gap"] < 1e-6 for r in placed)


def test_controls(spark):
    r = extensions.label_shuffle_null(spark, "").first()
    assert r["accuracy"] > 0.9 and 0.2 < r["null_median"] < 0.8 and r["exceeding"] <= 2
    rows = {x["shuffle"]: x for x in extensions.covariance_shuffles(spark, "").collect()}
    assert rows[0]["similarity"] == 1.0 and rows[0]["rank"] is None and rows[0]["r2"] > max(x["r2"] for k, x in rows.items() if k)
    assert all(x["status"] in ("ok", "nonconvergence") for x in extensions.factor_restarts(spark, FOLDER).collect())
