from collections import Counter

import pandas as pd

from lumenframe.plans import gaussian_task as g


def test_whole_grid_with_its_statuses():
    rows = pd.concat([g.evaluate(s, k) for s in g.SCENARIOS for k in range(g.REPLICATES)])
    assert len(rows) == 5445
    assert Counter(rows["status"]) == {"ok": 1515, "inapplicable": 3930}
    ok = rows[rows["status"] == "ok"]
    assert ok["value"].notna().all() and rows[rows["status"] != "ok"]["value"].isna().all()
    assert ok[ok["metric"] == "oracle_mean_discrepancy"]["value"].max() < 1e-9
    assert (ok[ok["metric"] == "reset_first_state_abs_difference"]["value"] > 0).all()
    mean = ok[ok["metric"] == "latent_rmse"].groupby("method")["value"].mean()
    assert mean["known_rts_smoother"] < mean["known_kalman_filter"] < mean["stationary_mean"]


def test_in_spark(spark):
    rows = g.linear_gaussian_results(spark, "")
    assert rows.count() == 5445 and rows.select("row_key").distinct().count() == 5445
