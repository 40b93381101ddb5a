import json
import zlib

import numpy as np
import pytest

from lumenframe.sources import artifacts


def test_arrays_and_pictures(spark, tmp_path):
    arrays = {"b": np.arange(6.0).reshape(2, 3), "a": np.array([1, 2])}
    for k in (1, 2):
        artifacts.save_arrays(str(tmp_path / f"x{k}.npz"), dict(reversed(list(arrays.items()))) if k == 2 else arrays)
    assert (tmp_path / "x1.npz").read_bytes() == (tmp_path / "x2.npz").read_bytes()
    rows = artifacts.load_arrays(spark, str(tmp_path)).where("path like '%x1.npz'").orderBy("name", "index").collect()
    assert [(r["name"], r["index"], r["value"]) for r in rows] == [("a", 0, 1.0), ("a", 1, 2.0), *(("b", k, float(k)) for k in range(6))]
    artifacts.draw_bars(str(tmp_path / "p.png"), [0.0, 0.5, 1.0], 30, 10)
    data = (tmp_path / "p.png").read_bytes()
    at = data.index(b"IDAT")
    image = np.frombuffer(zlib.decompress(data[at + 4 : at + 4 + int.from_bytes(data[at - 4 : at])]), np.uint8).reshape(10, 31)[:, 1:]
    assert (image[:, 25] == 90).all() and (image[:5, 15] == 255).all() and (image[6:, 15] == 90).all()


def test_metric_tables(spark, tmp_path):
    frame = spark.createDataFrame([("b", 0.1), ("a", 1 / 3)], "k string, value double").coalesce(1)
    artifacts.write_metrics(frame, str(tmp_path / "m"), ["k"])
    text = "".join(p.read_text() for p in sorted((tmp_path / "m").glob("part-*")))
    assert [x for x in text.split() if x != "k,value"] == [f"a,{1 / 3!r}", "b,0.1"]
    with pytest.raises(Exception, match="finite"):
        artifacts.write_metrics(frame.selectExpr("k", "double('nan') as value"), str(tmp_path / "n"), ["k"])
    assert artifacts.canonical_json({"b": np.float64(1.5), "a": [1]}) == '{\n  "a": [\n    1\n  ],\n  "b": 1.5\n}\n'
    with pytest.raises(ValueError):
        artifacts.canonical_json({"a": float("nan")})


def test_manifests_and_gate(spark, tmp_path):
    import hashlib

    def tree(name, layout, status="ok", count=1, maturity="L1", **more):
        own = tmp_path / "trees" / name
        own.mkdir(parents=True)
        (own / "results.csv").write_text(f"row_key,status\nk,{status}\n")
        (own / "diagnostics.json").write_text(json.dumps({"status_counts": {"ok": count}}))
        sha = {n: hashlib.sha256((own / n).read_bytes()).hexdigest() for n in ("results.csv", "diagnostics.json")}
        (own / "manifest.json").write_text(json.dumps({"maturity": maturity, "status": "stable", **layout(sha), **more}))

    tree("good", lambda s: {"files_sha256": s}, object_id="first")
    tree("second", lambda s: {"artifact_hashes_sha256": s}, benchmark="other")
    tree("third", lambda s: {"artifacts": {k: {"sha256": v} for k, v in s.items()}})
    tree("bad", lambda s: {"files_sha256": {**s, "results.csv": "0"}}, status="strange", count=2, maturity="L0")
    found = artifacts.manifests(spark, str(tmp_path / "trees"))
    assert {r["name"] for r in artifacts.benchmark_names(found).collect()} == {"first", "other", "third", "bad"}
    assert artifacts.manifest_hashes(found).count() == 8
    gate = artifacts.tree_gate(spark, str(tmp_path / "trees")).collect()
    assert {(r["folder"], r["problem"]) for r in gate} == {("bad", p) for p in ("maturity_or_status", "hash_results.csv", "status_strange", "count_ok", "count_strange")}
    (tmp_path / "trees" / "good" / "results.csv").unlink()
    assert ("good", "missing_results.csv") in {(r["folder"], r["problem"]) for r in artifacts.tree_gate(spark, str(tmp_path / "trees")).collect()}
    assert artifacts.artifact_problems(str(tmp_path / "trees" / "good"), {"results.csv": "x", "manifest.json": "y"}) == ["changed manifest.json", "missing results.csv", "unexpected diagnostics.json"]
