import hashlib
import random
import re

from lumenframe.llm import secret_scan

SCHEMA = "doc_id long, text string, source string, start int"


def hexes(seed, n=40):
    return hashlib.sha512(str(seed).encode()).hexdigest()[:n]


def corpus():
    rng = random.Random(4)
    rows = []
    for k in range(200):
        parts = ["some words here"]
        for _ in range(rng.randint(0, 3)):
            x = rng.random()
            if x < 0.3:
                parts.append(f'token = "{hexes(rng.random())}"')
            elif x < 0.5:
                parts.append("AKIA" + "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(16)))
            elif x < 0.7:
                parts.append("card " + "".join(rng.choice("0123456789") for _ in range(16)))
            elif x < 0.8:
                parts.append(f"password={hexes(rng.random(), 18)}")
            else:
                parts.append(f"release-version-{rng.randint(1, 99)}")
            parts.append(rng.choice(["and more é", "\nnext", "日本"]))
        rows.append((k, " ".join(parts), rng.choice(["src/a", "docs/example", None])))
    return rows


def test_candidates_against_python(spark):
    rows = [(i, t) for i, t, _ in corpus()] + [(900, ""), (901, None), (902, hexes(1) + " x"), (903, "x " + hexes(2)), (904, f"{hexes(3)}é{hexes(4)}"), (905, "key1234567890ab " * 3000), (None, hexes(5)), (902, hexes(1) + " x"), (906, "-----BEGIN RSA PRIVATE KEY-----\nMIIE")]
    docs = spark.createDataFrame([(i, t, "p", 1) for i, t in rows], SCHEMA)
    # Python's lookbehind takes one width only: the alternatives are written out
    pattern = re.compile(r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----|(?:(?<=(?i:password)[=:])|(?<=(?i:passwd)[=:])|(?<=(?i:secret)[=:]))[^\s\"'=]{6,}|(?<![A-Za-z0-9_+/-])(?=[A-Za-z_+/-]*[0-9])[A-Za-z0-9_+/-]{12,}={0,2}")
    want = sorted(((i, m.start(), m.group(), t[max(0, m.start() - 10) : m.start()][-10:]) for i, t in rows for m in pattern.finditer(t or "")), key=str)
    found = secret_scan.candidates(docs).collect()
    assert sorted(((r["doc_id"], r["start"], r["finding"]) for r in found), key=str) == sorted((w[:3] for w in want), key=str)


def test_features_against_python(spark):
    docs = spark.createDataFrame([(i, t, s, 1) for i, t, s in corpus()], SCHEMA)
    dictionary = secret_scan.words(spark)
    known = {r["word"] for r in dictionary.collect()}
    assert {"the", "table", "version"} <= known and len(known) <= secret_scan.WORDS
    for r in secret_scan.features(secret_scan.candidates(docs), dictionary).collect():
        f = r["finding"]
        runs = [x for x in re.findall("[A-Z]?[a-z]{2,}|[A-Z]{3,}", f) if len(x) > 2]
        assert abs(r["f_dictionary"] - sum(len(x) for x in runs if x.lower() in known) / len(f)) < 1e-12
        assert r["f_length"] == len(f)
        assert abs(r["f_digits"] - sum(c in "0123456789" for c in f) / len(f)) < 1e-12
        assert abs(r["f_distinct"] - len(set(f)) / len(f)) < 1e-12
        assert abs(r["f_pairs"] - sum(f[k : k + 2].lower() in secret_scan.PAIRS for k in range(len(f))) / len(f)) < 1e-12
        kind = lambda c: 0 if c in "abcdefghijklmnopqrstuvwxyz" else 1 if "A" <= c <= "Z" else 2 if c.isdigit() else 3
        assert abs(r["f_changes"] - sum(kind(a) != kind(b) for a, b in zip(f, f[1:], strict=False)) / len(f)) < 1e-12
        assert r["f_keyword"] == len(re.findall("(?i)" + "|".join(secret_scan.KEYWORDS), r["before"]))


def test_forest_on_labelled_findings(spark):
    docs = spark.createDataFrame([(i, t, s, 1) for i, t, s in corpus()], SCHEMA)
    truth = {(r["doc_id"], r["start"]): not re.match(r"^([0-9]{16}|release.*)$", r["finding"]) for r in secret_scan.candidates(docs).collect()}
    some = spark.createDataFrame([(i, s, int(v)) for (i, s), v in truth.items() if i % 2], "doc_id long, start long, is_secret int")
    rows = secret_scan.scan(docs, some).collect()
    rest = [r for r in rows if r["doc_id"] % 2 == 0]
    assert len(rest) > 50 and sum(r["is_secret"] == truth[r["doc_id"], r["start"]] for r in rest) / len(rest) > 0.97
    again = secret_scan.scan(docs, some).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))
    own = secret_scan.scan(docs).collect()
    assert sum(r["is_secret"] == truth[r["doc_id"], r["start"]] for r in own) / len(own) > 0.95


def test_kinds_that_were_not_seen(spark):
    """Precision and recall on values of kinds that training left out."""
    precision, recall = secret_scan.held_out(spark)
    assert precision > 0.6 and recall > 0.6, (precision, recall)


def test_scores_against_the_trees(spark):
    """From candidates to is_secret: the mean of the trees' own shares, worked out one finding at a time."""
    from pyspark.ml.linalg import Vectors

    docs = spark.createDataFrame([(i, t, s, 1) for i, t, s in corpus()[:40]], SCHEMA)
    dictionary = secret_scan.words(spark)
    model = secret_scan.train(secret_scan.labelled_examples(spark, dictionary))
    want = {}
    for r in secret_scan.features(secret_scan.candidates(docs), dictionary).collect():
        x = Vectors.dense([r[f"f_{k}"] for k in secret_scan.FEATURES])
        shares = [t.predictProbability(x)[1] for t in model.trees]
        want[r["doc_id"], r["start"]] = sum(shares) / len(shares)
    got = secret_scan.scan(docs).collect()
    assert {(r["doc_id"], r["start"]) for r in got} == set(want)
    assert all(abs(r["score"] - want[r["doc_id"], r["start"]]) < 1e-9 and r["is_secret"] == (r["score"] >= 0.5) for r in got)


def test_no_findings_and_one_label(spark):
    docs = spark.createDataFrame([(1, "plain", "p", 1)], SCHEMA)
    assert secret_scan.scan(docs).collect() == [] and secret_scan.scan(docs.limit(0)).collect() == []
    one = spark.createDataFrame([(1, f"x {hexes(7)}", None, 1)], SCHEMA)
    labels = spark.createDataFrame([(1, 2, 0)], "doc_id long, start long, is_secret int")
    assert [r["is_secret"] for r in secret_scan.scan(one, labels).collect()] == [False]
