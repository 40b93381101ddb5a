import random
from collections import Counter, defaultdict

import pytest

from lumenframe.llm import lines, mixing, queries
from tests.llm.oracle import same

SCHEMA = "doc_id long, text string, source string, hash string"
FOLDER = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", ["op8_temperature_mixing", "op9_line_chunks", "op4_spotsigs", "spotsigs_classes"])
def test_queries_equal_their_sql(spark, name):
    same(queries.QUERIES[name](spark, FOLDER).collect(), queries.ORACLES[name], FOLDER)


def brute_lines(rows):
    seen, out = {}, []
    order = sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0))
    done = {}
    for i, t in order:
        all_lines, kept = (t or "").split("\n"), []
        for a, b in lines.cut(all_lines):
            part = all_lines[a:b]
            if len(part) >= 2 and sum(bool(x.strip()) for x in part) >= 2:
                if "\n".join(part) in seen:
                    continue
                seen["\n".join(part)] = i
            kept += part
        done[i, t] = "\n".join(kept)
    for i, t in rows:
        out.append((i, done[i, t]))
    return sorted(out, key=str)


def test_lines_against_brute_force(spark):
    rng = random.Random(3)
    some = [f"line {k} é" for k in range(60)] + ["", " "]
    passages = [[rng.choice(some) for _ in range(rng.randint(3, 12))] for _ in range(5)]
    rows = []
    for k in range(60):
        parts = sum(([*rng.choice(passages)] if rng.random() < 0.4 else [f"own {k} {rng.random()}" for _ in range(rng.randint(0, 4))] for _ in range(rng.randint(1, 6))), [])
        rows.append((k * 2, "\n".join(parts)))
    rows += [(500, None), (501, ""), (502, "\n\n\n"), (503, "same\n" * 3000), rows[4], rows[4], (None, rows[5][1]), (504, rows[6][1])]
    docs = spark.createDataFrame([(i, t, "s", "h") for i, t in rows], SCHEMA).repartition(3)
    got = lines.remove_repeats(docs)
    assert got.columns == docs.columns
    assert sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=str) == brute_lines(rows)
    assert lines.remove_repeats(docs.limit(0), counts=True).collect() == []


def test_boundaries_resist_shifts():
    rng = random.Random(1)
    body = [f"l{rng.random()}" for _ in range(400)]
    a = {"\n".join(body[x:y]) for x, y in lines.cut(body)}
    shifted = ["new"] + body[:200] + ["also new"] + body[200:]
    b = {"\n".join(shifted[x:y]) for x, y in lines.cut(shifted)}
    assert len(a - b) <= 3


def test_mixture_meets_its_weights(spark):
    rng = random.Random(6)
    rows = [(k, "w " * rng.randint(0, 30), rng.choice(["big"] * 12 + ["mid"] * 4 + ["small", None]), "h") for k in range(600)]
    rows += [(9000, None, "empty", "h"), (9001, "", "empty", "h"), (None, "w w w", "small", "h"), rows[0], rows[0]]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = mixing.mix(docs, block_tokens=500).collect()
    totals, used, epochs = Counter(), Counter(), Counter()
    for _, t, s, _ in rows:
        totals[s or ""] += len((t or "").split())
    for r in got:
        used[r["source"]] += r["n_tokens"]
        epochs[r["source"]] = max(epochs[r["source"]], r["epoch"] + 1)
    assert "empty" not in used
    # each document with tokens at least once, whole epochs complete
    by = defaultdict(Counter)
    for r in got:
        by[r["source"], r["epoch"]][r["doc_id"]] += 1
    for s in ("big", "mid", "small", ""):
        assert by[s, 0] == Counter(i for i, _, x, _ in rows if (x or "") == s)
    assert max(used[s] / totals[s] for s in used) <= mixing.REPEATS + 0.5
    slots = defaultdict(list)
    for r in got:
        slots[r["block"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    applied = mixing.apply(docs, block_tokens=500)
    without = {(i, t) for i, t, x, _ in rows if x == "empty"}  # a source without tokens: its rows come back once
    assert applied.columns == docs.columns and applied.count() == len(got) + len(without)
    assert mixing.mix(docs.limit(0)).collect() == []
    small = mixing.mix(docs, budget=100).collect()
    assert 60 <= sum(r["n_tokens"] for r in small) <= 250


def test_exponent_meets_entropy_and_limit(spark):
    import math

    def weights(shares, x):
        u = [s**x for s in shares]
        return [v / sum(u) for v in u]

    shares = [0.7, 0.2, 0.06, 0.04]
    frame = spark.createDataFrame([(s,) for s in shares], "share double")
    x = mixing.exponent(frame, entropy=0.9, repeats=1e9)
    entropy = lambda a: -sum(w * math.log(w) for w in weights(shares, a / 1e6)) / math.log(4)
    assert entropy(x) >= 0.9 > entropy(x + 1)
    most = lambda a: max(w / s for w, s in zip(weights(shares, a / 1e6), shares, strict=True)) / min(w / s for w, s in zip(weights(shares, a / 1e6), shares, strict=True))
    y = mixing.exponent(frame, entropy=0.9, repeats=2.0)
    assert y > x and most(y) <= 2.0 < most(y - 1)
    assert mixing.exponent(frame.limit(1)) == 1_000_000


def test_clashing_names_and_equal_keys(spark):
    """Columns named like the operators' own come back; rows that differ in another column only are all used."""
    body = "\n".join(f"line {k} of a text" for k in range(30))
    rows = [(1, body, "s", "a", 1), (2, body, "s", "b", 2), (2, body, "s", "c", 3), (3, "alone", "t", None, 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, doc string, mark int").withColumnsRenamed({"doc": "__doc"})
    cut = lines.remove_repeats(docs)
    assert cut.columns == docs.columns and sorted((r["doc_id"], r["__doc"] or "", r["mark"]) for r in cut.collect()) == [(1, "a", 1), (2, "b", 2), (2, "c", 3), (3, "", 4)]
    mixed = mixing.apply(docs)
    assert mixed.columns == docs.columns and {(r["doc_id"], r["__doc"], r["mark"]) for r in mixed.collect()} == {(1, "a", 1), (2, "b", 2), (2, "c", 3), (3, None, 4)}


def test_chunks_of_one_hash_are_compared(spark):
    """With hashes of two bits many chunks share one; only those with equal bytes go."""
    rng = random.Random(4)
    rows = [(i, i, "\n".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 12)))) for i in range(60)]
    plain = spark.createDataFrame(rows, "doc long, mark long, text string")
    want = sorted(map(tuple, lines.repeated(plain).collect()))
    assert want and sorted(map(tuple, lines.repeated(plain, bits=2).collect())) == want
