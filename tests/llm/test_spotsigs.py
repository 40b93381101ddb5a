import hashlib
import random
import re

from lumenframe.llm import spotsigs

SCHEMA = "doc_id long, text string, sigs string, rank int"


def brute_sigs(text):
    words = [w for w in re.split(r"[\W_]+", text.lower()) if w]
    out = set()
    for i, w in enumerate(words):
        if w in spotsigs.ANCHORS:
            chain = [x for x in words[i + 1 :] if x not in spotsigs.ANCHORS][:2]
            if chain:
                out.add(" ".join([w, *(chain + [""])[:2]]))
    return sorted({hashlib.md5(x.encode()).hexdigest()[:8] for x in out or {"= " + " ".join(words)}})


def jaccard(a, b):
    return len(set(a) & set(b)) / len(set(a) | set(b))


def brute(rows):
    order = sorted({(-(1 << 63) if i is None else i, t or "") for i, t in rows}, reverse=True)
    out = []
    for i, t in rows:
        t = t or ""
        at = order.index((-(1 << 63) if i is None else i, t))
        follow = order[(at + 1) % len(order)][1]
        half = len(t) // 2
        edited = t[: len(t) - half] + follow[:half]
        own, new, nxt = brute_sigs(t), brute_sigs(edited), brute_sigs(follow)
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), "".join(own), "".join(new), jaccard(own, new), jaccard(own, nxt)))
    return sorted(out, key=str)


def make(n, seed=1):
    rng = random.Random(seed)
    words = ["alpha", "Beta", "the", "of", "und", "été", "x1", "it", "Zeta", "los", "naïve"]
    return [(k * 3 - 20, rng.choice([" ", ", ", "\n"]).join(rng.choice(words) for _ in range(rng.randint(0, 60)))) for k in range(n)]


def test_against_brute_force(spark):
    rows = make(50) + [(1000, None), (1001, ""), (1002, "the the the"), (1003, "alone"), (1004, "the end"), (1005, "the end " * 300), (None, "of a null id")]
    rows += [rows[3], rows[3]]
    docs = spark.createDataFrame([(i, t, "s", 1) for i, t in rows], SCHEMA)
    assert sorted((tuple(r) for r in spotsigs.with_next(docs).collect()), key=str) == brute(rows)


def test_one_document_and_none(spark):
    docs = spark.createDataFrame([(5, "the quick one of them all", "s", 1)], SCHEMA)
    assert [tuple(r) for r in spotsigs.with_next(docs).collect()] == brute([(5, "the quick one of them all")])
    assert spotsigs.with_next(docs.limit(0)).collect() == []


def test_near_duplicates_against_all_pairs(spark):
    rng = random.Random(8)
    rows = []
    for k in range(12):
        base = [rng.choice(["the", "of", "un"] + [f"w{i}" for i in range(60)]) for _ in range(rng.randint(30, 160))]
        for _ in range(rng.randint(1, 6)):
            copy = base[:]
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(len(copy))] = f"w{rng.randrange(60)}"
            rows.append((len(rows), " ".join(copy)))
    rows += [(900, ""), (901, None), (902, rows[0][1])]
    sets = [brute_sigs(t or "") for _, t in rows]
    root = list(range(len(rows)))
    for _ in rows:
        for a in range(len(rows)):
            for b in range(len(rows)):
                if jaccard(sets[a], sets[b]) >= 0.8:
                    root[a] = root[b] = min(root[a], root[b])
    docs = spark.createDataFrame([(i, t, "s", 1) for i, t in rows], SCHEMA)
    got = {r["doc_id"]: r["class_id"] for r in spotsigs.near_duplicates(docs).collect()}
    assert got == {i: rows[root[k]][0] for k, (i, _) in enumerate(rows)}
