import random
import re

import numpy as np
import xxhash

from lumenframe.llm import graph, simhash

SCHEMA = "doc_id long, text string, fp string, key int"


def brute_fingerprint(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    grams = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] if len(words) >= 4 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def union(n, links):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        parent[find(a)] = find(b)
    return [find(x) for x in range(n)]


def brute(rows):
    fps = [brute_fingerprint(t) for _, t in rows]
    links = [(a, b) for a in range(len(rows)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 4]
    roots = union(len(rows), links)
    low = {}
    for (i, _), r in zip(rows, roots, strict=True):
        if i is not None:
            low[r] = min(low.get(r, i), i)
    return sorted(((i, f"{f:016x}", low.get(r)) for (i, _), f, r in zip(rows, fps, roots, strict=True)), key=str)


def test_golay_code_is_perfect_and_keys_meet():
    table = simhash.decoder()
    assert len(np.unique(table)) == 4096 and (np.bincount(table) == 2048).all()
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 64, 3000, dtype=np.uint64)
    b = a.copy()
    for i in range(len(a)):
        for bit in rng.choice(64, rng.integers(0, 5), replace=False):
            b[i] ^= np.uint64(1) << np.uint64(bit)
    keys = [[set() for _ in a] for _ in range(2)]
    for side, x in enumerate((a, b)):
        for r, k in zip(*simhash.golay_keys(x), strict=True):
            keys[side][r].add(int(k))
    assert all(x & y for x, y in zip(*keys, strict=True))


def test_against_brute_force(spark):
    rng = random.Random(3)
    words = [f"W{i}é" for i in range(40)]
    rows = []
    for _ in range(12):
        base = [rng.choice(words) for _ in range(rng.randint(1, 120))]
        for _ in range(rng.randint(1, 9)):
            copy = base[:]
            for _ in range(rng.randint(0, 2)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append((rng.randint(0, 10**6), " ".join(copy)))
    rows += [(1, ""), (2, None), (3, " \n"), (4, "A b"), (5, "a B"), rows[0], (None, rows[1][1]), (None, "quite alone here with no partner"), (7, "word " * 5000)]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], SCHEMA)
    assert sorted((tuple(r) for r in simhash.near_duplicates(docs).collect()), key=str) == brute(rows)


def test_chain_of_fingerprints(spark):
    """Members of a bucket that its leaders don't reach are still linked."""
    rng = random.Random(9)
    fps = []
    for _ in range(6):
        x = rng.getrandbits(64)
        for _ in range(40):
            fps.append(x)
            for bit in rng.sample(range(64), 3):
                x ^= 1 << bit
    fps = sorted(set(fps))
    links = [(a, b) for a in range(len(fps)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 4]
    roots = union(len(fps), links)
    signed = [int(np.array([f], np.uint64).view(np.int64)[0]) for f in fps]
    got = {r["fp"]: r["root"] for r in simhash.linked(spark.createDataFrame([(f,) for f in signed], "fp long")).collect()}
    low = {}
    for f, r in zip(signed, roots, strict=True):
        low[r] = min(low.get(r, f), f)
    assert all(got.get(f, f) == low[r] for f, r in zip(signed, roots, strict=True))


def test_components_against_union_find(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(500 + i, 501 + i) for i in range(60)] + [(700, 701 + i) for i in range(50)] + [(4, 4)]
    roots = union(800, edges)
    low = {}
    for n, r in enumerate(roots):
        low[r] = min(low.get(r, n), n)
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {n: low[roots[n]] for n in {x for e in edges if e[0] != e[1] for x in e}}


def test_empty_table(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []
