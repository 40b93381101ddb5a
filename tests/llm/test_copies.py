import random
import re
from collections import defaultdict
from itertools import combinations

import corpus_pipeline
from lumenframe.llm import copies, graph, simhash
from lumenframe.llm.common import CLEANUP, table
from lumenframe.llm.graph import best_stars, key_ends
from tests.llm.test_simhash import union

SCHEMA = "doc_id long, text string, source string"


def grams(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)}


def brute(rows):
    """doc_id, smallest doc_id of its component by exact coefficients of all pairs that share a shingle."""
    sets = [grams(t) for _, t in rows]
    having = defaultdict(list)
    for k, s in enumerate(sets):
        for g in s:
            having[g].append(k)
    pairs = {p for own in having.values() for p in combinations(own, 2)}
    links = [(a, b) for a, b in pairs if len(sets[a] & sets[b]) * 5 >= len(sets[a] | sets[b]) * 4]
    roots, low = union(len(rows), links), {}
    for (i, _), r in zip(rows, roots, strict=True):
        if i is not None:
            low[r] = min(low.get(r, i), i)
    return sorted(((i, low.get(r)) for (i, _), r in zip(rows, roots, strict=True)), key=str)


def made():
    rng = random.Random(8)
    rows = []
    for _ in range(25):
        base = [f"w{rng.randrange(4000)}" for _ in range(rng.randint(3, 200))]
        for _ in range(rng.randint(1, 7)):
            copy = base[:]
            for _ in range(rng.randint(0, max(1, len(base) // 40))):
                copy[rng.randrange(len(copy))] = f"W{rng.randrange(4000)}é"
            rows.append((rng.randint(0, 10**6), " ".join(copy)))
    return rows + [(1, ""), (2, None), (3, " \n"), (4, "A b"), (5, "a B"), (9, "a b c"), rows[0], (None, rows[1][1]), (None, "quite alone here with no partner at all"), (7, "word " * 500)]


def test_against_brute_force(spark):
    rows = made()
    got = copies.near_copies(spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)


def test_common_shingles_change_no_result(spark, monkeypatch):
    monkeypatch.setattr(copies, "COMMON_BITS", 1 << 15)  # most shingles share a bit with a common one
    rows = made()
    got = copies.near_copies(spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)


def test_stage_takes_copies_at_four_fifths(spark):
    """Against all pairs of sf0.01; near copies at 0.8 differ in more bits than the digest query links."""
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    got = sorted(r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect())
    assert got == sorted({c for _, c in brute(rows)})


def test_fingerprints_in_numpy():
    import numpy as np

    rng = np.random.default_rng(3)
    h = rng.integers(0, 1 << 63, 400, dtype=np.uint64) * np.uint64(2)
    bounds = np.array([0, 1, 3, 300, 400])
    for a, b, fp in zip(bounds, bounds[1:], simhash.majority(h, bounds)):
        want = sum(1 << k for k in range(64) if sum(int(x) >> k & 1 for x in h[a:b]) * 2 > b - a)
        assert int(fp) % (1 << 64) == want


def test_one_of_each_group_stays(spark):
    """Different texts under one id are different documents; columns with clashing names come back."""
    long = " ".join(f"w{k}" for k in range(40))
    rows = [(1, long, "a", 5), (1, "quite another text under the same id", "b", 6), (2, long + " x", "c", 7), (None, long, "d", 8), (3, "alone " * 9, "e", 9), (3, "alone " * 9, "e", 9), (None, "nameless but unlike the others here", "f", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, mark string, key int").repartition(3)
    kept = copies.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(map(tuple, kept.collect()), key=str) == sorted({r for r in rows if r[2] in "abef"}, key=str)
    assert copies.keep_one(docs.limit(0)).collect() == []


def test_empty_table(spark):
    assert copies.near_copies(spark.createDataFrame([], SCHEMA)).collect() == []


def test_keys_shared_by_chance_make_no_rows(spark, capsys):
    """Far prints that share a key are told apart in the join, and a key of two of them isn't kept; the near ones stay."""
    keys = spark.createDataFrame([(0, 1), (-1, 1), (0, 2), (1, 2), (-1, 2), (7, 3), (5, 3)], "node long, key int")
    ends = key_ends(keys, simhash.near)
    assert sorted(r["key"] for r in ends.collect()) == [2, 3]
    stars = best_stars(keys, ends, near=simhash.near)
    assert sorted(map(tuple, stars.collect())) == [(0, 1), (5, 7), (7, 5)]
    capsys.readouterr()
    stars.explain()
    assert [x for x in capsys.readouterr().out.split("\n") if "Join" in x and "bit_count" in x]


def test_shuffle_files_of_steps_go(spark, tmp_path):
    import os

    files = lambda: sum(f.startswith("shuffle_") for d in own for _, _, names in os.walk(d) for f in names)
    own = [str(x) for x in spark._jsc.sc().env().blockManager().diskBlockManager().localDirsString()]
    docs = spark.createDataFrame([(*r, "x") for r in made()], SCHEMA)
    before, setting = files(), spark.conf.get(CLEANUP, "false")
    copies.near_copies(docs)
    assert files() - before <= 100 and spark.conf.get(CLEANUP, "false") == setting


def test_a_crowd_of_edited_texts_gives_few_pairs(spark, monkeypatch):
    """Copies of one text with few to many edits, cut or whole: all share most shingles, few are alike. Result as brute force;
    what is left to compare after the stars grows with the copies, not with their square."""
    rng = random.Random(5)
    base = [f"w{rng.randrange(4000)}" for _ in range(150)]
    rows = []
    for k in range(500):
        copy = base[: rng.choice((150, 150, 150, 140, 125, 118))]
        for _ in range(rng.randint(1, 12)):
            copy[rng.randrange(len(copy))] = f"W{rng.randrange(10**6)}"
        rows.append((k, " ".join(copy)))
    met = []

    def counting(keys, verify, **more):
        def counted(pairs):
            met.append(pairs.count())
            return verify(pairs)

        return link_by_keys(keys, counted, **more)

    link_by_keys = copies.link_by_keys
    monkeypatch.setattr(copies, "link_by_keys", counting)
    got = copies.near_copies(spark.createDataFrame([(*r, "x") for r in rows], SCHEMA).repartition(4)).collect()
    want = brute(rows)
    assert sorted(map(tuple, got), key=str) == want
    assert 20 < len({c for _, c in want}) < 480
    assert sum(met) <= 10 * len(rows)


def test_first_shared_shingles_are_in_reach(spark):
    """Of sets of every two sizes that may be alike: a rank that leaves as many as must be shared meets, the next doesn't."""
    sized = [(n, m, -(-(n + m) * 4 // 9)) for n in range(1, 90) for m in range(-(-n * 4 // 5), n * 5 // 4 + 1)]
    src = [(k, 2 * k, 1, n - c + late, n) for k, (n, _, c) in enumerate(sized) for late in (0, 1)]
    dst = [(k, 2 * k + 1, 2, m - c, m, 2) for k, (_, m, c) in enumerate(sized)]
    minor = spark.createDataFrame(src, "src_key long, src long, src_own long, src_rank int, src_n int")
    other = spark.createDataFrame(dst, "key long, dst long, dst_own long, dst_rank int, dst_n int, major long")
    got = copies._in_reach(minor, other).select("src_key", "src_rank").collect()
    assert sorted(map(tuple, got)) == [(k, n - c) for k, (n, _, c) in enumerate(sized)]


def test_few_edges_take_few_tasks_and_stars_one_round(spark, monkeypatch):
    rounds, star = [], graph._star
    monkeypatch.setattr(graph, "_star", lambda edges: rounds.append(edges.rdd.getNumPartitions()) or star(edges))
    off, setting = "spark.sql.adaptive.coalescePartitions.enabled", spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set(off, "false")
    try:
        path = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101), (7, 7)], "src long, dst long")
        found = graph.components(path)
        assert sorted(map(tuple, found.collect())) == [(k, 0) for k in range(41)] + [(100, 100), (101, 100)]
        assert len(rounds) > 2 and set(rounds[1:]) == {1}
        rounds.clear()
        again = graph.components(graph.star_edges(found))
        assert sorted(map(tuple, again.collect())) == sorted(map(tuple, found.collect())) and len(rounds) == 1
    finally:
        spark.conf.set(off, setting)
