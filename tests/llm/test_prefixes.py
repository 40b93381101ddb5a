import hashlib
import random
import zlib
from collections import defaultdict

from lumenframe.llm import prefixes, queries
from tests.llm.oracle import same

SCHEMA = "conv_id long, turn int, role string, text string, dig string, p int"
SF = "/root/testdata/sf0.01"
COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def digest(role, text):
    return hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()[:16]


def brute(rows):
    own = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            own[c].append(((0, 0) if t is None else (1, t), digest(role or "", text or ""), role or "", text or ""))
    plain = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    built = {}
    for c, v in plain.items():
        h, rest = zlib.crc32(str(c).encode()) % 6, abs(c) % 100 * (1 if c >= 0 else -1)
        built[c] = tuple(plain.get(c - rest, [])[:h] + v[h:])
    members, ends = defaultdict(list), defaultdict(list)
    for c, v in sorted(built.items()):
        for d in range(len(v) + 1):
            members[v[:d]].append(c)
        ends[v].append(c)
    children = defaultdict(int)
    for k in members:
        if k:
            children[k[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for k, m in members.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += children[k] == 0
            saved[k[:d]] += (len(m) - 1) * (len(k[-1][1]) if k else 0)
    return sorted((m[0], len(k), members[k[:-1]][0] if k else None, len(m), children[k], leaves[k], saved[k], hashlib.sha256(",".join(map(str, ends[k])).encode()).hexdigest()) for k, m in members.items()), max(map(len, built.values()), default=0)


def result(frame):
    return sorted(tuple(r) for r in frame.select(*COLUMNS).collect())


def make(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)


def sample(seed, n=60, longest=9):
    rng = random.Random(seed)
    pool = ["", "a", "b b", "é" * 9, "\U0001f600 end"]
    rows = []
    for _ in range(n):
        c = rng.choice([0, 1, 2, 3, 100, 101, 199, 200, 305, -7, -100, 10**12 + 5]) + rng.randint(0, 3)
        for t in range(rng.randint(0, longest)):
            rows.append((c, rng.choice([t, t, t, None]), rng.choice(["user", None, "u"]), rng.choice([*pool, None])))
    return rows + [(None, 0, "user", "lost")]


def test_against_brute_force(spark):
    for seed in (1, 2):
        rows = sample(seed)
        assert result(prefixes.trie(make(spark, rows))) == brute(rows)[0]


def test_long_conversations_in_stretches_and_blocks(spark):
    """Conversations over many stretches, blocks and partitions; one has most of the rows."""
    rng = random.Random(3)
    rows = [(c, t, "user", rng.choice("ab") if t > 20 + c % 7 * 9 else "same") for c in (1, 2, 3, 4, 150, 151, 152) for t in range(rng.randint(60, 90))]
    rows += [(9, t, "user", "same" if t < 40 else str(t % 3)) for t in range(900)]
    rows += [(c, t, "user", "same" if t < 40 else str(t % 3)) for c in (8, 7) for t in range(300)]
    want, deepest = brute(rows)
    assert deepest > 512
    assert result(prefixes.trie(make(spark, rows), stretch=16, block=8)) == want
    assert result(prefixes.trie(make(spark, rows), stretch=10, block=3)) == want
    assert result(prefixes.trie(make(spark, rows))) == want


def test_subtree_sums_of_a_chain(spark):
    """One chain of nodes, in blocks: each has all below it."""
    nodes = spark.createDataFrame([(1, p, 1, 0) for p in range(600)], "rep long, p long, n_leaves long, saved_tokens long")
    names = nodes.selectExpr("rep as conv", "p", "rep")
    made = {r["p"]: r["n_leaves"] for r in prefixes.subtree_sums(nodes, names, 600, 8).collect()}
    assert made == {p: 600 - p for p in range(600)}


def test_long_lists_of_ends(spark):
    """More ids than a piece holds, over several partitions."""
    rows = [(c, 0, "u", "hello") for c in range(0, 10_000) if zlib.crc32(str(c).encode()) % 6 == 0]
    ids = spark.createDataFrame([(5, 0, c) for c in range(-3000, 9000)] + [(5, 1, 3)], "rep long, p long, conv long")
    got = {r["p"]: r["ends_sha256"] for r in prefixes.id_hashes(ids).collect()}
    assert got == {0: hashlib.sha256(",".join(map(str, range(-3000, 9000))).encode()).hexdigest(), 1: hashlib.sha256(b"3").hexdigest()}
    assert result(prefixes.trie(make(spark, rows))) == brute(rows)[0]


def test_empty_and_turnless(spark):
    assert prefixes.trie(make(spark, [])).collect() == []
    c = next(c for c in range(101, 200) if zlib.crc32(str(c).encode()) % 6 > 1)
    rows = [(c, 0, "u", "gone")]  # its group's first is absent, so no turn is left
    assert result(prefixes.trie(make(spark, rows))) == brute(rows)[0] == [(c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]
    long = [(100, 0, "u", "x" * 300_000), (100, 1, "u", "x" * 300_000 + "y")]
    assert result(prefixes.trie(make(spark, long))) == brute(long)[0]


def test_query_equals_sql(spark):
    same(queries.op13_prefix_trie(spark, SF).collect(), prefixes.ORACLE, SF)
