import hashlib
import math
import random

from lumenframe.llm import balls, queries
from tests.llm.oracle import same

SCHEMA = "vec_id long, embedding array<double>, cluster string, label int"
SF = "/root/testdata/sf0.01"


def brute(rows, k, rounds, size, scale=1024, seed=3):
    keep = [(i, [math.floor(x * scale) for x in e]) for i, e in rows if e is not None and len(e) == size and all(x is not None and math.isfinite(x) and abs(x) < balls.RANGE for x in e)]
    order = sorted(keep, key=lambda r: (hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centre = [v for _, v in order[:k]]
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c, strict=True))

    def assign():
        return [min((far(v, c), j) for j, c in enumerate(centre)) for _, v in keep]

    for _ in range(rounds):
        best = assign()
        for j in range(len(centre)):
            own = [v for (_, v), b in zip(keep, best, strict=True) if b[1] == j]
            if own:
                centre[j] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    best = assign()
    total = sum(d for d, _ in best)
    return sorted(((i, j, d, sum(e for e, b in best if b == j), total, hashlib.sha256(",".join(map(str, centre[j])).encode()).hexdigest()) for (i, _), (d, j) in zip(keep, best, strict=True)), key=str)


def rows_of(frame):
    return sorted((tuple(r) for r in frame.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect()), key=str)


def make(spark, rows):
    return spark.createDataFrame([(i, e, "x", 1) for i, e in rows], SCHEMA)


def test_against_brute_force(spark):
    rng = random.Random(5)
    middles = [[rng.uniform(-1, 1) for _ in range(4)] for _ in range(9)]
    rows = [(i, [x + rng.gauss(0, 0.03) for x in middles[i % 9 if i % 3 else 0]]) for i in range(300)]
    rows += [(7, rows[7][1]), (7, rows[8][1]), (None, rows[9][1]), (400, None), (401, [0.0] * 3), (402, [0.0] * 5), (403, []), (404, [None, 0.0, 0.0, 0.0]), (405, [math.nan, 0.0, 0.0, 0.0])]
    rows += [(406, [math.inf, 0.0, 0.0, 0.0]), (407, [-math.inf] * 4), (408, [40000.0, 0.0, 0.0, 0.0]), (409, [-32767.9] * 4), (-5, [32767.5] * 4), (410, rows[3][1])]
    for k, rounds in ((6, 10), (1, 2), (9, 0)):
        report = []
        got = rows_of(balls.cluster(make(spark, rows), k=k, rounds=rounds, size=4, report=report))
        assert got == brute(rows, k, rounds, 4)
    report = []
    assert rows_of(balls.cluster(make(spark, rows), k=9, rounds=12, size=4, replay=3, report=report)) == brute(rows, 9, 12, 4)


def test_cores_and_still_balls_are_not_compared(spark):
    """Well apart, a member is compared with its own centroid only; balls that stay cost nothing."""
    rng = random.Random(2)
    rows = [(i, [(i % 5) * 10 + rng.uniform(-0.2, 0.2), rng.uniform(-0.2, 0.2)]) for i in range(500)]
    report = []
    got = rows_of(balls.cluster(make(spark, rows), k=5, rounds=30, size=2, report=report, replay=2))
    assert got == brute(rows, 5, 30, 2)
    assert len(report) < 30 and report[-1][0] < 600 and report[-1][1] >= 3  # plain rounds work out 2,500 distances


def test_ties_and_repeats(spark):
    """Equal centroids: the smaller number takes all; the other keeps its place."""
    rows = [(i, [1.0, 2.0]) for i in range(10)] + [(i, [3.0, 2.0]) for i in range(10, 13)] + [(13, [2.0, 2.0])]
    assert rows_of(balls.cluster(make(spark, rows), k=8, rounds=3, size=2)) == brute(rows, 8, 3, 2)


def test_few_and_none(spark):
    assert balls.cluster(make(spark, []), size=2).collect() == []
    assert balls.cluster(make(spark, [(1, None)]), size=2).dtypes == balls.cluster(make(spark, [(1, [1.0, 2.0])]), size=2).dtypes
    rows = [(1, [1.0, 2.0]), (2, [1.0, 2.5])]
    assert rows_of(balls.cluster(make(spark, rows), size=2)) == brute(rows, 8, 10, 2)


def test_query_equals_sql(spark):
    same(queries.op11_ball_kmeans(spark, SF).collect(), balls.ORACLE, SF)
