import random
import re

import numpy as np
import pyarrow as pa
import pytest

from lumenframe.llm import suffixes
from lumenframe.llm.words import chunks

SCHEMA = "doc_id long, text string, h string, place int"
KEY = 1 << 62


def brute(rows, words, span, gram):
    """The same passages from pairs of retained places, all compared with all."""
    run = words - span + 1
    docs = sorted({(KEY if i is None else i, t or "") for i, t in rows})
    split = [re.findall(r"[^\x20\x09-\x0D]+", t) for _, t in docs]
    places = []
    for d, (_, t) in enumerate(docs):
        for _, w in chunks(pa.array([t])):
            places += [(d, int(p)) for p in suffixes.retained(w, span, gram)[1] if p + run <= len(split[d])]
    covered = [np.zeros(len(w), bool) for w in split]
    later = [np.zeros(len(w), bool) for w in split]
    for d, p in places:
        for e, q in places:
            if (d, p) != (e, q) and split[d][p : p + run] == split[e][q : q + run]:
                a = b = 0
                while a < span and p - a > 0 and q - a > 0 and split[d][p - a - 1] == split[e][q - a - 1]:
                    a += 1
                while b < span and p + run + b < len(split[d]) and q + run + b < len(split[e]) and split[d][p + run + b] == split[e][q + run + b]:
                    b += 1
                covered[d][p - a : p + run + b] = True
                if (e, q) < (d, p):
                    later[d][p : p + run] = True
    out = []
    for d, (i, _) in enumerate(docs):
        turns = np.flatnonzero(np.diff(covered[d], prepend=False, append=False)).reshape(-1, 2)
        out += [(None if i == KEY else i, int(a), int(b), int(b - a), int(later[d][a:b].sum())) for a, b in turns if b - a >= words]
    return sorted(out, key=str)


def windows_twice(rows, words):
    """Words in a window of ``words`` words that occurs at two places."""
    seen = {}
    docs = sorted({(KEY if i is None else i, t or "") for i, t in rows})
    for i, t in docs:
        w = t.split()
        for a in range(len(w) - words + 1):
            seen.setdefault(tuple(w[a : a + words]), []).append((i, a))
    return {(i, a + k) for places in seen.values() if len(places) > 1 for i, a in places for k in range(words)}


@pytest.mark.parametrize("flush", [30, 1_000_000])
def test_against_all_pairs(spark, monkeypatch, flush):
    monkeypatch.setattr(suffixes, "FLUSH", flush)
    monkeypatch.setattr(suffixes, "BUCKET", 50)
    rng = random.Random(flush)
    own = lambda n: [f"é{rng.randint(0, 10**9)}" for _ in range(n)]
    shared = [own(rng.randint(8, 50)) for _ in range(5)]
    rows = []
    for k in range(50):
        body = sum((own(rng.randint(0, 15)) + (rng.choice(shared)[rng.randint(0, 4) :] if rng.random() < 0.5 else []) for _ in range(rng.randint(0, 5))), [])
        rows.append((k, " ".join(body)))
    rows += [(100, None), (101, ""), (102, "same " * 400), rows[3], (103, rows[3][1]), (None, " ".join(shared[0] + own(3)))]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], SCHEMA).repartition(3)
    got = sorted((tuple(r) for r in suffixes.passages(docs, 12, 5, 2).collect()), key=str)
    assert got == brute(rows, 12, 5, 2)
    told = {(KEY if i is None else i, w) for i, a, b, *_ in got for w in range(a, b)}
    assert windows_twice(rows, 12) <= told


def test_one_long_passage_in_many_documents(spark):
    rng = random.Random(2)
    passage = " ".join(f"p{k}" for k in range(60))
    rows = [(k, f"{' '.join(f'a{rng.random()}' for _ in range(30))} {passage} {' '.join(f'b{rng.random()}' for _ in range(30))}") for k in range(300)]
    rows += [(1000 + k, " ".join(f"c{rng.random()}" for _ in range(100))) for k in range(50)]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], SCHEMA).repartition(5)
    got = suffixes.passages(docs).collect()
    assert {tuple(r)[:4] for r in got} == {(k, 30, 90, 60) for k in range(300)}
    assert [r["n_later"] for r in got if r["doc_id"] == 0] == [0]


def test_empty_table(spark):
    assert suffixes.passages(spark.createDataFrame([], SCHEMA)).collect() == []
