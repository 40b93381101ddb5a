import hashlib
import random
import re

import pytest

from lumenframe.llm import windows

SCHEMA = "doc_id long, text string, n_words string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, window):
    words = [(i, WORD.findall(t or "")) for i, t in rows]
    key = lambda i: (i is None, i)
    first = {}
    for i, w in words:
        for a in range(len(w) - window + 1):
            k = tuple(w[a : a + window])
            first[k] = min(first.get(k, key(i)), key(i))
    out = []
    for i, w in words:
        gone = [False] * len(w)
        for a in range(len(w) - window + 1):
            if first[tuple(w[a : a + window])] < key(i):
                gone[a : a + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("flush", [50, 2_000_000])
def test_against_brute_force(spark, monkeypatch, flush):
    monkeypatch.setattr(windows, "FLUSH", flush)
    monkeypatch.setattr(windows, "BUCKET", 200)
    rng = random.Random(5)
    vocabulary = ["a", "b", "é", "日本", "x y", "\x00"]
    shared = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(6, 30))) for _ in range(4)]
    rows = []
    for i in range(60):
        parts = [rng.choice(shared) if rng.random() < 0.5 else " ".join(rng.choice(vocabulary) + str(rng.randint(0, 9)) for _ in range(rng.randint(0, 12))) for _ in range(rng.randint(0, 5))]
        rows.append((rng.randint(0, 100), rng.choice([" ", "\n", "\t\r "]).join(parts)))
    rows += [rows[0], (None, rows[1][1]), (None, shared[0]), (200, None), (201, ""), (202, "  \n"), (203, shared[0] * 50)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], SCHEMA).repartition(3)
    got = sorted((tuple(r) for r in windows.remove_repeats(docs, 6).collect()), key=str)
    assert got == brute(rows, 6)
    full = windows.remove_repeats(docs, 6, texts=True).collect()
    assert all(sum(x["end"] - x["start"] for x in r["removed"]) == r["n_removed"] and len(r["kept"].split(" ")) == max(1, r["n_words"] - r["n_removed"]) for r in full)


def test_empty_table(spark):
    assert windows.remove_repeats(spark.createDataFrame([], SCHEMA)).collect() == []


def test_words_of_a_symmetric_sequence(spark):
    """Polynomials modulo a power of two can't tell a long Thue-Morse word from its complement."""
    word = "a"
    for _ in range(11):
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    assert word != other
    rest = "x y z u v"
    docs = spark.createDataFrame([(1, f"{word} {rest}", ""), (2, f"{other} {rest}", ""), (3, f"{word} {rest}", "")], SCHEMA)
    assert {r["doc_id"]: r["n_removed"] for r in windows.remove_repeats(docs, 6).collect()} == {1: 0, 2: 0, 3: 6}


def test_long_text_in_pieces(monkeypatch):
    import numpy as np
    import pyarrow as pa

    from lumenframe.llm import words

    rng = random.Random(1)
    texts = [" \n".join("".join(rng.choice("abé") for _ in range(rng.choice((1, 3, 9, 80, 700)))) for _ in range(300)), "", "x" * 5000, " y"]
    whole = list(words.chunks(pa.array(texts)))
    monkeypatch.setattr(words, "CHUNK", 512)
    found = []
    for _, part in words.chunks(pa.array(texts)):
        raw = part.data.tobytes()
        for a, b in zip(part.first, part.first[1:]):
            found.append([raw[s:e].decode() for s, e in zip(part.start[a:b], part.end[a:b])])
    assert found == [WORD.findall(t) for t in texts]
    assert np.array_equal(np.concatenate([w.hash for _, w in whole]), np.concatenate([w.hash for _, w in words.chunks(pa.array(texts))]))
