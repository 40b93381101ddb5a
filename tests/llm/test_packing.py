import zlib
from collections import defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from lumenframe.llm import packing

SCHEMA = "doc_id long, text string, sequence_id string, length int"


def check_layout(rows, capacity):
    by = defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in by.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= capacity
    return len(by)


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 30), max_size=25))
def test_plan_places_each_rank_once_and_tight(histogram):
    rows = []
    for length, r0, r1, s0, per, o0 in packing.plan(histogram, 40):
        rows += [{"length": length, "rank": r, "sequence_id": s0 + (r - r0) // per, "offset": o0 + (r - r0) % per * length} for r in range(r0, r1)]
    assert sorted((r["length"], r["rank"]) for r in rows) == sorted((k, r) for k, n in histogram.items() for r in range(n))
    used = check_layout(rows, 40)
    # the same rule one piece at a time
    bins = []
    for length in sorted((k for k, n in histogram.items() for _ in range(n)), reverse=True):
        fit = min((b for b in range(len(bins)) if bins[b] >= length), key=lambda b: bins[b], default=None)
        if fit is None:
            bins.append(40 - length)
        else:
            bins[fit] -= length
    assert used == len(bins)


def test_pack_round_trip_and_odd_rows(spark):
    path = packing.tokenizer_path()
    from tokenizers import Tokenizer

    full = Tokenizer.from_file(path)
    texts = ["", None, "a b", "a b", "word " * 90, "x<|endoftext|>y", "ü\u0000  é" * 40, " \n\n\t "]
    docs = spark.createDataFrame([(i, t, "s", 1) for i, t in enumerate(texts)] + [(2, "a b", "s", 1), (None, "z", None, None)], SCHEMA)
    got = [r.asDict() for r in packing.pack(docs, capacity=50, keep_ids=True).collect()]
    check_layout(got, 50)
    by = defaultdict(list)
    for r in got:
        by[r["doc_id"]].append(r)
    for i, t in enumerate(texts):
        ids = [*full.encode(t or "", add_special_tokens=False).ids, 0]
        parts = sorted(by[i], key=lambda r: r["piece"])[:: 2 if i == 2 else 1]
        assert sum((p["ids"] for p in parts), []) == ids
        assert [p["piece"] for p in parts] == list(range(len(parts)))
        assert all(p["length"] == 50 for p in parts[1:]) and parts[0]["start"] == 0
        assert all(p["ids_crc32"] == zlib.crc32(np.array(p["ids"], "<u4").tobytes()) for p in parts)
    assert len(by[2]) == 2 and len(by[None]) == 1


def test_empty_table(spark):
    assert packing.pack(spark.createDataFrame([], SCHEMA)).collect() == []


@settings(max_examples=80, deadline=None)
@given(st.text(max_size=300))
def test_ids_equal_the_full_tokenizer(text):
    from tokenizers import Tokenizer

    path = packing.tokenizer_path()
    test_ids_equal_the_full_tokenizer.full = full = getattr(test_ids_equal_the_full_tokenizer, "full", None) or Tokenizer.from_file(path)
    assert packing._encoder(path)(text).tolist() == full.encode(text, add_special_tokens=False).ids


def test_ids_of_all_documents_are_those_of_tokenizers():
    """Every text of sf0.01, and texts over 200,000 characters with and without spaces, encoded by both libraries."""
    import pyarrow.parquet as pq
    from tokenizers import Tokenizer

    full, encode = Tokenizer.from_file(packing.tokenizer_path()), packing._encoder(packing.tokenizer_path())
    texts = [t or "" for t in pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"]).column(0).to_pylist()]
    texts += [" ".join(texts)[:260_000], "é日本 x" * 60_000, "ab" * 110_000]
    for text, own in zip(texts, full.encode_batch(texts, add_special_tokens=False), strict=True):
        assert encode(text).tolist() == own.ids
