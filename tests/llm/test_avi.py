import hashlib
import random
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lumenframe.llm import avi

SCHEMA = "doc_id long, text string, media string, clip int"


def plain_decode(frame):
    """One lossless JPEG frame, bit by bit."""
    at, tables = 2, {}
    while True:
        mark, length = frame[at + 1], struct.unpack_from(">H", frame, at + 2)[0]
        body = frame[at + 4 : at + 2 + length]
        if mark == 0xC3:
            height, width, parts = *struct.unpack_from(">HH", body, 1), body[5]
        if mark == 0xC4:
            code, k = 0, 17
            for n in range(1, 17):
                for _ in range(body[n]):
                    tables[f"{code:0{n}b}"] = body[k]
                    code, k = code + 1, k + 1
                code <<= 1
        at += 2 + length
        if mark == 0xDA:
            break
    bits = "".join(f"{x:08b}" for x in frame[at:-2].replace(b"\xff\x00", b"\xff"))
    out, p = np.zeros((height, width, parts), int), 0
    for y in range(height):
        for x in range(width):
            for c in range(parts):
                n = 1
                while bits[p : p + n] not in tables:
                    n += 1
                s = tables[bits[p : p + n]]
                p += n
                extra = bits[p : p + s]
                p += s
                d = 0 if not s else int(extra, 2) if extra[0] == "1" else int(extra, 2) - (1 << s) + 1
                near = 128 if x == y == 0 else out[y - 1, 0, c] if x == 0 else out[y, x - 1, c]
                out[y, x, c] = (near + d) & 0xFF
    return out.astype(np.uint8)


@settings(max_examples=30, deadline=None)
@given(st.lists(st.binary(max_size=900), min_size=1, max_size=5))
def test_lossless_round_trip(parts):
    payloads = [p + b" " * (-len(p) % 192 or (0 if p else 192)) for p in parts]
    frames = avi.encode_frames(np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, 8, 8, 3))
    assert b"".join(plain_decode(f).tobytes() for f in frames[:3]) == b"".join(payloads)[: 192 * min(3, len(frames))]
    files, at = [], 0
    for p in payloads:
        files.append(avi.write_avi(frames[at : at + len(p) // 192]))
        at += len(p) // 192
    assert [x["payload"] for x in avi.load(files)] == payloads
    alone = [avi.load([f])[0] for f in files]
    assert alone == avi.load(files)  # what lies beside a file doesn't matter


def test_extreme_differences():
    x = np.zeros((3, 8, 8, 3), np.uint8)
    x[0, ::2], x[1, :, ::2], x[2] = 255, 255, np.random.default_rng(0).integers(0, 256, (8, 8, 3))
    assert (np.stack(avi.decode_frames(avi.encode_frames(x))) == x).all()


def test_shots_are_found_at_cuts():
    rng = np.random.default_rng(4)
    scenes = [rng.integers(lo, lo + 40, (n, 8, 8, 3)) for lo, n in ((0, 9), (120, 12), (30, 7), (200, 10))]
    frames = avi.encode_frames(np.concatenate(scenes).astype(np.uint8))
    (back,) = avi.load([avi.write_avi(frames)])
    assert back["clips"] == [(0, 9), (9, 21), (21, 28), (28, 38)]


def test_damaged_files():
    good = avi.store(["some text " * 60])[0][1]
    for bad in (b"", b"RIFF", good[:200], good.replace(b"idx1", b"idx2"), good[:-20]):
        with pytest.raises((ValueError, struct.error)):
            avi.load([bad])
    assert avi.load([avi.write_avi([])])[0]["clips"] == []


def test_digest_against_plain_computation(spark):
    rng = random.Random(1)
    texts = ["", None, "x", "é" * 96, "a" * 192, "b" * 193, "long " * 60_000, "A quick one. " * 30] + ["".join(chr(rng.randint(1, 0x2FF)) for _ in range(rng.randint(0, 2000))) for _ in range(20)]
    docs = spark.createDataFrame([(i, t, "m", 1) for i, t in enumerate([*texts, texts[-1]])] + [(None, "x", None, None)], SCHEMA)
    got = {r["doc_id"]: r.asDict() for r in avi.media_digest(docs).collect()}
    media = {r["doc_id"]: bytes(r["media"]) for r in avi.text_media(docs).collect()}
    for i, t in enumerate(texts):
        data = (t or "").encode()
        payload = data + b" " * (-len(data) % 192 or (0 if data else 192))
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert (r["media_bytes"], r["media_sha256"]) == (len(media[i]), hashlib.sha256(media[i]).hexdigest())
    assert {k: v for k, v in got[len(texts)].items() if k != "doc_id"} == {k: v for k, v in got[len(texts) - 1].items() if k != "doc_id"}
    rows = avi.clips(avi.text_media(docs)).where("doc_id = 6").orderBy("clip").collect()
    assert rows[0]["start_ms"] == 0 and rows[-1]["end_ms"] == -(-300_000 // 192) * 40 and all(a["end_ms"] == b["start_ms"] for a, b in zip(rows, rows[1:], strict=False))


def test_empty_table(spark):
    assert avi.media_digest(spark.createDataFrame([], SCHEMA)).collect() == []
