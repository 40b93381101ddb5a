"""Media columns: AVI files with motion-JPEG intra frames, decoded in NumPy, and shots as timed clip rows.

Frames are 8 x 8 pixels of three 8-bit components, coded by JPEG's lossless process (SOF3, predictor 1,
one interleaved scan), so that 192 bytes make a frame and come back as they were. The reader follows the
RIFF index, reads the JPEG markers of a frame (size, components, Huffman tables, predictor) and decodes
all frames of like shape side by side, one sample of every frame a step.

Shots: a frame begins a shot if the histogram difference to the frame before it exceeds the mean of the
differences around it by ``SPREAD`` standard deviations, and a floor, and no neighbour's is larger.

Defined results: null and empty texts are a payload of 192 spaces, one frame, one shot; a text of any length is
one file, coded and decoded ``CHUNK`` bytes at a time; of equal differences beside each other the first begins the
shot; repeated rows give equal rows; an empty table gives no rows; columns other than ``doc_id`` and ``text`` are ignored; a file
without a frame gives no clip, a damaged one raises ValueError.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.llm.common import documents, per_batch, prepare

UNIT, SIDE, PARTS = 192, 8, 3
FRAME_MS = 40
AROUND, SPREAD, FLOOR = 6, 1.5, 0.25
HIST = 16
#: Bytes of payload coded at once.
CHUNK = 1 << 20
#: Code lengths of difference categories 0 to 8, for text; a parameter of the files written.
LENGTHS = (4, 4, 3, 2, 2, 4, 5, 3, 6)


def _canonical(counts: list[int], values: list[int]) -> list[tuple[int, int, int]]:
    """(value, code, length) of a JPEG Huffman table."""
    out, code, k = [], 0, 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            out.append((values[k], code, length))
            code, k = code + 1, k + 1
        code <<= 1
    return out


_values = sorted(range(len(LENGTHS)), key=lambda v: (LENGTHS[v], v))
_counts = [LENGTHS.count(n) for n in range(1, 17)]


@lru_cache(maxsize=1)
def _codes() -> tuple[np.ndarray, np.ndarray]:
    """By difference + 255: code with extra bits, and how many bits."""
    of = {v: (code, length) for v, code, length in _canonical(_counts, _values)}
    bits, size = np.zeros(511, np.uint64), np.zeros(511, np.int64)
    for d in range(-255, 256):
        category = abs(d).bit_length()
        code, length = of[category]
        bits[d + 255] = code << category | (d if d >= 0 else d + (1 << category) - 1)
        size[d + 255] = length + category
    return bits, size


_HEAD = (
    b"\xff\xd8\xff\xc3" + struct.pack(">HBHHB", 8 + 3 * PARTS, 8, SIDE, SIDE, PARTS) + b"".join(bytes([c, 0x11, 0]) for c in range(1, PARTS + 1))
    + b"\xff\xc4" + struct.pack(">HB", 19 + len(_values), 0) + bytes(_counts) + bytes(_values)
    + b"\xff\xda" + struct.pack(">HB", 6 + 2 * PARTS, PARTS) + b"".join(bytes([c, 0]) for c in range(1, PARTS + 1)) + bytes([1, 0, 0])
)


def encode_frames(samples: np.ndarray) -> list[bytes]:
    """uint8 of shape (frames, 8, 8, 3) -> a JPEG file for each frame."""
    n = len(samples)
    x = samples.astype(np.int16)
    diff = np.empty_like(x)
    diff[:, :, 1:] = x[:, :, 1:] - x[:, :, :-1]
    diff[:, 1:, 0] = x[:, 1:, 0] - x[:, :-1, 0]
    diff[:, 0, 0] = x[:, 0, 0] - 128
    bits, size = _codes()
    at = diff.reshape(n, -1) + 255
    value, length = bits[at], size[at]
    for _ in range(2):  # neighbours become one: up to 4 codes of 14 bits
        value = value[:, ::2] << length[:, 1::2].astype(np.uint64) | value[:, 1::2]
        length = length[:, ::2] + length[:, 1::2]
    end = np.cumsum(length, axis=1)
    used = end[:, -1]
    whole = (used + 7) // 8
    first = np.concatenate([[0], np.cumsum(whole)])
    pad = (whole * 8 - used).astype(np.uint64)
    value[:, -1] = value[:, -1] << pad | (np.uint64(1) << pad) - np.uint64(1)  # at most 56 + 7 bits
    length[:, -1] += pad.astype(np.int64)
    end[:, -1] = whole * 8
    start = (end - length + 8 * first[:-1, None]).ravel()
    value, length = value.ravel(), length.ravel()
    word, inside = start >> 6, start & 63
    over = inside + length - 64
    words = np.zeros(first[-1] // 8 + 2, np.uint64)
    np.bitwise_or.at(words, word, np.where(over > 0, value >> np.maximum(over, 0).astype(np.uint64), value << np.maximum(-over, 0).astype(np.uint64)))
    spill = over > 0
    np.bitwise_or.at(words, word[spill] + 1, value[spill] << (64 - over[spill]).astype(np.uint64))
    data = words.astype(">u8").view(np.uint8)[: first[-1]]
    full = np.flatnonzero(data == 0xFF)
    stuffed = np.insert(data, full + 1, 0).tobytes()
    bounds = (first + np.searchsorted(full, first)).tolist()
    return [_HEAD + stuffed[a:b] + b"\xff\xd9" for a, b in zip(bounds, bounds[1:], strict=False)]


def _chunk(name: bytes, data: bytes) -> bytes:
    return name + struct.pack("<I", len(data)) + data + b"\0" * (len(data) & 1)


def write_avi(frames: list[bytes], width: int = SIDE, height: int = SIDE) -> bytes:
    """An AVI file of one motion-JPEG stream with an index."""
    largest = max(map(len, frames), default=0)
    main = struct.pack("<14I", FRAME_MS * 1000, largest * 1000 // FRAME_MS, 0, 0x10, len(frames), 0, 1, largest, width, height, 0, 0, 0, 0)
    stream = b"vidsMJPG" + struct.pack("<10I4H", 0, 0, 0, FRAME_MS, 1000, 0, len(frames), largest, 0xFFFFFFFF, 0, 0, 0, width, height)
    form = struct.pack("<IiiHH4s5I", 40, width, height, 1, 24, b"MJPG", width * height * 3, 0, 0, 0, 0)
    streams = b"LIST" + struct.pack("<I", 4 + 8 + len(stream) + 8 + len(form)) + b"strl" + _chunk(b"strh", stream) + _chunk(b"strf", form)
    header = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", main) + streams)
    index, at = [], 4
    for x in frames:
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(x)))
        at += 8 + len(x) + (len(x) & 1)
    movie = _chunk(b"LIST", b"movi" + b"".join([_chunk(b"00dc", x) for x in frames]))
    body = b"AVI " + header + movie + _chunk(b"idx1", b"".join(index))
    return b"RIFF" + struct.pack("<I", len(body)) + body


def read_index(file: bytes) -> tuple[int, list[tuple[int, int]]]:
    """Milliseconds a frame, and (offset, size) of each frame by the RIFF index."""
    if file[:4] != b"RIFF" or file[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    at, movie, index, micro = 12, None, None, FRAME_MS * 1000
    while at + 8 <= len(file):
        name, size = file[at : at + 4], struct.unpack_from("<I", file, at + 4)[0]
        if name == b"LIST" and file[at + 8 : at + 12] == b"movi":
            movie = at + 8
        elif name == b"LIST" and file[at + 8 : at + 12] == b"hdrl" and file[at + 12 : at + 16] == b"avih":
            micro = struct.unpack_from("<I", file, at + 20)[0]
        elif name == b"idx1":
            index = np.frombuffer(file, np.dtype([("id", "S4"), ("flags", "<u4"), ("at", "<u4"), ("size", "<u4")]), size // 16, at + 8)
        at += 8 + size + (size & 1)
    if movie is None or index is None:
        raise ValueError("an AVI file without frames' list or index")
    video = index[np.char.endswith(index["id"], b"dc") | np.char.endswith(index["id"], b"db")] if not (index["id"] == b"00dc").all() else index
    places = list(zip((video["at"].astype(np.int64) + movie + 8).tolist(), video["size"].tolist(), strict=True))
    if any(a + n > len(file) for a, n in places):
        raise ValueError("an index beyond the end of an AVI file")
    return micro // 1000, places


@lru_cache(maxsize=64)
def _parse(head: bytes):
    """(height, width, components, predictor, tables by component) of the markers up to the scan."""
    at, size, tables = 2, None, {}
    while at < len(head):
        mark, length = head[at + 1], struct.unpack_from(">H", head, at + 2)[0]
        body = head[at + 4 : at + 2 + length]
        if mark == 0xC3:
            if body[0] != 8 or any(body[7 + 3 * k] != 0x11 for k in range(body[5])):
                raise ValueError("only 8-bit frames without subsampling are read")
            size = (*struct.unpack_from(">HH", body, 1), body[5])
        elif mark == 0xC4:
            while body:
                counts = list(body[1:17])
                n = sum(counts)
                tables[body[0]] = (tuple(counts), tuple(body[17 : 17 + n]))
                body = body[17 + n :]
        elif mark == 0xDA:
            if size is None:
                raise ValueError("only lossless JPEG frames are read")
            chosen = tuple(tables[body[2 + 2 * k] >> 4] for k in range(body[0]))
            return (*size, body[1 + 2 * body[0]], chosen)
        at += 2 + length
    raise ValueError("a frame without a scan")


@lru_cache(maxsize=16)
def _lookup(table) -> tuple[np.ndarray, np.ndarray]:
    """By the next 16 bits: category and code length (0: no such code)."""
    category, length = np.zeros(1 << 16, np.uint64), np.zeros(1 << 16, np.uint64)
    for value, code, n in _canonical(list(table[0]), list(table[1])):
        category[code << 16 - n : code + 1 << 16 - n] = value
        length[code << 16 - n : code + 1 << 16 - n] = n
    return category, length


def _header(frame: bytes) -> bytes:
    at = 2
    while frame[at + 1] != 0xDA:
        at += 2 + struct.unpack_from(">H", frame, at + 2)[0]
    return frame[: at + 2 + struct.unpack_from(">H", frame, at + 2)[0]]


def decode_frames(frames: list[bytes]) -> list[np.ndarray]:
    """Each JPEG frame as uint8 of shape (height, width, components)."""
    groups: dict[bytes, list[int]] = {}
    last = None
    for k, x in enumerate(frames):
        if x[:2] != b"\xff\xd8" or x[-2:] != b"\xff\xd9":
            raise ValueError("not a JPEG frame")
        if last is None or not x.startswith(last):
            last = _header(x)
        groups.setdefault(last, []).append(k)
    out: list = [None] * len(frames)
    for head, members in groups.items():
        samples = _decode(_parse(head), [frames[k][len(head) : -2] for k in members])
        for k, x in zip(members, samples, strict=True):
            out[k] = x
    return out


def _decode(shape, scans: list[bytes]) -> np.ndarray:
    height, width, parts, predictor, tables = shape
    if predictor != 1:
        raise ValueError("only predictor 1 is read")
    n = len(scans)
    data = np.frombuffer(b"".join(scans), np.uint8)
    bounds = np.concatenate([[0], np.cumsum([len(x) for x in scans])])
    keep = np.ones(len(data), bool)
    full = np.flatnonzero(data == 0xFF)
    keep[full[full + 1 < len(data)] + 1] = False  # the zero after each 0xFF
    moved = np.concatenate([[0], np.cumsum(keep)])
    data = np.concatenate([data[keep], np.zeros(8, np.uint8)]).astype(np.uint64)
    window = data[:-4] << np.uint64(32) | data[1:-3] << np.uint64(24) | data[2:-2] << np.uint64(16) | data[3:-1] << np.uint64(8) | data[4:]
    place = (moved[bounds[:-1]] * 8).astype(np.int64)
    limit = moved[bounds[1:]] * 8
    steps = height * width * parts
    diff = np.empty((steps, n), np.int16)
    looks = [_lookup(t) for t in tables]
    last = len(window) - 1
    for k in range(steps):
        category, length = looks[k % parts]
        rest = window[np.minimum(place >> 3, last)] << (place & 7).astype(np.uint64) + np.uint64(24)  # 33 bits at the top
        top = (rest >> np.uint64(48)).astype(np.intp)
        c, used = category[top], length[top]
        if not used.all():
            raise ValueError("a code that the table doesn't have")
        extra = (rest << used >> np.uint64(1) >> np.uint64(63) - c).astype(np.int64)
        c = c.astype(np.int64)
        diff[k] = extra - np.where((extra >> np.maximum(c - 1, 0) == 0) & (c > 0), (1 << c) - 1, 0)
        place += used.astype(np.int64) + c
    if (place > limit).any():
        raise ValueError("a frame that ends early")
    d = diff.T.reshape(n, height, width, parts).astype(np.int64)
    d[:, 0, 0] += 128
    d[:, :, 0] = np.cumsum(d[:, :, 0], axis=1)
    return (np.cumsum(d, axis=2) & 0xFF).astype(np.uint8)


def shot_starts(frames: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For frames of many files laid end to end (file k: first[k] to first[k+1]): whether each frame
    begins a shot, and each frame's histogram over HIST bins of all samples."""
    n = len(frames)
    parts = []
    for a in range(0, n, CHUNK // UNIT):
        some = (frames[a : a + CHUNK // UNIT].reshape(min(n - a, CHUNK // UNIT), -1) >> 4).astype(np.int64)
        parts.append(np.bincount((some + HIST * np.arange(len(some))[:, None]).ravel(), minlength=HIST * len(some)).reshape(-1, HIST))
    hist = np.concatenate(parts)
    samples = frames[0].size
    begins = np.zeros(n, bool)
    begins[first[:-1][first[:-1] < first[1:]]] = True
    change = np.zeros(n)
    change[1:] = np.abs(np.diff(hist, axis=0)).sum(1) / (2 * samples)
    change[begins] = 0
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    lo = np.maximum(np.arange(n) - AROUND, first[:-1][owner] + 1)
    hi = np.minimum(np.arange(n) + AROUND + 1, first[1:][owner])
    count = np.maximum(hi - lo, 1)
    # sums of whole numbers, so that a file's shots don't hang on the files beside it
    whole = np.rint(change * 2 * samples).astype(np.int64)
    one, two = (np.concatenate([[0], np.cumsum(x)]) for x in (whole, whole * whole))
    scale = 2 * samples
    mean = (one[hi] - one[np.minimum(lo, hi)]) / count / scale
    square = (two[hi] - two[np.minimum(lo, hi)]) / count / scale**2
    limit = np.maximum(mean + SPREAD * np.sqrt(np.maximum(square - mean * mean, 0)), FLOOR)
    before = np.where(begins, -1, np.concatenate([[-1], change[:-1]]))
    ends = np.concatenate([begins[1:], [True]])
    after = np.where(ends, -1, np.concatenate([change[1:], [-1]]))
    return begins | (change > limit) & (change >= before) & (change > after), hist


def payload_of(text: str | None) -> tuple[int, bytes]:
    data = (text or "").encode("utf-8", "replace")
    return len(data), data + b" " * (-len(data) % UNIT or (0 if data else UNIT))


def store(texts: list[str | None]) -> list[tuple[int, bytes]]:
    """(unpadded bytes, AVI file) of each text."""
    made = [payload_of(t) for t in texts]
    samples = np.frombuffer(b"".join(p for _, p in made), np.uint8).reshape(-1, SIDE, SIDE, PARTS)
    frames = [f for a in range(0, len(samples), CHUNK // UNIT) for f in encode_frames(samples[a : a + CHUNK // UNIT])]
    out, at = [], 0
    for n, p in made:
        out.append((n, write_avi(frames[at : at + len(p) // UNIT])))
        at += len(p) // UNIT
    return out


def load(files: list[bytes]) -> list[dict]:
    """For each AVI file: payload, frame_ms, clips as (first frame, end frame), hist (sum over frames)."""
    places = [read_index(f) for f in files]
    raw = [f[a : a + n] for f, (_, own) in zip(files, places, strict=True) for a, n in own]
    frames = [x for a in range(0, len(raw), CHUNK // UNIT) for x in decode_frames(raw[a : a + CHUNK // UNIT])]
    out, at = [], 0
    first = np.concatenate([[0], np.cumsum([len(own) for _, own in places])])
    like = len({x.shape for x in frames}) <= 1
    if like and frames:
        stack = np.stack(frames)
        starts, hist = shot_starts(stack, first)
    for k, (ms, own) in enumerate(places):
        a, b = int(first[k]), int(first[k + 1])
        if not own:
            out.append({"payload": b"", "frame_ms": ms, "clips": [], "hist": [0] * HIST})
            continue
        if like:
            mine, counts, payload = starts[a:b], hist[a:b], stack[a:b].tobytes()
        else:
            mine, counts = shot_starts(np.stack(frames[a:b]), np.array([0, b - a]))
            payload = b"".join(x.tobytes() for x in frames[a:b])
        cuts = [*np.flatnonzero(mine).tolist(), b - a]
        out.append({"payload": payload, "frame_ms": ms, "clips": list(zip(cuts, cuts[1:], strict=False)), "hist": counts.sum(0).tolist()})
        at += b - a
    return out


def _runs(sizes: list[int]):
    """Ranges of rows of about CHUNK bytes."""
    at = 0
    while at < len(sizes):
        to, total = at + 1, sizes[at]
        while to < len(sizes) and total + sizes[to] <= CHUNK:
            total += sizes[to]
            to += 1
        yield at, to
        at = to


def text_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: each text's payload stored as an AVI file."""
    prepare(docs.sparkSession)

    def make():
        def step(batch: pa.RecordBatch):
            texts = batch.column(1).to_pylist()
            for a, b in _runs([len(t) for t in texts]):
                made = store(texts[a:b])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array([n for n, _ in made], pa.int64()), pa.array([m for _, m in made], pa.binary())], names=["doc_id", "n_bytes", "media"])

        return step

    return documents(docs).mapInArrow(per_batch(make), "doc_id long, n_bytes long, media binary")


_CLIP = "clip int, start_ms long, end_ms long, first_frame int, end_frame int"


def clips(media: DataFrame, key: str = "doc_id", column: str = "media") -> DataFrame:
    """Timed clip rows of a table of AVI files: the key, clip, start_ms, end_ms, first_frame, end_frame."""
    prepare(media.sparkSession)
    plain = media.where(F.col(column).isNotNull()).select(F.col(key).alias("key"), F.col(column).alias("media"))

    def make():
        def step(batch: pa.RecordBatch):
            files = batch.column(1).to_pylist()
            for a, b in _runs([len(f) for f in files]):
                keys, rows = [], []
                for k, x in enumerate(load(files[a:b]), a):
                    for c, (lo, hi) in enumerate(x["clips"]):
                        keys.append(k)
                        rows.append((c, lo * x["frame_ms"], hi * x["frame_ms"], lo, hi))
                if rows:
                    kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32())
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keys)), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True))], names=["key", "clip", "start_ms", "end_ms", "first_frame", "end_frame"])

        return step

    kind = plain.schema["key"].dataType.simpleString()
    return plain.mapInArrow(per_batch(make), f"key {kind}, {_CLIP}").withColumnRenamed("key", key)


def media_digest(docs: DataFrame) -> DataFrame:
    """Store each text, read the stored bytes back, and sum up what came back; the files themselves go
    from one step to the next inside a task and are not shuffled."""
    prepare(docs.sparkSession)
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def make():
        def step(batch: pa.RecordBatch):
            texts = batch.column(1).to_pylist()
            for a, b in _runs([len(t) for t in texts]):
                made = store(texts[a:b])
                rows = []
                for (n, file), back in zip(made, load([m for _, m in made]), strict=True):
                    p = back["payload"]
                    shots = ",".join(str(lo * back["frame_ms"]) for lo, _ in back["clips"])
                    total = sum(back["hist"])
                    feature = f"frames={len(p) // UNIT};clips={len(back['clips'])};hist={','.join(str(round(1000 * h / total)) for h in back['hist'])};starts_ms={shots}"
                    rows.append((n, len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]), len(file), hashlib.sha256(file).hexdigest(), feature))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True))], names=["doc_id", *names])

        return step

    return documents(docs).mapInArrow(per_batch(make), schema)
