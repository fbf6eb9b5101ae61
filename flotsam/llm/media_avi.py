"""Texts as AVI motion-JPEG: encoding, RIFF index parsing, decoding of intra frames, and shots as timed clips.

A sample of the payload becomes one 8 x 8 block of a grey baseline JPEG: a flat block whose DC coefficient, quantised by
8, is the sample less 128, so every byte comes back exactly.  A row of blocks is a restart interval; rows of many frames
are coded and decoded side by side in numpy.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import doc_bytes, small_batches

#: Blocks in a row and rows in a frame, frames a second, and bytes of payload handled at a time.
COLUMNS, ROWS, RATE, BATCH_BYTES = 32, 32, 25, 1 << 20
FRAME = COLUMNS * ROWS
#: A frame starts a shot where its histogram differs from the last one's by more than the mean of the differences of the
#: last WINDOW frames and SPREAD standard deviations, and by LEAST at all.
BINS, WINDOW, SPREAD, LEAST = 16, 8, 3.0, 0.12
#: Order of an 8 x 8 block's coefficients in a file.
ZIGZAG = np.array(sorted(range(64), key=lambda k: (k // 8 + k % 8, k % 8 if (k // 8 + k % 8) % 2 == 0 else k // 8)))


def _header() -> bytes:
    """What stands before the scan of every frame."""
    segment = lambda mark, body: bytes([0xFF, mark]) + struct.pack(">H", len(body) + 2) + body
    dc = bytes([0x00, 0, 0, 0, 9] + [0] * 12) + bytes(range(9))
    ac = bytes([0x10, 1] + [0] * 15) + b"\0"
    size = struct.pack(">BHHB", 8, 8 * ROWS, 8 * COLUMNS, 1) + b"\1\x11\0"
    return b"\xff\xd8" + segment(0xDB, b"\0" + bytes([8] + [1] * 63)) + segment(0xC0, size) + segment(0xC4, dc) + segment(0xC4, ac) + segment(0xDD, struct.pack(">H", COLUMNS)) + segment(0xDA, b"\1\1\0\0\x3f\0")


HEADER = _header()


def encode_frames(samples: np.ndarray) -> list[bytes]:
    """JPEG files of frames (n, ROWS * COLUMNS) of bytes."""
    n = len(samples)
    rows = samples.reshape(n * ROWS, COLUMNS).astype(np.int32) - 128
    diff = np.diff(rows, axis=1, prepend=0)
    size = np.frexp(np.abs(diff).astype(np.float32))[1].astype(np.int64)
    extra = np.where(diff < 0, diff + (1 << size) - 1, diff)
    value = ((size << size | extra) << 1).astype(np.int64)  # category in 4 bits, its bits, and one bit that ends the block
    length = size + 5
    before = np.cumsum(length, axis=1)
    bits = before[:, -1]
    row_bytes = (bits + 7) // 8
    row_at = np.cumsum(row_bytes) - row_bytes
    at = (row_at * 8)[:, None] + before - length
    shifted = (value << (24 - length - (at & 7))).ravel()
    where = (at >> 3).ravel()
    total = int(row_bytes.sum())
    out = sum(np.bincount(where + k, (shifted >> (16 - 8 * k)) & 255, total + 2) for k in range(3))[:total].astype(np.int64)
    out[row_at + row_bytes - 1] += (1 << (row_bytes * 8 - bits)) - 1
    full = out == 255
    place = np.arange(total) + np.cumsum(full) - full + 2 * np.repeat(np.arange(n * ROWS), row_bytes)
    stream = np.zeros(total + int(full.sum()) + 2 * n * ROWS, np.uint8)
    stream[place] = out
    ends = place[row_at + row_bytes - 1] + 1 + full[row_at + row_bytes - 1]
    marks = np.where(np.arange(n * ROWS) % ROWS == ROWS - 1, 0xD9, 0xD0 + np.arange(n * ROWS) % ROWS % 8)
    stream[ends], stream[ends + 1] = 0xFF, marks
    data, stops = stream.tobytes(), (ends[ROWS - 1 :: ROWS] + 2).tolist()
    return [HEADER + data[a:b] for a, b in zip([0, *stops[:-1]], stops, strict=True)]


def write_avi(frames: list[bytes], payload_bytes: int) -> bytes:
    """An AVI file of the frames with an index; the payload's length is its comment."""
    chunk = lambda name, body: name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)
    width, height, most = 8 * COLUMNS, 8 * ROWS, max(map(len, frames))
    main = struct.pack("<14I", 1_000_000 // RATE, most * RATE, 0, 0x10, len(frames), 0, 1, most, width, height, 0, 0, 0, 0)
    stream = b"vidsMJPG" + struct.pack("<IHHIIIIIIiI4h", 0, 0, 0, 0, 1, RATE, 0, len(frames), most, -1, 0, 0, 0, width, height)
    bitmap = struct.pack("<IiiHH4sIiiII", 40, width, height, 1, 24, b"MJPG", width * height * 3, 0, 0, 0, 0)
    head = chunk(b"LIST", b"hdrl" + chunk(b"avih", main) + chunk(b"LIST", b"strl" + chunk(b"strh", stream) + chunk(b"strf", bitmap)))
    info = chunk(b"LIST", b"INFO" + chunk(b"ICMT", f"payload={payload_bytes}".encode()))
    at, index = 4, []
    for f in frames:
        index.append(b"00dc" + struct.pack("<III", 0x10, at, len(f)))
        at += 8 + len(f) + len(f) % 2
    movi = chunk(b"LIST", b"movi" + b"".join(chunk(b"00dc", f) for f in frames))
    body = b"AVI " + head + info + movi + chunk(b"idx1", b"".join(index))
    return b"RIFF" + struct.pack("<I", len(body)) + body


def read_avi(data: bytes) -> tuple[list[bytes], int, float]:
    """(frames by the index, payload bytes, seconds a frame)."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("no AVI file")
    found: dict[bytes, tuple[int, int]] = {}
    todo = [(12, 8 + struct.unpack_from("<I", data, 4)[0])]
    while todo:
        at, end = todo.pop()
        while at + 8 <= end:
            name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
            if name == b"LIST":
                name = data[at + 8 : at + 12]
                if name != b"movi":
                    todo.append((at + 12, at + 8 + size))
            found.setdefault(name, (at + 8, size))
            at += 8 + size + size % 2
    base, (index, size) = found[b"movi"][0], found[b"idx1"]
    frames = []
    for at in range(index, index + size, 16):
        name, _, offset, length = struct.unpack_from("<4sIII", data, at)
        if name[2:] == b"dc":
            frames.append(data[base + offset + 8 : base + offset + 8 + length])
    at, size = found[b"ICMT"]
    return frames, int(data[at : at + size].rpartition(b"=")[2]), struct.unpack_from("<I", data, found[b"avih"][0])[0] / 1e6


@lru_cache(maxsize=16)
def _parse(header: bytes):
    """(block rows, block columns, quantiser, code tables for DC and AC, restart interval) of a grey baseline file."""
    at, quant, codes, restart, shape = 2, None, {}, 0, None
    while at < len(header):
        mark, size = header[at + 1], struct.unpack_from(">H", header, at + 2)[0]
        body = header[at + 4 : at + 2 + size]
        if mark == 0xDB:
            quant = np.frombuffer(body[1:65], np.uint8).astype(np.int64)
        elif mark == 0xC0:
            shape = struct.unpack_from(">HH", body, 1)
        elif mark == 0xC4:
            lookup, code, k = np.zeros(1 << 16, np.int32), 0, 17
            for bits in range(1, 17):
                for _ in range(body[bits]):
                    lookup[code << (16 - bits) : (code + 1) << (16 - bits)] = bits << 8 | body[k]
                    code, k = code + 1, k + 1
                code <<= 1
            codes[body[0] >> 4] = lookup
        elif mark == 0xDD:
            restart = struct.unpack(">H", body)[0]
        at += 2 + size
    return -(-shape[0] // 8), -(-shape[1] // 8), quant, codes[0], codes[1], restart


def _scan_start(frame: bytes) -> int:
    at = frame.index(b"\xff\xda")
    return at + 2 + struct.unpack_from(">H", frame, at + 2)[0]


def decode_frames(frames: list[bytes]) -> np.ndarray:
    """(n, blocks) mean sample of each block of the frames, which share one header; restart intervals go side by side."""
    start = _scan_start(frames[0])
    rows, columns, quant, dc_codes, ac_codes, interval = _parse(frames[0][:start])
    if any(f[:start] != frames[0][:start] for f in frames):
        return np.concatenate([decode_frames([f]) for f in frames])
    raw = np.frombuffer(b"".join(f[start:-2] + b"\xff\xd0" for f in frames), np.uint8)
    ff = raw[:-1] == 255
    mark = np.flatnonzero(ff & (raw[1:] >= 0xD0) & (raw[1:] <= 0xD7))
    drop = np.zeros(len(raw), bool)
    drop[1:] = ff & (raw[1:] == 0)
    drop[mark], drop[mark + 1] = True, True
    kept = np.cumsum(~drop)
    ends = kept[mark]
    data = np.concatenate((raw[~drop], np.zeros(8, np.uint8))).astype(np.int64)
    words = data[:-2] << 16 | data[1:-1] << 8 | data[2:]
    lanes = np.append(0, ends[:-1]) * 8
    per_lane = interval or rows * columns
    blocks = np.zeros((len(lanes), per_lane), np.int64)
    dc = np.zeros(len(lanes), np.int64)
    rest: list[tuple] = []

    def symbol(pos: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        found = codes[(words[pos >> 3] >> (8 - (pos & 7))) & 0xFFFF]
        return pos + (found >> 8), found & 255

    def bits(pos: np.ndarray, size: np.ndarray) -> np.ndarray:
        value = ((words[pos >> 3] >> (8 - (pos & 7))) & 0xFFFF) >> (16 - size)
        return np.where(value < (1 << size) >> 1, value - (1 << size) + 1, value)

    pos = lanes.copy()
    for k in range(per_lane):
        pos, size = symbol(pos, dc_codes)
        dc += bits(pos, size)
        pos += size
        blocks[:, k] = dc
        live, place = np.arange(len(lanes)), np.zeros(len(lanes), np.int64)
        while len(live):
            moved, code = symbol(pos[live], ac_codes)
            pos[live] = moved
            go = code != 0
            live, place, code = live[go], place[go], code[go]
            if len(live):
                place, size = place + (code >> 4) + 1, code & 15
                rest.append((live, np.full(len(live), k), place, bits(pos[live], size)))
                pos[live] += size
                go = place < 63
                live, place = live[go], place[go]
    if rest:  # blocks with detail: the mean of the inverse transform after clipping
        lane, at, place, value = (np.concatenate(x) for x in zip(*rest, strict=True))
        key, own = np.unique(lane * per_lane + at, return_inverse=True)
        coefficients = np.zeros((len(key), 64))
        coefficients[:, 0] = blocks.ravel()[key] * quant[0]
        coefficients[own, ZIGZAG[place]] = value * quant[place]
        basis = np.array([[np.cos((2 * x + 1) * u * np.pi / 16) * (0.5 if u else 0.125**0.5) for u in range(8)] for x in range(8)])
        pixels = np.clip(np.einsum("xu,nuv,yv->nxy", basis, coefficients.reshape(-1, 8, 8), basis) + 128, 0, 255)
    out = np.clip((blocks * quant[0] + 4) // 8 + 128, 0, 255)
    if rest:
        out.ravel()[key] = np.round(pixels.mean(axis=(1, 2))).astype(np.int64)
    return out.reshape(len(frames), -1).astype(np.uint8)


def shots(samples: np.ndarray) -> list[tuple[int, int]]:
    """(first, last) frame of each shot of frames (n, blocks)."""
    n = len(samples)
    if n == 1:
        return [(0, 0)]
    bins = np.bincount((np.arange(n)[:, None] * BINS + (samples >> 4)).ravel(), minlength=n * BINS).reshape(n, BINS) / samples.shape[1]
    diff = np.abs(np.diff(bins, axis=0)).sum(axis=1) / 2
    cuts, first = [], 0
    for k in range(n - 1):
        recent = diff[max(first, k - WINDOW) : k]
        most = max(LEAST, recent.mean() + SPREAD * recent.std()) if len(recent) else LEAST
        if diff[k] > most:
            cuts.append(k + 1)
            first = k + 1
    return list(zip([0, *cuts], [*(c - 1 for c in cuts), n - 1], strict=True))


def payload(data: bytes | None) -> bytes:
    """The text's bytes and zeros up to a positive multiple of 64."""
    data = data or b""
    return data + b"\0" * (max(64, -(-len(data) // 64) * 64) - len(data))


def _stored(texts: list[bytes]) -> Iterator[tuple[bytes, bytes, np.ndarray, float]]:
    """(AVI file, payload read back, decoded frames, seconds a frame) of each text, several coded at a time."""
    at = 0
    while at < len(texts):
        some, size = [], 0
        while at < len(texts) and (not some or size + len(texts[at]) <= BATCH_BYTES):
            some.append(payload(texts[at]))
            size += len(texts[at])
            at += 1
        counts = [-(-len(p) // FRAME) for p in some]
        samples = np.frombuffer(b"".join(p + b"\0" * (c * FRAME - len(p)) for p, c in zip(some, counts, strict=True)), np.uint8).reshape(-1, FRAME)
        frames: list[bytes] = []
        for k in range(0, len(samples), 2 * BATCH_BYTES // FRAME):
            frames += encode_frames(samples[k : k + 2 * BATCH_BYTES // FRAME])
        first, files, read = 0, [], []
        for p, c in zip(some, counts, strict=True):
            files.append(write_avi(frames[first : first + c], len(p)))
            read.append(read_avi(files[-1]))
            first += c
        flat = [f for r in read for f in r[0]]
        decoded = np.concatenate([decode_frames(flat[k : k + 2 * BATCH_BYTES // FRAME]) for k in range(0, len(flat), 2 * BATCH_BYTES // FRAME)])
        first = 0
        for file, (own, n, seconds) in zip(files, read, strict=True):
            part = decoded[first : first + len(own)]
            first += len(own)
            yield file, part.tobytes()[:n], part, seconds


def media_digests(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature) per row of docs.

    payload_sha256 and tail_crc32 are of the payload read back from the stored file.  feature names frames and shots.
    A null text counts as empty, whose payload is 64 zeros; equal texts have equal values; repeated rows give repeated
    results, an empty table an empty one; extra columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x or b"" for x in batch.column(1).to_pylist()]
            rows = []
            for text, (file, back, frames, seconds) in zip(texts, _stored(texts), strict=True):
                spans = ",".join(f"{a}-{b}@{a * seconds:.2f}-{(b + 1) * seconds:.2f}" for a, b in shots(frames))
                rows.append((len(text), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(file), hashlib.sha256(file).hexdigest(), f"frames={len(frames)};shots={spans}"))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    small_batches(docs.sparkSession)
    return doc_bytes(docs).mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def as_media(docs: DataFrame) -> DataFrame:
    """(doc_id, media): each text as an AVI file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            media = [file for file, *_ in _stored([x or b"" for x in batch.column(1).to_pylist()])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(media, pa.binary())], names=["doc_id", "media"])

    small_batches(docs.sparkSession)
    return doc_bytes(docs).mapInArrow(run, "doc_id long, media binary")


def clips(media: DataFrame) -> DataFrame:
    """(doc_id, clip, first_frame, last_frame, start_s, end_s): a row for each shot of each AVI file; null media none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if data.is_valid:
                    frames, _, seconds = read_avi(data.as_py())
                    rows += [(doc_id, k, a, b, a * seconds, (b + 1) * seconds) for k, (a, b) in enumerate(shots(decode_frames(frames)))]
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=["doc_id", "clip", "first_frame", "last_frame", "start_s", "end_s"])

    return media.select("doc_id", "media").mapInArrow(run, "doc_id long, clip int, first_frame int, last_frame int, start_s double, end_s double")
