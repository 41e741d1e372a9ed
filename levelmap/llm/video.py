"""Motion-JPEG video in AVI: storing bytes as frames, reading them back, and detecting shots.

Frames are lossless JPEG (the sequential Huffman process with prediction from the left), grey, of
24 by 24 8-bit samples. Reading follows the RIFF index to the frames; all frames of a batch are
decoded together, one symbol of each at a time. A shot ends where the difference of successive
histograms exceeds what the preceding ones let expect.
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

from levelmap.llm.common import slices, text_bytes

SIDE = 24
FRAME = SIDE * SIDE
RATE = 24
PAD = 255
#: Code lengths of the difference categories 0 to 8, for text read as samples.
LENGTHS = {2: 3, 3: 3, 4: 3, 5: 3, 6: 3, 7: 3, 0: 4, 1: 4, 8: 6}
BATCH = 1 << 21
#: Frames coded in one step, whose working arrays take some 70 bytes a sample.
STEP = 1 << 10
BINS = 16
PRECEDING = 8


def _codes(lengths: dict[int, int]) -> dict[int, tuple[int, int]]:
    """Canonical Huffman codes: symbol to (code, length), for symbols in order of their lengths."""
    out, code, last = {}, 0, 0
    for symbol, n in lengths.items():
        code <<= n - last
        out[symbol], code, last = (code, n), code + 1, n
    return out


def _frame_head(width: int, height: int) -> bytes:
    """Markers before the coded samples: size (SOF3), Huffman table (DHT), scan with predictor 1 (SOS)."""
    counts = bytes(sum(n == k for n in LENGTHS.values()) for k in range(1, 17))
    table = b"\x00" + counts + bytes(LENGTHS)
    return (
        b"\xff\xd8"
        + b"\xff\xc3" + struct.pack(">HBHHB3B", 11, 8, height, width, 1, 1, 0x11, 0)
        + b"\xff\xc4" + struct.pack(">H", 2 + len(table)) + table
        + b"\xff\xda" + struct.pack(">HB2B3B", 8, 1, 1, 0, 1, 0, 0)
    )


@lru_cache
def _coding() -> tuple[np.ndarray, np.ndarray]:
    """Bits of each difference from -255 to 255, code and remainder together, and their number."""
    bits, size, codes = np.zeros(511, np.uint32), np.zeros(511, np.int64), _codes(LENGTHS)
    for d in range(-255, 256):
        s = abs(d).bit_length()
        code, n = codes[s]
        rest = d if d > 0 else d + (1 << s) - 1
        bits[d + 255], size[d + 255] = code << s | rest, n + s
    return bits, size


def encode_frames(samples: np.ndarray) -> list[bytes]:
    """JPEG files of frames (count, SIDE, SIDE) of uint8."""
    bits, size = _coding()
    n, wide = len(samples), samples.astype(np.int16)
    diff = wide.copy()
    diff[:, :, 1:] -= wide[:, :, :-1]
    diff[:, 1:, 0] -= wide[:, :-1, 0]
    diff[:, 0, 0] -= 128
    at = diff.reshape(n, FRAME) + 255
    length = size[at]
    ends = np.cumsum(length, axis=1)
    total = (ends[:, -1] + 7) // 8
    base = np.cumsum(total) - total
    where = (base[:, None] * 8 + ends - length).ravel()
    window = bits[at].ravel() << (24 - length.ravel() - (where & 7)).astype(np.uint32)
    byte, room = where >> 3, int(total.sum()) + 2
    data = sum(np.bincount(byte + k, (window >> np.uint32(16 - 8 * k)) & np.uint32(255), room) for k in range(3))
    data = data.astype(np.uint8)[: room - 2]
    data[base + total - 1] |= ((1 << (total * 8 - ends[:, -1])) - 1).astype(np.uint8)
    head, raw = _frame_head(SIDE, SIDE), data.tobytes()
    return [head + raw[a : a + k].replace(b"\xff", b"\xff\x00") + b"\xff\xd9" for a, k in zip(base.tolist(), total.tolist(), strict=True)]


def _chunk(name: bytes, data: bytes) -> bytes:
    return name + struct.pack("<I", len(data)) + data + b"\0" * (len(data) & 1)


def avi(frames: list[bytes], width: int = SIDE, height: int = SIDE, rate: int = RATE) -> bytes:
    """An AVI file of JPEG frames with its index."""
    most = max(map(len, frames))
    main = struct.pack("<14I", 1_000_000 // rate, most * rate, 0, 0x10, len(frames), 0, 1, most, width, height, 0, 0, 0, 0)
    stream = struct.pack("<4s4sIHHIIIIIIII4H", b"vids", b"MJPG", 0, 0, 0, 0, 1, rate, 0, len(frames), most, 0xFFFFFFFF, 0, 0, 0, width, height)
    form = struct.pack("<IiiHH4sIiiII", 40, width, height, 1, 8, b"MJPG", width * height, 0, 0, 0, 0)
    head = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", main) + _chunk(b"LIST", b"strl" + _chunk(b"strh", stream) + _chunk(b"strf", form)))
    chunks = [_chunk(b"00dc", f) for f in frames]
    index, at = np.zeros(len(frames), [("id", "S4"), ("flags", "<u4"), ("at", "<u4"), ("size", "<u4")]), 4
    index["id"], index["flags"] = b"00dc", 0x10
    index["size"] = [len(f) for f in frames]
    index["at"] = at + np.cumsum([0, *map(len, chunks)])[:-1]
    body = b"AVI " + head + _chunk(b"LIST", b"movi" + b"".join(chunks)) + _chunk(b"idx1", index.tobytes())
    return b"RIFF" + struct.pack("<I", len(body)) + body


def frames_of(media: bytes) -> tuple[list[bytes], float]:
    """The frames that the index of an AVI file names, and its rate a second."""
    if media[:4] != b"RIFF" or media[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    movie = index = None
    rate, at = float(RATE), 12
    while at + 8 <= len(media):
        name, size = media[at : at + 4], int.from_bytes(media[at + 4 : at + 8], "little")
        if name == b"LIST" and media[at + 8 : at + 12] == b"hdrl":
            scale, per_scale = struct.unpack_from("<II", media, media.index(b"strh", at, at + 8 + size) + 28)
            rate = per_scale / max(1, scale)
        elif name == b"LIST" and media[at + 8 : at + 12] == b"movi":
            movie = at + 8
        elif name == b"idx1":
            index = np.frombuffer(media, [("id", "S4"), ("flags", "<u4"), ("at", "<u4"), ("size", "<u4")], size // 16, at + 8)
        at += 8 + size + (size & 1)
    if movie is None or index is None:
        raise ValueError("an AVI file without frames or index")
    own = index[(index["id"] == b"00dc") | (index["id"] == b"00db")]
    starts = (own["at"].astype(np.int64) + movie + 8).tolist()
    return [media[a : a + n] for a, n in zip(starts, own["size"].tolist(), strict=True)], rate


@lru_cache(8)
def _decoding(head: bytes) -> tuple[int, int, int, np.ndarray, np.ndarray]:
    """Length of the markers at the front of a frame, its height and width, and by the next 16 bits the
    length of the code there (0: none) and its category."""
    length, category = np.zeros(1 << 16, np.uint32), np.zeros(1 << 16, np.uint32)
    at, height, width = 2, 0, 0
    while True:
        mark, size = head[at + 1], int.from_bytes(head[at + 2 : at + 4], "big")
        body = head[at + 4 : at + 2 + size]
        if mark == 0xC3:
            depth, height, width, parts = struct.unpack(">BHHB", body[:6])
            if depth != 8 or parts != 1:
                raise ValueError("frames of one 8-bit component are read")
        elif mark in (0xC0, 0xC1, 0xC2):
            raise ValueError("lossless frames are read")
        elif mark == 0xC4:
            symbols = iter(body[17:])
            lengths = {next(symbols): k for k, n in enumerate(body[1:17], 1) for _ in range(n)}
            for symbol, (code, n) in _codes(lengths).items():
                span = slice(code << (16 - n), (code + 1) << (16 - n))
                length[span], category[span] = n, symbol
        elif mark == 0xDA:
            if body[3] != 1:
                raise ValueError("frames predicted from the left are read")
            return at + 2 + size, height, width, length, category
        at += 2 + size


def _head_of(frame: bytes) -> bytes:
    at = 2
    while frame[at + 1] != 0xDA:
        at += 2 + int.from_bytes(frame[at + 2 : at + 4], "big")
    return frame[: at + 2 + int.from_bytes(frame[at + 2 : at + 4], "big")]


def decode_frames(frames: list[bytes]) -> np.ndarray:
    """Samples (count, height, width) of frames that have one size and table, as those of one writer do."""
    head = _head_of(frames[0])
    skip, height, width, length, category = _decoding(head)
    coded = []
    for frame in frames:
        if not frame.startswith(head):
            raise ValueError("frames differ in size or table")
        coded.append(frame[skip:-2].replace(b"\xff\x00", b"\xff"))
    sizes = np.fromiter(map(len, coded), np.int64, len(coded))
    raw = np.frombuffer(b"".join(coded) + b"\0" * 8, np.uint8).astype(np.uint64)
    # The five bytes from each place on hold any code and its remainder.
    window = raw[:-4] << np.uint64(32) | raw[1:-3] << np.uint64(24) | raw[2:-2] << np.uint64(16) | raw[3:-1] << np.uint64(8) | raw[4:]
    at = ((np.cumsum(sizes) - sizes) * 8).astype(np.uint64)
    diff = np.empty((height * width, len(frames)), np.int32)
    seven, mask = np.uint64(7), np.uint64(0xFFFF)
    for k in range(height * width):
        bits = window[at >> np.uint64(3)] >> (np.uint64(8) - (at & seven))  # 32 bits from here
        code = (bits >> np.uint64(16)) & mask
        n, s = length[code].astype(np.uint64), category[code].astype(np.uint64)
        rest = ((bits >> (np.uint64(32) - n - s)) & ((np.uint64(1) << s) - np.uint64(1))).astype(np.int32)
        low = s.astype(np.int32)
        half = np.int32(1) << low >> 1
        diff[k] = np.where(rest < half, rest - (np.int32(1) << low) + 1, rest)
        at += n + s
    if (at.astype(np.int64) > np.cumsum(sizes) * 8).any():
        raise ValueError("a frame ends before its last sample")
    table = diff.T.reshape(-1, height, width)
    table[:, 0, 0] += 128
    table[:, :, 0] = np.cumsum(table[:, :, 0], axis=1)
    return (np.cumsum(table, axis=2) & 255).astype(np.uint8)


def cuts(samples: np.ndarray, of: np.ndarray) -> np.ndarray:
    """True for frames that begin a shot; `of` numbers the video of each frame, in order.

    The first frame begins one, and so does a frame whose histogram differs from the previous one's by
    more than the mean and three deviations of the up to eight differences before it, the largest left
    out (a cut itself, maybe), and by a tenth of the samples at least. Sums are of whole numbers, so
    equal videos give equal cuts anywhere.
    """
    n = len(samples)
    flat = samples.reshape(n, -1)
    bins = np.bincount((np.arange(n)[:, None] * BINS + (flat >> 4)).ravel(), minlength=n * BINS).reshape(n, BINS)
    first = np.r_[True, of[1:] != of[:-1]]
    change = np.r_[0, np.abs(np.diff(bins, axis=0)).sum(1)]
    change[first] = 0
    start = np.maximum.accumulate(np.where(first, np.arange(n), 0)) + 1
    lo = np.maximum(start, np.arange(n) - PRECEDING)
    count = np.maximum(np.arange(n) - lo, 0)
    run, squares = np.r_[0, np.cumsum(change)], np.r_[0, np.cumsum(change * change)]
    before = np.where(count > 0, lo, np.arange(n))
    total, square = run[np.arange(n)] - run[before], squares[np.arange(n)] - squares[before]
    most = np.zeros(n, np.int64)
    for back in range(1, PRECEDING + 1):
        earlier = np.arange(n) - back
        most = np.maximum(most, np.where(earlier >= lo, change[np.maximum(earlier, 0)], 0))
    total, square, size = total - most, square - most * most, np.maximum(count - 1, 1)
    deviation = np.sqrt(np.maximum(square * size - total * total, 0)) / size
    return first | ((change > total / size + 3 * deviation) & (change >= flat.shape[1] // 5))


def store(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media) for every row of `docs` (doc_id, text): the text's UTF-8 bytes as an AVI file.

    Bytes are filled with 255 to whole frames, one at least; a null text counts as empty. Equal
    texts give equal files. An empty table gives an empty result.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.array([len(t.as_buffer()) for t in batch.column(1)], np.int64)
            for lo, hi in slices(sizes, BATCH):
                texts = [t.as_py() for t in batch.column(1).slice(lo, hi - lo)]
                counts = [max(1, -(-len(t) // FRAME)) for t in texts]
                payload = b"".join(t.ljust(k * FRAME, bytes([PAD])) for t, k in zip(texts, counts, strict=True))
                samples = np.frombuffer(payload, np.uint8).reshape(-1, SIDE, SIDE)
                frames = [f for at in range(0, len(samples), STEP) for f in encode_frames(samples[at : at + STEP])]
                files, at = [], 0
                for k in counts:
                    files.append(avi(frames[at : at + k]))
                    at += k
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(sizes[lo:hi]), pa.array(files, pa.binary())], ["doc_id", "n_bytes", "media"]
                )

    return docs.select("doc_id", text_bytes()).mapInArrow(each, "doc_id long, n_bytes long, media binary")


def _read(batch: pa.RecordBatch, column: int):
    """Of runs of rows: the first row, media, samples, frames of each row, rates, and where shots begin."""
    sizes = np.array([len(m.as_buffer()) for m in batch.column(column)], np.int64)
    for lo, hi in slices(sizes, BATCH):
        media = [m.as_py() for m in batch.column(column).slice(lo, hi - lo)]
        parsed = [frames_of(m) for m in media]
        frames = [f for own, _ in parsed for f in own]
        samples = np.concatenate([decode_frames(frames[at : at + STEP]) for at in range(0, len(frames), STEP)])
        counts = np.array([len(own) for own, _ in parsed])
        yield lo, media, samples, counts, [r for _, r in parsed], cuts(samples, np.repeat(np.arange(len(counts)), counts))


def clips(media: DataFrame) -> DataFrame:
    """One row per shot of each video (doc_id, media): clip, first_frame, frames, start_s, end_s, luma."""
    names = ["doc_id", "clip", "first_frame", "frames", "start_s", "end_s", "luma"]
    kinds = [pa.int64(), *(pa.int32(),) * 3, *(pa.float64(),) * 3]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, _, samples, counts, rates, begins in _read(batch, 1):
                rows, at = [], 0
                for own, (n, rate) in enumerate(zip(counts.tolist(), rates, strict=True)):
                    starts = [*np.flatnonzero(begins[at : at + n]).tolist(), n]
                    for clip, (a, b) in enumerate(zip(starts, starts[1:], strict=False)):
                        rows.append((batch.column(0)[lo + own].as_py(), clip, a, b - a, a / rate, b / rate, float(samples[at + a : at + b].mean())))
                    at += n
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return media.select("doc_id", "media").mapInArrow(each, "doc_id long, clip int, first_frame int, frames int, start_s double, end_s double, luma double")


def digests(media: DataFrame) -> DataFrame:
    """What reading each video (doc_id, n_bytes, media) back gives: payload and file digests and a feature.

    The feature names the number of frames and of shots, the frames at which shots begin, and the mean luma.
    """
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    kinds = [pa.int64()] * 3 + [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, files, samples, counts, _, begins in _read(batch, 2):
                payload, size, rows, at = samples.tobytes(), samples[0].size, [], 0
                for own, n in enumerate(counts.tolist()):
                    data = payload[at * size : (at + n) * size]
                    starts = np.flatnonzero(begins[at : at + n]).tolist()
                    luma = int(samples[at : at + n].sum()) // len(data)
                    feature = f"frames={n};shots={len(starts)};starts={','.join(map(str, starts))};luma={luma}"
                    rows.append((
                        batch.column(0)[lo + own].as_py(), batch.column(1)[lo + own].as_py(), len(data), hashlib.sha256(data).hexdigest(),
                        zlib.crc32(data[-32:]), len(files[own]), hashlib.sha256(files[own]).hexdigest(), feature,
                    ))
                    at += n
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    sql = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return media.select("doc_id", "n_bytes", "media").mapInArrow(each, sql)
