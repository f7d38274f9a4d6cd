"""Media columns: AVI files of motion JPEG, their frames and their shots.

Reading: the RIFF index gives each frame's place, every frame is an intra-coded
baseline JPEG and is decoded on its own, and shots are cut where the difference
of successive luma histograms stands out from those before it.

Writing: a payload of bytes is stored without loss as quantised DCT
coefficients, 64 to a block.  The quantiser is 1, and the Huffman tables know one
symbol, "no zeros, then eight bits", so a byte becomes the eight magnitude bits
of a coefficient of -255 to -128 or 128 to 255.  A restart after every block
keeps DC coefficients absolute.  A block is then 576 bits, and encoding and
decoding are array operations; files whose tables differ go through the general
Huffman decoder.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helixlake.llm.common import sliced, table

#: Bytes in a block, and the most blocks in a frame that is written.
UNIT = 64
BLOCKS = 16
RATE = 25
#: Histogram bins, and the rule for a cut: at least ``LEAST``, and ``SIGMAS`` deviations over the mean of the last ``RECENT`` differences.
BINS, LEAST, SIGMAS, RECENT = 16, 0.08, 2.0, 8


def _zigzag() -> np.ndarray:
    """Row-major place of each coefficient in zigzag order."""
    cells = sorted(((i, j) for i in range(8) for j in range(8)), key=lambda c: (c[0] + c[1], c[0] if (c[0] + c[1]) % 2 else c[1]))
    return np.array([8 * i + j for i, j in cells])


def _inverse_dct() -> np.ndarray:
    """Matrix from 64 row-major coefficients to 64 row-major samples."""
    x, u = np.arange(8)[:, None], np.arange(8)[None, :]
    c = np.cos((2 * x + 1) * u * np.pi / 16) * np.where(u == 0, np.sqrt(1 / 8), np.sqrt(2 / 8))
    return np.kron(c, c).T.astype(np.float32)  # coefficients (1 x 64) @ matrix


# ---------------------------------------------------------------- writing


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def jpeg_header(blocks: int) -> bytes:
    """Everything before the entropy-coded data of a frame one block high."""
    one = bytes([1] + [0] * 15)  # one code, of one bit
    return (
        b"\xff\xd8"
        + _segment(0xE0, b"AVI1" + bytes(10))
        + _segment(0xDB, b"\x00" + b"\x01" * 64)
        + _segment(0xC0, struct.pack(">BHHB", 8, 8, 8 * blocks, 1) + b"\x01\x11\x00")
        + _segment(0xC4, b"\x00" + one + b"\x08" + b"\x10" + one + b"\x08")
        + _segment(0xDD, struct.pack(">H", 1))
        + _segment(0xDA, b"\x01\x01\x00\x00\x3f\x00")
    )


def pack_blocks(payload: np.ndarray) -> np.ndarray:
    """(n, 64) bytes to (n, 72): a zero bit, the one Huffman code, before each byte's eight bits."""
    units = payload.reshape(-1, 8, 8)
    out = np.zeros((len(units), 8, 9), np.uint8)
    for u in range(8):
        out[:, :, u] |= units[:, :, u] >> (u + 1) if u < 7 else 0
        out[:, :, u + 1] |= units[:, :, u] << (7 - u)
    return out.reshape(-1, 72)


def unpack_blocks(packed: np.ndarray) -> np.ndarray:
    """``pack_blocks`` undone."""
    rows = packed.reshape(-1, 8, 9)
    out = np.empty((len(rows), 8, 8), np.uint8)
    for u in range(8):
        high = rows[:, :, u] << (u + 1) if u < 7 else np.uint8(0)
        out[:, :, u] = high | (rows[:, :, u + 1] >> (7 - u))
    return out.reshape(-1, 64)


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)


def write_avi(data: bytes, blocks: int = BLOCKS, rate: int = RATE) -> bytes:
    """``data`` as an AVI of motion JPEG; its length must be a positive multiple of 64.

    Frames hold equally many blocks, at most ``blocks``; the last is filled up
    with zeros, and the chunk ``plen`` tells the payload's length.
    """
    n = len(data) // UNIT
    if n * UNIT != len(data) or not n:
        raise ValueError("the payload must fill one block or more")
    frames = -(-n // blocks)
    per = -(-n // frames)
    padded = np.zeros(frames * per * UNIT, np.uint8)
    padded[: len(data)] = np.frombuffer(data, np.uint8)
    packed = pack_blocks(padded)
    head, stuffed = jpeg_header(per), bool((packed == 0xFF).any())
    marks = np.empty((frames * per, 2), np.uint8)
    marks[:, 0] = 0xFF
    marks[:, 1] = 0xD0 + np.arange(frames * per) % per % 8
    body = None if stuffed else np.concatenate([packed, marks], axis=1).tobytes()
    movi, index, at = [b"movi"], [], 4
    for f in range(frames):
        if stuffed:
            part = b"".join(packed[i].tobytes().replace(b"\xff", b"\xff\0") + marks[i].tobytes() for i in range(f * per, (f + 1) * per))[:-2]
        else:
            part = body[f * per * 74 : (f + 1) * per * 74 - 2]
        frame = head + part + b"\xff\xd9"
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(frame)))
        movi.append(_chunk(b"00dc", frame))
        at += len(movi[-1])
    width, height, largest = 8 * per, 8, len(head) + per * 146
    avih = struct.pack("<14I", 1_000_000 // rate, largest * rate, 0, 0x10, frames, 0, 1, largest, width, height, 0, 0, 0, 0)
    strh = struct.pack("<4s4sIHHIIIIIIII4H", b"vids", b"MJPG", 0, 0, 0, 0, 1, rate, 0, frames, largest, 0xFFFFFFFF, 0, 0, 0, width, height)
    strf = struct.pack("<IiiHH4sIiiII", 40, width, height, 1, 8, b"MJPG", width * height, 0, 0, 0, 0)
    hdrl = b"hdrl" + _chunk(b"avih", avih) + _chunk(b"LIST", b"strl" + _chunk(b"strh", strh) + _chunk(b"strf", strf))
    riff = b"AVI " + _chunk(b"LIST", hdrl) + _chunk(b"plen", struct.pack("<Q", len(data))) + _chunk(b"LIST", b"".join(movi)) + _chunk(b"idx1", b"".join(index))
    return _chunk(b"RIFF", riff)


# ---------------------------------------------------------------- reading


@dataclass
class Avi:
    """What the headers and the index of a file say."""

    width: int = 0
    height: int = 0
    rate: float = 0.0
    payload: int | None = None
    frames: list[tuple[int, int]] = field(default_factory=list)


def parse_avi(data: bytes) -> Avi:
    """Headers and frame places; from the index, or, without one, from the movi list."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    avi, index, walked, movi = Avi(), [], [], 0

    def visit(at: int, end: int) -> None:
        nonlocal movi
        while at + 8 <= end:
            name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
            body = at + 8
            if name == b"LIST":
                kind = data[body : body + 4]
                if kind == b"movi":
                    movi = body
                visit(body + 4, min(end, body + size))
            elif name == b"avih":
                micro, avi.width, avi.height = struct.unpack_from("<I", data, body)[0], *struct.unpack_from("<II", data, body + 32)
                avi.rate = 1e6 / micro if micro else 0.0
            elif name == b"strh" and data[body : body + 4] == b"vids":
                scale, rate = struct.unpack_from("<II", data, body + 20)
                avi.rate = rate / scale if scale else avi.rate
            elif name == b"plen":
                avi.payload = struct.unpack_from("<Q", data, body)[0]
            elif name == b"idx1":
                index.extend(struct.iter_unpack("<4sIII", data[body : body + size // 16 * 16]))
            elif name[2:] in (b"dc", b"db"):
                walked.append((body, size))
            at = body + size + (size & 1)

    visit(12, min(len(data), 8 + struct.unpack_from("<I", data, 4)[0]))
    found = [(at, size) for name, _, at, size in index if name[2:] in (b"dc", b"db")]
    if found:
        # offsets count from the movi list's name, or, in some files, from the file's start
        base = movi if data[movi + found[0][0] : movi + found[0][0] + 4] == index[0][0] else 0
        avi.frames = [(base + at + 8, size) for at, size in found]
    else:
        avi.frames = walked
    return avi


def _huffman(counts: bytes, symbols: bytes) -> dict[tuple[int, int], int]:
    """(length, code) to symbol."""
    out, code, k = {}, 0, 0
    for length in range(1, 17):
        for _ in range(counts[length - 1]):
            out[length, code] = symbols[k]
            code += 1
            k += 1
        code <<= 1
    return out


class _Bits:
    def __init__(self, data: bytes) -> None:
        self.value = int.from_bytes(data, "big")
        self.left = 8 * len(data)

    def take(self, n: int) -> int:
        if n > self.left:
            raise ValueError("the frame ends early")
        self.left -= n
        return self.value >> self.left & ((1 << n) - 1)

    def symbol(self, codes: dict[tuple[int, int], int]) -> int:
        code = 0
        for length in range(1, 17):
            code = code << 1 | self.take(1)
            if (length, code) in codes:
                return codes[length, code]
        raise ValueError("no such Huffman code")


def decode_jpeg(data: bytes) -> tuple[list[np.ndarray], list[tuple[int, int]], int, int, list[np.ndarray]]:
    """Quantised coefficients of a baseline JPEG by the general decoder.

    Returns, for each component, (rows of blocks, columns, 64) in zigzag order,
    and its sampling factors; the width and height; and each one's quantiser.
    """
    at, quant, codes, comps, restart = 2, {}, {}, [], 0
    width = height = 0
    while data[at] == 0xFF and data[at + 1] != 0xDA:
        marker, size = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
        body = data[at + 4 : at + 2 + size]
        if marker == 0xDB:
            while body:
                wide = body[0] >> 4
                quant[body[0] & 15] = np.frombuffer(body[1 : 1 + 64 * (1 + wide)], ">u2" if wide else np.uint8).astype(np.float32)
                body = body[1 + 64 * (1 + wide) :]
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                codes[body[0]] = _huffman(body[1:17], body[17 : 17 + n])
                body = body[17 + n :]
        elif marker in (0xC0, 0xC1):
            _, height, width, n = struct.unpack_from(">BHHB", body)
            comps = [[body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i], 0, 0] for i in range(n)]
        elif 0xC2 <= marker <= 0xCF and marker != 0xC8 and marker != 0xCC:
            raise ValueError("only baseline JPEG frames are decoded")
        elif marker == 0xDD:
            restart = struct.unpack(">H", body)[0]
        at += 2 + size
    size = struct.unpack_from(">H", data, at + 2)[0]
    for i in range(data[at + 4]):
        name, tables = data[at + 5 + 2 * i : at + 7 + 2 * i]
        for c in comps:
            if c[0] == name:
                c[4], c[5] = tables >> 4, tables & 15
    scan, parts, begun, k = data[at + 2 + size :], [], 0, 0
    while k < len(scan) - 1:
        if scan[k] == 0xFF and scan[k + 1]:
            if not 0xD0 <= scan[k + 1] <= 0xD7:
                break
            parts.append(scan[begun:k])
            begun = k + 2
            k += 1
        k += 1
    parts.append(scan[begun:k])
    if len(comps) == 1:
        comps[0][1] = comps[0][2] = 1
    hmax, vmax = max(c[1] for c in comps), max(c[2] for c in comps)
    across, down = -(-width // (8 * hmax)), -(-height // (8 * vmax))
    planes = [np.zeros((down * c[2], across * c[1], 64), np.int32) for c in comps]
    total = across * down
    step = restart or total
    for first, part in zip(range(0, total, step), parts, strict=False):
        bits, dc = _Bits(part.replace(b"\xff\0", b"\xff")), [0] * len(comps)
        for m in range(first, min(total, first + step)):
            for i, (_, h, v, _, td, ta) in enumerate(comps):
                for y in range(v):
                    for x in range(h):
                        block = planes[i][m // across * v + y, m % across * h + x]
                        s = bits.symbol(codes[td])
                        dc[i] += _extend(bits.take(s), s)
                        block[0] = dc[i]
                        k = 1
                        while k < 64:
                            rs = bits.symbol(codes[16 + ta])
                            s = rs & 15
                            if not s:
                                if rs != 0xF0:
                                    break
                                k += 16
                                continue
                            k += rs >> 4
                            block[k] = _extend(bits.take(s), s)
                            k += 1
    return planes, [(c[1], c[2]) for c in comps], width, height, [quant[c[3]] for c in comps]


def _extend(value: int, size: int) -> int:
    return value if not size or value >> (size - 1) else value - (1 << size) + 1


def frame_bytes(data: bytes) -> np.ndarray:
    """(blocks, 64) payload bytes of a frame that ``write_avi`` wrote."""
    head = data.find(b"\xff\xda") + 10
    blocks = struct.unpack_from(">H", data, data.find(b"\xff\xc0") + 7)[0] // 8
    if data[:head] == jpeg_header(blocks):
        body = data[head:-2]
        if len(body) == 74 * blocks - 2:
            rows = np.frombuffer(body + b"\0\0", np.uint8).reshape(blocks, 74)[:, :72]
            return unpack_blocks(rows)
    planes, *_ = decode_jpeg(data)
    coefficients = planes[0].reshape(-1, 64)
    return np.where(coefficients >= 0, coefficients, coefficients + 255).astype(np.uint8)


def luma_of_payload(blocks: np.ndarray) -> np.ndarray:
    """Samples (n, 64) of blocks of payload bytes: dequantised, transformed, shifted and clamped."""
    value = blocks.astype(np.float32)
    value[blocks < 128] -= 255
    coefficients = np.empty_like(value)
    coefficients[:, _zigzag()] = value
    return np.clip(np.rint(coefficients @ _inverse_dct() + 128), 0, 255).astype(np.uint8)


def luma(data: bytes) -> np.ndarray:
    """Luma plane (height x width) of any baseline frame."""
    planes, factors, width, height, quant = decode_jpeg(data)
    rows, columns, _ = planes[0].shape
    coefficients = np.empty((rows * columns, 64), np.float32)
    coefficients[:, _zigzag()] = planes[0].reshape(-1, 64) * quant[0]
    samples = np.clip(np.rint(coefficients @ _inverse_dct() + 128), 0, 255).astype(np.uint8)
    plane = samples.reshape(rows, columns, 8, 8).transpose(0, 2, 1, 3).reshape(8 * rows, 8 * columns)
    hmax, vmax = max(f[0] for f in factors), max(f[1] for f in factors)
    return plane[: -(-height * factors[0][1] // vmax), : -(-width * factors[0][0] // hmax)]


def histograms(frames: list[np.ndarray]) -> np.ndarray:
    """Share of samples in each of ``BINS`` luma bins, one row for each frame."""
    out = np.zeros((len(frames), BINS))
    for i, f in enumerate(frames):
        out[i] = np.bincount(f.ravel() * np.int64(BINS) // 256, minlength=BINS) / max(1, f.size)
    return out


def shots(histogram: np.ndarray) -> list[int]:
    """First frames of the shots.

    A frame begins a shot if its histogram differs from the one before (half the
    sum of absolute differences) by at least ``LEAST`` and by more than the mean
    plus ``SIGMAS`` deviations of the last ``RECENT`` differences of its shot.
    """
    begins = [0] if len(histogram) else []
    difference = 0.5 * np.abs(np.diff(histogram, axis=0)).sum(axis=1)
    recent: list[float] = []
    for i, d in enumerate(difference, 1):
        if d >= LEAST and (len(recent) < 2 or d > np.mean(recent) + SIGMAS * np.std(recent)):
            begins.append(i)
            recent = []
        else:
            recent = [*recent[1 - RECENT :], float(d)]
    return begins


def clips_of(histogram: np.ndarray, rate: float) -> list[dict]:
    """Timed clips: first frame, number of frames, start and end in seconds."""
    begins = shots(histogram)
    ends = [*begins[1:], len(histogram)]
    rate = rate or 1.0
    return [{"first_frame": a, "frames": b - a, "start_s": a / rate, "end_s": b / rate} for a, b in zip(begins, ends, strict=True)]


# ---------------------------------------------------------------- columns

CLIP = T.StructType([T.StructField("first_frame", T.LongType()), T.StructField("frames", T.LongType()), T.StructField("start_s", T.DoubleType()), T.StructField("end_s", T.DoubleType())])
_CLIP_ARROW = pa.list_(pa.struct([("first_frame", pa.int64()), ("frames", pa.int64()), ("start_s", pa.float64()), ("end_s", pa.float64())]))


def store_texts(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(``doc_id``, n_bytes, media): each text's UTF-8 bytes, zero-filled to whole blocks, as an AVI file.

    A null text counts as empty; an empty one is a block of zeros.
    """
    rows = docs.select(doc_id, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            sizes, media, total, first = [], [], 0, 0
            for i, value in enumerate(batch.column(1).cast(pa.large_binary())):
                data = value.as_py() or b""
                sizes.append(len(data))
                media.append(write_avi(data + bytes(-len(data) % UNIT or (0 if data else UNIT))))
                total += len(media[-1])
                if total > 1 << 24 or i == batch.num_rows - 1:
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, i + 1 - first), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], names=[doc_id, "n_bytes", "media"])
                    sizes, media, total, first = [], [], 0, i + 1

    return rows.mapInArrow(run, T.StructType([rows.schema[doc_id], T.StructField("n_bytes", T.LongType()), T.StructField("media", T.BinaryType())]))


def read_payloads(media: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """Stored files read back: (``doc_id``, n_bytes, media_bytes, media_sha256, payload, clips)."""
    rows = media.select(doc_id, "n_bytes", "media")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            sizes, digests, payloads, clips = [], [], [], []
            for value in batch.column(2):
                data = value.as_py()
                avi = parse_avi(data)
                parts = [frame_bytes(data[at : at + size]) for at, size in avi.frames]
                blocks = np.concatenate(parts)
                payloads.append(blocks.tobytes()[: avi.payload])
                frame = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
                bins = luma_of_payload(blocks).astype(np.int64) * BINS // 256 + BINS * frame[:, None]
                counts = np.bincount(bins.ravel(), minlength=BINS * len(parts)).reshape(-1, BINS)
                clips.append(clips_of(counts / counts.sum(axis=1, keepdims=True), avi.rate))
                sizes.append(len(data))
                digests.append(hashlib.sha256(data).hexdigest())
            columns = [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(digests, pa.string()), pa.array(payloads, pa.binary()), pa.array(clips, _CLIP_ARROW)]
            yield pa.RecordBatch.from_arrays(columns, names=[doc_id, "n_bytes", "media_bytes", "media_sha256", "payload", "clips"])

    fields = [T.StructField("n_bytes", T.LongType()), T.StructField("media_bytes", T.LongType()), T.StructField("media_sha256", T.StringType()), T.StructField("payload", T.BinaryType()), T.StructField("clips", T.ArrayType(CLIP))]
    return rows.mapInArrow(run, T.StructType([rows.schema[doc_id], *fields]))


def clip_rows(media: DataFrame, column: str = "media", media_id: str = "media_id") -> DataFrame:
    """Timed clips of any motion-JPEG AVI column: (``media_id``, clip, first_frame, frames, start_s, end_s).

    A null or empty value, one that isn't such a file, and one without frames give no rows.
    """
    rows = media.select(media_id, column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            out = []
            for value in batch.column(1):
                data, found = value.as_py(), []
                if data:
                    try:
                        avi = parse_avi(data)
                        found = clips_of(histograms([luma(data[at : at + size]) for at, size in avi.frames]), avi.rate)
                    except (ValueError, IndexError, KeyError, struct.error):
                        found = []
                out.append(found)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, _CLIP_ARROW)], names=[media_id, "clips"])

    got = rows.mapInArrow(run, T.StructType([rows.schema[media_id], T.StructField("clips", T.ArrayType(CLIP))]))
    return got.select(media_id, F.posexplode("clips").alias("clip", "c")).select(media_id, "clip", "c.first_frame", "c.frames", "c.start_s", "c.end_s")


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole document stored as a motion-JPEG AVI and read back: digests, and its shots as a string."""
    back = read_payloads(store_texts(table(spark, sf_dir, "documents")))
    shown = F.transform("clips", lambda c: F.concat_ws("+", c["first_frame"].cast("string"), c["frames"].cast("string")))
    return back.select(
        "doc_id",
        "n_bytes",
        F.length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -UNIT, UNIT)).alias("tail_crc32"),
        "media_bytes",
        "media_sha256",
        F.concat(F.lit("shots="), F.array_join(shown, ",")).alias("feature"),
    )
