import hashlib
import random
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from helixlake.llm import media as m


@settings(max_examples=60, deadline=None)
@given(st.binary(min_size=1, max_size=3000), st.integers(1, 20))
def test_payload_survives(data, blocks):
    data += bytes(-len(data) % 64)
    avi = m.write_avi(data, blocks)
    info = m.parse_avi(avi)
    back = b"".join(m.frame_bytes(avi[a : a + n]).tobytes() for a, n in info.frames)
    assert back[: info.payload] == data
    assert len(avi) == 8 + struct.unpack_from("<I", avi, 4)[0]


def test_general_decoder_agrees_with_the_array_decoder():
    data = random.Random(3).randbytes(64 * 20) + b"\xff" * 64
    avi = m.write_avi(data, 7)
    for at, size in m.parse_avi(avi).frames:
        frame = avi[at : at + size]
        planes, _, width, height, quant = m.decode_jpeg(frame)
        c = planes[0].reshape(-1, 64)
        got = np.where(c >= 0, c, c + 255).astype(np.uint8)
        assert (got == m.frame_bytes(frame)).all() and (width, height) == (56, 8) and (quant[0] == 1).all()
        samples = m.luma_of_payload(got).reshape(1, 7, 8, 8).transpose(0, 2, 1, 3).reshape(8, 56)
        assert (m.luma(frame) == samples).all()


def test_inverse_transform_against_the_formula():
    rng = np.random.default_rng(1)
    z = rng.integers(-200, 200, 64)
    square = np.zeros(64)
    square[m._zigzag()] = z
    square = square.reshape(8, 8)
    want = np.zeros((8, 8))
    for x in range(8):
        for y in range(8):
            for u in range(8):
                for v in range(8):
                    cu, cv = (2**-0.5 if u == 0 else 1), (2**-0.5 if v == 0 else 1)
                    want[x, y] += cu * cv / 4 * square[u, v] * np.cos((2 * x + 1) * u * np.pi / 16) * np.cos((2 * y + 1) * v * np.pi / 16)
    got = (square.reshape(1, 64).astype(np.float32) @ m._inverse_dct()).reshape(8, 8)
    assert np.allclose(got, want, atol=1e-2)
    assert list(m._zigzag()[:10]) == [0, 1, 8, 16, 9, 2, 3, 10, 17, 24]


def flat_frame(dc):
    """A gray frame of one DC coefficient, coded with ordinary tables and an end of block."""
    size = abs(dc).bit_length()
    bits = "0" + (format(dc if dc > 0 else dc + (1 << size) - 1, f"0{size}b") if size else "") + "0"
    body = int(bits.ljust(-(-len(bits) // 8) * 8, "1"), 2).to_bytes(-(-len(bits) // 8), "big").replace(b"\xff", b"\xff\0")
    one = bytes([1] + [0] * 15)
    return (
        b"\xff\xd8" + m._segment(0xDB, b"\0" + b"\x08" * 64) + m._segment(0xC0, struct.pack(">BHHB", 8, 8, 8, 1) + b"\x01\x11\0")
        + m._segment(0xC4, b"\0" + one + bytes([size])) + m._segment(0xC4, b"\x10" + one + b"\0") + m._segment(0xDA, b"\x01\x01\0\0\x3f\0") + body + b"\xff\xd9"
    )


def plain_avi(frames):
    movi, index, at = b"movi", b"", 4
    for f in frames:
        index += struct.pack("<4sIII", b"00dc", 16, at, len(f))
        movi += m._chunk(b"00dc", f)
        at = len(movi)
    return m._chunk(b"RIFF", b"AVI " + m._chunk(b"LIST", b"hdrl" + m._chunk(b"avih", struct.pack("<14I", 100_000, 0, 0, 16, len(frames), 0, 1, 0, 8, 8, 0, 0, 0, 0))) + m._chunk(b"LIST", movi) + m._chunk(b"idx1", index))


def test_shots_of_an_ordinary_file(spark):
    levels = [10] * 5 + [90] * 4 + [-60] * 3
    avi = plain_avi([flat_frame(x) for x in levels])
    info = m.parse_avi(avi)
    assert int(m.luma(avi[info.frames[0][0] : sum(info.frames[0])])[0, 0]) == 128 + 10
    rows = spark.createDataFrame([(1, bytearray(avi), 5), (2, None, 5), (3, bytearray(b"junk"), 5), (4, bytearray(), 5)], "media_id int, media binary, clip int")
    got = [tuple(r) for r in m.clip_rows(rows).orderBy("media_id", "clip").collect()]
    assert got == [(1, 0, 0, 5, 0.0, 0.5), (1, 1, 5, 4, 0.5, 0.9), (1, 2, 9, 3, 0.9, 1.2)]


def test_query_columns(spark, tmp_path):
    texts = ["", None, "é" * 40, "x" * 64, "y" * 65, "word " * 3000, "word " * 3000]
    spark.createDataFrame([(i, t, "a") for i, t in enumerate(texts)], "doc_id long, text string, media string").write.parquet(str(tmp_path / "documents.parquet"))
    rows = {r["doc_id"]: r for r in m.op8_media(spark, str(tmp_path)).collect()}
    for i, t in enumerate(texts):
        data = (t or "").encode()
        padded = data + bytes(-len(data) % 64 or (0 if data else 64))
        r = rows[i]
        assert (r["n_bytes"], r["payload_bytes"]) == (len(data), len(padded))
        assert r["payload_sha256"] == hashlib.sha256(padded).hexdigest()
        assert r["tail_crc32"] == zlib.crc32(padded[-64:])
        assert r["media_sha256"] == hashlib.sha256(m.write_avi(padded)).hexdigest()
    assert rows[5][1:] == rows[6][1:] and rows[0][1:] == rows[1][1:]


def test_bad_payload():
    with pytest.raises(ValueError):
        m.write_avi(b"")
