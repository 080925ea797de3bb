import hashlib
import struct
import zlib

import numpy as np
import pytest

from graphloom.llm import media_tiff, tiff

RNG = np.random.default_rng(7)


def little(image):
    return image.astype(image.dtype.newbyteorder("<")).tobytes()


@pytest.mark.parametrize("compression", [tiff.NONE, tiff.PACKBITS, tiff.LZW, tiff.DEFLATE])
@pytest.mark.parametrize("predictor", [1, 2])
@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("tile", [None, (16, 32)])
def test_round_trip(compression, predictor, order, tile):
    images = [
        np.repeat(RNG.integers(0, 9, (21, 5, 1)), 9, 1).astype(np.uint8),
        RNG.integers(0, 65536, (40, 70, 3)).astype(np.uint16),
        RNG.integers(0, 2**32, (3, 2, 1)).astype(np.uint32),
    ]
    raw = tiff.write(images, compression, predictor, strip_rows=7, tile=tile, order=order)
    got = list(tiff.pages(raw))
    assert [p.pixels for p in got] == [little(x) for x in images]
    assert [(p.height, p.width, p.samples) for p in got] == [x.shape for x in images]


@pytest.mark.parametrize("order", ["<", ">"])
def test_float_predictor(order):
    image = RNG.normal(size=(9, 11, 2)).astype(np.float32)
    (page,) = tiff.pages(tiff.write([image], tiff.DEFLATE, 3, order=order))
    assert page.pixels == little(image)


@pytest.mark.parametrize("raw", [b"", b"a", b"aaaa" * 100, bytes(range(256)) * 40, RNG.integers(0, 3, 50_000).astype(np.uint8).tobytes(), RNG.integers(0, 256, 20_000).astype(np.uint8).tobytes()])
def test_byte_codecs(raw):
    assert tiff.unpack_bits(tiff.pack_bits(raw), len(raw)) == raw
    assert tiff.unpack_lzw(tiff.pack_lzw(raw), len(raw)) == raw


def test_known_packbits():
    # the example of the published description
    packed = bytes([0xFE, 0xAA, 0x02, 0x80, 0x00, 0x2A, 0xFD, 0xAA, 0x03, 0x80, 0x00, 0x2A, 0x22, 0xF7, 0xAA])
    want = bytes([0xAA] * 3 + [0x80, 0x00, 0x2A] + [0xAA] * 4 + [0x80, 0x00, 0x2A, 0x22] + [0xAA] * 10)
    assert tiff.unpack_bits(packed, len(want)) == want


def test_one_bit_and_planar():
    bits = RNG.integers(0, 2, (4, 13)).astype(np.uint8)
    strip = np.packbits(bits, axis=1).tobytes()
    entries = [(256, 4, 13), (257, 4, 4), (258, 3, 1), (259, 3, 1), (273, 4, 8), (277, 3, 1), (278, 4, 4), (279, 4, len(strip))]
    body = struct.pack("<H", len(entries)) + b"".join(struct.pack("<HHI", t, k, 1) + struct.pack("<I", v) for t, k, v in entries) + bytes(4)
    raw = b"II" + struct.pack("<HI", 42, 8 + len(strip)) + strip + body
    (page,) = tiff.pages(raw)
    assert page.pixels == bits.tobytes()
    red, blue = RNG.integers(0, 256, (2, 3, 5)).astype(np.uint8)
    strips = red.tobytes() + blue.tobytes()
    extra = 8 + len(strips)
    entries = [(256, 3, 1, 5), (257, 3, 1, 3), (258, 3, 2, 8 | 8 << 16), (259, 3, 1, 1), (273, 4, 2, extra), (277, 3, 1, 2), (278, 3, 1, 3), (279, 4, 2, extra + 8), (284, 3, 1, 2)]
    body = struct.pack("<H", len(entries)) + b"".join(struct.pack("<HHII", *e) for e in entries) + bytes(4)
    raw = b"II" + struct.pack("<HI", 42, extra + 16) + strips + struct.pack("<IIII", 8, 8 + 15, 15, 15) + body
    (page,) = tiff.pages(raw)
    assert page.pixels == np.stack([red, blue], -1).tobytes()


def test_broken_files_are_rows(spark):
    good = tiff.write([np.full((2, 3, 1), 5, np.uint8), np.full((1, 1, 1), 6, np.uint8)])
    loop = bytearray(tiff.write([np.zeros((1, 1, 1), np.uint8)], tiff.NONE))
    at = struct.unpack_from("<I", loop, 4)[0]
    struct.pack_into("<I", loop, at + 2 + 12 * struct.unpack_from("<H", loop, at)[0], at)
    rows = [(1, good, "x"), (2, None, "x"), (3, b"junk", "x"), (None, bytes(loop), "x"), (1, good, "x"), (5, good[:40], "x")]
    df = spark.createDataFrame(rows, "doc_id long, media binary, pixels string")
    got = media_tiff.pages(df).collect()
    assert sorted((r.page, r.width) for r in got if r.doc_id == 1) == [(0, 3), (0, 3), (1, 1), (1, 1)]
    assert [r.error for r in got if r.doc_id == 2] == ["null"]
    assert all(r.error for r in got if r.doc_id in (3, 5))
    assert [r.page for r in got if r.doc_id is None] == [0, 1]


def test_documents(spark):
    texts = ["", None, "a" * 576, "b" * 577, "é|ü" * 40_000, "same", "same"]
    df = spark.createDataFrame([(i if i else None, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, media_bytes int")
    got = sorted(media_tiff.digests(media_tiff.store(df)).collect(), key=lambda r: r.doc_id or 0)
    for r, t in zip(got, texts):
        raw = (t or "").encode()
        payload = raw + b"\xff" * (-len(raw) % 576 or (0 if raw else 576))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
        assert r.tail_crc32 == zlib.crc32(payload[-32:])
    assert got[5][1:] == got[6][1:]
    assert media_tiff.digests(media_tiff.store(df.limit(0))).count() == 0


def claimed(width, height, rows, at=(8,), sizes=(1,), tile=None, bits=8):
    """A small file whose header claims a size."""
    entries = [(256, 4, 1, width), (257, 4, 1, height), (258, 3, 1, bits), (259, 3, 1, 1), (277, 3, 1, 1)]
    entries += [(322, 4, 1, tile[0]), (323, 4, 1, tile[1]), (324, 4, 1, at[0]), (325, 4, 1, sizes[0])] if tile else [(273, 4, 1, at[0]), (278, 4, 1, rows), (279, 4, 1, sizes[0])]
    body = struct.pack("<H", len(entries)) + b"".join(struct.pack("<HHII", *e) for e in sorted(entries)) + bytes(4)
    return b"II" + struct.pack("<HI", 42, 16) + b"x" * 8 + body


def test_hostile_sizes_are_errors(spark):
    top = 2**31 - 1
    files = [claimed(1, top, 1), claimed(top, top, top), claimed(16, 16, 16, tile=(2**30, 2**30)), claimed(0, 5, 1), claimed(5, 5, 0), claimed(top, 1, 1, bits=64), claimed(16, 16, 16, tile=(0, 16))]
    assert all(len(f) < 200 for f in files)
    got = media_tiff.pages(spark.createDataFrame(list(enumerate(files)), "doc_id long, media binary")).collect()
    assert len(got) == len(files) and all(r.error and r.pixels is None for r in got)


@pytest.mark.parametrize("layout", media_tiff.LAYOUTS)
def test_each_layout_gives_the_payload_back(spark, layout):
    texts = ["", "short", "line of text\n" * 700, "\xff\x00é" * 3000, "a" * 576 * 33]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in media_tiff.digests(media_tiff.store(df, (layout,))).collect():
        raw = texts[r.doc_id].encode()
        payload = raw + b"\xff" * (-len(raw) % 576 or (0 if raw else 576))
        assert (r.payload_bytes, r.payload_sha256) == (len(payload), hashlib.sha256(payload).hexdigest())


def test_a_stored_page_that_cannot_be_read_is_an_error(spark):
    df = spark.createDataFrame([(1, 3, b"II*\0junk")], "doc_id long, n_bytes long, media binary")
    with pytest.raises(Exception, match="can't be read"):
        media_tiff.digests(df).collect()
