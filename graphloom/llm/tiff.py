"""TIFF reading and writing for operator 3: directories, strips and tiles, PackBits, LZW, deflate, predictors.

Read: both byte orders, classic and big files, any number of directories, strips or tiles, chunky or
planar samples of 1, 2, 4, 8, 16, 32 or 64 bits, no compression, PackBits, LZW and deflate, predictors
1 to 3. Samples come out chunky and little-endian, row by row.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

# Fixed values of the format: field type -> (bytes, struct letter), and the tags used here.
TYPES = {1: (1, "B"), 2: (1, "c"), 3: (2, "H"), 4: (4, "I"), 5: (8, "II"), 6: (1, "b"), 7: (1, "B"), 8: (2, "h"), 9: (4, "i"), 10: (8, "ii"), 11: (4, "f"), 12: (8, "d"), 13: (4, "I"), 16: (8, "Q"), 17: (8, "q"), 18: (8, "Q")}
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIP_AT, SAMPLES, STRIP_ROWS, STRIP_BYTES = 256, 257, 258, 259, 262, 273, 277, 278, 279
PLANAR, PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_AT, TILE_BYTES = 284, 317, 322, 323, 324, 325
NONE, LZW, DEFLATE, PACKBITS, OLD_DEFLATE = 1, 5, 8, 32773, 32946
CLEAR, END = 256, 257
#: A larger image is an error: what a header claims must not fill a worker's memory.
MAX_IMAGE_BYTES = 1 << 30


class TiffError(ValueError):
    pass


@dataclass(frozen=True)
class Page:
    number: int
    width: int
    height: int
    bits: int
    samples: int
    compression: int
    predictor: int
    pixels: bytes


def unpack_bits(raw: bytes, size: int) -> bytes:
    out, at = bytearray(), 0
    while at < len(raw) and len(out) < size:
        n = raw[at]
        if n < 128:
            out += raw[at + 1 : at + 2 + n]
            at += 2 + n
        elif n > 128:
            out += raw[at + 1 : at + 2] * (257 - n)
            at += 2
        else:
            at += 1
    return bytes(out)


_RUN = re.compile(rb"(.)\1{2,127}", re.S)


def pack_bits(raw: bytes) -> bytes:
    """Runs of three bytes or more as such, what is between them as literals."""
    out, at = bytearray(), 0

    def literal(lo: int, hi: int) -> None:
        for k in range(lo, hi, 128):
            part = raw[k : min(k + 128, hi)]
            out.append(len(part) - 1)
            out.extend(part)

    for m in _RUN.finditer(raw):
        literal(at, m.start())
        at = m.end()
        out += bytes([257 - (at - m.start()), raw[m.start()]])
    literal(at, len(raw))
    return bytes(out)


def unpack_lzw(raw: bytes, size: int) -> bytes:
    """Codes with the high bit first; a code grows by a bit one entry early."""
    out, known = bytearray(), [bytes([i]) for i in range(256)] + [b"", b""]
    wide, held, have, last = 9, 0, 0, b""
    for byte in raw:
        held = (held << 8) | byte
        have += 8
        if have < wide:
            continue
        have -= wide
        code = held >> have
        held &= (1 << have) - 1
        if code == CLEAR:
            del known[258:]
            wide, last = 9, b""
            continue
        if code == END:
            break
        if code < len(known):
            entry = known[code]
        elif code == len(known) and last:
            entry = last + last[:1]
        else:
            raise TiffError("an LZW code that no table entry has")
        if last and len(known) < 4096:
            known.append(last + entry[:1])
        out += entry
        last = entry
        wide = 9 if len(known) < 511 else 10 if len(known) < 1023 else 11 if len(known) < 2047 else 12
        if len(out) >= size:
            break
    return bytes(out)


def pack_lzw(raw: bytes) -> bytes:
    """Codes by a table of (code, next byte); their bits are put together at once."""
    codes, widths = [CLEAR], [9]
    known: dict[int, int] = {}
    following, wide, grows, prefix = 258, 9, 512, -1
    for byte in raw:
        if prefix < 0:
            prefix = byte
            continue
        key = prefix << 8 | byte
        code = known.get(key)
        if code is not None:
            prefix = code
            continue
        codes.append(prefix)
        widths.append(wide)
        known[key] = following
        following += 1
        if following == grows:
            wide, grows = wide + 1, grows * 2
        if following == 4094:
            codes.append(CLEAR)
            widths.append(wide)
            known, following, wide, grows = {}, 258, 9, 512
        prefix = byte
    if prefix >= 0:
        codes.append(prefix)
        widths.append(wide)
        if following + 1 == grows:
            wide += 1
    codes.append(END)
    widths.append(wide)
    bits = np.unpackbits(np.array(codes, ">u2").view(np.uint8).reshape(-1, 2), axis=1)
    return np.packbits(bits[np.arange(16) >= 16 - np.array(widths)[:, None]]).tobytes()


def _inflate(raw: bytes, compression: int, size: int) -> bytes:
    if compression == NONE:
        got = raw
    elif compression == PACKBITS:
        got = unpack_bits(raw, size)
    elif compression == LZW:
        got = unpack_lzw(raw, size)
    elif compression in (DEFLATE, OLD_DEFLATE):
        # never more than the segment needs, whatever the stream claims
        got = zlib.decompressobj().decompress(raw, max(size, 1))
    else:
        raise TiffError(f"compression {compression} isn't supported")
    if len(got) < size:
        raise TiffError(f"a segment has {len(got)} bytes of {size}")
    return got[:size]


def _directories(raw: bytes) -> Iterator[tuple[str, dict[int, tuple]]]:
    order = {b"II": "<", b"MM": ">"}.get(raw[:2])
    if order is None or len(raw) < 8:
        raise TiffError("no TIFF header")
    magic = struct.unpack_from(order + "H", raw, 2)[0]
    if magic not in (42, 43):
        raise TiffError("no TIFF header")
    big = magic == 43
    word, count, entry = ("Q", "Q", 20) if big else ("I", "H", 12)
    at = struct.unpack_from(order + word, raw, 8 if big else 4)[0]
    seen = set()
    while at:
        if at in seen:
            raise TiffError("the directories form a loop")
        seen.add(at)
        try:
            n = struct.unpack_from(order + count, raw, at)[0]
            at += struct.calcsize(count)
            tags = {}
            for k in range(n):
                tag, kind = struct.unpack_from(order + "HH", raw, at + k * entry)
                values = struct.unpack_from(order + word, raw, at + k * entry + 4)[0]
                if kind not in TYPES:
                    continue
                wide, letter = TYPES[kind]
                place = at + k * entry + (12 if big else 8)
                if wide * values > struct.calcsize(word):
                    place = struct.unpack_from(order + word, raw, place)[0]
                if place + wide * values > len(raw):
                    raise TiffError("a field lies beyond the end")
                tags[tag] = struct.unpack_from(f"{order}{values * len(letter)}{letter[0]}", raw, place)
            at = struct.unpack_from(order + word, raw, at + n * entry)[0]
        except struct.error as e:
            raise TiffError("a directory lies beyond the end") from e
        yield order, tags


def _unpredict(part: np.ndarray, width: int, samples: int, wide: int, predictor: int, order: str) -> np.ndarray:
    """part: the bytes of each row; rows x width x samples x bytes, little-endian."""
    rows = len(part)
    if predictor == 3:
        # differences of bytes, whose planes lie one after the other, the highest first
        line = np.cumsum(part.reshape(rows, -1, samples), axis=1, dtype=np.uint64).astype(np.uint8).reshape(rows, wide, width * samples)
        return np.ascontiguousarray(line[:, ::-1].transpose(0, 2, 1)).reshape(rows, width, samples, wide)
    typed = np.ascontiguousarray(part).view(f"{order}u{wide}").reshape(rows, width, samples)
    if predictor == 2:
        typed = np.cumsum(typed, axis=1, dtype=np.uint64)
    return np.ascontiguousarray(typed.astype(f"<u{wide}")).view(np.uint8).reshape(rows, width, samples, wide)


def _samples(raw: bytes, rows: int, width: int, samples: int, bits: int, predictor: int, order: str) -> np.ndarray:
    """rows x width x samples x bytes of a decompressed segment; samples of under 8 bits take a byte each."""
    data = np.frombuffer(raw, np.uint8)
    if bits < 8:
        if predictor != 1:
            raise TiffError("a predictor needs whole bytes")
        line = np.unpackbits(data.reshape(rows, -1), axis=1)[:, : width * samples * bits].reshape(rows, width, samples, bits)
        return (line * (1 << np.arange(bits - 1, -1, -1))).sum(-1, dtype=np.uint8)[..., None]
    return _unpredict(data.reshape(rows, -1), width, samples, bits // 8, predictor, order)


def pages(raw: bytes) -> Iterator[Page]:
    """Each directory's image. Raises TiffError on what is broken or not supported."""
    for number, (order, tags) in enumerate(_directories(raw)):
        try:
            width, height = tags[WIDTH][0], tags[HEIGHT][0]
            depth = set(tags.get(BITS, (1,)))
        except (KeyError, IndexError) as e:
            raise TiffError("a directory has no image") from e
        bits, samples = depth.pop(), tags.get(SAMPLES, (1,))[0]
        if depth or bits not in (1, 2, 4, 8, 16, 32, 64):
            raise TiffError("samples of these bits aren't supported")
        compression, predictor = tags.get(COMPRESSION, (NONE,))[0], tags.get(PREDICTOR, (1,))[0]
        if predictor not in (1, 2, 3):
            raise TiffError(f"predictor {predictor} isn't supported")
        planes = samples if tags.get(PLANAR, (1,))[0] == 2 else 1
        each = samples // planes
        tiled = TILE_AT in tags
        at, sizes = (tags.get(TILE_AT), tags.get(TILE_BYTES)) if tiled else (tags.get(STRIP_AT), tags.get(STRIP_BYTES))
        if not at or not sizes or len(at) != len(sizes):
            raise TiffError("a directory has no segments")
        across, down = (tags[TILE_WIDTH][0], tags[TILE_HEIGHT][0]) if tiled else (width, min(height, tags.get(STRIP_ROWS, (height,))[0]))
        if min(width, height, samples, across, down) < 1:
            raise TiffError("a size of none")
        # counted before anything of that size is made
        if -(-height // down) * -(-width // across) * planes > len(at):
            raise TiffError("segments are missing")
        if max(width * height, across * down) * samples * max(1, bits // 8) > MAX_IMAGE_BYTES:
            raise TiffError(f"an image of more than {MAX_IMAGE_BYTES} bytes")
        grid = [(y, x) for y in range(0, height, down) for x in range(0, width, across)]
        if not tiled and planes == 1 and bits == 8 and predictor == 1:
            # whole rows of bytes lie one after the other
            parts = [_inflate(raw[a : a + n], compression, min(down, height - y) * width * each) for (y, _), a, n in zip(grid, at, sizes)]
            yield Page(number, width, height, bits, samples, compression, predictor, b"".join(parts))
            continue
        image = np.zeros((height, width, samples, max(1, bits // 8)), np.uint8)
        for plane in range(planes):
            for k, (y, x) in enumerate(grid):
                a, n = at[plane * len(grid) + k], sizes[plane * len(grid) + k]
                rows = down if tiled else min(down, height - y)
                part = _inflate(raw[a : a + n], compression, rows * -(-across * each * bits // 8))
                got = _samples(part, rows, across, each, bits, predictor, order)
                h, w = min(rows, height - y), min(across, width - x)
                image[y : y + h, x : x + w, plane * each : (plane + 1) * each] = got[:h, :w]
        yield Page(number, width, height, bits, samples, compression, predictor, image.tobytes())


def write(images: list[np.ndarray], compression: int = DEFLATE, predictor: int = 1, strip_rows: int = 64, tile: tuple[int, int] | None = None, order: str = "<", level: int = 1) -> bytes:
    """A classic file with a page for each image, height x width x samples of an unsigned type (or float, predictor 3)."""
    pack = {NONE: bytes, PACKBITS: pack_bits, LZW: pack_lzw, DEFLATE: lambda x: zlib.compress(x, level)}[compression]
    out = bytearray({"<": b"II", ">": b"MM"}[order] + struct.pack(order + "HI", 42, 0))
    link = 4
    for image in images:
        height, width, samples = image.shape
        bits = image.dtype.itemsize * 8
        down, across = tile or (min(strip_rows, height), width)
        at, sizes = [], []
        for y in range(0, height, down):
            for x in range(0, width, across):
                part = image[y : y + down, x : x + across]
                if tile:
                    part = np.pad(part, ((0, down - part.shape[0]), (0, across - part.shape[1]), (0, 0)))
                if predictor == 2:
                    part = np.diff(part, axis=1, prepend=np.zeros_like(part[:, :1]))
                if predictor == 3:
                    rows = part.shape[0]
                    planes = np.ascontiguousarray(part.astype(part.dtype.newbyteorder(">"))).view(np.uint8).reshape(rows, -1, bits // 8).transpose(0, 2, 1).reshape(rows, -1, samples)
                    raw = np.diff(planes, axis=1, prepend=np.zeros_like(planes[:, :1])).tobytes()
                else:
                    raw = np.ascontiguousarray(part.astype(part.dtype.newbyteorder(order))).tobytes()
                packed = pack(raw)
                at.append(len(out))
                sizes.append(len(packed))
                out += packed
        fields = [(WIDTH, 4, [width]), (HEIGHT, 4, [height]), (BITS, 3, [bits] * samples), (COMPRESSION, 3, [compression]), (PHOTOMETRIC, 3, [1]), (SAMPLES, 3, [samples]), (PREDICTOR, 3, [predictor])]
        fields += [(TILE_WIDTH, 4, [across]), (TILE_HEIGHT, 4, [down]), (TILE_AT, 4, at), (TILE_BYTES, 4, sizes)] if tile else [(STRIP_AT, 4, at), (STRIP_ROWS, 4, [down]), (STRIP_BYTES, 4, sizes)]
        rows = []
        for tag, kind, values in sorted(fields):
            raw = struct.pack(f"{order}{len(values)}{TYPES[kind][1]}", *values)
            if len(raw) > 4:
                out += b"\0" * (len(out) % 2)
                place = struct.pack(order + "I", len(out))
                out += raw
            else:
                place = raw.ljust(4, b"\0")
            rows.append(struct.pack(order + "HHI", tag, kind, len(values)) + place)
        out += b"\0" * (len(out) % 2)
        struct.pack_into(order + "I", out, link, len(out))
        out += struct.pack(order + "H", len(rows)) + b"".join(rows)
        link = len(out)
        out += bytes(4)
    return bytes(out)
