"""Operator 2, token output: static range asymmetric numeral system (rANS).

One frequency table is shared by all files. A file holds whole documents in order; their ids are cut
into blocks that are coded independently, each with LANES interleaved states, so numpy moves all
lanes of all blocks of a file at once. A block has its states at every CHECKPOINT steps, from which
decoding can start, and a checksum of its ids.

File format, little-endian: header, documents (known flag, doc_id, number of ids), block directory
(ids, words, crc32), checkpoints (word position and lane states), words.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

SCALE_BITS = 20
LANES = 64
BLOCK = 1 << 16
CHECKPOINT = 256
LOW = np.uint64(1 << 31)
MAGIC = b"GLRANS01"
_HEADER = struct.Struct("<8sIIIIIQ")
_DOC = np.dtype([("known", "u1"), ("doc_id", "<i8"), ("n", "<u4")])
_DIR = np.dtype([("n", "<u4"), ("words", "<u4"), ("crc", "<u4")])


class Table:
    """Frequencies that sum to 2**SCALE_BITS; a symbol that occurs has one at least."""

    def __init__(self, freq: np.ndarray):
        self.freq = freq.astype(np.uint64)
        self.cum = np.concatenate([[0], np.cumsum(self.freq)[:-1]]).astype(np.uint64)
        self.crc = zlib.crc32(freq.astype("<u4").tobytes())
        self._slots: np.ndarray | None = None

    @classmethod
    def from_counts(cls, counts: np.ndarray) -> Table:
        total, size = int(counts.sum()), 1 << SCALE_BITS
        if not total:
            raise ValueError("a table needs a symbol")
        if (counts > 0).sum() > size:
            raise ValueError("more symbols than slots")
        freq = np.where(counts > 0, np.maximum(1, (counts.astype(object) * size // total).astype(np.int64)), 0)
        # what rounding leaves or takes goes to and from the commonest symbols
        rest = size - int(freq.sum())
        order = np.lexsort((np.arange(len(freq)), -freq))
        if rest > 0:
            freq[order[0]] += rest
        for i in order:
            if rest >= 0:
                break
            take = min(int(freq[i]) - 1, -rest)
            freq[i] -= take
            rest += take
        return cls(freq)

    def bytes(self) -> bytes:
        return self.freq.astype("<u4").tobytes()

    @classmethod
    def from_bytes(cls, raw: bytes) -> Table:
        return cls(np.frombuffer(raw, "<u4").astype(np.int64))

    @property
    def slots(self) -> np.ndarray:
        if self._slots is None:
            self._slots = np.repeat(np.arange(len(self.freq), dtype=np.uint32), self.freq.astype(np.int64))
        return self._slots


def _encode(ids: np.ndarray, table: Table) -> tuple[np.ndarray, list[np.ndarray], np.ndarray, np.ndarray]:
    """ids: blocks x steps x lanes. Word counts, words, checkpoint states and checkpoint positions of each block."""
    blocks, steps, lanes = ids.shape
    bits = np.uint64(SCALE_BITS)
    high = np.uint64(31 - SCALE_BITS + 32)
    state = np.full((blocks, lanes), LOW, np.uint64)
    sent = np.zeros((steps, blocks, lanes), bool)
    words = np.zeros((steps, blocks, lanes), np.uint32)
    marks = range(0, steps, CHECKPOINT)
    saved = np.zeros((len(marks), blocks, lanes), np.uint64)
    for step in range(steps - 1, -1, -1):
        symbol = ids[:, step]
        f, c = table.freq[symbol], table.cum[symbol]
        full = state >= (f << high)
        sent[step] = full
        words[step] = state.astype(np.uint32)
        state = np.where(full, state >> np.uint64(32), state)
        q = state // f
        state = (q << bits) + (state - q * f) + c
        if step % CHECKPOINT == 0:
            saved[step // CHECKPOINT] = state
    per_step = sent.sum(2)
    before = np.concatenate([np.zeros((1, blocks), np.int64), np.cumsum(per_step, 0)])
    streams = [words[:, b][sent[:, b]] for b in range(blocks)]
    return before[-1], streams, saved, before[list(marks)]


def _decode(counts: np.ndarray, words: np.ndarray, state: np.ndarray, at: np.ndarray, start: np.ndarray, steps: int, table: Table) -> np.ndarray:
    """Ids, blocks x steps x lanes. start: each block's first word; at: words of it that are used up."""
    blocks, lanes = state.shape
    out = np.empty((steps, blocks, lanes), np.uint32)
    mask, bits, slots = np.uint64((1 << SCALE_BITS) - 1), np.uint64(SCALE_BITS), table.slots
    words = np.append(words, np.zeros(lanes, np.uint32)).astype(np.uint64)
    place = start + at
    for step in range(steps):
        slot = state & mask
        symbol = slots[slot.astype(np.int64)]
        out[step] = symbol
        state = table.freq[symbol] * (state >> bits) + slot - table.cum[symbol]
        need = state < LOW
        rank = np.cumsum(need, 1)
        index = np.minimum(place[:, None] + rank - 1, len(words) - 1)
        state = np.where(need, (state << np.uint64(32)) | words[np.maximum(index, 0)], state)
        place = place + rank[:, -1]
    if (state != LOW).any() or (place != start + counts).any():
        raise ValueError("a block's states don't end as they began")
    return out.transpose(1, 0, 2)


def _shapes(total: int) -> list[tuple[int, int, int]]:
    """(first id, blocks, ids in each) of the full blocks and of the last."""
    full = total // BLOCK
    return [x for x in ((0, full, BLOCK), (full * BLOCK, 1, total - full * BLOCK)) if x[1] and x[2]]


def encode_file(docs: list[tuple[int | None, np.ndarray]], table: Table, first_id: int) -> bytes:
    """A file of these documents; first_id: ids before it, in its run of files."""
    head = np.zeros(len(docs), _DOC)
    for i, (doc_id, ids) in enumerate(docs):
        head[i] = (doc_id is not None, doc_id or 0, len(ids))
    ids = np.concatenate([x for _, x in docs]) if docs else np.zeros(0, np.uint32)
    filler = int(np.argmax(table.freq))
    rows, marks, streams = [], [], []
    for first, blocks, n in _shapes(len(ids)):
        steps = -(-n // LANES)
        part = np.full((blocks, steps * LANES), filler, np.int64)
        part[:, :n] = ids[first : first + blocks * n].reshape(blocks, n)
        counts, words, saved, at = _encode(part.reshape(blocks, steps, LANES), table)
        for b in range(blocks):
            own = ids[first + b * n : first + (b + 1) * n]
            rows.append((n, int(counts[b]), zlib.crc32(own.astype("<u4").tobytes())))
            marks += [at[:, b].astype("<u4").tobytes(), saved[:, b].astype("<u8").tobytes()]
        streams += words
    raw = b"".join([head.tobytes(), np.array(rows, _DIR).tobytes(), *marks, *(x.astype("<u4").tobytes() for x in streams)])
    return _HEADER.pack(MAGIC, len(docs), len(rows), table.crc, len(ids), zlib.crc32(raw), first_id) + raw


class File:
    """A parsed file: documents, and blocks that can each be decoded alone."""

    def __init__(self, raw: bytes, table: Table):
        magic, n_docs, n_blocks, table_crc, self.total, crc, self.first_id = _HEADER.unpack_from(raw)
        if magic != MAGIC or table_crc != table.crc or zlib.crc32(raw[_HEADER.size :]) != crc:
            raise ValueError("not a whole file, or one of another table")
        self.table, at = table, _HEADER.size
        self.docs = np.frombuffer(raw, _DOC, n_docs, at)
        at += self.docs.nbytes
        self.blocks = np.frombuffer(raw, _DIR, n_blocks, at)
        at += self.blocks.nbytes
        self.marks = []
        for n in self.blocks["n"]:
            k = -(-(-(-int(n) // LANES)) // CHECKPOINT)
            where = np.frombuffer(raw, "<u4", k, at).astype(np.int64)
            states = np.frombuffer(raw, "<u8", k * LANES, at + 4 * k).reshape(k, LANES)
            self.marks.append((where, states))
            at += 4 * k + 8 * k * LANES
        self.words = np.frombuffer(raw, "<u4", offset=at)
        self.starts = np.concatenate([[0], np.cumsum(self.blocks["words"].astype(np.int64))])[:-1]

    def ids(self) -> np.ndarray:
        """All ids; the full blocks are decoded side by side."""
        out = []
        for first, blocks, n in _shapes(self.total):
            own = slice(first // BLOCK, first // BLOCK + blocks)
            states = np.stack([m[1][0] for m in self.marks[own]]).astype(np.uint64)
            got = _decode(self.blocks["words"][own].astype(np.int64), self.words, states, np.zeros(blocks, np.int64), self.starts[own], -(-n // LANES), self.table)
            got = got.reshape(blocks, -1)[:, :n]
            for b, crc in enumerate(self.blocks["crc"][own]):
                if zlib.crc32(got[b].astype("<u4").tobytes()) != crc:
                    raise ValueError("a block's checksum differs")
            out.append(got.ravel())
        return np.concatenate(out) if out else np.zeros(0, np.uint32)

    def ids_from(self, block: int, mark: int) -> np.ndarray:
        """The ids of a block from one of its checkpoints on."""
        where, states = self.marks[block]
        n = int(self.blocks["n"][block])
        steps = -(-n // LANES) - mark * CHECKPOINT
        got = _decode(self.blocks["words"][block : block + 1].astype(np.int64), self.words, states[mark : mark + 1].astype(np.uint64), where[mark : mark + 1], self.starts[block : block + 1], steps, self.table)
        return got.reshape(-1)[: n - mark * CHECKPOINT * LANES]
