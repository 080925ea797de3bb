"""Operator 10, SentencePiece encoding and decoding.

An Aho-Corasick automaton holds the model's pieces. One pass over a text gives, at each position, all
pieces that end there (the automaton follows its output links, longest first), and the best score of
the position is relaxed with each: a Viterbi search over all segmentations. A character that is no
piece costs the unknown score and is written as its bytes' pieces.

No piece of the model has a word boundary mark after another character, and none has a line feed, so
the best segmentation of a text is that of its words one after the other: each distinct word is
segmented once. A text with two spaces on end, or one at its start, is segmented as a whole.

The segmentation maximises the sum of the pieces' scores. For a model of type BPE (as the public
vocabulary here) that isn't the order of merges of the library's BPE encoder: the ids may differ from
it, and agree with the library's unigram encoder for the same pieces. Decoding gives the text back.

Defined results: a null text counts as empty and has no pieces; rows are kept one by one, whatever
their doc_id; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table
from .token_output import pieces as slices

MODEL = "piece_bpe_32k.model"
MARK = "▁"
# Fixed values of the model format: the kinds of pieces, and what an unknown character costs below the lowest score.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNKNOWN_COST = 10.0
MEMO_UNITS = 200_000
PIECE_BYTES = 4 << 20


def _fields(raw: bytes) -> Iterator[tuple[int, bytes | int]]:
    """(number, value) of each field of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = raw[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < len(raw):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(kind) or varint()
            yield key >> 3, raw[at : at + size]
            at += size


class Codec:
    def __init__(self, model: bytes):
        import ahocorasick

        self.texts: list[str] = []
        self.scores: list[float] = []
        self.kinds: list[int] = []
        self.byte_fallback, self.prefix, squeeze, escape, charsmap = False, True, True, True, b""
        for number, value in _fields(model):
            if number == 1:
                piece = dict(_fields(value))
                self.texts.append(piece.get(1, b"").decode())
                self.scores.append(struct.unpack("<f", piece.get(2, bytes(4)))[0])
                self.kinds.append(piece.get(3, NORMAL))
            elif number == 2:
                self.byte_fallback = bool(dict(_fields(value)).get(35, 0))
            elif number == 3:
                spec = dict(_fields(value))
                charsmap = spec.get(2, b"")
                self.prefix, squeeze, escape = (bool(spec.get(k, 1)) for k in (3, 4, 5))
        if charsmap or squeeze or not escape:
            raise NotImplementedError("only models that leave texts as they are, but for escaped spaces, are supported")
        usable = [i for i, k in enumerate(self.kinds) if k in (NORMAL, USER_DEFINED)]
        low, high = min(self.scores[i] for i in usable), max(self.scores[i] for i in usable)
        self.unknown_score = low - UNKNOWN_COST
        self.unknown = self.kinds.index(UNKNOWN)
        self.singles = {self.texts[i] for i in usable if len(self.texts[i]) == 1}
        self.automaton = ahocorasick.Automaton()
        for i in usable:
            n = len(self.texts[i])
            score = n * high - 0.1 if self.kinds[i] == USER_DEFINED else self.scores[i]
            self.automaton.add_word(self.texts[i], (n, score, i))
        self.automaton.make_automaton()
        self.bytes_of = {int(self.texts[i][3:5], 16): i for i, k in enumerate(self.kinds) if k == BYTE}
        self.cuts = self.prefix and all(MARK not in self.texts[i].lstrip(MARK) and "\n" not in self.texts[i] for i in usable)
        self.back = [self._bytes(i) for i in range(len(self.texts))]
        self.is_byte = np.array([k == BYTE for k in self.kinds])
        self.memo: dict[str, bytes] = {}

    @classmethod
    def load(cls, path: str) -> Codec:
        with open(path, "rb") as f:
            return cls(f.read())

    def _bytes(self, i: int) -> bytes:
        kind = self.kinds[i]
        if kind == BYTE:
            return bytes([int(self.texts[i][3:5], 16)])
        if kind == UNKNOWN:
            return " ⁇ ".encode()
        return b"" if kind == CONTROL else self.texts[i].replace(MARK, " ").encode()

    def segment(self, s: str) -> list[int]:
        """The ids of the best segmentation of an escaped text, in one pass: hits come by their ends, and each relaxes its end's best score at once."""
        n, at = len(s), 0
        best, sizes, ids = [0.0] * (n + 1), [1] * (n + 1), [-1] * (n + 1)
        singles, unknown = self.singles, self.unknown_score
        for end, (size, score, i) in self.automaton.iter(s):
            end += 1
            while at < end:
                # a position begins as an unknown character, or with nothing where the character is a piece
                at += 1
                best[at] = -1e300 if s[at - 1] in singles else best[at - 1] + unknown
            total = best[end - size] + score
            if total > best[end]:
                best[end], sizes[end], ids[end] = total, size, i
        # what follows the last hit is unknown: its ids and sizes are set
        out, e = [], n
        while e:
            size, i = sizes[e], ids[e]
            if i >= 0:
                out.append(i)
            elif self.byte_fallback:
                out += [self.bytes_of[b] for b in reversed(s[e - 1].encode())]
            elif not out or out[-1] != self.unknown:
                out.append(self.unknown)
            e -= size
        out.reverse()
        return out

    def whole(self, text: str) -> list[int]:
        return self.segment((MARK if self.prefix else "") + text.replace(" ", MARK)) if text else []

    def _learn(self, units: list[str]) -> None:
        if len(self.memo) + len(units) > MEMO_UNITS:
            self.memo.clear()
        for u in units:
            # a unit that begins with a line feed has no space before it
            self.memo[u] = array("I", self.segment(u if u[:1] == "\n" else MARK + u)).tobytes()

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of each text; a null is empty."""
        texts = pc.fill_null(texts, "")
        odd = pc.or_(pc.match_substring(texts, "  "), pc.starts_with(texts, " ")).to_numpy(zero_copy_only=False)
        if not self.cuts:
            odd[:] = True
        cut = pc.split_pattern(pc.replace_substring(texts, "\n", " \n"), " ")
        coded = cut.flatten().dictionary_encode()
        which, edges = coded.indices.to_numpy(), cut.offsets.to_numpy()
        edges = edges - edges[0]
        units = coded.dictionary.to_pylist()
        parts = list(map(self.memo.get, units))
        if None in parts:
            self._learn([u for u, p in zip(units, parts) if p is None])
            memo = self.memo
            parts = [memo[u] if p is None else p for u, p in zip(units, parts)]
        sizes = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
        starts = np.cumsum(sizes) - sizes
        pool = np.frombuffer(b"".join(parts), "<u4")
        each = sizes[which]
        ends = np.cumsum(each)
        ids = pool[np.repeat(starts[which] - (ends - each), each) + np.arange(ends[-1] if len(ends) else 0)]
        ends = np.concatenate([[0], ends])[edges]
        empty = pc.equal(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
        return [
            np.zeros(0, np.uint32) if empty[k] else np.array(self.whole(texts[k].as_py()), np.uint32) if odd[k] else ids[ends[k] : ends[k + 1]]
            for k in range(len(texts))
        ]

    def decode(self, ids: list[int]) -> str:
        """The text of some ids; bytes that are no UTF-8 become replacement characters."""
        text = b"".join(map(self.back.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if self.prefix and text[:1] == " " else text


_CODECS: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    if path not in _CODECS:
        _CODECS[path] = Codec.load(path)
    return _CODECS[path]


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            for part in slices(batch, "text", PIECE_BYTES):
                ids = own.encode(part.column("text"))
                edges = np.concatenate([[0], np.cumsum([len(x) for x in ids])])
                values = pa.array(np.concatenate(ids).astype(np.int32) if ids else [], pa.int32())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.ListArray.from_arrays(pa.array(edges, pa.int32()), values)], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, text of each row; null ids give an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            ids = batch.column("ids")
            texts = [own.decode(x.values.to_numpy().tolist() if x.is_valid else []) for x in ids]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, text string")


def round_trips(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_pieces, n_byte_pieces, ids_crc32 (little-endian 32-bit), decoded_crc32, round_trip of each row, encoded and decoded in one go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            for part in slices(batch, "text", PIECE_BYTES):
                rows = []
                for x, text in zip(own.encode(part.column("text")), part.column("text")):
                    back = own.decode(x.tolist())
                    rows.append((len(x), int(own.is_byte[x].sum()), zlib.crc32(x.astype("<u4").tobytes()), zlib.crc32(back.encode()), back == (text.as_py() or "")))
                n, b, c, d, r = zip(*rows)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(v, pa.int64()) for v in (n, b, c, d)), pa.array(r, pa.bool_())], ["doc_id", "n_pieces", "n_byte_pieces", "ids_crc32", "decoded_crc32", "round_trip"])

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return plain.mapInArrow(run, "doc_id long, n_pieces long, n_byte_pieces long, ids_crc32 long, decoded_crc32 long, round_trip boolean")


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return round_trips(table(spark, sf_dir, "documents"), public_tokenizers.path(MODEL))
