"""Operator 2: texts to ids to rANS files in ascending doc_id order, and back.

Files are rows (part, number, payload) of a Parquet table in the shared folder, so they can be written to and read
from any store that Spark reads. Steps: encode each text once and stage its ids; count ids over all
documents (at most one row for each id of the vocabulary reaches the driver); sort by range, write
files of FILE_IDS ids about; read them back.

Defined results: a null text is empty and yields the end id alone; a null doc_id sorts first; rows
with one doc_id are ordered by checksum, length and ids; an empty table gives no rows.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import rans
from .common import stage, table

TOKENIZER = "byte_bpe_50k.json"
END_ID = 2
FILE_IDS = 1 << 22
#: Units of text whose ids a worker keeps; it starts anew when they are reached.
MEMO_UNITS = 1_000_000
#: Text that is encoded at once.
PIECE_BYTES = 24 << 20


def _byte_letters() -> str:
    """The letter that byte-level vocabularies have for each byte: printable bytes stand for themselves, the others follow from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return "".join(chr(b if b in plain else next(others)) for b in range(256))


class Encoder:
    """Ids of whole texts, by the tokenizers library.

    The pre-tokenizer's pattern always breaks before a single space between two other characters and
    around a single line feed between two others. A text is cut there into units; a unit that begins
    a line keeps the line feed. Each distinct unit is encoded once: a run of letters is one piece of
    the pattern, so it goes straight to the library's model, and so does one before a single
    punctuation mark; other units go through the whole pipeline. A text with other white space, or with one
    of the vocabulary's added tokens (which the library finds anywhere in a text), is encoded as a whole.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        added = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values() if t.content]
        self.added = "|".join(added)
        self.tokens = self.model.tokenize
        self.letters = _byte_letters()
        self.space = self.letters[32]
        self.memo: dict[str, bytes] = {}
        self.odd: set[str] = set()
        self.line = self._raw(self._plain("\n"))
        self.marks = {c: self._raw(self._plain("a" + c)[1:]) for c in ",.;:!?"}

    @staticmethod
    def _raw(ids: list[int]) -> bytes:
        return np.array(ids, "<u4").tobytes()

    def _plain(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _word(self, word: str) -> bytes:
        """A run of letters, with the space before it where there is one. ASCII letters stand for themselves."""
        mapped = word.replace(" ", self.space) if word.isascii() else word.encode().decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.tokens(mapped)]).tobytes()

    def _learn(self, units: list[str]) -> None:
        if len(self.memo) + len(units) > MEMO_UNITS:
            self.memo.clear()
            self.odd.clear()
        memo, rest, tokens, space = self.memo, [], self.tokens, self.space
        for u in units:
            if u.isalpha() and u.isascii():
                memo[u] = array("I", [t.id for t in tokens(space + u)]).tobytes()
                continue
            first = u[:1] == "\n"
            word = u[1:] if first else u
            if not word or word[0].isspace() or word[-1].isspace():
                self.odd.add(u)
                memo[u] = b""
                continue
            lead, gap = (self.line, "") if first else (b"", " ")
            if word.isalpha():
                memo[u] = lead + self._word(gap + word)
            elif word[-1] in self.marks and word[:-1].isalpha():
                memo[u] = lead + self._word(gap + word[:-1]) + self.marks[word[-1]]
            else:
                rest.append((u, lead, gap + word))
        if rest:
            for (u, lead, _), e in zip(rest, self.tokenizer.encode_batch_fast([w for _, _, w in rest], add_special_tokens=False)):
                memo[u] = lead + array("I", e.ids).tobytes()

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of each text; a null is empty. Units are cut and made distinct by Arrow, ids are put together by numpy."""
        texts = pc.fill_null(texts, "")
        special = pc.match_substring_regex(texts, self.added).to_numpy(zero_copy_only=False) if self.added else np.zeros(len(texts), bool)
        led = pc.replace_substring(pc.binary_join_element_wise("\n", texts, ""), "\n", " \n")
        cut = pc.split_pattern(led, " ")
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
        whole = np.zeros(len(which), bool)
        if self.odd:
            whole = np.fromiter((u in self.odd for u in units), bool, len(units))[which]
            whole[edges[:-1]] = False  # what stands before a text's own first unit
        odd = np.concatenate([[0], np.cumsum(whole)])[edges]
        out = []
        for k in range(len(texts)):
            if special[k] or odd[k + 1] > odd[k]:
                out.append(np.array(self._plain(texts[k].as_py()), "<u4"))
            else:
                out.append(ids[ends[k] + 1 : ends[k + 1]])
        return out


def pieces(batch: pa.RecordBatch, column: str, most: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about `most` bytes of the column each."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
    lo = 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(sizes, (sizes[lo - 1] if lo else 0) + most, "right")))
        yield batch.slice(lo, hi - lo)
        lo = hi


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


@cache
def _zstd():
    """The worker's own compressor and decompressor: making them costs more than most texts' ids."""
    import zstandard

    return zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def pack(ids: np.ndarray) -> bytes:
    """Staged ids: two or four bytes each, compressed."""
    planes = ids.astype("<u2") if not len(ids) or ids.max() < 65536 else ids
    return bytes([planes.dtype.itemsize]) + _zstd()[0].compress(planes.tobytes())


def unpack(raw: bytes) -> np.ndarray:
    return np.frombuffer(_zstd()[1].decompress(raw[1:]), f"<u{raw[0]}").astype(np.uint32)


def tokenize(docs: DataFrame, path: str, end_id: int = END_ID) -> DataFrame:
    """doc_id, n_tokens, ids_crc32 and the packed ids of each text with the end id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(path), np.array([end_id], "<u4")
        for batch in batches:
            for part in pieces(batch, "text", PIECE_BYTES):
                ids = [np.concatenate([x, end]) for x in enc.encode(part.column("text"))]
                columns = [part.column("doc_id"), pa.array([len(x) for x in ids], pa.int64()), pa.array([zlib.crc32(x.tobytes()) for x in ids], pa.int64()), pa.array([pack(x) for x in ids], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_crc32", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids_crc32 long, ids binary")


def count_ids(tokens: DataFrame) -> np.ndarray:
    """How often each id occurs in all documents; one row for each id at most reaches the driver."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(1, np.int64)
        for batch in batches:
            for lo in range(0, len(batch), 200):
                got = np.bincount(np.concatenate([unpack(x) for x in batch["ids"].iloc[lo : lo + 200]]))
                if len(got) > len(total):
                    got[: len(total)] += total
                    total = got
                else:
                    total[: len(got)] += got
        seen = np.flatnonzero(total)
        yield pd.DataFrame({"id": seen, "n": total[seen]})

    rows = tokens.select("ids").mapInPandas(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(max((r["id"] for r in rows), default=0) + 1, np.int64)
    for r in rows:
        counts[r["id"]] = r["n"]
    return counts


def write_files(tokens: DataFrame, coder: rans.Table, file_ids: int = FILE_IDS) -> DataFrame:
    """Rows (part, number, n_ids, payload): the parts, and the files of a part, are in ascending doc_id order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int | None, np.ndarray]] = []
        n = first = number = part = 0

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([n], pa.int64()), pa.array([rans.encode_file(held, coder, first)], pa.binary())], ["part", "number", "n_ids", "payload"])

        for batch in batches:
            for doc_id, ids, part in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "ids", "part"))):
                held.append((doc_id, unpack(ids)))
                n += len(held[-1][1])
                if n >= file_ids:
                    yield flush()
                    held, first, n, number = [], first + n, 0, number + 1
        if held:
            yield flush()

    order = F.col("doc_id").asc_nulls_first()
    ordered = tokens.repartitionByRange(order, "ids_crc32").sortWithinPartitions(order, "ids_crc32", "n_tokens", "ids")
    ready = ordered.select("doc_id", "ids", F.spark_partition_id().alias("part"))
    return stage(ready.mapInArrow(run, "part int, number int, n_ids long, payload binary"), "rans-files", codec="none")


def read_files(files: DataFrame, coder: rans.Table) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the files' bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, payload in zip(batch.column("part").to_pylist(), batch.column("payload")):
                file = rans.File(payload.as_py(), coder)
                ids, sizes = file.ids().astype("<u4"), file.docs["n"].astype(np.int64)
                edges = np.concatenate([[0], np.cumsum(sizes)])
                doc_id = pa.array(file.docs["doc_id"].astype(np.int64), pa.int64(), mask=file.docs["known"] == 0)
                crcs = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(edges, edges[1:])]
                columns = [pa.array([part] * len(sizes), pa.int32()), doc_id, pa.array(file.first_id + edges[:-1], pa.int64()), pa.array(sizes, pa.int64()), pa.array(crcs, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["part", "doc_id", "at", "n_tokens", "ids_crc32"])

    # a part is a range partition: their number is set by the shuffle, not by the documents
    sizes = {r["part"]: r["n"] for r in files.groupBy("part").agg(F.sum("n_ids").alias("n")).collect()}
    starts, total = [], 0
    for part in sorted(sizes):
        starts.append((part, total))
        total += sizes[part]
    offsets = files.sparkSession.createDataFrame(starts, "part int, before long")
    rows = files.select("part", "payload").mapInArrow(run, "part int, doc_id long, at long, n_tokens long, ids_crc32 long")
    return rows.join(F.broadcast(offsets), "part").select("doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def encode(docs: DataFrame, path: str, end_id: int = END_ID) -> tuple[DataFrame, rans.Table]:
    """The files of docs and the table that they share."""
    tokens = stage(tokenize(docs, path, end_id), "token-ids", codec="none")
    counts = count_ids(tokens)
    if not counts.sum():
        counts[0] = 1
    coder = rans.Table.from_counts(counts)
    return write_files(tokens, coder), coder


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    files, coder = encode(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))
    return read_files(files, coder)
