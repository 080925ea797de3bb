"""Operator 3, media columns: TIFF pages in and out of binary columns.

`pages` emits a row for each page of each file; `store` keeps texts as 8-bit samples, ROW_BYTES wide, in one of
LAYOUTS (strips and tiles, all compressions, with and without a predictor), which the checksum of the
samples picks; `digests` gives the payload back from the stored bytes, and fails where it can't be read.

Defined results: a null or broken file gives one row, with its error and no pixels (pages before the
fault are kept); a file without a directory gives none; a null text counts as empty and is stored as
one row of filling; null and repeated doc_ids are kept row by row; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tiff
from .common import stage, table

ROW_BYTES = 576
FILL = 255
#: Compression, predictor and tile of the stored pages; most are deflated, as that is the smallest and fastest.
LAYOUTS = (
    (tiff.DEFLATE, 1, None), (tiff.DEFLATE, 2, None), (tiff.DEFLATE, 1, (16, 192)), (tiff.DEFLATE, 2, (32, 96)),
    (tiff.DEFLATE, 1, None), (tiff.LZW, 1, None), (tiff.PACKBITS, 2, (16, 192)), (tiff.PACKBITS, 1, None),
)
#: Output rows are handed over once they hold so many bytes.
FLUSH_BYTES = 16 << 20


def feature(pixels: bytes, width: int) -> str:
    """Mean, deviation, mean step along a row, and a histogram of 16 bins in thousandths, of a page's bytes."""
    data = np.frombuffer(pixels, np.uint8)
    if not len(data):
        return "empty"
    counts = np.bincount(data, minlength=256)
    values = np.arange(256)
    mean = float((counts * values).sum() / len(data))
    spread = float((counts * values * values).sum() / len(data)) - mean * mean
    line = data[: len(data) // width * width].reshape(-1, width) if width and len(data) % width == 0 else data.reshape(1, -1)
    step = float(np.abs(line[:, 1:].astype(np.int16) - line[:, :-1]).mean()) if line.shape[1] > 1 else 0.0
    bins = counts.reshape(16, 16).sum(1) * 1000 // len(data)
    return f"mean={mean:.3f};sd={max(0.0, spread) ** 0.5:.3f};step={step:.3f};hist={','.join(map(str, bins))}"


def _batches(rows: Iterator[tuple], schema: pa.Schema, weight: int) -> Iterator[pa.RecordBatch]:
    """Batches of rows of about FLUSH_BYTES; `weight`: the column whose bytes are counted."""
    held, size = [], 0

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)

    for row in rows:
        held.append(row)
        size += len(row[weight] or b"") + 100
        if size >= FLUSH_BYTES:
            yield batch()
            held, size = [], 0
    if held:
        yield batch()


PAGE_FIELDS = "page int, width int, height int, bits int, samples int, compression int, predictor int, pixels binary, feature string, error string"
_PAGE_ARROW = [*((n, pa.int32()) for n in ("page", "width", "height", "bits", "samples", "compression", "predictor")), ("pixels", pa.binary()), ("feature", pa.string()), ("error", pa.string())]


def pages(files: DataFrame, media: str = "media", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `carry` and PAGE_FIELDS: a row for each page of each file."""
    width = len(carry)

    def rows(batch: pa.RecordBatch) -> Iterator[tuple]:
        for *own, raw in zip(*(batch.column(k).to_pylist() for k in range(width)), batch.column(width)):
            raw, done = raw.as_py(), 0
            try:
                if raw is None:
                    raise tiff.TiffError("null")
                for p in tiff.pages(raw):
                    yield *own, p.number, p.width, p.height, p.bits, p.samples, p.compression, p.predictor, p.pixels, feature(p.pixels, p.width), None
                    done = p.number + 1
            except Exception as e:  # a broken file is a row, not a failed job
                yield *own, done, *[None] * 8, str(e) or type(e).__name__

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            schema = pa.schema([*(pa.field(f"c{k}", batch.schema.field(k).type) for k in range(width)), *_PAGE_ARROW])
            for out in _batches(rows(batch), schema, width + 7):
                yield out.rename_columns([f"c{k}" for k in range(width)] + [n for n, _ in _PAGE_ARROW])

    plain = files.select(*(F.col(c).alias(f"c{k}") for k, c in enumerate(carry)), F.col(media).cast("binary").alias("media"))
    fields = ", ".join(f"c{k} {plain.schema[k].dataType.simpleString()}" for k in range(width))
    return plain.mapInArrow(run, f"{fields}, {PAGE_FIELDS}").select(*(F.col(f"c{k}").alias(c) for k, c in enumerate(carry)), *(n for n, _ in _PAGE_ARROW))


def store(docs: DataFrame, layouts=LAYOUTS) -> DataFrame:
    """doc_id, n_bytes, media: each whole text, filled up, as a one-page file; equal texts give equal files."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for k, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                raw = text.as_py() or b""
                height = max(1, -(-len(raw) // ROW_BYTES))
                image = np.full(height * ROW_BYTES, FILL, np.uint8)
                image[: len(raw)] = np.frombuffer(raw, np.uint8)
                compression, predictor, tile = layouts[zlib.crc32(image) % len(layouts)]
                yield k, len(raw), tiff.write([image.reshape(height, ROW_BYTES, 1)], compression, predictor, tile=tile)

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return plain.mapInArrow(lambda b: _batches(rows(b), schema, 2), "doc_id long, n_bytes long, media binary")


def digests(stored: DataFrame) -> DataFrame:
    """What is read back from the stored bytes of each document."""
    sized = stored.withColumns({"media_bytes": F.length("media").cast("long"), "media_sha256": F.sha2("media", 256)})
    read = pages(sized, "media", ("doc_id", "n_bytes", "media_bytes", "media_sha256"))
    tail = F.substring("pixels", -32, 32)
    broken = F.raise_error(F.concat(F.lit("a stored page can't be read: "), "error"))
    read = read.withColumn("pixels", F.when(F.col("error").isNull(), F.col("pixels")).otherwise(broken.cast("binary")))
    return read.select("doc_id", "n_bytes", F.length("pixels").cast("long").alias("payload_bytes"), F.sha2("pixels", 256).alias("payload_sha256"), F.crc32(tail).alias("tail_crc32"), "media_bytes", "media_sha256", "feature")


def query(spark, sf_dir: str) -> DataFrame:
    stored = stage(store(table(spark, sf_dir, "documents")), "tiff", codec="none")
    return digests(stored)
