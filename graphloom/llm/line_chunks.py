"""Operator 6, line dedup: runs of lines, removed where they repeat in the corpus.

Two kinds of runs are compared. Content-defined chunks: a rolling hash over the last WINDOW line
hashes sets a boundary, so the same passage is cut alike wherever it stands; a chunk of two lines or
more counts, however few words it has. Least runs: from each line on, and up to each line, the
shortest run of LONG_WORDS words or more. Any repeated run of lines with that many words is the union
of the least runs within it, so all of its lines are found, wherever it begins and ends.
The first occurrence (lowest doc_id, then position) stays; the others go once their bytes were found
equal to the first's. Where an occurrence overlaps the first one in its own text, only the lines
after that one go.

Steps: the runs' hashes (no text) are staged and counted; of the repeated runs in each document a few
that cover the same lines are chosen, and the first occurrences' texts are taken out for these alone;
each document gets the texts that its runs should equal, compares and cuts. Hot runs are counted with
partial aggregation; the joins on a run's hash and on a document are plain equi-joins that adaptive
execution can split.

Defined results: a null text stays null; an empty one stays empty; a null doc_id comes first; rows
alike in doc_id and text are treated alike; a least run begins and ends with a line that has a word,
so blank lines beside a passage, or between lines of LONG_WORDS words, stay; other columns are not
read by `dedup`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import boxed, digest, stage, table, unboxed

WINDOW = 2
#: A boundary comes after one line in MEAN_LINES on average, and after MOST_LINES at the latest.
MEAN_LINES, LEAST_LINES, MOST_LINES = 4, 2, 64
LONG_WORDS = 50
_MASK = (1 << 64) - 1
_FLUSH = 16 << 20


def _line_hash(line: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(line, digest_size=8).digest(), "little")


def chunks(lines: list[bytes]) -> list[tuple[int, int]]:
    """(first line, line after the last) of each chunk."""
    out, start, roll, held = [], 0, 0, [0] * WINDOW
    for i, line in enumerate(lines):
        if len(line) >= 2 * LONG_WORDS - 1 and len(line.split()) >= LONG_WORDS:
            if start < i:
                out.append((start, i))
            out.append((i, i + 1))
            start, roll, held = i + 1, 0, [0] * WINDOW
            continue
        h = _line_hash(line)
        gone = held[i % WINDOW]
        held[i % WINDOW] = h
        roll = ((roll << 1) | (roll >> 63)) & _MASK
        roll ^= h ^ (((gone << WINDOW) | (gone >> (64 - WINDOW))) & _MASK)
        n = i + 1 - start
        if n >= MOST_LINES or (n >= LEAST_LINES and (roll * 0x9E3779B97F4A7C15 & _MASK) >> 32 < (1 << 32) // MEAN_LINES):
            out.append((start, i + 1))
            start = i + 1
    if start < len(lines):
        out.append((start, len(lines)))
    return out


def least_runs(words: list[int]) -> set[tuple[int, int]]:
    """(first line, line after the last) of the shortest runs of LONG_WORDS words from each line on and up to each line that has a word."""
    at = [i for i, n in enumerate(words) if n]
    out, end, held = set(), 0, 0
    for i in at:
        while end < len(at) and held < LONG_WORDS:
            held += words[at[end]]
            end += 1
        if held < LONG_WORDS:
            break
        out.add((i, at[end - 1] + 1))
        held -= words[i]
    start, held = 0, 0
    for j in at:
        held += words[j]
        while held - words[at[start]] >= LONG_WORDS:
            held -= words[at[start]]
            start += 1
        if held >= LONG_WORDS:
            out.add((at[start], j + 1))
    return out


def runs(lines: list[bytes]) -> list[tuple[int, int]]:
    """(first line, line after the last) of the runs that are compared, in order."""
    return sorted(least_runs([len(x.split()) for x in lines]).union((a, b) for a, b in chunks(lines) if b - a > 1))


def hashed_runs(text: bytes) -> Iterator[tuple[int, int, int, bytes, bytes]]:
    """(number, first line, line after the last, bytes, hash) of the runs that are compared.

    The lines are those that go if the run isn't the first of its bytes: without those of the first in this text.
    """
    lines, ends = text.split(b"\n"), {}
    for k, (a, b) in enumerate(runs(lines)):
        raw = b"\n".join(lines[a:b])
        h = hash_of(raw)
        end = ends.setdefault(h, b)
        yield k, (a if end == b else max(a, end)), b, raw, h


def counted_chunks(text: bytes) -> Iterator[tuple[int, int, int, bytes]]:
    """hashed_runs() without hashes."""
    return (x[:4] for x in hashed_runs(text))


def hash_of(raw: bytes) -> bytes:
    return hashlib.blake2b(raw, digest_size=16).digest()


def chunk_hashes(docs: DataFrame) -> DataFrame:
    """doc_id, digest, number, lines (see hashed_runs) and hash of each run that is compared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, numbers, starts, ends, hashes = [], [], [], [], []
            for k, text in enumerate(batch.column("text")):
                for number, a, b, _, h in hashed_runs(text.as_py() or b""):
                    at.append(k)
                    numbers.append(number)
                    starts.append(a)
                    ends.append(b)
                    hashes.append(h)
            own = batch.select(["doc_id", "digest"]).take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([*own.columns, *(pa.array(x, pa.int32()) for x in (numbers, starts, ends)), pa.array(hashes, pa.binary())], ["doc_id", "digest", "number", "start", "end", "h"])

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), digest().alias("digest"), F.col("text").cast("binary").alias("text"))
    return plain.mapInArrow(run, "doc_id long, digest binary, number int, start int, end int, h binary")


def _same_row(doc_id: str, digest_name: str) -> Column:
    return F.col("doc_id").eqNullSafe(F.col(doc_id)) & (F.col("digest") == F.col(digest_name))


def _lists(rows: DataFrame, entry: Column) -> DataFrame:
    """for_id, for_digest, entries: a row for each document; it has as many entries as runs at most."""
    return rows.groupBy(F.col("doc_id").alias("for_id"), F.col("digest").alias("for_digest")).agg(F.collect_set(entry).alias("entries"))


def first_texts(docs: DataFrame, firsts: DataFrame) -> DataFrame:
    """h and the bytes of the first occurrence of each run in firsts."""
    wanted = _lists(firsts, F.struct("number", "h"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), digest().alias("digest"), F.col("text").cast("binary").alias("text"))
    joined = rows.join(wanted, _same_row("for_id", "for_digest")).select("text", "entries")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, texts, size = [], [], 0
            for text, entries in zip(batch.column("text"), batch.column("entries")):
                want = {e["number"]: e["h"] for e in entries.as_py()}
                lines = (text.as_py() or b"").split(b"\n")
                for number, (a, b) in enumerate(runs(lines)):
                    if number in want:
                        hashes.append(want[number])
                        texts.append(b"\n".join(lines[a:b]))
                        size += len(texts[-1])
                if size > _FLUSH:
                    yield pa.RecordBatch.from_arrays([pa.array(hashes, pa.binary()), pa.array(texts, pa.binary())], ["h", "chunk"])
                    hashes, texts, size = [], [], 0
            yield pa.RecordBatch.from_arrays([pa.array(hashes, pa.binary()), pa.array(texts, pa.binary())], ["h", "chunk"])

    # rows alike in doc_id and text give one text
    return joined.mapInArrow(run, "h binary, chunk binary").groupBy("h").agg(F.first("chunk").alias("chunk"))


def _cut(text: bytes, want: dict[int, bytes]) -> tuple[bytes, int, int]:
    """The text without the runs whose bytes equal the wanted ones, the runs and the lines removed."""
    gone, lines = [], text.split(b"\n")
    for number, a, b, raw in counted_chunks(text):
        if want.get(number) == raw:
            gone.append((a, b))
    left, at = [], 0
    for a, b in sorted(gone):
        left += lines[at:a]
        at = max(at, b)
    left += lines[at:]
    return b"\n".join(left), len(gone), len(lines) - len(left)


def cover(entries: list[dict]) -> list[dict]:
    """Entries, of which no line is in more than two, that hold the same lines as all."""
    out, reach, best = [], 0, None
    for e in sorted(entries, key=lambda e: (e["start"], e["number"])):
        if best is not None and e["start"] > reach:
            out.append(best)
            reach, best = best["end"], None
        if e["start"] > reach:
            reach = e["start"]
        if e["end"] > (reach if best is None else best["end"]):
            best = e
    return out if best is None else [*out, best]


def chosen_runs(later: DataFrame) -> DataFrame:
    """doc_id, digest, number, h: of the runs in later, those that cover() takes in each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, numbers, hashes = [], [], []
            for k, entries in enumerate(batch.column("entries")):
                for e in cover(entries.as_py()):
                    at.append(k)
                    numbers.append(e["number"])
                    hashes.append(e["h"])
            own = batch.select(["for_id", "for_digest"]).take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([*own.columns, pa.array(numbers, pa.int32()), pa.array(hashes, pa.binary())], ["doc_id", "digest", "number", "h"])

    return _lists(later, F.struct("number", "start", "end", "h")).mapInArrow(run, "doc_id long, digest binary, number int, h binary")


def _repeats(docs: DataFrame) -> DataFrame:
    """for_id, for_digest, entries (number, chunk): what each document may lose."""
    held = stage(chunk_hashes(docs), "chunks")
    seen = held.groupBy("h").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "digest", "number")).alias("first"))
    repeated = stage(seen.where("n > 1").select(F.col("h").alias("rh"), F.col("first.doc_id").alias("rid"), F.col("first.digest").alias("rdigest"), F.col("first.number").alias("rnumber")), "repeated")
    own = F.col("doc_id").eqNullSafe(F.col("rid")) & (F.col("digest") == F.col("rdigest")) & (F.col("number") == F.col("rnumber"))
    later = held.join(repeated, F.col("h") == F.col("rh")).where(~own).select("doc_id", "digest", "number", "start", "end", "h")
    chosen = stage(chosen_runs(later), "chosen")
    firsts = repeated.join(chosen.select("h").distinct(), F.col("rh") == F.col("h"), "left_semi")
    firsts = firsts.select(F.col("rid").alias("doc_id"), F.col("rdigest").alias("digest"), F.col("rnumber").alias("number"), F.col("rh").alias("h"))
    texts = stage(first_texts(docs, firsts).withColumnRenamed("h", "th"), "first-texts")
    # one table by hash, so that a single join meets the runs and its hot hashes can be split
    found = chosen.join(texts, F.col("h") == F.col("th")).select("doc_id", "digest", "number", "chunk")
    return _lists(found, F.struct("number", "chunk"))


def _deduped(docs: DataFrame, keep_rows: bool) -> DataFrame:
    carried = boxed(docs, "doc_id", "text", without=("text",)) if keep_rows else docs.select("doc_id", "text")
    rows = carried.select(*(["row_box"] if keep_rows else []), F.col("doc_id").cast("long").alias("doc_id"), digest().alias("digest"), F.col("text").cast("binary").alias("text"))
    joined = rows.join(_repeats(docs), _same_row("for_id", "for_digest"), "left").drop("for_id", "for_digest", "digest")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, n_lines, n_chunks, n_gone = [], [], [], []
            for text, entries in zip(batch.column("text"), batch.column("entries")):
                raw, want = text.as_py(), entries.as_py()
                left, k, gone = _cut(raw, {e["number"]: e["chunk"] for e in want}) if raw is not None and want else (raw, 0, 0)
                texts.append(left)
                n_lines.append(0 if not raw else raw.count(b"\n") + 1)
                n_chunks.append(k)
                n_gone.append(gone)
            own = [n for n in batch.schema.names if n not in ("text", "entries")]
            made = [pa.array(texts, pa.binary()).cast(pa.string()), *(pa.array(x, pa.int64()) for x in (n_lines, n_chunks, n_gone))]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in own), *made], [*own, "text", "n_lines", "removed_chunks", "removed_lines"])

    box = f"row_box {rows.schema['row_box'].dataType.simpleString()}, " if keep_rows else ""
    return joined.mapInArrow(run, f"{box}doc_id long, text string, n_lines long, removed_chunks long, removed_lines long")


def dedup(docs: DataFrame) -> DataFrame:
    """doc_id, text (without repeats), n_lines, removed_chunks, removed_lines of each row."""
    return _deduped(docs, False)


def rewrite(docs: DataFrame) -> DataFrame:
    """docs with repeats taken out of `text`, and `n_chars` brought up to date where there is one."""
    new = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType)
    return unboxed(_deduped(docs, True), docs.columns, **new)


def query(spark, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents"))
