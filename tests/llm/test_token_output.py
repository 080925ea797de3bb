import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from graphloom.llm import rans, token_output

PATH = public_tokenizers.path(token_output.TOKENIZER)
PLAIN = Tokenizer.from_file(PATH)
ENCODER = token_output.Encoder(PATH)


def plain(text):
    return np.array(PLAIN.encode(text or "", add_special_tokens=False).ids, "<u4").tobytes()


def encoded(texts):
    return [x.astype("<u4").tobytes() for x in ENCODER.encode(pa.array(texts, pa.string()))]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text(st.one_of(st.sampled_from(list(" \n\t\r,.!?;:'’abcZé漢1٣  \x1c²Ⅷ_-<|>")), st.characters(exclude_categories=["Cs"])), max_size=30), max_size=4))
def test_encoder_is_the_librarys(texts):
    assert encoded(texts) == [plain(t) for t in texts]


def test_units():
    texts = ["a b", " a", "a ", "a  b", "a\n\nb", "\na\n", "don't we're", "x, y. z!", "日本 語", "ab́ c", "<|endoftext|> x", "naïve, Straße\nÜber", "a\r\nb", "ª, º.", "　x", ""]
    assert encoded(texts * 2) == [plain(t) for t in texts * 2]
    assert encoded([None, "a"]) == [b"", plain("a")]


def test_added_tokens_are_the_librarys():
    end = "<|endoftext|>"
    texts = [end, f"a {end} b", f"a{end}b", f"{end} a", f"a {end}", f"a\n{end}\nb", f"{end}{end}", f" {end}  {end} ", "<|endof text|>", f"x, {end}. y", f"{end[:-1]} {end[1:]}"]
    assert 50256 in ENCODER.encode(pa.array([f"a {end} b"]))[0].tolist()
    assert encoded(texts) == [plain(t) for t in texts]
    assert encoded([" ".join(texts), "a b"]) == [plain(" ".join(texts)), plain("a b")]


def coder_of(ids, size=300):
    return rans.Table.from_counts(np.bincount(ids, minlength=size))


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 16_384, 65_536, 65_537, 200_000])
@pytest.mark.parametrize("kind", ["skewed", "one", "even"])
def test_rans_round_trip(n, kind):
    rng = np.random.default_rng(n)
    ids = {"skewed": np.minimum(rng.geometric(0.2, n), 299), "one": np.full(n, 7), "even": rng.integers(0, 300, n)}[kind].astype(np.uint32)
    coder = coder_of(np.append(ids, 3))
    cut = n // 3
    raw = rans.encode_file([(5, ids[:cut]), (None, ids[cut:])], coder, 12)
    file = rans.File(raw, rans.Table.from_bytes(coder.bytes()))
    assert np.array_equal(file.ids(), ids) and file.first_id == 12
    assert file.docs.tolist() == [(1, 5, cut), (0, 0, n - cut)]
    at = 0
    for b, row in enumerate(file.blocks):
        for mark in range(len(file.marks[b][0])):
            assert np.array_equal(file.ids_from(b, mark), ids[at + mark * rans.CHECKPOINT * rans.LANES : at + row["n"]])
        at += row["n"]


def test_rans_is_near_the_entropy_and_sees_damage():
    ids = np.minimum(np.random.default_rng(2).geometric(0.05, 300_000), 299)
    p = np.bincount(ids) / len(ids)
    bits = -(p[p > 0] * np.log2(p[p > 0])).sum() * len(ids)
    coder = coder_of(ids)
    raw = bytearray(rans.encode_file([(1, ids)], coder, 0))
    assert len(raw) * 8 < 1.05 * bits
    raw[len(raw) // 2] ^= 1
    with pytest.raises(ValueError):
        rans.File(bytes(raw), coder)
    with pytest.raises(ValueError):
        rans.File(rans.encode_file([(1, ids)], coder, 0), coder_of(ids[:5]))


def test_table_keeps_rare_symbols():
    counts = np.zeros(60_000, np.int64)
    counts[0], counts[1:50_001] = 10**15, 1
    coder = rans.Table.from_counts(counts)
    assert coder.freq.sum() == 1 << rans.SCALE_BITS and (coder.freq[:50_001] >= 1).all() and not coder.freq[50_001:].any()


def test_documents(spark):
    texts = {3: "b c d", None: "null id", 1: None, 2: "", 2**53 + 1: "big", 10: "long word " * 20_000, 7: "same"}
    rows = [(k, t, k, "x") for k, t in texts.items()] + [(7, "same", 7, "x"), (7, "other", 7, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, start long, ids string")
    files, coder = token_output.encode(df, PATH)
    got = token_output.read_files(files, coder).collect()
    want, at = [], 0
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, zlib.crc32(plain(r[1]) + np.array([2], "<u4").tobytes())))
    for k, t, *_ in order:
        ids = plain(t) + np.array([2], "<u4").tobytes()
        want.append((k, at, len(ids) // 4, zlib.crc32(ids)))
        at += len(ids) // 4
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    files, coder = token_output.encode(df.limit(0), PATH)
    assert token_output.read_files(files, coder).count() == 0


def test_many_files(spark):
    df = spark.createDataFrame([(i, f"doc {i} " * (i % 50)) for i in range(500)], "doc_id long, text string")
    tokens = token_output.tokenize(df, PATH)
    coder = rans.Table.from_counts(token_output.count_ids(tokens))
    files = token_output.write_files(tokens, coder, file_ids=300)
    assert files.count() > 20
    got = sorted(token_output.read_files(files, coder).collect(), key=lambda r: r.doc_id)
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
