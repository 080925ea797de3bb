import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from graphloom.llm import sentencepiece_codec as sc

PATH = public_tokenizers.path(sc.MODEL)
CODEC = sc.Codec.load(PATH)


def varint(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def unigram():
    """The library's own Viterbi over the same pieces: the model with its type set to unigram."""
    out = b""
    for number, value in sc._fields(open(PATH, "rb").read()):
        if number == 2:
            kept = b""
            for k, v in _pairs(value):
                kept += varint(k << 3) + varint(1) if k == 3 else v
            value = kept
        out += varint(number << 3 | 2) + varint(len(value)) + value
    return sentencepiece.SentencePieceProcessor(model_proto=out)


def _pairs(raw):
    """(number, raw field) of a message."""
    at = 0
    while at < len(raw):
        start, key, shift = at, 0, 0
        while True:
            b = raw[at]
            at += 1
            key |= (b & 127) << shift
            shift += 7
            if b < 128:
                break
        if key & 7 == 0:
            while raw[at] > 127:
                at += 1
            at += 1
        elif key & 7 == 2:
            n = shift = 0
            while True:
                b = raw[at]
                at += 1
                n |= (b & 127) << shift
                shift += 7
                if b < 128:
                    break
            at += n
        else:
            at += 4 if key & 7 == 5 else 8
        yield key >> 3, raw[start:at]


LIBRARY = unigram()


def score(ids):
    return sum(CODEC.unknown_score if CODEC.kinds[i] == sc.BYTE else CODEC.scores[i] for i in ids)


def brute(s):
    """The best score over all segmentations, without an automaton."""
    known = {t: CODEC.scores[i] for i, t in enumerate(CODEC.texts) if CODEC.kinds[i] == sc.NORMAL}
    best = [0.0]
    for e in range(1, len(s) + 1):
        options = [best[a] + known[s[a:e]] for a in range(e) if s[a:e] in known]
        if s[e - 1] not in known:
            options.append(best[e - 1] + CODEC.unknown_score)
        best.append(max(options))
    return best[-1]


@pytest.mark.parametrize("text", ["the thing", "Hello, World! It's 2024.", "naïve Straße über", "日本語 テスト", "a", "thnttionwh erattionble ononha", "x=y+z;", "emoji 🙂 here", "tab\there"])
def test_like_the_librarys_viterbi(text):
    got = CODEC.whole(text)
    # the lattice's best path; the library's fast path takes a word that is a piece without a search
    assert got == LIBRARY.nbest_encode_as_ids(text, 2)[0]
    assert score(got) >= score(LIBRARY.encode(text))
    assert CODEC.decode(got) == text == LIBRARY.decode(got)


@settings(max_examples=200, deadline=None)
@given(st.text(st.one_of(st.sampled_from(list("  \n\tabcdeth.,é漢🙂▁")), st.characters(exclude_categories=["Cs"])), max_size=24))
def test_best_and_whole(text):
    (cut,) = CODEC.encode(pa.array([text]))
    s = ("▁" + text.replace(" ", "▁")) if text else ""
    assert cut.tolist() == CODEC.whole(text)
    back = b"".join(CODEC.back[i] for i in cut)
    assert back == s.replace("▁", " ").encode()
    if "▁" not in text:
        assert CODEC.decode(cut.tolist()) == text
    unknown = sum(c not in CODEC.singles for c in s)
    plain = sum(CODEC.scores[i] for i in cut if CODEC.kinds[i] == sc.NORMAL)
    assert plain + unknown * CODEC.unknown_score == pytest.approx(brute(s), abs=1e-6)


def test_documents(spark):
    texts = [None, "", " ", "a  b", "plain words here\nand a line", "\n\n", "long word " * 30_000, "same", "same", "é ​\x00"]
    df = spark.createDataFrame([(i if i else None, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    got = sorted(sc.round_trips(df, PATH).collect(), key=lambda r: r.doc_id or 0)
    for r, t in zip(got, texts):
        ids = CODEC.whole(t or "")
        assert (r.n_pieces, r.ids_crc32, r.round_trip) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), True)
        assert r.decoded_crc32 == zlib.crc32((t or "").encode())
    encoded = sc.encode(df, PATH)
    assert sorted((r.doc_id or 0, r.text) for r in sc.decode(encoded, PATH).collect()) == [(i, t or "") for i, t in enumerate(texts)]
    assert sc.round_trips(df.limit(0), PATH).count() == sc.encode(df.limit(0), PATH).count() == 0
