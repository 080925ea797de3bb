"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from . import line_chunks, line_frequency, media_tiff, mixing, near_duplicates, quality_qda, secret_scan, sentencepiece_codec, token_output, url_filter

QUERIES = {
    "op1_quality_qda": quality_qda.query,
    "op2_rans_tokens": token_output.query,
    "op3_tiff_media": media_tiff.query,
    "op4_url_ngrams": url_filter.query,
    "op5_secret_battery": secret_scan.query,
    "op6_line_chunks": line_chunks.query,
    "op7_mixing": mixing.query,
    "op8_line_frequency": line_frequency.query,
    "op9_prob_minhash": near_duplicates.query,
    "op10_sentencepiece": sentencepiece_codec.query,
}


def oracles() -> dict[str, str]:
    """The SQL of the queries that have one. That of the URL filter holds the trained weights, so it is made when it is asked for."""
    return {"op4_url_ngrams": url_filter.oracle(), "op7_mixing": mixing.ORACLE, "op8_line_frequency": line_frequency.ORACLE}
