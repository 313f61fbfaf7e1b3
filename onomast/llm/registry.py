"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from onomast.llm import bpe, langid, media, mixing, quality, simhash, token_files, training_order, urls, warc

QUERIES = {
    "op1_simhash": simhash.query,
    "op2_media": media.query,
    "op3_mixing": mixing.query,
    "op4_bpe": bpe.query,
    "op5_langid": langid.query,
    "op6_training_order": training_order.query,
    "op7_warc": warc.query,
    "op8_token_counts": token_files.query,
    "op9_urls": urls.query,
    "op10_quality": quality.query,
}

SQL = {
    "op3_mixing": mixing.SQL,
    "op7_warc": warc.SQL,
}
