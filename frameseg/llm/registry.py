"""Queries of this package by name, and their SQL."""

from __future__ import annotations

from . import chat, hnsw, htmltext, linededup, minhash, mixing, multiindex, packing, toxicity, warc


def queries() -> dict:
    return {f.__name__: f for f in (hnsw.op1_embedding_dedup, mixing.op2_mixing, warc.op3_warc, htmltext.op4_htmltext, multiindex.op5_multiindex, chat.op6_chat, toxicity.op7_toxicity, packing.op8_packing, linededup.op9_linededup, minhash.op10_minhash)}


def oracle_sql() -> dict:
    return {"op2_mixing": mixing.SQL, "op3_warc": warc.SQL, "op9_linededup": linededup.SQL}
