"""The queries of this package and their SQL."""

from __future__ import annotations

from . import ann, chat, decontaminate, jaccard, langid, linedup, merkle, mixing, phrases, quality, sharding, urlfilter, warc

QUERIES = {
    "op1_quality": quality.op1_quality,
    "op2_decontamination": decontaminate.op2_decontamination,
    "op3_jaccard_join": jaccard.op3_jaccard_join,
    "op4_chat_formatting": chat.op4_chat_formatting,
    "op5_ann": ann.op5_ann,
    "op6_line_dedup": linedup.op6_line_dedup,
    "op7_sharding": sharding.op7_sharding,
    "op8_mixing": mixing.op8_mixing,
    "op9_warc": warc.op9_warc,
    "op10_url_filters": urlfilter.op10_url_filters,
    "op11_merkle": merkle.op11_merkle,
    "op12_phrases": phrases.op12_phrases,
    "op13_language_id": langid.op13_language_id,
}

ORACLES = {
    "op4_chat_formatting": chat.OP4_SQL,
    "op8_mixing": mixing.OP8_SQL,
    "op9_warc": warc.OP9_SQL,
    "op10_url_filters": urlfilter.OP10_SQL,
    "op11_merkle": merkle.OP11_SQL,
    "op12_phrases": phrases.OP12_SQL,
}
