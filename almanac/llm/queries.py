"""The subpackage's queries and, where SQL can express them, their oracles."""

from __future__ import annotations

from almanac.llm import centroids, chat, decontaminate, html, langid, mixing, pieces, pii, quality, simhash, substrings, warc, whitening

QUERIES = {
    "op5_substrings": substrings.op5_substrings,
    "op9_chat": chat.op9_chat,
    "op4_warc": warc.op4_warc,
    "op2_html": html.op2_html,
    "op7_language": langid.op7_language,
    "op6_pii": pii.op6_pii,
    "op8_mixing": mixing.op8_mixing,
    "op1_simhash": simhash.op1_simhash,
    "op3_quality": quality.op3_quality,
    "op10_decontamination": decontaminate.op10_decontamination,
    "op11_whitening": whitening.op11_whitening,
    "op12_pieces": pieces.op12_pieces,
    "op13_centroids": centroids.op13_centroids,
}

ORACLES = {
    "op9_chat": chat.SQL,
    "op4_warc": warc.SQL,
    "op10_decontamination": decontaminate.SQL,
    "op13_centroids": centroids.SQL,
}
