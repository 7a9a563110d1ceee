"""The corpus operators' queries and their SQL, as __spark_entry__.py registers them."""

from __future__ import annotations

from . import chat, collocations, decontaminate, fim, licenses, lm, media, packing, pii, quality, simhash, token_counts, url_filter

QUERIES = {
    "op1_url_filter": url_filter.op1_url_filter,
    "op2_simhash": simhash.op2_simhash,
    "op3_chat": chat.op3_chat,
    "op4_decontaminate": decontaminate.op4_decontaminate,
    "op5_media": media.op5_media,
    "op6_pii": pii.op6_pii,
    "op7_packing": packing.op7_packing,
    "op8_quality": quality.op8_quality,
    "op9_lm": lm.op9_lm,
    "op10_token_counts": token_counts.op10_token_counts,
    "op11_fim": fim.op11_fim,
    "op12_licenses": licenses.op12_licenses,
    "op13_collocations": collocations.op13_collocations,
}

ORACLE = {
    "op1_url_filter": url_filter.OP1_SQL,
    "op3_chat": chat.OP3_SQL,
    "op4_decontaminate": decontaminate.OP4_SQL,
    "op11_fim": fim.OP11_SQL,
    "op13_collocations": collocations.OP13_SQL,
}
