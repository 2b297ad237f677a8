"""The queries of the training-data operators and their SQL."""

from __future__ import annotations

from . import byte_bpe, chat_format, collocations, decontaminate, lang_id, line_dedup, mixing, ranked_search, search, simhash, token_count, url_filter, warc

QUERIES = {
    "op1_line_dedup": line_dedup.op1_line_dedup,
    "op2_url_filter": url_filter.op2_url_filter,
    "op3_source_mixing": mixing.op3_source_mixing,
    "op4_exact_search": search.op4_exact_search,
    "op5_warc_revisits": warc.op5_warc_revisits,
    "op6_chat_format": chat_format.op6_chat_format,
    "op7_token_counts": token_count.op7_token_counts,
    "op8_language_id": lang_id.op8_language_id,
    "op9_decontamination": decontaminate.op9_decontamination,
    "op10_simhash_near_dedup": simhash.op10_simhash_near_dedup,
    "op11_collocations": collocations.op11_collocations,
    "op12_byte_bpe": byte_bpe.op12_byte_bpe,
    "op13_ranked_search": ranked_search.op13_ranked_search,
}

ORACLES = {
    "op1_line_dedup": line_dedup.ORACLE,
    "op2_url_filter": url_filter.ORACLE,
    "op4_exact_search": search.ORACLE,
    "op5_warc_revisits": warc.ORACLE,
    "op6_chat_format": chat_format.ORACLE,
    "op11_collocations": collocations.ORACLE,
    "op13_ranked_search": ranked_search.ORACLE,
}
