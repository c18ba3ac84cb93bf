"""The queries of this folder by name, and DuckDB SQL for those that it can express."""

from . import chat, decontam, html, langid, linedup, media, mixing, sharding, simhash, tokens, trie, urlfilter, vectorcodes

QUERIES = {
    "op1_token_ids": tokens.op1_token_ids,
    "op2_decontamination": decontam.op2_decontamination,
    "op3_html_text": html.op3_html_text,
    "op4_language_id": langid.op4_language_id,
    "op5_line_dedup": linedup.op5_line_dedup,
    "op6_mixing": mixing.op6_mixing,
    "op7_url_filter": urlfilter.op7_url_filter,
    "op8_media": media.op8_media,
    "op9_preference_format": chat.op9_preference_format,
    "op10_simhash": simhash.op10_simhash,
    "op11_sharding": sharding.op11_sharding,
    "op12_prefix_trie": trie.op12_prefix_trie,
    "op13_vector_codes": vectorcodes.op13_vector_codes,
}

ORACLE: dict[str, str] = {
    "op6_mixing": mixing.ORACLE,
    "op7_url_filter": urlfilter.ORACLE,
    "op9_preference_format": chat.ORACLE,
    "op11_sharding": sharding.ORACLE,
    "op12_prefix_trie": trie.ORACLE,
    "op13_vector_codes": vectorcodes.ORACLE,
}
