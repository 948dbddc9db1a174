"""The subpackage's queries and, where SQL can express them, their DuckDB text."""

from __future__ import annotations

from . import ann, bpe, chat, htmltext, langid, lexical, packing, quality, sharding, simhash, spelling, tokenfile, urlfilter

QUERIES = {
    "op1_power_of_two_packing": packing.query,
    "op2_html_layout_text": htmltext.query,
    "op3_simhash_near_dedup": simhash.query,
    "op4_hilbert_sharding": sharding.query,
    "op5_multiprobe_ann": ann.query,
    "op6_bpe_pair_index": bpe.query,
    "op7_byte_cnn_language": langid.query,
    "op8_quality_ledger": quality.query,
    "op9_url_link_trust": urlfilter.query,
    "op10_token_files": tokenfile.query,
    "op11_bit_sliced_search": lexical.query,
    "op12_spelling_variants": spelling.query,
    "op13_chat_windows": chat.query,
}

ORACLE_SQL = {"op8_quality_ledger": quality.SQL, "op11_bit_sliced_search": lexical.SQL, "op12_spelling_variants": spelling.SQL, "op13_chat_windows": chat.SQL}
