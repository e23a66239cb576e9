"""Queries of this subpackage and their SQL, for the entry module."""

from __future__ import annotations

from . import ann, lexical, linededup, media, minhash, mixing, packing, quality, secretscan, sharding, suffixes, tokens, trie

QUERIES = {
    "op1_line_dedup": linededup.op1_line_dedup,
    "op2_minhash_dedup": minhash.op2_minhash_dedup,
    "op3_token_pack": tokens.op3_token_pack,
    "op4_bestfit_pack": packing.op4_bestfit_pack,
    "op5_ann_search": ann.op5_ann_search,
    "op6_mixture": mixing.op6_mixture,
    "op7_media_columns": media.op7_media_columns,
    "op8_suffix_dedup": suffixes.op8_suffix_dedup,
    "op9_quality": quality.op9_quality,
    "op10_sharding": sharding.op10_sharding,
    "op11_prefix_trie": trie.op11_prefix_trie,
    "op12_lexical_search": lexical.op12_lexical_search,
    "op13_secret_scan": secretscan.op13_secret_scan,
}

ORACLE_SQL = {
    "op1_line_dedup": linededup.SQL_OP1,
    "op10_sharding": sharding.SQL_OP10,
    "op11_prefix_trie": trie.SQL_OP11,
    "op12_lexical_search": lexical.SQL_OP12,
    "op13_secret_scan": secretscan.SQL_OP13,
}
