"""The operators' queries and, where SQL can express them, their oracles."""

from __future__ import annotations

from . import bpe, chat, extract, langid, linededup, neardup, ngramjoin, packing, prefixtrie, quality, resample, sharding, simhash

QUERIES = {
    "op1_byte_bpe": bpe.op1_byte_bpe,
    "op2_simhash": simhash.op2_simhash,
    "op3_dom_boosting": extract.op3_dom_boosting,
    "op4_concat_packing": packing.op4_concat_packing,
    "op5_superminhash": neardup.op5_superminhash,
    "op6_prefix_tree_chat": chat.op6_prefix_tree_chat,
    "op7_compression_langid": langid.op7_compression_langid,
    "op8_mcd_quality": quality.op8_mcd_quality,
    "op9_line_dedup": linededup.op9_line_dedup,
    "op10_hash_tree_sharding": sharding.op10_hash_tree_sharding,
    "op11_ngram_jaccard_join": ngramjoin.op11_ngram_jaccard_join,
    "op12_importance_resampling": resample.op12_importance_resampling,
    "op13_prefix_trie": prefixtrie.op13_prefix_trie,
}

ORACLES = {
    "op5_superminhash": neardup.ORACLE,
    "op6_prefix_tree_chat": chat.ORACLE,
    "op9_line_dedup": linededup.ORACLE,
    "op10_hash_tree_sharding": sharding.oracle(),
    "op11_ngram_jaccard_join": ngramjoin.oracle(),
    "op12_importance_resampling": resample.ORACLE,
    "op13_prefix_trie": prefixtrie.ORACLE,
}
