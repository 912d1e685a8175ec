"""The corpus queries and their SQL, by name."""

from . import embed_dedup, fingerprint, jaccard, langid, mixing, pieces, quality_mil, secrets, suffix_tree, surrogates

QUERIES = {
    "op1_secret_ownership": secrets.op1_query,
    "op2_bottom_k_fingerprints": fingerprint.op2_query,
    "op3_embedding_duplicates": embed_dedup.op3_query,
    "op4_suffix_tree_scores": suffix_tree.op4_query,
    "op10_language_evidence": langid.op10_query,
    "op9_passage_quality": quality_mil.op9_query,
    "op8_piece_paths": pieces.op8_query,
    "op5_entity_surrogates": surrogates.op5_query,
    "op6_mix_sources": mixing.op6_query,
    "op7_jaccard_groups": jaccard.op7_query,
}

ORACLE_SQL = {
    "op1_secret_ownership": secrets.OP1_SQL,
    "op6_mix_sources": mixing.OP6_SQL,
}
