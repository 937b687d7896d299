"""The queries of this subpackage and, where SQL expresses them, their SQL."""

from . import automata, byte_bpe, exact, langid, packing, pseudonyms, simhash, suffix_levels, syncmers, token_output

QUERIES = {
    "op1_language_id": langid.op1_language_id,
    "op2_simhash_dedup": simhash.op2_simhash_dedup,
    "op3_best_fit_packing": packing.op3_best_fit_packing,
    "op4_exact_dedup": exact.op4_exact_dedup,
    "op5_token_matrices": token_output.op5_token_matrices,
    "op6_suffix_dedup": suffix_levels.op6_suffix_dedup,
    "op7_syncmer_fingerprints": syncmers.op7_syncmer_fingerprints,
    "op8_pii_pseudonyms": pseudonyms.op8_pii_pseudonyms,
    "op9_substring_dedup": automata.op9_substring_dedup,
    "op10_byte_bpe": byte_bpe.op10_byte_bpe,
}
ORACLES = {
    "op4_exact_dedup": exact.OP4_SQL,
}
