"""All queries of this subpackage, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from cuelake.llm import bpe_automaton, decontamination, language_id, license_scan, near_duplicates, quality_divergence, sharding, toxicity, warc, wavelet_tokens

QUERIES = {
    "op1_boundary_chain": warc.op1_boundary_chain,
    "op2_latent_retrieval": decontamination.op2_latent_retrieval,
    "op3_signature_join": near_duplicates.op3_signature_join,
    "op9_diagonal_voting": license_scan.op9_diagonal_voting,
    "op10_nearest_centroid": language_id.op10_nearest_centroid,
    "op4_subsequence_kernel": toxicity.op4_subsequence_kernel,
    "op5_wavelet_shards": wavelet_tokens.op5_wavelet_shards,
    "op6_token_automaton": bpe_automaton.op6_token_automaton,
    "op7_distribution_divergence": quality_divergence.op7_distribution_divergence,
    "op8_jump_sharding": sharding.op8_jump_sharding,
}
ORACLES: dict[str, str] = {}
