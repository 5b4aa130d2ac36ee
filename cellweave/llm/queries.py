"""The registered queries of this folder and their reference SQL."""

from __future__ import annotations

from . import (
    bitslice,
    gated_lm,
    lattice,
    line_dedup,
    mixture,
    oddsketch,
    packing,
    pii,
    prefix_trie,
    reference,
    secret_scan,
    toxicity,
    url_trust,
    va_clusters,
)

QUERIES = {
    "op1_url_trust": url_trust.query,
    "op2_gated_lm": gated_lm.query,
    "op3_bit_sliced_search": bitslice.query,
    "op4_lattice_dedup": lattice.query,
    "op5_genetic_packing": packing.query,
    "op6_odd_sketch_dedup": oddsketch.query,
    "op7_secret_scan": secret_scan.query,
    "op8_weak_supervision_pii": pii.query,
    "op9_toxicity": toxicity.query,
    "op10_source_mix": mixture.query,
    "op11_va_clusters": va_clusters.query,
    "op12_line_dedup": line_dedup.query,
    "op13_prefix_trie": prefix_trie.query,
}
SQL: dict[str, str] = {
    "op3_bit_sliced_search": reference.EXACT_SEARCH,
    "op4_lattice_dedup": reference.LATTICE_DEDUP,
    "op6_odd_sketch_dedup": reference.ODD_SKETCH_DEDUP,
    "op10_source_mix": mixture.SQL,
    "op11_va_clusters": va_clusters.SQL,
    "op12_line_dedup": line_dedup.SQL,
    "op13_prefix_trie": prefix_trie.SQL,
}
