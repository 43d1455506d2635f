"""The queries of this subpackage and, where SQL can express them, their oracles."""

from __future__ import annotations

from loomline.llm import automaton, ball_kmeans, exact_dedup, html_main, mixing, packing, repetition, sharding, simhash, surrogates, tiered, warc, wavelet

QUERIES = {
    "op1_exact_dedup": exact_dedup.op1_exact_dedup,
    "op2_repetition": repetition.op2_repetition,
    "op3_label_propagation": sharding.op3_label_propagation,
    "op4_mix_sources": mixing.op4_mix_sources,
    "op5_pack": packing.op5_pack,
    "op6_surrogates": surrogates.op6_surrogates,
    "op7_simhash": simhash.op7_simhash,
    "op8_wavelet": wavelet.op8_wavelet,
    "op9_html_main": html_main.op9_html_main,
    "op10_warc": warc.op10_warc,
    "op11_tiered_search": tiered.op11_tiered_search,
    "op12_bpe_automaton": automaton.op12_bpe_automaton,
    "op13_ball_kmeans": ball_kmeans.op13_ball_kmeans,
}
ORACLES = {"op1_exact_dedup": exact_dedup.ORACLE_SQL, "op2_repetition": repetition.ORACLE_SQL, "op9_html_main": html_main.ORACLE_SQL, "op10_warc": warc.ORACLE_SQL, "op11_tiered_search": tiered.ORACLE_SQL, "op13_ball_kmeans": ball_kmeans.ORACLE_SQL}
