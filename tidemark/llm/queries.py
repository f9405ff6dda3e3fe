"""The corpus queries and, where SQL can express them, their DuckDB counterparts."""

from __future__ import annotations

from . import divergence, langid, lines, media, mixing, near_vectors, neighbours, ngram_join, oracles, packing, sharding, spelling, suffix_dedup, warc

QUERIES = {
    "op10_warc_chunked": warc.op10,
    "op8_hierarchical_packing": packing.op8,
    "op4_pivotal_mixing": mixing.op4,
    "op3_label_propagation": sharding.op3,
    "op7_embedding_near_dedup": near_vectors.op7,
    "op6_ivf_pq": neighbours.op6,
    "op9_language_id": langid.op9,
    "op2_line_dedup": lines.op2,
    "op5_ngram_jaccard_join": ngram_join.op5,
    "op1_suffix_array_dedup": suffix_dedup.op1,
    "op11_wav_fingerprints": media.op11,
    "op12_spelling_variants": spelling.op12,
    "op13_source_divergence": divergence.op13,
}
ORACLES = {
    "op10_warc_chunked": warc.ORACLE,
    "op2_line_dedup": oracles.LINES,
    "op5_ngram_jaccard_join": oracles.NGRAMS,
    "op7_embedding_near_dedup": oracles.VECTORS,
    "op12_spelling_variants": oracles.SPELLING,
    "op13_source_divergence": oracles.DIVERGENCE,
}
