"""Queries of the corpus operators and the SQL that some of them can be held against."""

from __future__ import annotations

from ledgerlens.llm import centroids, collocations, decontamination, hnsw, line_dedup, packing, quality, simhash, suffix_dedup, suffix_tree_lm, telephony, token_counts, unigram

QUERIES = {
    "op1_suffix_dedup": suffix_dedup.op1_suffix_dedup,
    "op2_hnsw": hnsw.op2_hnsw,
    "op3_telephony": telephony.op3_telephony,
    "op4_sentencepiece": unigram.op4_sentencepiece,
    "op5_quality": quality.op5_quality,
    "op6_simhash": simhash.op6_simhash,
    "op7_suffix_tree": suffix_tree_lm.op7_suffix_tree,
    "op8_line_dedup": line_dedup.op8_line_dedup,
    "op9_packing": packing.op9_packing,
    "op10_token_counts": token_counts.op10_token_counts,
    "op11_collocations": collocations.op11_collocations,
    "op12_decontamination": decontamination.op12_decontamination,
    "op13_centroids": centroids.op13_centroids,
}

ORACLES = {
    "op8_line_dedup": line_dedup.OP8_SQL,
    "op11_collocations": collocations.OP11_SQL,
    "op12_decontamination": decontamination.OP12_SQL,
    "op13_centroids": centroids.OP13_SQL,
}
