"""Queries of the training-data operators."""

from __future__ import annotations

from candlewick.llm import chunk_bpe, hard_negatives, knn_join, near_dedup, parity_join, quote_linking, token_rollups, warc
from candlewick.llm.best_fit_packing import op6_best_fit_packing
from candlewick.llm.knn_join import op5_voronoi_knn
from candlewick.llm.language_id import op3_language_bitmask
from candlewick.llm.near_dedup import op9_superminhash_dedup
from candlewick.llm.ngram_perplexity import op1_ngram_perplexity
from candlewick.llm.quality_classifier import op7_subword_quality
from candlewick.llm.whitening import op11_bitsliced_whitening

QUERIES: dict = {
    "op1_ngram_perplexity": op1_ngram_perplexity,
    "op2_warc_chain": warc.op2_warc_chain,
    "op3_language_bitmask": op3_language_bitmask,
    "op4_chunk_bpe": chunk_bpe.op4_chunk_bpe,
    "op5_voronoi_knn": op5_voronoi_knn,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op7_subword_quality": op7_subword_quality,
    "op8_quote_linking": quote_linking.op8_quote_linking,
    "op9_superminhash_dedup": op9_superminhash_dedup,
    "op10_token_rollups": token_rollups.op10_token_rollups,
    "op11_bitsliced_whitening": op11_bitsliced_whitening,
    "op12_hilbert_negatives": hard_negatives.op12_hilbert_negatives,
    "op13_parity_jaccard": parity_join.op13_parity_jaccard,
}

ORACLES: dict = {
    "op2_warc_chain": warc.ORACLE,
    "op5_voronoi_knn": knn_join.ORACLE,
    "op8_quote_linking": quote_linking.ORACLE,
    "op9_superminhash_dedup": near_dedup.ORACLE,
    "op10_token_rollups": token_rollups.ORACLE,
    "op12_hilbert_negatives": hard_negatives.ORACLE,
    "op13_parity_jaccard": parity_join.ORACLE,
}
