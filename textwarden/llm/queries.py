"""The registered queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from textwarden.llm import byte_bpe, centroids, jaccard_join, line_dedup, mixing, quality, token_files, tokenize_pieces, toxicity, url_filter, vector_codes, vector_search, warc

QUERIES = {
    "op1_top_k_search": vector_search.op1,
    "op2_url_filters": url_filter.op2,
    "op3_jaccard_join": jaccard_join.op3,
    "op4_quality_rules": quality.op4,
    "op5_warc": warc.op5,
    "op6_toxicity": toxicity.op6,
    "op7_sentencepiece": tokenize_pieces.op7,
    "op8_token_files": token_files.op8,
    "op9_mixing": mixing.op9,
    "op10_line_dedup": line_dedup.op10,
    "op11_vector_codes": vector_codes.op11,
    "op12_byte_bpe": byte_bpe.op12,
    "op13_centroids": centroids.op13,
}

ORACLES = {
    "op1_top_k_search": vector_search.SQL,
    "op2_url_filters": url_filter.SQL,
    "op4_quality_rules": quality.SQL,
    "op5_warc": warc.SQL,
    "op9_mixing": mixing.SQL,
    "op10_line_dedup": line_dedup.SQL,
    "op11_vector_codes": vector_codes.SQL,
    "op13_centroids": centroids.SQL,
}
