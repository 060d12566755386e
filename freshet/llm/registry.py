"""The corpus queries and their SQL."""

from __future__ import annotations

from . import collocations, fingerprints, license_scan, line_dedup, mixing, ngram_join, periodic_runs, piece_codec, quality_model, quality_rules, sharding, token_counts, toxicity

QUERIES = {
    "op1_token_counts": token_counts.op1_token_counts,
    "op2_ngram_jaccard": ngram_join.op2_ngram_jaccard,
    "op3_sentencepiece": piece_codec.op3_sentencepiece,
    "op4_mixing": mixing.op4_mixing,
    "op5_line_dedup": line_dedup.op5_line_dedup,
    "op6_quality_classifier": quality_model.op6_quality_classifier,
    "op7_fingerprints": fingerprints.op7_fingerprints,
    "op8_quality_rules": quality_rules.op8_quality_rules,
    "op9_sharding": sharding.op9_sharding,
    "op10_toxicity": toxicity.op10_toxicity,
    "op11_periodic_runs": periodic_runs.op11_periodic_runs,
    "op12_collocations": collocations.op12_collocations,
    "op13_license_scan": license_scan.op13_license_scan,
}
ORACLES = {
    "op2_ngram_jaccard": ngram_join.OP2_SQL,
    "op5_line_dedup": line_dedup.OP5_SQL,
    "op8_quality_rules": quality_rules.OP8_SQL,
    "op12_collocations": collocations.OP12_SQL,
}
