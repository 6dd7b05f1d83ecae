"""The registered queries of the corpus operators and the SQL that checks them."""

from __future__ import annotations

from . import ann, exact_dedup, jaccard, langid, lm_ppm, mixing, packing, pii, toxicity, warc

QUERIES = {
    "op1_mix_sources": mixing.query,
    "op2_exact_dedup": exact_dedup.query,
    "op3_lm_score": lm_ppm.query,
    "op4_pack_best_fit": packing.query,
    "op5_ann_one_bit": ann.query,
    "op6_pii_boosted": pii.query,
    "op7_language_id": langid.query,
    "op8_warc": warc.query,
    "op9_toxicity": toxicity.query,
    "op10_ngram_jaccard_join": jaccard.query,
}

ORACLES: dict[str, str] = {
    "op2_exact_dedup": exact_dedup.ORACLE,
    "op5_ann_one_bit": ann.ORACLE,
    "op8_warc": warc.ORACLE,
}
