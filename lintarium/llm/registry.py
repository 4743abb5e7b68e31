"""Queries of the corpus operators and their SQL."""

from __future__ import annotations

from lintarium.llm import bpe, brown, exact_dedup, mixing, quality, sharding, simhash, token_counts, toxicity, warc

QUERIES = {
    "op1_brown": brown.op1_brown,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_exact_dedup": exact_dedup.op3_exact_dedup,
    "op4_quality": quality.op4_quality,
    "op5_mixing": mixing.op5_mixing,
    "op6_simhash": simhash.op6_simhash,
    "op7_sharding": sharding.op7_sharding,
    "op8_warc": warc.op8_warc,
    "op9_token_counts": token_counts.op9_token_counts,
    "op10_bpe": bpe.op10_bpe,
}

ORACLES = {
    "op3_exact_dedup": exact_dedup.ORACLE,
    "op5_mixing": mixing.ORACLE,
    "op7_sharding": sharding.ORACLE,
    "op8_warc": warc.ORACLE,
}
