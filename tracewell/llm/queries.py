"""The corpus queries and their SQL, by name."""

from __future__ import annotations

from . import alignment, decontaminate, lm, mixing, neardup, prefixes, quality, secrets, sharding, substrings, tokens, urls, variants

QUERIES = {
    "op1_neardup": neardup.op1_neardup,
    "op2_decontaminate": decontaminate.op2_decontaminate,
    "op3_mixing": mixing.op3_mixing,
    "op4_secrets": secrets.op4_secrets,
    "op5_urls": urls.op5_urls,
    "op6_substrings": substrings.op6_substrings,
    "op7_tokens": tokens.op7_tokens,
    "op8_lm": lm.op8_lm,
    "op9_quality": quality.op9_quality,
    "op10_sharding": sharding.op10_sharding,
    "op11_alignment": alignment.op11_alignment,
    "op12_token_counts": prefixes.op12_token_counts,
    "op13_variants": variants.op13_variants,
}

ORACLE_SQL = {
    "op2_decontaminate": decontaminate.oracle(),
    "op3_mixing": mixing.oracle(),
    "op5_urls": urls.oracle(),
    "op9_quality": quality.oracle(),
    "op10_sharding": sharding.oracle(),
}
