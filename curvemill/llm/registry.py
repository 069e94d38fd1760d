"""The ten operators' queries, and SQL for those that SQL can express."""

from . import langid, line_dedup, mixing, neardup, packing, quality, sharding, topk, toxicity, url_rules

QUERIES = {
    "op1_neardup": neardup.query,
    "op2_line_dedup": line_dedup.query,
    "op3_url_rules": url_rules.query,
    "op4_toxicity": toxicity.query,
    "op5_packing": packing.query,
    "op6_sharding": sharding.query,
    "op7_quality": quality.query,
    "op8_topk": topk.query,
    "op9_langid": langid.query,
    "op10_mixing": mixing.query,
    "url_rules_curated": url_rules.curated_query,
}
ORACLES = {
    "op2_line_dedup": line_dedup.ORACLE,
    "op8_topk": topk.ORACLE,
    "op10_mixing": mixing.ORACLE,
    "url_rules_curated": url_rules.CURATED_ORACLE,
}
