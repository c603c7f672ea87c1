"""The queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

import corpus_pipeline

from weir.llm import decontaminate, jaccard, language, licenses, line_dedup, media, packing, sharding, toxicity, url_filter


def queries() -> dict:
    return {
        "op1_media": media.op1,
        "op2_packing": packing.op2,
        "op3_licenses": licenses.op3,
        "op4_sharding": sharding.op4,
        "op5_decontaminate": decontaminate.op5,
        "op6_line_dedup": line_dedup.op6,
        "op7_language": language.op7,
        "op8_toxicity": toxicity.op8,
        "op9_url_filter": url_filter.op9,
        "op10_jaccard": jaccard.op10,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    """Learned models, tokenisers, licence rules, PageRank and seeded hashes have no SQL
    counterpart; those queries are tested against brute force in tests/llm."""
    return {"op10_jaccard": jaccard.ORACLE_SQL} | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
