"""The queries of the operators for training data, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import byte_bpe, decontamination, jaccard_join, nearest, repeats, secrets, sharding, toxicity, url_filters, warc


def queries() -> dict:
    return {
        "op1_secret_scans": secrets.op1_secret_scans,
        "op2_decontamination": decontamination.op2_decontamination,
        "op3_sharding": sharding.op3_sharding,
        "op4_suffix_dedup": repeats.op4_suffix_dedup,
        "op5_warc": warc.op5_warc,
        "op6_byte_bpe": byte_bpe.op6_byte_bpe,
        "op7_nearest_neighbours": nearest.op7_nearest_neighbours,
        "op8_jaccard_join": jaccard_join.op8_jaccard_join,
        "op9_url_filters": url_filters.op9_url_filters,
        "op10_toxicity": toxicity.op10_toxicity,
    }


def oracle_sql() -> dict[str, str]:
    return {"op9_url_filters": url_filters.ORACLE}
