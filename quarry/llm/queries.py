"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from . import decontaminate, jaccard_join, licenses, media, mixing, quality, sharding, substring_dedup, suffix_dedup, url_filter

QUERIES = {
    "op1_url_filters": url_filter.query,
    "op2_ngram_jaccard_join": jaccard_join.query,
    "op3_mixing": mixing.query,
    "op4_quality": quality.query,
    "op5_license_scans": licenses.query,
    "op6_benchmark_decontamination": decontaminate.query,
    "op7_suffix_dedup": suffix_dedup.query,
    "op8_sharding": sharding.query,
    "op9_media_columns": media.query,
    "op10_substring_dedup": substring_dedup.query,
}
SQL = {
    "op1_url_filters": url_filter.SQL,
    "op2_ngram_jaccard_join": jaccard_join.SQL,
    "op3_mixing": mixing.SQL,
    "op5_license_scans": licenses.SQL,
    "op10_substring_dedup": substring_dedup.SQL,
}
