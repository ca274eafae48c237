"""The queries of this subpackage and the SQL that gives the same rows, where SQL can."""

from __future__ import annotations

from gramwell.llm import decontamination, jaccard_join, license_scans, media_columns, packing, plain_sql, secret_scans, suffix_dedup, token_counts, toxicity, url_filters

QUERIES = {
    "op1_packing": packing.op1_packing,
    "op2_secret_scan": secret_scans.op2_secret_scan,
    "op3_decontamination": decontamination.op3_decontamination,
    "op4_suffix_dedup": suffix_dedup.op4_suffix_dedup,
    "op5_token_counts": token_counts.op5_token_counts,
    "op6_media": media_columns.op6_media,
    "op7_toxicity": toxicity.op7_toxicity,
    "op9_jaccard_join": jaccard_join.op9_jaccard_join,
    "op8_license_scan": license_scans.op8_license_scan,
    "op10_url_filter": url_filters.op10_url_filter,
}

SQL = {
    "op3_decontamination": plain_sql.OP3_SQL,
    "op4_suffix_dedup": plain_sql.OP4_SQL,
    "op9_jaccard_join": plain_sql.OP9_SQL,
    "op8_license_scan": license_scans.OP8_SQL,
    "op10_url_filter": url_filters.OP10_SQL,
}
