"""The registered queries of this subpackage, with SQL where SQL can express them."""

from __future__ import annotations

from plansmith.llm import ann, bpe, license_scan, line_dedup, near_dedup, packing, quality, quote_links, secret_scan, token_files

QUERIES = {
    "op1_quality_rules": quality.query,
    "op2_bpe": bpe.query,
    "op3_line_dedup": line_dedup.query,
    "op4_license_scans": license_scan.query,
    "op5_token_files": token_files.query,
    "op6_packing": packing.query,
    "op7_quote_links": quote_links.query,
    "op8_nearest": ann.query,
    "op9_near_dedup": near_dedup.query,
    "op10_secret_scans": secret_scan.query,
}

ORACLE = {
    "op3_line_dedup": line_dedup.ORACLE_SQL,
    "op4_license_scans": license_scan.ORACLE_SQL,
    "op7_quote_links": quote_links.ORACLE_SQL,
    "op10_secret_scans": secret_scan.ORACLE_SQL,
}
