"""The registered queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from helixmill.llm import bpe, centroids, conversation_repair, html_extract, license_scan, line_dedup, ngram_jaccard, order_minhash, packing, quality_rules, substring_dedup, super_minhash, url_rules


def queries():
    return {
        "op10_ngram_jaccard": ngram_jaccard.op10_ngram_jaccard,
        "op11_centroids": centroids.op11_centroids,
        "op12_near_duplicates": super_minhash.op12_near_duplicates,
        "op13_conversation_repair": conversation_repair.op13_conversation_repair,
        "op1_substring_dedup": substring_dedup.op1_substring_dedup,
        "op2_license_scan": license_scan.op2_license_scan,
        "op3_order_minhash": order_minhash.op3_order_minhash,
        "op4_quality": quality_rules.op4_quality,
        "op5_line_dedup": line_dedup.op5_line_dedup,
        "op6_url_filter": url_rules.op6_url_filter,
        "op7_packing": packing.op7_packing,
        "op8_html_extract": html_extract.op8_html_extract,
        "op9_bpe": bpe.op9_bpe,
    }


def oracle_sql():
    return {"op6_url_filter": url_rules.ORACLE}
