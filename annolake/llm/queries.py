"""The subpackage's queries and their SQL."""

from __future__ import annotations

from annolake.llm import byte_bpe, chat_format, collocations, decontaminate, html_extract, jaccard_join, license_scan, line_dedup, quality, ranked_search, substring_dedup, url_filter, voronoi_knn

QUERIES = {
    "op1_html_extract": html_extract.op1_html_extract,
    "op2_byte_bpe": byte_bpe.op2_byte_bpe,
    "op3_quality": quality.op3_quality,
    "op4_chat_format": chat_format.op4_chat_format,
    "op5_license_scan": license_scan.op5_license_scan,
    "op6_substring_dedup": substring_dedup.op6_substring_dedup,
    "op7_line_dedup": line_dedup.op7_line_dedup,
    "op8_jaccard_join": jaccard_join.op8_jaccard_join,
    "op9_decontaminate": decontaminate.op9_decontaminate,
    "op10_topk_search": voronoi_knn.op10_topk_search,
    "op11_collocations": collocations.op11_collocations,
    "op12_ranked_search": ranked_search.op12_ranked_search,
    "op13_url_filter": url_filter.op13_url_filter,
}

ORACLE_SQL = {
    "op4_chat_format": chat_format.OP4_SQL,
    "op7_line_dedup": line_dedup.OP7_SQL,
    "op10_topk_search": voronoi_knn.OP10_SQL,
    "op11_collocations": collocations.op11_collocations,
    "op11_collocations": collocations.OP11_SQL,
    "op12_ranked_search": ranked_search.OP12_SQL,
}
