"""Contract queries of the training-data operators and their DuckDB SQL."""

from __future__ import annotations

from vitrine.llm import (fill_middle, filter_audit, ftrl_quality, langid, line_dedup, packing, simhash_cover, sphere_caps,
                         suffix_dedup, suffix_tree_lm, template_decontam, url_rules, warc)

QUERIES = {
    "op1_suffix_tree_lm": suffix_tree_lm.op1_suffix_tree_lm,
    "op2_template_decontam": template_decontam.op2_template_decontam,
    "op3_packing": packing.op3_packing,
    "op4_ftrl_quality": ftrl_quality.op4_ftrl_quality,
    "op5_warc": warc.op5_warc,
    "op6_language_id": langid.op6_language_id,
    "op7_simhash_cover": simhash_cover.op7_simhash_cover,
    "op8_suffix_dedup": suffix_dedup.op8_suffix_dedup,
    "op9_sphere_caps": sphere_caps.op9_sphere_caps,
    "op10_url_filters": url_rules.op10_url_filters,
    "op11_filter_audit": filter_audit.op11_filter_audit,
    "op12_fill_middle": fill_middle.op12_fill_middle,
    "op13_line_dedup": line_dedup.op13_line_dedup,
}

ORACLE_SQL = {
    "op10_url_filters": url_rules.ORACLE,
    "op11_filter_audit": filter_audit.ORACLE,
    "op12_fill_middle": fill_middle.ORACLE,
    "op13_line_dedup": line_dedup.ORACLE,
}
