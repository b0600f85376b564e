"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

import corpus_pipeline

from . import op1_packing, op2_sharding, op3_html, op4_rules, op5_tokenfile, op6_bpe, op7_counts, op8_simhash, op9_ogg, op10_pii, op11_mixing, op12_fim, op13_filter_audit

QUERIES = {
    "op1_packing": op1_packing.query,
    "op2_kd_sharding": op2_sharding.query,
    "op3_html_text": op3_html.query,
    "op4_rule_ledger": op4_rules.query,
    "op5_token_files": op5_tokenfile.query,
    "op6_merge_replay": op6_bpe.query,
    "op7_edit_counts": op7_counts.query,
    "op8_simhash_anchors": op8_simhash.query,
    "op9_ogg_media": op9_ogg.query,
    "op10_boosted_pii": op10_pii.query,
    "op11_hash_mixing": op11_mixing.query,
    "op12_fill_in_middle": op12_fim.query,
    "op13_filter_audit": op13_filter_audit.query,
    "rule_ablations": op4_rules.ablation_query,
    "pipeline": corpus_pipeline.run,
}

SQL = {"op4_rule_ledger": op4_rules.SQL, "rule_ablations": op4_rules.ABLATION_SQL, "op11_hash_mixing": op11_mixing.SQL, "op12_fill_in_middle": op12_fim.SQL, "op13_filter_audit": op13_filter_audit.SQL}
if corpus_pipeline.ORACLE_SQL:
    SQL["pipeline"] = corpus_pipeline.ORACLE_SQL
