"""The registered queries of this subpackage, and the SQL for those that SQL can express."""

from __future__ import annotations

from timeline_lake.llm import bpe, chat, collocations, exact_dedup, filter_audit, html_template, near_dedup, packing, quality_rank, quality_rules, token_files, toxicity, warc

QUERIES = {
    "op1_best_fit_packing": packing.op1_best_fit_packing,
    "op2_warc_from_arc": warc.op2_warc_from_arc,
    "op3_quality_ranking": quality_rank.op3_quality_ranking,
    "op4_quality_rules": quality_rules.op4_quality_rules,
    "op5_bpe_prefix": bpe.op5_bpe_prefix,
    "op6_toxicity_neighbours": toxicity.op6_toxicity_neighbours,
    "op7_token_files": token_files.op7_token_files,
    "op8_template_extraction": html_template.op8_template_extraction,
    "op9_minhash_near_dedup": near_dedup.op9_minhash_near_dedup,
    "op10_exact_dedup": exact_dedup.op10_exact_dedup,
    "op11_filter_audit": filter_audit.op11_filter_audit,
    "op12_chat_format": chat.op12_chat_format,
    "op13_phrase_collocations": collocations.op13_phrase_collocations,
}

ORACLES = {
    "op2_warc_from_arc": warc.OP2_SQL,
    "op10_exact_dedup": exact_dedup.OP10_SQL,
    "op11_filter_audit": filter_audit.OP11_SQL,
    "op12_chat_format": chat.OP12_SQL,
    "op13_phrase_collocations": collocations.OP13_SQL,
}
