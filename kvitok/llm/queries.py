"""Queries of the subpackage by name, and the SQL of those that SQL can express."""

from kvitok.llm.decontamination import OP2_SQL, op2_decontamination
from kvitok.llm.filter_audit import OP13_SQL, op13_filter_audit
from kvitok.llm.languages import op5_language_id
from kvitok.llm.license_scan import op11_license_scan
from kvitok.llm.lines import OP4_SQL, op4_line_dedup
from kvitok.llm.mixing import op8_mixing
from kvitok.llm.mixing_sql import OP8_SQL
from kvitok.llm.near_duplicates import op3_near_dedup
from kvitok.llm.nearest import op9_exact_top_k
from kvitok.llm.scoring import op10_lm_scores
from kvitok.llm.spelling import OP12_SQL, op12_spelling_variants
from kvitok.llm.suffixes import op7_suffix_dedup
from kvitok.llm.tokens import op6_token_counts
from kvitok.llm.toxicity import op1_toxicity

QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_decontamination": op2_decontamination,
    "op3_near_dedup": op3_near_dedup,
    "op4_line_dedup": op4_line_dedup,
    "op5_language_id": op5_language_id,
    "op6_token_counts": op6_token_counts,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_mixing": op8_mixing,
    "op9_exact_top_k": op9_exact_top_k,
    "op10_lm_scores": op10_lm_scores,
    "op11_license_scan": op11_license_scan,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_filter_audit": op13_filter_audit,
}

ORACLE_SQL = {
    "op2_decontamination": OP2_SQL,
    "op4_line_dedup": OP4_SQL,
    "op8_mixing": OP8_SQL,
    "op12_spelling_variants": OP12_SQL,
    "op13_filter_audit": OP13_SQL,
}
