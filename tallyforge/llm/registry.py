"""The queries of this subpackage and, where SQL can express them, their twins."""

from tallyforge.llm.crosstok import op11_cross_tokenizer
from tallyforge.llm.decontaminate import OP3_SQL, op3_decontamination
from tallyforge.llm.filteraudit import OP12_SQL, op12_filter_audit
from tallyforge.llm.licenses import op7_license_scans
from tallyforge.llm.lm import op10_lm_scoring
from tallyforge.llm.neardup import OP5_SQL, op5_minhash_near_dedup
from tallyforge.llm.packing import op9_best_fit_packing
from tallyforge.llm.pii import op2_pii
from tallyforge.llm.quality import OP6_SQL, op6_quality_rules
from tallyforge.llm.secrets import OP1_SQL, op1_secret_scans
from tallyforge.llm.tokencount import op8_token_counts
from tallyforge.llm.tokenfiles import op13_token_ids
from tallyforge.llm.urlfilter import OP4_SQL, op4_url_filters

QUERIES = {
    "op1_secret_scans": op1_secret_scans,
    "op2_pii": op2_pii,
    "op3_decontamination": op3_decontamination,
    "op4_url_filters": op4_url_filters,
    "op5_minhash_near_dedup": op5_minhash_near_dedup,
    "op6_quality_rules": op6_quality_rules,
    "op7_license_scans": op7_license_scans,
    "op8_token_counts": op8_token_counts,
    "op9_best_fit_packing": op9_best_fit_packing,
    "op10_lm_scoring": op10_lm_scoring,
    "op11_cross_tokenizer": op11_cross_tokenizer,
    "op12_filter_audit": op12_filter_audit,
    "op13_token_ids": op13_token_ids,
}
ORACLE = {
    "op1_secret_scans": OP1_SQL,
    "op3_decontamination": OP3_SQL,
    "op4_url_filters": OP4_SQL,
    "op5_minhash_near_dedup": OP5_SQL,
    "op6_quality_rules": OP6_SQL,
    "op12_filter_audit": OP12_SQL,
}
