"""The queries of this subpackage, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from pointloom.llm.decontaminate import op2_benchmark_decontamination
from pointloom.llm.langid import op10_language_id
from pointloom.llm.langmodel import op7_lm_scoring
from pointloom.llm.licenses import op6_license_scans
from pointloom.llm.linededup import op3_line_dedup
from pointloom.llm.oracles import ORACLE_SQL
from pointloom.llm.packing import op1_best_fit_packing
from pointloom.llm.quality import op9_quality_rules
from pointloom.llm.simhash import op4_simhash_near_dedup
from pointloom.llm.toxicity import op8_toxicity
from pointloom.llm.urlfilter import op5_url_filters

QUERIES = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_benchmark_decontamination": op2_benchmark_decontamination,
    "op3_line_dedup": op3_line_dedup,
    "op4_simhash_near_dedup": op4_simhash_near_dedup,
    "op5_url_filters": op5_url_filters,
    "op6_license_scans": op6_license_scans,
    "op7_lm_scoring": op7_lm_scoring,
    "op8_toxicity": op8_toxicity,
    "op9_quality_rules": op9_quality_rules,
    "op10_language_id": op10_language_id,
}

__all__ = ["ORACLE_SQL", "QUERIES"]
