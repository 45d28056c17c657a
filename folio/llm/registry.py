"""The queries of the ten operators over whole tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import sql
from .decontaminate import op1_decontamination
from .kneser_ney import op8_quality_rules
from .line_dedup import op7_line_dedup
from .mixing import op2_mixing
from .near_dedup import op10_near_dedup
from .ppm import op9_lm_scoring
from .quality import op3_quality
from .records import op4_token_records
from .sharding import op6_sharding
from .toxicity import op5_toxicity

QUERIES = {
    "op1_decontamination": op1_decontamination,
    "op2_mixing": op2_mixing,
    "op3_quality": op3_quality,
    "op4_token_records": op4_token_records,
    "op5_toxicity": op5_toxicity,
    "op6_sharding": op6_sharding,
    "op7_line_dedup": op7_line_dedup,
    "op8_quality_rules": op8_quality_rules,
    "op9_lm_scoring": op9_lm_scoring,
    "op10_near_dedup": op10_near_dedup,
}
ORACLE_SQL = {"op1_decontamination": sql.DECONTAMINATION, "op7_line_dedup": sql.LINE_DEDUP, "op10_near_dedup": sql.NEAR_DEDUP}
