"""The subpackage's queries and, where SQL can express them, their SQL."""

from __future__ import annotations

from perilune.llm import op1_secret_scans as o1
from perilune.llm import op2_quality_rules as o2
from perilune.llm import op3_warc as o3
from perilune.llm import op4_chat_format as o4
from perilune.llm import op5_packing as o5
from perilune.llm import op6_jaccard_join as o6
from perilune.llm import op7_quality_classifier as o7
from perilune.llm import op8_mixing as o8
from perilune.llm import op9_lm_scoring as o9
from perilune.llm import op10_topk as o10
from perilune.llm import op11_alignment as o11
from perilune.llm import op12_near_vectors as o12
from perilune.llm import op13_divergence as o13

QUERIES = {
    "op1_secret_scans": o1.op1_secret_scans,
    "op2_quality_rules": o2.op2_quality_rules,
    "op3_warc": o3.op3_warc,
    "op4_chat_format": o4.op4_chat_format,
    "op5_packing": o5.op5_packing,
    "op6_jaccard_join": o6.op6_jaccard_join,
    "op7_quality_classifier": o7.op7_quality_classifier,
    "op8_mixing": o8.op8_mixing,
    "op9_lm_scoring": o9.op9_lm_scoring,
    "op10_topk": o10.op10_topk,
    "op11_alignment": o11.op11_alignment,
    "op12_near_vectors": o12.op12_near_vectors,
    "op13_divergence": o13.op13_divergence,
}
ORACLE_SQL = {k: m.SQL for k, m in zip(QUERIES, (o1, o2, o3, o4, o5, o6, o7, o8, o9, o10, o11, o12, o13), strict=True) if m.SQL}
