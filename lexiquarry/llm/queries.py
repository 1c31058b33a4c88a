"""The queries of this subpackage by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from lexiquarry.llm import bpe, dialog_repair, exact_dup, langid, licenses, line_dedup, mixing, near_dup, quality, quality_rules, topk, toxicity, whitening

QUERIES = {
    "op1_topk": topk.op1_topk,
    "op2_lines": line_dedup.op2_lines,
    "op3_mixing": mixing.op3_mixing,
    "op4_licenses": licenses.op4_licenses,
    "op5_exact": exact_dup.op5_exact,
    "op6_langid": langid.op6_langid,
    "op7_quality": quality.op7_quality,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_bpe": bpe.op9_bpe,
    "op10_minhash": near_dup.op10_minhash,
    "op11_whitening": whitening.op11_whitening,
    "op12_dialog_repair": dialog_repair.op12_dialog_repair,
    "op13_quality_rules": quality_rules.op13_quality_rules,
}

ORACLE_SQL: dict[str, str] = {
    "op1_topk": topk.OP1_SQL,
    "op5_exact": exact_dup.OP5_SQL,
    "op12_dialog_repair": dialog_repair.OP12_SQL,
}
