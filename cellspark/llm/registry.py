"""Queries of this subpackage and the DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from . import alignment, bpe, decontaminate, minhash, packing, periodic, quality_classifier, quality_rules, suffix_dedup, tool_calls, toxicity, warc, wavelet

QUERIES = {
    "op1_minhash": minhash.op1_minhash,
    "op2_suffix_dedup": suffix_dedup.op2_suffix_dedup,
    "op3_quality_rules": quality_rules.op3_quality_rules,
    "op4_byte_bpe": bpe.op4_byte_bpe,
    "op5_tool_calls": tool_calls.op5_tool_calls,
    "op6_warc_revisits": warc.op6_warc_revisits,
    "op7_quality_classifier": quality_classifier.op7_quality_classifier,
    "op8_decontaminate": decontaminate.op8_decontaminate,
    "op9_wavelet_ids": wavelet.op9_wavelet_ids,
    "op10_toxicity": toxicity.op10_toxicity,
    "op11_token_alignment": alignment.op11_token_alignment,
    "op12_best_fit_packing": packing.op12_best_fit_packing,
    "op13_periodic_runs": periodic.op13_periodic_runs,
}

ORACLES: dict[str, str] = {
    "op3_quality_rules": quality_rules.OP3_SQL,
    "op5_tool_calls": tool_calls.OP5_SQL,
    "op6_warc_revisits": warc.OP6_SQL,
}
