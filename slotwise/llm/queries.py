"""Registered queries of the subpackage, with oracle SQL where SQL can express them."""

from . import decontamination, filter_audit, line_crf, line_dedup, near_dup, packing, resampling, simhash, substring_dedup, suffix_dedup, toxicity, urls, weak_labels

QUERIES = {
    "op1_line_crf": line_crf.op1_line_crf,
    "op2_noisy_channel_toxicity": toxicity.op2_noisy_channel_toxicity,
    "op3_best_fit_packing": packing.op3_best_fit_packing,
    "op4_suffix_automaton": substring_dedup.op4_suffix_automaton,
    "op5_suffix_merge_sort": suffix_dedup.op5_suffix_merge_sort,
    "op6_line_chunks": line_dedup.op6_line_chunks,
    "op7_weighted_near_dup": near_dup.op7_weighted_near_dup,
    "op8_association_rules": urls.op8_association_rules,
    "op9_weak_label_quality": weak_labels.op9_weak_label_quality,
    "op10_benchmark_decontamination": decontamination.op10_benchmark_decontamination,
    "op11_filter_audit": filter_audit.op11_filter_audit,
    "op12_simhash_pigeonhole": simhash.op12_simhash_pigeonhole,
    "op13_importance_resampling": resampling.op13_importance_resampling,
}
ORACLES = {"op8_association_rules": urls.OP8_SQL, "op11_filter_audit": filter_audit.OP11_SQL, "op13_importance_resampling": resampling.OP13_SQL}
