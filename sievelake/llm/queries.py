"""The registered queries of this subpackage and their SQL."""

from sievelake.llm import alignment, ann, decontam, langid, line_dedup, near_dedup, packing, pii, resampling, secrets_scan, sharding, substring_dedup, topk

QUERIES = {
    "op1_secret_scan": secrets_scan.op1_secret_scan,
    "op2_substring_dedup": substring_dedup.op2_substring_dedup,
    "op3_best_fit_packing": packing.op3_best_fit_packing,
    "op4_benchmark_decontamination": decontam.op4_benchmark_decontamination,
    "op5_personal_data": pii.op5_personal_data,
    "op6_near_duplicates": near_dedup.op6_near_duplicates,
    "op7_line_dedup": line_dedup.op7_line_dedup,
    "op8_virtual_slot_sharding": sharding.op8_virtual_slot_sharding,
    "op9_exact_top_k": topk.op9_exact_top_k,
    "op10_language_id": langid.op10_language_id,
    "op11_importance_resampling": resampling.op11_importance_resampling,
    "op12_nearest_neighbours": ann.op12_nearest_neighbours,
    "op13_tokenizer_alignment": alignment.op13_tokenizer_alignment,
}
ORACLE_SQL = {
    "op4_benchmark_decontamination": decontam.OP4_SQL,
    "op9_exact_top_k": topk.OP9_SQL,
}
