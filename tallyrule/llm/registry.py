"""The corpus operators' queries by name, and DuckDB SQL for those that SQL can express."""

from tallyrule.llm import bpe, decontamination, exact_dedup, html_extract, language_id, near_dedup, secrets, sharding, suffix_dedup, toxicity

QUERIES = {
    "op1_suffix_dedup": suffix_dedup.op1_suffix_dedup,
    "op2_exact_dedup": exact_dedup.op2_exact_dedup,
    "op3_bpe": bpe.op3_bpe,
    "op4_language_id": language_id.op4_language_id,
    "op5_sharding": sharding.op5_sharding,
    "op6_near_dedup": near_dedup.op6_near_dedup,
    "op7_secret_scan": secrets.op7_secret_scan,
    "op8_decontamination": decontamination.op8_decontamination,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_html_extract": html_extract.op10_html_extract,
}
SQL = {
    "op1_suffix_dedup": suffix_dedup.OP1_SQL,
    "op2_exact_dedup": exact_dedup.OP2_SQL,
    "op5_sharding": sharding.OP5_SQL,
    "op6_near_dedup": near_dedup.OP6_SQL,
}
