"""The subpackage's queries, and SQL for those that SQL can express."""

from __future__ import annotations

import importlib

#: Query name and module. A module has query(spark, sf_dir), and ORACLE where SQL can express it.
MODULES = {
    "op1_sentencepiece": "sentencepiece_codec",
    "op2_neardup": "neardup",
    "op3_licenses": "licenses",
    "op4_quality_rules": "quality_rules",
    "op5_suffix_dedup": "suffix_dedup",
    "op6_sharding": "sharding",
    "op7_decontaminate": "decontaminate",
    "op8_secrets": "secret_scan",
    "op9_token_files": "token_files",
    "op10_toxicity": "toxicity",
    "op11_divergence": "source_divergence",
    "op12_lm_scores": "lm_mixing",
    "op13_collocations": "collocations",
}


def queries() -> dict:
    return {name: importlib.import_module(f"{__package__}.{module}").query for name, module in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    found = {name: getattr(importlib.import_module(f"{__package__}.{module}"), "ORACLE", None) for name, module in MODULES.items()}
    return {name: sql for name, sql in found.items() if sql}
