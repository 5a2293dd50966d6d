"""Queries of this package and, where SQL can express them, their oracles."""

from __future__ import annotations

import importlib

#: query name -> module of this package that holds ``query`` and maybe ``SQL``.
MODULES = {
    "op1_decontamination": "decontaminate",
    "op2_token_counts": "tokencount",
    "op3_secret_scan": "secrets",
    "op4_pii": "pii",
    "op5_url_filter": "urls",
    "op6_quality_rules": "quality",
    "op7_ngram_jaccard_join": "jaccard",
    "op8_token_files": "tokenfiles",
    "op9_license_scan": "licenses",
    "op10_sentencepiece": "pieces",
    "op11_collocations": "collocations",
    "op12_periodic_runs": "runs",
    "op13_chat_formatting": "chat",
}


def queries() -> dict:
    return {name: importlib.import_module(f"pathloom.llm.{module}").query for name, module in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    found = {name: getattr(importlib.import_module(f"pathloom.llm.{module}"), "SQL", None) for name, module in MODULES.items()}
    return {name: sql for name, sql in found.items() if sql}
