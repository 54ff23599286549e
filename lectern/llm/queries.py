"""The queries of this subpackage, by name, and SQL for those that SQL can express."""

from __future__ import annotations

import importlib

#: Name of the query: module.
MODULES = {
    "op1_mixing": "mixing",
    "op2_quality": "quality",
    "op3_pii": "pii",
    "op4_toxicity": "toxicity",
    "op5_ngram_join": "ngram_join",
    "op6_html": "html_diff",
    "op7_ann": "ann",
    "op8_warc": "warc",
    "op9_vector_dedup": "vector_dedup",
    "op10_packing": "packing",
    "op11_chat": "chat",
    "op12_collocations": "collocations",
    "op13_filter_audit": "filter_audit",
}


def _pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    found = {name: importlib.import_module(f"lectern.llm.{module}").query for name, module in MODULES.items()}
    return found | {"pipeline": _pipeline}


def oracle_sql() -> dict[str, str]:
    found = {name: importlib.import_module(f"lectern.llm.{module}") for name, module in MODULES.items()}
    return {name: module.sql() for name, module in found.items() if hasattr(module, "sql")}
