"""Operators for preparing training text, and the queries registered for them."""

from __future__ import annotations

from importlib import import_module

MODULES = (
    "jaccard_join", "decontaminate", "mixing", "html_layout", "token_counts", "suffix_tree", "line_dedup", "toxicity", "host_rules", "token_files",
    "lexical_search", "packing", "spelling",
)


def catalog() -> dict:
    """Query name to (function, SQL or None), the corpus pipeline among them."""
    out: dict = {}
    for module in MODULES:
        out.update(import_module(f"tidefold.llm.{module}").CHECKS)
    pipeline = import_module("corpus_pipeline")
    out["pipeline"] = (pipeline.run, pipeline.ORACLE_SQL)
    return out
