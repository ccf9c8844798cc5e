"""Queries of the document operators and of the corpus pipeline."""

from __future__ import annotations

from importlib import import_module

MODULES = [
    "line_dedup", "token_counts", "quality_rules", "bpe", "fingerprints", "quality_classifier", "packing", "substrings", "jaccard_join", "suffixes", "periodic_runs", "prefix_trie", "lm_scoring",
    "pipeline_plan",
]


def llm_plans() -> dict:
    """Name to (query, oracle SQL or None)."""
    plans: dict = {}
    for module in MODULES:
        plans.update(import_module(f"emberwatch.llm.{module}").QUERIES)
    return plans
