"""Every query of the engine and its SQL, gathered from the operator modules."""

from __future__ import annotations

import importlib
from collections.abc import Callable

#: Modules that hold QUERIES (name -> function) and ORACLE (name -> SQL).
MODULES: tuple[str, ...] = ("operators.detect", "operators.scan", "operators.relate", "operators.retrieve", "operators.judge", "streaming.ledger", "operators.extract", "operators.packets", "operators.heuristics", "operators.codefacts", "operators.slices", "operators.hypotheses", "operators.corpus", "operators.recall", "operators.stores", "operators.planner", "operators.semantics", "operators.vector_index", "operators.lexical_index", "streaming.stateful", "operators.containment", "operators.reach", "operators.sketches")


#: Queries on a few rows typed into their modules: tests compare them with their SQL, but they are not registered.
FIXTURES = frozenset(
    """hypothesis_rank hypothesis_merge finding_gates report_buckets hypothesis_origin tool_findings semantic_validation
    run_through plan_updates decision_filter evidence_records report_evidence plan_validate
    ground_truth run_candidates recall_matches recall_report artifact_arities
    normalize_finding finding_scores lexical_candidates freshness retrieval_labels best_models index_names
    note_files report_json report_markdown slim_state lesson_log framework
    front_matter_note nested_json_explode run_classify tolerant_json""".split()
)


def _gathered(attribute: str) -> dict:
    found: dict = {}
    for module in MODULES:
        found |= getattr(importlib.import_module(f"lodeline.{module}"), attribute)
    return found


def queries() -> dict[str, Callable]:
    """Queries over tables, to be registered."""
    return {name: query for name, query in _gathered("QUERIES").items() if name not in FIXTURES}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, sql in _gathered("ORACLE").items() if name not in FIXTURES}


def fixtures() -> dict[str, tuple[Callable, str]]:
    """Query and SQL of those that tests run on typed rows."""
    found, sql = _gathered("QUERIES"), _gathered("ORACLE")
    return {name: (found[name], sql[name]) for name in sorted(FIXTURES)}
