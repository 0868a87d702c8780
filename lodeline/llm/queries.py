"""The queries opN_<name> of this subpackage and their SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable

#: Modules that hold QUERIES (name -> function) and ORACLE (name -> SQL).
MODULES = ("bpe", "near_dup", "imatch", "language_id", "quality", "toxicity", "pii", "mixing", "html_text", "warc", "simhash", "divergence", "ranked")


def _gathered(attribute: str) -> dict:
    found: dict = {}
    for module in MODULES:
        found |= getattr(importlib.import_module(f"{__package__}.{module}"), attribute)
    return found


def queries() -> dict[str, Callable]:
    return _gathered("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _gathered("ORACLE")
