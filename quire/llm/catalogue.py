"""The queries of this subpackage and their SQL."""

from __future__ import annotations

import importlib

MODULES = ["toxicity", "mixing_model", "fingerprint", "private_data", "near_dup", "contamination", "language", "mixture", "licences", "token_count", "vector_codes", "exact_dup", "collocations"]
QUERIES: dict = {}
SQL: dict[str, str] = {}
for _name in MODULES:
    _module = importlib.import_module(f"{__package__}.{_name}")
    QUERIES |= _module.QUERIES
    SQL |= _module.SQL
