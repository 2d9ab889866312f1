"""The queries of this subpackage and their DuckDB oracles, by name."""

from __future__ import annotations

from plover.llm import op01, op02, op03, op04, op05, op06, op07, op08, op09, op10, op11, op12, op13

MODULES = (op01, op02, op03, op04, op05, op06, op07, op08, op09, op10, op11, op12, op13)
QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
ORACLES = {name: sql for module in MODULES for name, sql in getattr(module, "ORACLES", {}).items()}
