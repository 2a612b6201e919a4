"""The registered queries over the reference operators, and their DuckDB SQL."""

from __future__ import annotations

from broadsheet.plans import archive_queries, assembly_queries, field_queries, layout_queries, text_queries  # noqa: F401  (they register)
from broadsheet.plans.registry import ORACLES, QUERIES  # noqa: F401

FLAGSHIP = "j05_nearest_above"
