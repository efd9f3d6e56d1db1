"""All queries outside the llm subpackage."""

from __future__ import annotations

from tamis.plans import desk, flows, kernels, records, screening

MODULES = (records, desk, screening, flows, kernels)
QUERIES = {k: v for m in MODULES for k, v in m.QUERIES.items()}
SQL = {k: v for m in MODULES for k, v in m.SQL.items()}
FLAGSHIP = "p2_found"
