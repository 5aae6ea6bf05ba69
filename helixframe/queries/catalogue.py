"""All queries of the core, by name, with their SQL."""

from __future__ import annotations

from helixframe.queries import core_problems, mapping, more, results, scalars

MODULES = (core_problems, scalars, mapping, results, more)
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
SQL = {k: s for m in MODULES for k, s in m.SQL.items()}
FLAGSHIP = "map_unpaired"
