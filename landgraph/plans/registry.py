"""Every named query of the library, with its SQL where SQL can express it."""

from __future__ import annotations

from landgraph.plans import browse, entities, extraction, inventory, parcels, pieces, reading, records, review, searching, timeline

QUERIES: dict = {}
SQL: dict[str, str] = {}
for part in (browse, entities, extraction, inventory, parcels, pieces, reading, records, review, searching, timeline):
    QUERIES |= part.QUERIES
    SQL |= part.SQL
FLAGSHIP = "d11_group_fold"
