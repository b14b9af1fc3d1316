"""All queries of the library proper, by name, with their SQL."""

from __future__ import annotations

from claimflow.plans import intake, jobs, linkage, metrics, quality, records, texts

FLAGSHIP = "match_status_counts"
_GROUPS = [linkage, intake, metrics, quality, texts, records, jobs]
QUERIES = {name: query for group in _GROUPS for name, query in group.QUERIES.items()}
SQL = {name: sql for group in _GROUPS for name, sql in group.SQL.items()}
