"""All queries of the engine's own operators and their SQL equivalents."""

from __future__ import annotations

from . import aggregates, answering, classes, detection, extraction, indexes, integrity, linking, listing, naming, ordering, pages, processes, procurement, records, retrieval, storing, textual

_PARTS = (aggregates, answering, classes, detection, extraction, indexes, integrity, linking, listing, naming, ordering, pages, processes, procurement, records, retrieval, storing, textual)
QUERIES: dict = {name: query for part in _PARTS for name, query in part.QUERIES.items()}
ORACLES: dict[str, str] = {name: sql for part in _PARTS for name, sql in part.ORACLES.items()}
