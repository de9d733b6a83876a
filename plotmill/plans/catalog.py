"""All core queries and their SQL."""

from __future__ import annotations

from plotmill.plans import captures, card_pages, housekeeping, linkage, problems, relational, scalars, streams, summaries, upkeep

_MODULES = (problems, scalars, linkage, summaries, captures, card_pages, housekeeping, streams, relational, upkeep)

QUERIES = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLES = {k: v for m in _MODULES for k, v in m.ORACLES.items()}
