"""The registry of queries over the driver's tables and their SQL."""

from ..operators import access, analytics, casework, edits, guards, hygiene, knowledge, lifecycle, masking, precedents, provenance, retrieval, text, topics, triage, views
from ..streaming import jobs, timers

MODULES = (analytics, knowledge, casework, text, hygiene, retrieval, triage, lifecycle, views, masking, precedents, access, edits, guards, provenance, topics, jobs, timers)


def registered() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracles() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in m.SQL.items()}
