"""All registered queries and oracles of the network operators."""

from __future__ import annotations

from . import entropy, episodes, evaluate, ordering, prepare, sources, streaming, study, windows
from .base import ORACLES, QUERIES

ENTRY = QUERIES["pipe_entropy"]
#: A common table that refers to itself needs the keyword.
for _name, _sql in ORACLES.items():
    if _sql.startswith("WITH ") and "UNION ALL SELECT o." in _sql:
        ORACLES[_name] = "WITH RECURSIVE " + _sql[5:]

__all__ = ["ENTRY", "ORACLES", "QUERIES", "entropy", "episodes", "evaluate", "ordering", "prepare", "sources", "streaming", "study", "windows"]
