"""Every query of the engine with its SQL."""

from __future__ import annotations

from plumbline.plans import alignment, cameras, files, geometry, hands, joins, lookup, matching, metrics, readers, records, sequences, tracks  # noqa: F401
from plumbline.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
