"""All named queries over the driver's tables and their DuckDB twins."""

from __future__ import annotations

from strandline.plans import frontier, indices, kappa, paths, relational, replay, scalars, statistics  # noqa: F401  each registers its own
from strandline.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
