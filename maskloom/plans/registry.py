"""All queries over the test tables with their DuckDB SQL, gathered from the plan modules."""

from __future__ import annotations

from maskloom.plans import catalog, masks, pixels, records, results, sampling, scans, streams  # noqa: F401
from maskloom.plans.base import ORACLE_SQL, QUERIES  # noqa: F401
