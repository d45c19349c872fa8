"""All registered queries and their SQL twins."""

from __future__ import annotations

from pataspark.workload import queries_data, queries_text  # noqa: F401  (registers the queries)
from pataspark.workload.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
