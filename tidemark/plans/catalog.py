"""All registered queries of the library's own operators, with their DuckDB counterparts."""

from __future__ import annotations

from . import measures, places, records, relations, spectra, summaries  # noqa: F401
from .registry import ORACLES, QUERIES


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
