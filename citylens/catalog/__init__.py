"""Queries over the test tables, one per operator and analysis, each with its SQL twin."""

from citylens.catalog import ingest, queries_basic, queries_geo, queries_reports, queries_summaries  # noqa: F401
from citylens.catalog.registry import ORACLES, QUERIES  # noqa: F401
