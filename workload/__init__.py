"""Queries over the test tables, each beside the SQL it must agree with."""

from __future__ import annotations

from . import (  # noqa: F401 - importing registers the queries
    comparing,
    evaluating,
    fitting,
    logging,
    preparing,
    rendering,
    reporting,
    sources,
    splitting,
    vectors,
)
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
