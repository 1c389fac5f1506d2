"""Queries over the given tables, with the SQL that must give the same rows."""

from __future__ import annotations

from candlewick.plans.oracles import ORACLES
from candlewick.plans.queries import QUERIES

__all__ = ["ORACLES", "QUERIES"]
