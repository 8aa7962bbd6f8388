"""All queries over the given tables, and their SQL."""

from __future__ import annotations

from . import audits, catalogue, checks, dashboards, files, sales

MODULES = (sales, dashboards, checks, audits, files, catalogue)
QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
ORACLES = {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
