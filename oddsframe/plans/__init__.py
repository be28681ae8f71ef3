"""Registered queries over the generic tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from oddsframe.plans import core, domain, more, stored  # noqa: F401  (they register with core)


def queries() -> dict:
    return dict(core.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(core.ORACLES)
