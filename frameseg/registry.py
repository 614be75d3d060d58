"""All queries by name, and their SQL."""

from __future__ import annotations


def queries() -> dict:
    from .plans import base, core, extra  # noqa: F401

    return dict(base.QUERIES)


def oracle_sql() -> dict:
    queries()
    from .plans import base

    return dict(base.SQL)
