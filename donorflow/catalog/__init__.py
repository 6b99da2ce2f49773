"""Every registered query next to the SQL that checks it."""

from __future__ import annotations


def load():
    """(queries, SQL) of all groups."""
    from donorflow.catalog import (  # noqa: F401
        describing, evaluating, explaining, expressions, joining, modeling, rules, sampling, series, shaping, sources,
    )
    from donorflow.catalog.bindings import QUERIES, SQL

    return QUERIES, SQL
