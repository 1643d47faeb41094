"""Named queries over the test tables and the SQL that checks them."""

from __future__ import annotations


def load():
    """(queries, oracle SQL) of all sections."""
    from cohortlens.plans import analysis, modelling, tables  # noqa: F401
    from cohortlens.plans.registry import ORACLES, QUERIES

    return dict(QUERIES), dict(ORACLES)
