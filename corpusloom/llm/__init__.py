"""Training-data operators. Nothing else in the library imports this subpackage."""

from __future__ import annotations

from corpusloom.llm import registry


def queries():
    return registry.queries()


def oracle_sql():
    return registry.oracle_sql()
