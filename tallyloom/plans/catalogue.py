"""Every query of the library by name, with SQL that gives the same rows."""

from __future__ import annotations

from . import changes, facts, finding, insight, people, quality, writes
from .registry import Query

MODULES = (people, finding, changes, quality, insight, facts, writes)


def queries() -> dict[str, Query]:
    found = {name: query for m in MODULES for name, query in m.plans.queries.items()}
    return dict(sorted(found.items()))


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.plans.sql.items()}
