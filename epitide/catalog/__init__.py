"""The registered queries and the SQL each of them must agree with."""
from __future__ import annotations

from importlib import import_module

from .inputs import expand_rounding

GROUPS = ("core", "series", "panels", "landed", "fits")


def load() -> tuple[dict, dict]:
    """All queries and all oracle statements, by name."""
    queries, oracles = {}, {}
    for group in GROUPS:
        module = import_module(f"{__name__}.{group}")
        queries.update(module.QUERIES)
        oracles.update({name: expand_rounding(sql) for name, sql in module.ORACLES.items()})
    return queries, oracles
