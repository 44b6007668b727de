"""All registered queries and the SQL they are checked against."""

import importlib

MODULES = (
    "relational", "joins", "aggregates", "windows", "functions", "generators", "storage", "catalog",
    "user_code", "profiling", "hot",
)


def _gather(attribute: str) -> dict:
    found: dict = {}
    for name in MODULES:
        part = getattr(importlib.import_module(f"millrace.plans.{name}").R, attribute)
        if found.keys() & part.keys():
            raise ValueError(f"registered twice: {sorted(found.keys() & part.keys())}")
        found.update(part)
    return found


def all_queries() -> dict:
    return _gather("queries")


def all_oracles() -> dict:
    return _gather("oracles")
