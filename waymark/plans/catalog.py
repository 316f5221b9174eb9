"""All registered queries and their SQL counterparts."""

from importlib import import_module

from waymark.plans.context import registered

for _family in ("scans", "checks", "relational", "metrics", "release", "streams"):
    import_module(f"waymark.plans.catalog_{_family}")


def queries() -> dict:
    return dict(registered()[0])


def oracle_sql() -> dict:
    return dict(registered()[1])
