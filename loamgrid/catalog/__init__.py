"""Named queries over the driver tables, one or more per operator family."""

from importlib import import_module

from loamgrid.catalog.base import ORACLES, QUERIES

MODULES = ("points", "shapes", "surfaces", "ingest")


def _load() -> None:
    for name in MODULES:
        import_module(f"loamgrid.catalog.{name}")


def queries() -> dict:
    _load()
    return dict(QUERIES)


def oracle_sql() -> dict:
    _load()
    return dict(ORACLES)
