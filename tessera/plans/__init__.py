"""Queries of the engine over the star-schema tables, and the SQL that checks them."""


def load():
    """All queries and their SQL."""
    import importlib
    import pkgutil

    for m in pkgutil.iter_modules(__path__):
        importlib.import_module(f"{__name__}.{m.name}")
    from tessera.plans.registry import ORACLES, QUERIES

    return QUERIES, ORACLES
