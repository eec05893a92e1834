"""Registered queries: each reads the given tables and chains the operators."""


def registered():
    """(queries, SQL statements) by name."""
    import importlib
    import pkgutil

    from stripline.plans import registry

    for m in pkgutil.iter_modules(__path__):
        if m.name.startswith("plan_"):
            importlib.import_module(f"{__name__}.{m.name}")
    return registry.QUERIES, {n: registry.with_views(sql) for n, sql in registry.ORACLES.items()}
