"""DataFrame operators: ``f(df..., **params) -> DataFrame``."""
