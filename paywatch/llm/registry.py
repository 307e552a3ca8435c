"""Registry of this subpackage's queries and their SQL."""

QUERIES = {}
ORACLES = {}


def query(name, sql=None):
    """Registers a query; ``sql`` is its DuckDB text, left out where SQL cannot say it."""
    def register(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return register
