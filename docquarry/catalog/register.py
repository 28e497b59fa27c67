"""Registration of a module's queries and of their SQL."""

from __future__ import annotations

from docquarry.catalog.views import tidy


def registry():
    """Queries, their SQL, and the decorator that fills both."""
    queries, texts = {}, {}

    def query(sql: str | None = None):
        def register(fn):
            queries[fn.__name__] = lambda spark, folder: tidy(fn(spark, folder))
            if sql is not None:
                texts[fn.__name__] = sql
            return fn

        return register

    return queries, texts, query
