"""Registration of queries with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from jostle.catalog.fixtures import Fixture, fixture, with_ctes
from jostle.session import tune

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, needs: tuple[str, ...] = (), sql: str | None = None):
    """Register ``fn(fixture) -> DataFrame`` under ``name``; ``sql`` is completed with the common
    table expressions it ``needs``."""

    def register(fn: Callable[[Fixture], object]):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        def run(spark, folder):
            tune(spark)
            return fn(fixture(spark, folder))

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = with_ctes(needs, sql)
        return fn

    return register
