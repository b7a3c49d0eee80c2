"""Query catalogue: each query is a DataFrame function plus, where SQL can say it, an oracle."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from runqc.plans.views import VIEW_SQL, Views


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[Views], DataFrame]
    sql: str | None

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return self.build(Views(spark, sf_dir))


CATALOG: dict[str, Query] = {}


def with_views(sql: str, views: tuple[str, ...]) -> str:
    """Prefix the oracle text with the views it needs, in dependency order."""
    needed: list[str] = []

    def add(name: str) -> None:
        for parent in VIEW_SQL[name][0]:
            add(parent)
        if name not in needed:
            needed.append(name)

    for v in views:
        add(v)
    if not needed:
        return sql
    heads = ",\n".join(f"{v} as (\n{VIEW_SQL[v][1]}\n)" for v in needed)
    body = sql.strip()
    if body.lower().startswith("with recursive "):
        return f"with recursive {heads},\n{body[15:]}"
    return f"with {heads},\n{body[5:]}" if body.lower().startswith("with ") else f"with {heads}\n{body}"


def query(name: str, sql: str | None = None, views: tuple[str, ...] = ()):
    def register(build: Callable[[Views], DataFrame]):
        if name in CATALOG:
            raise ValueError(f"query {name} is registered twice")
        CATALOG[name] = Query(name, build, None if sql is None else with_views(sql, views))
        return build

    return register
