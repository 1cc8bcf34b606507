"""Registry of queries and the SQL that checks them."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from qassay.plans.views import VIEWS_SQL, Tables
from qassay.session import ensure_checkpoint_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def with_views(body: str) -> str:
    """SQL body with the definitions of every view it names, directly or through another view."""
    needed: list[str] = []

    def need(text: str) -> None:
        for name in re.findall(r"\bv_[a-z_]+\b", text):
            if name in VIEWS_SQL and name not in needed:
                need(VIEWS_SQL[name])
                if name not in needed:
                    needed.append(name)

    need(body)
    body = body.strip()
    parts = [f"{name} AS ({VIEWS_SQL[name].strip()})" for name in needed]
    if body.upper().startswith("WITH "):
        return "WITH " + ",\n".join(parts + [body[5:]])
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + body


def query(name: str, sql: str | None = None):
    """Register a function of Tables as a query."""

    def register(build: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return build(Tables(spark, sf_dir))

        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = with_views(sql)
        return build

    return register


def scratch(spark: SparkSession, name: str) -> str:
    """New folder below the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
