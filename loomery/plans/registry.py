"""Collects the named plans: each is (spark, sf_dir) -> DataFrame with an optional SQL twin."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Plan = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Entry:
    name: str
    plan: Plan
    sql: str | None
    doc: str


PLANS: dict[str, Entry] = {}


def query(name: str, sql: str | None = None) -> Callable[[Plan], Plan]:
    """Registers a plan under a unique name, with the DuckDB SQL that must give the same rows."""

    def put(plan: Plan) -> Plan:
        if name in PLANS:
            raise ValueError(f"plan {name} is registered twice")
        PLANS[name] = Entry(name, plan, sql, (plan.__doc__ or "").strip())
        return plan

    return put
