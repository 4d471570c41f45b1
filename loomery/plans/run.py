"""Finds and runs named plans."""

from __future__ import annotations

import inspect

from pyspark.sql import DataFrame, SparkSession

from .registry import PLANS


def search_plans(text: str = "") -> list[tuple[str, str]]:
    """Names and descriptions of the plans that hold every word of the text."""
    terms = text.lower().split()
    return [(e.name, e.doc) for e in PLANS.values() if all(t in f"{e.name} {e.doc}".lower() for t in terms)]


def run_plan(name: str, spark: SparkSession, sf_dir: str, **params) -> DataFrame:
    """Runs a plan by its exact name; unknown names and parameters are errors."""
    if name not in PLANS:
        raise KeyError(f"no plan named {name}")
    plan = PLANS[name].plan
    extra = set(params) - set(inspect.signature(plan).parameters)
    if extra:
        raise TypeError(f"{name} takes no {', '.join(sorted(extra))}")
    return plan(spark, sf_dir, **params)
