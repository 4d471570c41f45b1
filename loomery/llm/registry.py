"""The queries of this subpackage: each applies one operator with production parameters to its whole table."""

from __future__ import annotations

import importlib
import pkgutil
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


def _modules():
    package = importlib.import_module(f"{__package__}.plans")
    for m in sorted(pkgutil.iter_modules(package.__path__), key=lambda m: int(m.name.split("_")[0][2:])):
        yield importlib.import_module(f"{package.__name__}.{m.name}")


def queries() -> dict[str, Query]:
    return {m.__name__.rpartition(".")[2]: m.query for m in _modules()}


def oracle_sql() -> dict[str, str]:
    return {m.__name__.rpartition(".")[2]: m.SQL for m in _modules() if m.SQL}
