"""Named query plans and their DuckDB twins."""

from __future__ import annotations

import importlib
import pkgutil


def load_all() -> None:
    """Imports every plan module once, which registers its queries."""
    for m in pkgutil.iter_modules(__path__):
        importlib.import_module(f"{__name__}.{m.name}")
