"""User-defined tools: Python functions with a typed contract, run over the rows of a table as a table function.

The output's columns follow the tool that is named, so they are known when the plan is made: the input's columns that are no arguments, ok, error, message, and
the tool's outputs. A row that breaks the contract, or on which the tool fails, is one row with ok = false, a reason and a message; the others have a row for each
result. Bounds are checked before the tool sees a row, and the types of its results after it.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, LongType, StringType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

_TYPES = {"string": (str, StringType()), "integer": (int, LongType()), "number": (float, DoubleType()), "boolean": (bool, BooleanType())}
ENVELOPE = ("ok", "error", "message")


@dataclass(frozen=True)
class Field:
    """An argument or a result. low and high bound numbers, or the length of texts; an argument with a default may be missing (null)."""

    kind: str
    low: float | None = None
    high: float | None = None
    choices: tuple = ()
    default: object = None
    needed: bool = True

    def __post_init__(self):
        if self.kind not in _TYPES:
            raise ValueError(f"no such kind: {self.kind}")

    def checked(self, name: str, value: object) -> tuple[object, str | None]:
        """The value as the tool gets it, and what is wrong with it."""
        if value is None:
            return (self.default, None) if self.default is not None or not self.needed else (None, f"{name} is required")
        want = _TYPES[self.kind][0]
        if want is float and isinstance(value, int) and not isinstance(value, bool):
            value = float(value)
        if not isinstance(value, want) or want is int and isinstance(value, bool) or want is float and not math.isfinite(value):
            return None, f"{name} is no {self.kind}"
        size = len(value) if want is str else value
        if self.low is not None and size < self.low or self.high is not None and size > self.high:
            return None, f"{name} is out of bounds"
        if self.choices and value not in self.choices:
            return None, f"{name} is none of its choices"
        return value, None


@dataclass(frozen=True)
class Tool:
    """run takes the arguments by name and returns a mapping of results, or several of them."""

    name: str
    run: Callable[..., Mapping | Iterable[Mapping]]
    inputs: Mapping[str, Field]
    outputs: Mapping[str, Field]
    version: str = "1.0.0"
    read_only: bool = True
    idempotent: bool = True
    description: str = field(default="", compare=False)

    def __post_init__(self):
        if clash := set(ENVELOPE) & {*self.inputs, *self.outputs} or set(self.inputs) & set(self.outputs):
            raise ValueError(f"names used twice: {sorted(clash)}")

    def results(self, given: Mapping) -> tuple[list[tuple], str | None, str | None]:
        """The rows of results, or a reason and a message."""
        arguments, wrong = {}, []
        for name, f in self.inputs.items():
            arguments[name], bad = f.checked(name, given.get(name))
            wrong += [bad] if bad else []
        if wrong:
            return [], "invalid_input", "; ".join(wrong)
        try:
            made = self.run(**arguments)
            found = [made] if isinstance(made, Mapping) else list(made)
        except Exception as e:  # a tool's failure is a row's result, not the query's
            return [], "tool_failed", f"{type(e).__name__}: {e}"
        rows = []
        for r in found:
            values = [f.checked(name, r.get(name)) for name, f in self.outputs.items()]
            if bad := [x for _, x in values if x]:
                return [], "bad_output", "; ".join(bad)
            rows.append(tuple(v for v, _ in values))
        return rows, None, None


def table_function(tools: Iterable[Tool]):
    """A table function of a table and a tool's name, over these tools; register it with spark.udtf.register to use it in SQL."""
    known = {t.name: t for t in tools}

    class RunTool:
        def __init__(self, plan: AnalyzeResult):
            self.passed = [c for c in plan.schema.names if c not in ENVELOPE]
            self.tool: Tool | None = None

        @staticmethod
        def analyze(rows: AnalyzeArgument, tool: AnalyzeArgument) -> AnalyzeResult:
            if not rows.isTable or not tool.isConstantExpression:
                raise ValueError("a table and the constant name of a tool are asked for")
            if tool.value not in known:
                raise ValueError(f"no such tool: {tool.value}")
            t = known[tool.value]
            columns = rows.dataType.names
            if missing := [n for n, f in t.inputs.items() if f.needed and f.default is None and n not in columns]:
                raise ValueError(f"the table lacks {', '.join(missing)}")
            passed = [f for f in rows.dataType.fields if f.name not in t.inputs]
            if clash := {f.name for f in passed} & {*ENVELOPE, *t.outputs}:
                raise ValueError(f"the table has columns of the result: {sorted(clash)}")
            envelope = [StructField("ok", BooleanType()), StructField("error", StringType()), StructField("message", StringType())]
            return AnalyzeResult(StructType([*passed, *envelope, *[StructField(n, _TYPES[f.kind][1]) for n, f in t.outputs.items()]]))

        def eval(self, row, tool: str):
            t = known[tool]
            given = row.asDict()
            kept = tuple(given[c] for c in self.passed if c in given and c not in t.inputs)
            rows, error, message = t.results(given)
            if error:
                yield (*kept, False, error, message, *[None] * len(t.outputs))
            for r in rows:
                yield (*kept, True, None, None, *r)

    return F.udtf(RunTool)


def run_tool(rows: DataFrame, tool: Tool) -> DataFrame:
    """The tool over all rows, partitioned as they are."""
    return table_function([tool])(rows.asTable(), F.lit(tool.name))
