"""How many rows there may be, as part of the plan: a breach is an error when the plan runs, and no job runs before."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _checked(n: Column, need: bool, what: Column) -> Column:
    """True for one row, false for none; an error for more, and for none if one is needed."""
    out = F.when(n > 1, F.raise_error(F.concat(F.lit("more than one row for "), what)).cast("boolean"))
    if need:
        out = out.when(n == 0, F.raise_error(F.concat(F.lit("no row for "), what)).cast("boolean"))
    return out.otherwise(n == 1)


def _only(rows: DataFrame, need: bool, name: str) -> DataFrame:
    # Two rows are enough to know; one row with a struct of the columns comes back as itself.
    one = rows.limit(2).agg(F.count("*").alias("__n"), F.first(F.struct(*[F.col(f"`{c}`") for c in rows.columns])).alias("__row"))
    return one.filter(_checked(F.col("__n"), need, F.lit(name))).select("__row.*")


def maybe_one(rows: DataFrame, name: str = "the query") -> DataFrame:
    """The only row, or none."""
    return _only(rows, False, name)


def exactly_one(rows: DataFrame, name: str = "the query") -> DataFrame:
    """The only row."""
    return _only(rows, True, name)


def one_for_each(parents: DataFrame, rows: DataFrame, key: list[str], need: bool = False) -> DataFrame:
    """Each parent with its only row of rows, matched by key: more than one is an error, and so is none if one is needed (else its columns are null).

    Rows are counted by key map-side before the join, so a key with many is an error and not a burden.
    """
    rest = [c for c in rows.columns if c not in key]
    found = rows.groupBy(*key).agg(F.count("*").alias("__n"), F.first(F.struct(*rest)).alias("__row"))
    n, name = F.coalesce("__n", F.lit(0)), F.concat_ws(",", *[F.col(k).cast("string") for k in key])
    fine = F.when(n > 1, F.raise_error(F.concat(F.lit("more than one row for "), name)).cast("boolean"))
    if need:
        fine = fine.when(n == 0, F.raise_error(F.concat(F.lit("no row for "), name)).cast("boolean"))
    both = parents.join(found, key, "left").filter(fine.otherwise(True))
    return both.select(*parents.columns, *[F.col(f"__row.{c}").alias(c) for c in rest])
