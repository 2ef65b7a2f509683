"""Compute costly columns once per row.

Spark merges projections and moves filters below them, which repeats the expression of a column wherever
the column is mentioned. Text parsing repeated that way multiplies the cost of a job. A one-element
``explode`` keeps the columns together: what follows reads their values. The columns are made in a projection
before it, so that they are compiled; inside the ``explode`` one higher-order function would have all of them interpreted.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F


def computed(
    df: DataFrame, columns: dict[str, Column], keep: list[str] | None = None,
    where: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """Add ``columns`` to ``keep`` (all columns by default); ``where`` tests the struct of new columns."""
    kept = [c for c in (df.columns if keep is None else keep) if c not in columns]
    made = df.select(*kept, F.struct(*[c.alias(n) for n, c in columns.items()]).alias("_made"))
    one = F.array("_made") if where is None else F.when(where(F.col("_made")), F.array("_made"))
    return made.select(*kept, F.explode(one).alias("_computed")).select(*kept, "_computed.*")
