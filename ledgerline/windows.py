"""Windows over the yearly rows of one company. Keys are unique, so a group is as long as the company's history."""

from __future__ import annotations

from pyspark.sql import Window, WindowSpec


def by_year(*more: str) -> WindowSpec:
    return Window.partitionBy("ticker", *more).orderBy("fiscal_year")
