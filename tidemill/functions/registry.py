"""User functions: scalars, aggregates, per-series windows and table functions, found before built-in ones."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import SparkSession
from pyspark.sql import functions as F


class Functions:
    def __init__(self, spark: SparkSession):
        self.spark, self.enabled = spark, True
        self.scalars: dict[str, object] = {}
        self.aggregates: dict[str, object] = {}
        self.windows: dict[str, Callable] = {}
        self.tables: dict[str, Callable] = {}

    def scalar(self, name: str, f: Callable, kind: str, vectorised: bool = True) -> None:
        """f over pandas series (or, if not vectorised, over values)."""
        self.scalars[name.lower()] = made = F.pandas_udf(f, kind) if vectorised else F.udf(f, kind)
        self.spark.udf.register(name, made)

    def aggregate(self, name: str, f: Callable, kind: str) -> None:
        """f from one pandas series to one value; a group must fit a task."""
        self.aggregates[name.lower()] = made = F.pandas_udf(f, kind, F.PandasUDFType.GROUPED_AGG)
        self.spark.udf.register(name, made)

    def window(self, name: str, kernel: Callable) -> None:
        """kernel() makes a step function for each series, as in operators.stateful."""
        self.windows[name.lower()] = kernel

    def table(self, name: str, f: Callable) -> None:
        """f(spark, *arguments) makes a DataFrame."""
        self.tables[name.lower()] = f

    def unregister(self, name: str) -> bool:
        name, found = name.lower(), False
        for kind in (self.scalars, self.aggregates, self.windows, self.tables):
            found |= kind.pop(name, None) is not None
        if found:
            self.spark.sql(f"DROP TEMPORARY FUNCTION IF EXISTS {name}")
        return found
