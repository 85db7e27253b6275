"""Where the modules of this package register their queries and oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .fixtures import view, with_views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


class Inputs:
    """The tables and derived views of one folder, as attributes."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return view(self.spark, self.sf_dir, name)


def query(sql: str | None = None) -> Callable:
    """Register ``f(inputs)`` under its name, with SQL that gives equal rows if there is any."""

    def add(f: Callable[[Inputs], DataFrame]) -> Callable[[Inputs], DataFrame]:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Inputs(spark, sf_dir))
        if sql:
            SQL[f.__name__] = with_views(sql)
        return f

    return add


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    """Columns at 6 decimals, as sums differ in the last digits between engines."""
    return df.withColumns({c: F.round(F.col(c).cast("double"), 6) for c in columns})
