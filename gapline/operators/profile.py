"""Profiles of tables in one pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gapline.functions.score import half_up, ratio
from gapline.functions.text import missing_like


def missing(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``column`` and ``missing`` (nulls and placeholders) of each column, from one aggregation."""
    kinds = dict(df.dtypes)
    names = columns or df.columns
    gone = lambda c: F.count_if(missing_like(F.col(c)) if kinds[c] == "string" else F.col(c).isNull())
    row = df.agg(F.count(F.lit(1)).alias("rows"), *[gone(c).alias(f"m_{i}") for i, c in enumerate(names)])
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"m_{i}").alias("missing")) for i, c in enumerate(names)])
    return row.select("rows", F.explode(pairs).alias("p")).select("rows", "p.*")


def completeness(df: DataFrame, sheet: str) -> DataFrame:
    """One row: rows, columns, missing and all cells, and the share that is filled."""
    m = missing(df).agg(F.max("rows").alias("rows"), F.count(F.lit(1)).alias("columns"), F.sum("missing").alias("missing_cells"))
    cells = F.col("rows") * F.col("columns")
    return m.select(F.lit(sheet).alias("sheet"), "rows", "columns", "missing_cells", cells.alias("cells"), half_up(F.when(cells == 0, 0.0).otherwise(1.0 - ratio(F.col("missing_cells"), cells)), 4).alias("ratio"))


def lengths(c: Column) -> list[Column]:
    n = F.coalesce(F.length(c), F.lit(0))
    return [F.count_if(n > 0).alias("with_text"), F.count_if(n == 0).alias("without_text"), F.min(n).alias("shortest"), F.median(n).alias("median"), half_up(F.avg(n), 4).alias("mean"), F.max(n).alias("longest")]


def examples(df: DataFrame, column: str, order: str, n: int = 5) -> DataFrame:
    """The first ``n`` different values in the order of their first row."""
    return df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.min(order).alias("first")).orderBy("first", "value").limit(n)
