"""Relational operators that recur: ordered deduplication, overlays, paging, guards."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def require_columns(df: DataFrame, names: list[str]) -> DataFrame:
    if missing := sorted(set(names) - set(df.columns)):
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def flag_duplicates(df: DataFrame, keys: list[str], order: list, name: str = "is_duplicate") -> DataFrame:
    """True for all but the first of rows that agree on ``keys``; nulls agree with each other."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) > 1)


def first_by(df: DataFrame, keys: list[str], order: list, k: int = 1) -> DataFrame:
    """The first ``k`` rows of each key in an order that must be total."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_rn") <= k).drop("_rn")


def overlay_union(frames: list[DataFrame], keys: list[str]) -> DataFrame:
    """All rows of all frames, one for each key: that of the earliest frame. Missing columns are null."""
    tagged = [f.withColumn("_src", F.lit(i)) for i, f in enumerate(frames)]
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
    rest = [F.col(c) for c in both.columns if c not in (*keys, "_src")]
    return first_by(both, keys, [F.col("_src"), *rest]).drop("_src")


def merge_filled(base: DataFrame, saved: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``base`` with values of ``saved`` where those aren't blank."""
    side = saved.select(key, *[F.col(c).alias(f"_s_{c}") for c in columns])
    out = base.join(side, key, "left")
    for c in columns:
        out = out.withColumn(c, F.when(F.btrim(F.col(f"_s_{c}")) != "", F.col(f"_s_{c}")).otherwise(F.col(c)))
    return out.drop(*[f"_s_{c}" for c in columns])


def enrich(base: DataFrame, extra: DataFrame, key: str, order: list) -> DataFrame:
    """``base`` left-joined with the first row per key of ``extra``; shared columns keep ``base`` where it has a value."""
    one = first_by(extra, [key], order)
    shared = [c for c in one.columns if c in base.columns and c != key]
    one = one.select(key, *[F.col(c).alias(f"_x_{c}") if c in shared else F.col(c) for c in one.columns if c != key])
    out = base.join(one, key, "left")
    for c in shared:
        out = out.withColumn(c, F.coalesce(c, f"_x_{c}"))
    return out.drop(*[f"_x_{c}" for c in shared])


def page(df: DataFrame, order: list, limit: int, offset: int = 0) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(limit)


def one_to_one(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """An inner join that fails at run time where a key repeats on either side."""
    def checked(df: DataFrame) -> DataFrame:
        n = F.count(F.lit(1)).over(Window.partitionBy(key))
        return df.withColumn("_n", n).where(F.assert_true(F.col("_n") == 1, F.lit(f"{key} is not unique")).isNull()).drop("_n")

    return checked(left).join(checked(right), key)


def scan_filter(df: DataFrame, equals: dict[str, str] | None = None, contains: dict[str, str] | None = None, least: dict[str, float] | None = None) -> DataFrame:
    """Case-blind equality, case-blind literal search and lower bounds; parts that are None are skipped."""
    tests: list[Column] = [F.lower(F.col(c)) == v.lower() for c, v in (equals or {}).items() if v]
    tests += [F.lower(F.col(c)).contains(v.lower()) for c, v in (contains or {}).items() if v]
    tests += [F.col(c) >= v for c, v in (least or {}).items() if v is not None]
    return df.where(reduce(lambda a, b: a & b, tests)) if tests else df


def histogram(df: DataFrame, column: Column, name: str = "value") -> DataFrame:
    return df.groupBy(column.alias(name)).agg(F.count(F.lit(1)).alias("n"))
