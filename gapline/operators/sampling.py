"""Deterministic samples under quotas, and the allocation of quotas."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def allocate(sizes: Mapping[str, int], total: int) -> dict[str, int]:
    """Shares of ``total`` by size: rounded half to even, one at least; then the largest gives or the roomiest takes.

    For a handful of strata, so plain Python on counts that an aggregation has made.
    """
    whole = sum(sizes.values())
    want = {k: max(1, round(n / whole * total)) for k, n in sizes.items()}
    while sum(want.values()) > total and (top := max(want, key=lambda k: want[k])) and want[top] > 1:
        want[top] -= 1
    while sum(want.values()) < total:
        top = max(sizes, key=lambda k: sizes[k] - want[k])
        if sizes[top] <= want[top]:
            break
        want[top] += 1
    return want


def capped_quota(df: DataFrame, stratum: str, group: str, order: list[Column], cap: int, target: int) -> DataFrame:
    """At most ``target`` rows a stratum: first those within ``cap`` a group, then the rest, each in ``order`` (a total order)."""
    inside = F.row_number().over(Window.partitionBy(stratum, group).orderBy(*order))
    ranked = df.withColumn("_over", (inside > cap).cast("int"))
    place = F.row_number().over(Window.partitionBy(stratum).orderBy("_over", *order))
    return ranked.withColumn("_place", place).where(F.col("_place") <= target).drop("_over", "_place")


def shuffled(key: Column, seed: int) -> Column:
    """A seeded order that any engine can repeat."""
    return F.md5(F.concat(key.cast("string"), F.lit(f":{seed}")))
