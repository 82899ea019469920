"""Shared pieces of the training-data operators: where intermediate tables go, and connected components."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gapline.operators.graph import discard, new_path, written
from gapline.operators.graph import materialise as cut

__all__ = ["components", "cut", "discard", "long_texts", "new_path", "written"]

ARROW_ROWS = 1000


def long_texts(spark: SparkSession) -> None:
    """Hold the session's Arrow batches to a thousand rows, unless it asks for fewer: ten thousand texts at a time take an
    executor hundreds of MB beside its heap."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000") or 0) not in range(1, ARROW_ROWS + 1):
        spark.conf.set(key, str(ARROW_ROWS))


#: Up to so many edges (1.6 MB, some 50 MB as Python numbers) one task joins them in under a second, where rounds over all executors
#: cost ten to twenty jobs; beyond, the rounds do. Both give the same roots.
FEW_EDGES = 100_000


def _join_few(batches):
    root: dict[int, int] = {}

    def top(x):
        while root.setdefault(x, x) != x:
            root[x] = x = root[root[x]]
        return x

    for b in batches:
        for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            x, y = top(x), top(y)
            if x != y:
                root[max(x, y)] = min(x, y)
    nodes = list(root)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([top(x) for x in nodes], pa.int64())], ["node", "root"])


def components(edges: DataFrame, max_rounds: int = 60, few: int = FEW_EDGES) -> DataFrame:
    """Connected components: in one task up to ``few`` edges, beyond by alternating large-star and small-star steps.

    ``edges`` has two long columns ``a`` and ``b``; nulls, loops and repeated or reversed pairs are allowed and harmless.
    Returns one row per node that has an edge to another: ``node`` and ``root``, the smallest node of its component. No
    neighbour list is ever gathered: each step is a minimum per node and an equi-join, so a node with a third of
    all edges is a skewed join and nothing worse. Empty input gives an empty result.
    """
    pair = lambda x, y: [F.greatest(x, y).alias("a"), F.least(x, y).alias("b")]
    now = cut(edges.where("a <> b").select(*pair("a", "b")).distinct())
    seen = _mark(now)
    if seen[0] <= few:
        joined = cut(now.coalesce(1).mapInArrow(_join_few, "node long, root long"))
        discard(now)
        return joined
    for _ in range(max_rounds if seen[0] else 0):
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").where("a <> b").distinct()
        small = cut(small)
        discard(now)
        now = small
        was, seen = seen, _mark(now)
        if was == seen:
            break
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _mark(edges: DataFrame) -> tuple:
    """Count and order-free digest of an edge set: equal for equal sets."""
    row = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.hash("b", "a"))).first()
    return tuple(row)
