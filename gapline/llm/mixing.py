"""Mixing sources to target weights, in DataFrame operations only.

A source's target is its share by weight of all sizes, stopped at ``limit`` times its own size; what is over is shared
again by weight among the sources below their stop, until none is above. That fixed point has a closed form: order the
sources by stop / weight; those under the water level are full and the level is what is left over the weight that is
left. Each document is then taken floor(rate) times, and once more if its hash, a number in [0, 1), is under the fraction.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
#: Up to so many sources the table of targets, one row per source, is broadcast; beyond, it is an ordinary join.
BROADCAST_SOURCES = 20_000


def words(text: Column) -> Column:
    """Number of words of a text; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), limit: int = 3) -> DataFrame:
    """``source``, ``source_size`` and ``target`` from rows of ``source`` and ``size``.

    One row per source passes through two ordered windows; documents never do. Sources weigh ``weights`` in turn, by
    code point with null last. A source whose documents are all empty has target 0.
    """
    each = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    turn = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    each = each.withColumn("weight", turn).withColumn("stop", F.col("source_size") * limit)
    before = Window.orderBy(F.col("stop") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(every) - F.coalesce(F.sum("stop").over(before), F.lit(0))
    weight_left = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    each = each.withColumn("level", left.cast("double") / weight_left.cast("double"))
    fits = F.when(F.col("stop") >= F.col("level") * F.col("weight"), F.col("level"))
    each = each.withColumn("level", F.max(fits).over(every))
    return each.select("source", "source_size", F.least(F.col("stop").cast("double"), F.col("level") * F.col("weight")).alias("target"))


def chance(ident: Column, digest: Column, seed: int) -> Column:
    """A number in [0, 1) from an id and a text's digest, the same in every run: 52 bits of an MD5."""
    text = F.concat(F.coalesce(ident.cast("string"), F.lit("")), F.lit("|"), F.coalesce(digest, F.lit("")), F.lit(f"|{seed}"))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def mix(documents: DataFrame, weights: tuple[int, ...] = (5, 2, 1), limit: int = 3, seed: int = 6, id_col: str = "doc_id", size: Column | None = None, digest: Column | None = None) -> DataFrame:
    """``documents`` with ``size``, ``source_size``, ``target``, ``copies`` and ``taken`` (size times copies) added.

    ``size`` defaults to the words of ``text`` and ``digest`` to its MD5. Columns of these names that are there already are replaced. Defined cases:
    null text and null source are size 0 and a source of their own (last); a source of size 0 takes none of its documents;
    rows with the same id and the same text share one chance (so do null ids with the same text); an empty table gives an empty result.
    """
    made = ("size", "source_size", "target", "copies", "taken")
    own = F.md5("text") if digest is None else digest
    docs = documents.withColumn("_chance", chance(F.col(id_col), own, seed)).withColumn("size", words(F.col("text")) if size is None else size)
    docs = docs.drop(*made[1:])
    goals = targets(docs.select("source", "size"), weights, limit)
    few = docs.select("source").distinct().limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    side = goals.select(F.col("source").alias("_source"), "source_size", "target")
    docs = docs.join(F.broadcast(side) if few else side, F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    more = F.col("_chance") < rate - F.floor(rate)
    docs = docs.withColumn("copies", F.floor(rate) + F.when(more, 1).otherwise(0))
    return docs.withColumn("taken", (F.col("size") * F.col("copies")).cast("long")).withColumn("copies", F.col("copies").cast("int")).drop("_chance")


def emit(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """Each row of ``mix`` as often as ``copies`` says, with ``columns`` only."""
    return mixed.where("copies > 0").withColumn("_copy", F.explode(F.expr("sequence(1, copies)"))).select(*columns)
