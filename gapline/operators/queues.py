"""Annotation queues: which rows people are asked to label next, under quotas and a cap per place.

A draw goes through passes in order, each with its own rows, target and seeded order, and counts what each place has given so
far. That is sequential, but only few rows can matter: a pass never takes a row that has ``cap`` rows of its place before it, and
passes over at most twice the whole draw before it has its target. So each pass first reduces to that many rows by windows, and
the draw itself runs over the few that are left, a number that depends on the draw's size and not on the table's.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gapline.functions import text as X
from gapline.functions.parse import rating_class
from gapline.operators.sampling import allocate, shuffled


@dataclass(frozen=True)
class Pass:
    """Rows under ``where``, at most ``target`` of them; ``spare``: what the cap held back may fill the target; ``capped``: whether the cap counts at all."""

    reason: str
    where: Column
    target: int
    spare: bool = False
    capped: bool = True


def draw(df: DataFrame, key: str, place: Column, passes: list[Pass], total: int, cap: int, seed: int = 42) -> DataFrame:
    """``df``'s rows that the passes take, with ``selection_reason`` and ``selection_place`` (from 1).

    ``key`` is unique. Each pass goes by a seeded hash of the key, which any engine can repeat. A null place is a place.
    """
    base = df.select(F.col(key).alias("_k"), F.coalesce(place.cast("string"), F.lit("")).alias("_p"), shuffled(F.col(key), seed).alias("_o"), F.array(*[F.coalesce(p.where, F.lit(False)) for p in passes]).alias("_w"))
    each = base.select("_k", "_p", "_o", F.posexplode("_w").alias("_i", "_on")).where("_on").drop("_on")
    by = Window.partitionBy("_i").orderBy("_o", "_k")
    near = F.row_number().over(Window.partitionBy("_i", "_p").orderBy("_o", "_k"))
    each = each.withColumn("_near", near).withColumn("_any", F.row_number().over(by)).withColumn("_in", F.row_number().over(Window.partitionBy("_i", F.col("_near") <= cap).orderBy("_o", "_k")))
    most = F.element_at(F.array(*[F.lit(min(p.target, total) + 2 * total) for p in passes]), F.col("_i") + 1)
    few = each.where((F.col("_any") <= most) | ((F.col("_near") <= cap) & (F.col("_in") <= most))).orderBy("_i", "_o", "_k").select("_i", "_k", "_p")
    taken: dict = {}
    given: dict[str, int] = {}
    rows: list[list] = [[] for _ in passes]
    for r in few.toLocalIterator():
        rows[r["_i"]].append((r["_k"], r["_p"]))
    for p, mine in zip(passes, rows, strict=True):
        here, held = 0, []
        for k, where in mine:
            if here >= p.target or len(taken) >= total:
                break
            if k in taken:
                continue
            if p.capped and given.get(where, 0) >= cap:
                held.append(k)
                continue
            taken[k] = p.reason
            given[where] = given.get(where, 0) + 1
            here += 1
        for k in held if p.spare else ():
            if here >= p.target or len(taken) >= total:
                break
            taken[k] = p.reason
            here += 1
    kind = df.schema[key].dataType.simpleString()
    chosen = df.sparkSession.createDataFrame([(k, r, i + 1) for i, (k, r) in enumerate(taken.items())], f"`{key}` {kind}, selection_reason string, selection_place int")
    return df.join(F.broadcast(chosen), key)


def label_candidates(reviews: DataFrame) -> DataFrame:
    """Rows with a weak label and text that are no duplicates; if there are none, the duplicates as well."""
    some = reviews.where("label is not null and text_raw is not null and text_length > 0")
    first = some.where("not is_duplicate")
    return some if first.isEmpty() else first


def sentiment_queue(reviews: DataFrame, size: int = 300, cap: int = 8, seed: int = 42) -> DataFrame:
    """A queue spread over label, rating, category and length in proportion: a target per stratum, filled from what the cap held
    back; then any rows under the cap; then any rows. ``reviews``: review_id, place_id, label, rating, category, text_raw, text_length, is_duplicate.
    """
    rows = label_candidates(reviews)
    stratum = F.concat_ws("|", "label", rating_class(F.col("rating")), "category", X.length_bucket(F.col("text_length")))
    rows = rows.withColumn("stratum", stratum)
    sizes = {r.stratum: r["count"] for r in rows.groupBy("stratum").count().orderBy(F.desc("count"), "stratum").toLocalIterator()}
    size = min(size, sum(sizes.values()))
    if not size:
        return rows.withColumn("selection_reason", F.lit(None).cast("string")).withColumn("selection_place", F.lit(None).cast("int"))
    passes = [Pass("stratum", F.col("stratum") == s, n, spare=True) for s, n in allocate(sizes, size).items()]
    passes += [Pass("fill", F.lit(True), size), Pass("fill_beyond_cap", F.lit(True), size, capped=False)]
    return draw(rows, "review_id", F.col("place_id"), passes, size, cap, seed)


def clause_queue(clauses: DataFrame, aspects: list[str], size: int, cap: int, other: str = "lainnya", seed: int = 42) -> DataFrame:
    """An even share of clauses for each aspect and for those without one, then any. ``clauses``: clause_id, place_id, weak_aspects (array)."""
    named = [a for a in aspects if a != other]
    quota = max(1, size // (len(named) + 1))
    passes = [Pass(f"weak_aspect:{a}", F.array_contains("weak_aspects", a), quota) for a in named]
    passes += [Pass("taxonomy_unmatched", F.col("weak_aspects") == F.array(F.lit(other)), quota), Pass("stratified_fill", F.lit(True), size)]
    return draw(clauses, "clause_id", F.col("place_id"), passes, size, cap, seed)


def aspect_sample(rows: DataFrame, key: str, size: int, seed: int = 42) -> DataFrame:
    """A few rows of every aspect (a thirtieth of the sample, three at least), each once, then rows in seeded order up to ``size``."""
    order = shuffled(F.col(key), seed)
    each = max(3, size // 30)
    seen = rows.select(key, F.explode("weak_aspects").alias("_a"), order.alias("_o"))
    first = seen.withColumn("_n", F.row_number().over(Window.partitionBy("_a").orderBy("_o"))).where(F.col("_n") <= each)
    seeds = first.groupBy(key).agg(F.min("_a").alias("_a"))
    ranked = rows.select(key, order.alias("_o")).join(seeds, key, "left").orderBy(F.col("_a").asc_nulls_last(), "_o").limit(size).select(key)
    return rows.join(F.broadcast(ranked), key, "left_semi")


def suggested_aspects(scores: DataFrame, key: str, threshold: float, most: int = 3, shown: int = 5, none: str = "none") -> DataFrame:
    """``key``, ``ai_suggested_aspects`` (at most ``most`` at the threshold, else ``none``) and ``ai_aspect_probabilities`` (JSON of the ``shown`` likeliest in order).

    ``scores``: ``key``, ``label``, ``p``.
    """
    # an object's keys keep the order they are written in
    every = F.sort_array(F.collect_list(F.struct((-F.col("p")).alias("n"), "label", "p")))
    part = F.transform(F.slice("_s", 1, shown), lambda x: F.concat(F.to_json(F.array(x.label)).substr(F.lit(2), F.length(F.to_json(F.array(x.label))) - 2), F.lit(": "), x.p.cast("string")))
    good = F.transform(F.slice(F.filter("_s", lambda x: x.p >= threshold), 1, most), lambda x: x.label)
    rows = scores.groupBy(key).agg(every.alias("_s"))
    text = F.when(F.size(good) > 0, F.array_join(good, "|")).otherwise(F.lit(none))
    return rows.select(key, text.alias("ai_suggested_aspects"), F.concat(F.lit("{"), F.array_join(part, ", "), F.lit("}")).alias("ai_aspect_probabilities"))


def gold_of(queue: DataFrame, key: str, label: str, approval: str, old: DataFrame | None = None) -> DataFrame:
    """The gold rows of an edited queue (approved, with a label, one per key); an error if rows of ``old`` would be lost."""
    from gapline.operators.annotation import keep_all

    rows = queue.where(X.approved(F.col(approval)) & F.coalesce(F.btrim(label) != "", F.lit(False))).dropDuplicates([key])
    return rows if old is None else keep_all(old, rows, key)


def read_probabilities(text: str) -> dict[str, float]:
    """The likeliest first, as written."""
    return json.loads(text)
