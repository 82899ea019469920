"""The service-gap score of every place and aspect."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapline.functions import score as S
from gapline.operators.graph import discard, materialise
from gapline.operators.metrics import ranked

METADATA = ["category", "place_type", "address", "lat", "lon", "rating", "status", "price_text", "facility_text"]


def place_facts(places: DataFrame, reviews: DataFrame, as_of: datetime.date) -> DataFrame:
    """Places with review_count, volume, completeness, reliability, gap of the rating and recency."""
    seen = reviews.groupBy("place_id").agg(F.countDistinct("review_id").alias("review_count"), F.max("day").alias("latest"))
    out = places.join(seen, "place_id", "left").withColumn("review_count", F.coalesce("review_count", F.lit(0).cast("long")))
    out = out.withColumn("volume", S.volume_confidence(F.col("review_count"))).withColumn("completeness", S.completeness([F.col(c) for c in METADATA]))
    out = out.withColumn("reliability", S.clamp((F.col("completeness") + F.col("volume")) / 2.0))
    return out.withColumn("rating_gap", S.rating_gap(F.col("rating"))).withColumn("recency", S.recency(F.col("latest"), F.lit(as_of)))


FEW = 10_000


def gap_scores(places: DataFrame, reviews: DataFrame, mentions: DataFrame, aspects: DataFrame, scarcity: DataFrame, as_of: datetime.date) -> DataFrame:
    """One row per (place, aspect) that is mentioned or whose place has enough reviews, with all components and a rank.

    ``mentions`` (place_id, aspect, negative) and the facts of places are aggregated once and kept as tables, and so are the scored rows that the rank
    is made from. Aspects are broadcast up to ``FEW`` of them; beyond, the product is made by a join. The global largest count is one
    broadcast row. Rank orders by score, negative and all mentions, then place and aspect.
    """
    counts = mentions.groupBy("place_id", "aspect").agg(F.count(F.lit(1)).alias("mentions"), F.count_if("negative").alias("negatives"))
    counts = materialise(counts)
    most = counts.agg(F.greatest(F.coalesce(F.max("mentions"), F.lit(0)), F.lit(1)).alias("most"))
    facts = place_facts(places, reviews, as_of).join(scarcity.select(F.col("id").alias("place_id"), "scarcity"), "place_id", "left")
    facts = materialise(facts)
    names = materialise(aspects.select("aspect").distinct())
    side = F.broadcast(names) if names.count() <= FEW else names
    rows = facts.crossJoin(side).join(counts, ["place_id", "aspect"], "left").fillna(0, ["mentions", "negatives"])
    rows = rows.where((F.col("mentions") > 0) | (F.col("review_count") >= S.REVIEW_FLOOR)).crossJoin(F.broadcast(most))
    rows = rows.withColumn("rate", S.smoothed_rate(F.col("negatives"), F.col("mentions")))
    rows = rows.withColumn("frequency", S.clamp(F.col("mentions") / F.greatest(F.col("review_count"), F.lit(1)).cast("double")))
    rows = rows.withColumn("frequency_norm", S.clamp(F.col("mentions") / F.col("most").cast("double"))).withColumn("scarcity", F.coalesce("scarcity", F.lit(0.5)))
    w = S.WEIGHTS
    base = w["negative_rate"] * F.col("rate") + w["mention_frequency"] * F.col("frequency_norm") + w["scarcity"] * F.col("scarcity") + w["volume"] * F.col("volume")
    base = base + w["rating_gap"] * F.col("rating_gap") + w["recency"] * F.col("recency") + w["metadata_gap"] * (1.0 - F.col("completeness"))
    rows = rows.withColumn("base", base).withColumn("score", S.half_up(S.clamp(F.col("base")) * 100.0 * F.col("reliability"), 4))
    rows = rows.withColumn("confidence", S.confidence(F.col("volume"), F.col("reliability")))
    for c in ("rate", "frequency", "frequency_norm", "scarcity", "volume", "completeness", "reliability", "rating_gap", "recency", "base"):
        rows = rows.withColumn(c, S.half_up(F.col(c), 6))
    rows = rows.withColumn("priority", S.priority(F.col("score")))
    rows = rows.withColumn("reasons", F.array_join(S.reason_codes(F.col("rate"), F.col("frequency"), F.col("scarcity"), F.col("volume"), F.col("reliability")), "|"))
    rows = materialise(rows.drop("most", "latest"))
    discard(counts, facts, names)
    return ranked(rows, "score", ["negatives", "mentions"], ["place_id", "aspect"])
