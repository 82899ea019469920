"""The batch: named stages in order, each from tables to tables, kept as Parquet between stages."""

from __future__ import annotations

import datetime
import time
from collections.abc import Callable
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gapline.functions import geo
from gapline.functions import score as S
from gapline.operators import cleaning, spatial
from gapline.operators import evidence as ev
from gapline.operators import profile as Pr
from gapline.operators.gap import gap_scores


@dataclass
class Context:
    """What stages share: the raw sheets, the taxonomy, the day that counts as today, and where tables go."""

    spark: SparkSession
    root: str
    sheets: dict[str, DataFrame]
    taxonomy: ev.Taxonomy
    context_words: list[str]
    as_of: datetime.date
    other: str = "lainnya"
    cluster_km: float = 5.0
    cluster_least: int = 4

    def put(self, name: str, df: DataFrame) -> None:
        df.write.mode("overwrite").parquet(f"{self.root.rstrip('/')}/{name}")

    def get(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root.rstrip('/')}/{name}")


def profile(c: Context) -> None:
    parts = [Pr.completeness(df, name) for name, df in c.sheets.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    c.put("sheet_profile", out)


def clean(c: Context) -> None:
    places, mapping, reviews = cleaning.build(c.sheets)
    c.put("entity_mapping", mapping)
    c.put("places", places)
    c.put("reviews", reviews)


def aspect_evidence(c: Context) -> None:
    """Clauses of usable reviews, their aspects by keyword, and whether each is negative by keyword or by the review's label."""
    usable = c.get("reviews").where("text is not null and text_length > 0 and not is_duplicate")
    clauses = ev.clause_rows(usable, "review_id", "text").join(usable.select("review_id", "place_id", "label"), "review_id")
    found = ev.detect(clauses, "clause_text", c.taxonomy, c.context_words, c.other)
    each = found.select("*", F.explode("weak_aspects").alias("aspect")).where(F.col("aspect") != c.other)
    decision = F.when(F.col("label") == "negative", "negative").otherwise("non_negative")
    label, negative, source, sure = ev.fuse(F.array_contains("negative_aspects", F.col("aspect")), decision, F.lit(0.5))
    c.put("evidence", each.select("review_id", "place_id", "clause_index", "aspect", "clause_text", label.alias("sentiment_label"), negative.alias("is_negative"), source.alias("sentiment_source"), sure.alias("prediction_confidence"), F.lit(None).cast("double").alias("complaint_probability")))


def geospatial(c: Context) -> None:
    points = c.get("places").where(geo.valid(F.col("lat"), F.col("lon"))).select(F.xxhash64("place_id").alias("id"), "place_id", "lat", "lon")
    found = spatial.dbscan(points, c.cluster_km, c.cluster_least)
    c.put("clusters", points.join(found, "id").select("place_id", F.col("cluster").cast("long").alias("cluster")))


def gap_scoring(c: Context) -> None:
    places, reviews = c.get("places"), c.get("reviews")
    mentions = c.get("evidence").select("place_id", "aspect", F.col("is_negative").alias("negative"))
    aspects = c.spark.createDataFrame([(a,) for a in c.taxonomy if a != c.other], "aspect string")
    near = spatial.scarcity(places.select(F.col("place_id").alias("id"), "lat", "lon", "category"), S.RADIUS_KM)
    c.put("service_gaps", gap_scores(places, reviews, mentions, aspects, near, c.as_of))


def export(c: Context) -> None:
    counts = [c.get(n).agg(F.lit(n).alias("name"), F.count(F.lit(1)).alias("rows")) for n in ("places", "reviews", "evidence", "clusters", "service_gaps")]
    out = counts[0]
    for p in counts[1:]:
        out = out.unionByName(p)
    c.put("export_summary", out)


#: Stage -> (function, tables it needs, tables it makes).
STAGES: dict[str, tuple[Callable[[Context], None], list[str], list[str]]] = {
    "profile": (profile, [], ["sheet_profile"]),
    "clean": (clean, [], ["entity_mapping", "places", "reviews"]),
    "aspect-sentiment": (aspect_evidence, ["reviews"], ["evidence"]),
    "geospatial": (geospatial, ["places"], ["clusters"]),
    "gap-scoring": (gap_scoring, ["places", "reviews", "evidence"], ["service_gaps"]),
    "export": (export, ["places", "reviews", "evidence", "clusters", "service_gaps"], ["export_summary"]),
}
ALIASES = {"eda": "profile", "preprocess": "clean", "aspects": "aspect-sentiment", "clusters": "geospatial", "scores": "gap-scoring"}


def resolve(name: str) -> list[str]:
    """The stages that a name stands for: all, an alias, or itself."""
    if name == "all":
        return list(STAGES)
    name = ALIASES.get(name, name)
    if name not in STAGES:
        raise ValueError(f"no stage {name}")
    return [name]


def run(c: Context, stage: str = "all") -> dict[str, float]:
    """Run a stage or all of them; seconds of each. A table that a stage needs and isn't there stops it before any work."""
    took = {}
    for name in resolve(stage):
        work, needs, makes = STAGES[name]
        for table in needs:
            try:
                c.get(table).schema  # noqa: B018
            except Exception as e:
                raise FileNotFoundError(f"{name} needs {table}") from e
        start = time.perf_counter()
        work(c)
        for table in makes:
            c.get(table).schema  # noqa: B018
        took[name] = time.perf_counter() - start
    return took


def artifacts(c: Context) -> list[dict]:
    """The tables of a local root, and whether they are there."""
    return [{"name": t, "exists": Path(c.root, t).exists()} for _, _, made in STAGES.values() for t in made]
