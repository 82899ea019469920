"""The read side: places, gaps and evidence under filters and pages, with published imports laid over the baseline."""

from __future__ import annotations

import datetime
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapline.functions import score as S
from gapline.operators import spatial
from gapline.operators.gap import gap_scores
from gapline.operators.imports import Manifest
from gapline.operators.relational import first_by, page, scan_filter


@dataclass
class Store:
    """Lazy views over the canonical tables.

    ``places`` (place_id, place_name, category, lat, lon, rating, ...), ``reviews`` (review_id, place_id, text, label, is_duplicate, day), ``evidence`` (review_id, place_id,
    clause_index, aspect, clause_text, is_negative, complaint_probability, prediction_confidence), ``aspects`` (aspect), ``clusters`` (place_id, cluster). ``imported_reviews`` and
    ``imported_evidence`` have an ``import_id`` too and count once their run is published.
    """

    places: DataFrame
    reviews: DataFrame
    evidence: DataFrame
    aspects: DataFrame
    clusters: DataFrame
    as_of: datetime.date
    imported_reviews: DataFrame | None = None
    imported_evidence: DataFrame | None = None
    radius_km: float = S.RADIUS_KM
    manifest: Manifest = field(default_factory=Manifest)

    def publish(self, run: str) -> None:
        self.manifest = self.manifest.publish(run)

    def unpublish(self, run: str) -> None:
        self.manifest = self.manifest.unpublish(run)

    def all_reviews(self) -> DataFrame:
        return self.reviews if self.imported_reviews is None else self.manifest.view(self.reviews, self.imported_reviews, ["review_id"])

    def all_evidence(self) -> DataFrame:
        return self.evidence if self.imported_evidence is None else self.manifest.view(self.evidence, self.imported_evidence, ["review_id", "clause_index", "aspect"])

    def valid_reviews(self) -> DataFrame:
        return self.all_reviews().where(~F.coalesce("is_duplicate", F.lit(False)) & (F.coalesce(F.length("text"), F.lit(0)) > 0))

    def rankings(self) -> DataFrame:
        mentions = self.all_evidence().select("place_id", "aspect", F.coalesce("is_negative", F.lit(False)).alias("negative"))
        near = spatial.scarcity(self.places.select(F.col("place_id").alias("id"), "lat", "lon", "category"), self.radius_km)
        return gap_scores(self.places, self.all_reviews(), mentions, self.aspects, near, self.as_of)

    def list_service_gaps(self, aspect: str | None = None, min_score: float = 0.0, category: str | None = None, cluster: int | None = None, search: str | None = None, confidence: str | None = None, min_reviews: int | None = None, ascending: bool = False, limit: int = 50, offset: int = 0) -> tuple[DataFrame, DataFrame]:
        """(page, total): gaps that pass all filters, by score and then rank."""
        rows = scan_filter(self.rankings(), {"aspect": aspect, "category": category, "confidence": confidence}, {"place_name": search}, {"score": min_score, "review_count": min_reviews})
        if cluster is not None:
            rows = rows.join(self.clusters.where(F.col("cluster") == cluster), "place_id", "left_semi")
        return page(rows, [F.asc("score") if ascending else F.desc("score"), F.asc("rank")], limit, offset), rows.agg(F.count(F.lit(1)).alias("total"))

    def place_rows(self, aspect: str | None = None) -> DataFrame:
        """Places with their reviews, cluster and top gap; with ``aspect`` only places that have it, with that gap."""
        gaps = self.rankings().select("place_id", "aspect", "score", "confidence", "rank")
        gaps = scan_filter(gaps, {"aspect": aspect})
        top = first_by(gaps, ["place_id"], [F.col("rank")]).drop("rank")
        seen = self.valid_reviews().groupBy("place_id").agg(F.countDistinct("review_id").alias("reviews"))
        rows = self.places.join(seen, "place_id", "left").join(self.clusters.select("place_id", "cluster"), "place_id", "left").join(top, "place_id", "inner" if aspect else "left")
        return rows.withColumn("reviews", F.coalesce("reviews", F.lit(0).cast("long")))

    def list_places(self, category: str | None = None, aspect: str | None = None, min_gap: float = 0.0, cluster: int | None = None, search: str | None = None, limit: int = 50, offset: int = 0) -> tuple[DataFrame, DataFrame]:
        rows = scan_filter(self.place_rows(aspect), {"category": category}, {"place_name": search}).where(F.coalesce("score", F.lit(0.0)) >= min_gap)
        if cluster is not None:
            rows = rows.where(F.col("cluster") == cluster)
        return page(rows, [F.coalesce("score", F.lit(0.0)).desc(), F.asc("place_name")], limit, offset), rows.agg(F.count(F.lit(1)).alias("total"))

    def place_evidence(self, place_id, aspect: str | None = None, search: str | None = None, min_probability: float = 0.0, min_confidence: float = 0.0, by_confidence: bool = False, limit: int = 50, offset: int = 0) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(page, totals, counts per aspect) of a place's negative clauses, the surest of each clause and aspect."""
        e = self.all_evidence().where((F.col("place_id") == place_id) & F.coalesce("is_negative", F.lit(False)))
        text = F.btrim(F.coalesce("clause_text", F.lit("")))
        number = lambda c: F.coalesce(F.col(c), F.lit(0.0))
        e = e.select(text.alias("clause_text"), F.coalesce("aspect", F.lit("lainnya")).alias("aspect"), number("complaint_probability").alias("complaint_probability"), number("prediction_confidence").alias("confidence")).where("clause_text <> ''")
        every = first_by(e, ["clause_text", "aspect"], [F.desc("complaint_probability"), F.desc("confidence")])
        rows = scan_filter(every, {"aspect": aspect}, {"clause_text": (search or "").strip()}, {"complaint_probability": min_probability, "confidence": min_confidence})
        keys = ["confidence", "complaint_probability"] if by_confidence else ["complaint_probability", "confidence"]
        totals = rows.agg(F.count(F.lit(1)).alias("total")).crossJoin(every.agg(F.count(F.lit(1)).alias("total_all")))
        return page(rows, [*map(F.desc, keys), F.asc("aspect"), F.asc("clause_text")], limit, offset), totals, every.groupBy("aspect").agg(F.count(F.lit(1)).alias("n"))

    def features(self, kind: str | None = None, aspect: str | None = None, cluster: int | None = None) -> DataFrame:
        """Map features (x, y, properties) of places with their top gap and of cluster centres without noise."""
        rows = self.place_rows().where("lat is not null and lon is not null")
        place = rows.select(F.col("lon").alias("x"), F.col("lat").alias("y"), F.struct(F.lit("place").alias("kind"), F.col("place_id").cast("string").alias("id"), F.col("place_name").alias("name"), "cluster", "aspect", "score").alias("properties"))
        mid = rows.where("cluster >= 0").groupBy("cluster").agg(F.avg("lon").alias("x"), F.avg("lat").alias("y"), F.avg("score").alias("score"))
        centre = mid.select("x", "y", F.struct(F.lit("cluster").alias("kind"), F.col("cluster").cast("string").alias("id"), F.concat(F.lit("cluster "), F.col("cluster")).alias("name"), "cluster", F.lit(None).cast("string").alias("aspect"), "score").alias("properties"))
        out = scan_filter(place.unionByName(centre), {"properties.kind": kind, "properties.aspect": aspect})
        return out if cluster is None else out.where(F.col("properties.cluster") == cluster)

    def place_detail(self, place_id) -> dict[str, DataFrame]:
        """A place's row, its labels, its six first gaps and its eight surest clauses."""
        gaps = self.rankings().where(F.col("place_id") == place_id).orderBy("rank").limit(6)
        labels = self.valid_reviews().where(F.col("place_id") == place_id).groupBy("label").agg(F.count(F.lit(1)).alias("n"))
        return {"place": self.places.where(F.col("place_id") == place_id), "labels": labels, "gaps": gaps, "evidence": self.place_evidence(place_id, limit=8)[0]}
