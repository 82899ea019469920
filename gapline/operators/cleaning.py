"""Sheets of a workbook to canonical places and reviews."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gapline.functions import parse as P
from gapline.functions import text as X
from gapline.operators import entities
from gapline.operators.relational import enrich, first_by, flag_duplicates


@dataclass(frozen=True)
class ReviewSheet:
    name: str
    place: str
    rating: str
    text: str
    category: str
    published: str | None = None
    collected: str | None = None


@dataclass(frozen=True)
class MetadataSheet:
    name: str
    category: str
    price: str
    facility: str | None = None
    place: str = "place_name"
    coordinate: str = "lat_long"
    rating: str = "place_rating"
    address: str = "address"
    type: str = "place_type"
    status: str = "status"


# The sheets of the workbook and the columns they have.
REVIEW_SHEETS = [
    ReviewSheet("wisata-v2", "place_name", "reviewer_rating", "review_text", "wisata", "published_at", "collect_date"),
    ReviewSheet("resto-hotel-v2", "place_name", "reviewer_rating", "review_text", "hotel_resto", "published_at", "collect_date"),
    ReviewSheet("tempat-wisata-v1", "place", "rating", "review", "wisata"),
    ReviewSheet("hotel-resto-v1", "place", "rating", "review", "hotel_resto"),
]
METADATA_SHEETS = [MetadataSheet("wisata-metadata", "wisata", "entry_fee"), MetadataSheet("hotel-metadata", "hotel", "price_per_head", "fasilitas"), MetadataSheet("resto-metadata", "restoran", "price_per_head", "fasilitas")]
ROLES = {
    "place": ["place", "place_name", "nama_tempat", "destination_name"], "review": ["review", "review_text", "ulasan"], "rating": ["rating", "reviewer_rating", "place_rating"],
    "coordinate": ["lat_long", "coordinate", "latitude", "longitude"], "price": ["price", "entry_fee", "price_per_head"], "date": ["published_at", "collect_date", "review_date"],
}


def roles(columns: list[str]) -> dict[str, list[str]]:
    """The columns that may play each role, by name."""
    return {role: [c for c in columns if X.column_name(c) in names] for role, names in ROLES.items()}


def clean_sheet(df: DataFrame) -> DataFrame:
    """Names to snake case, text cells cleaned, rows dropped that have nothing but a row number."""
    df = df.toDF(*X.column_names(df.columns))
    kinds = dict(df.dtypes)
    df = df.select(*[X.clean_text(F.col(c)).alias(c) if kinds[c] == "string" else F.col(c) for c in df.columns])
    cells = [c for c in df.columns if c != "row_no"]
    return df.dropna("all", subset=cells) if cells else df


def rename_aliases(df: DataFrame, aliases: dict[str, str], required: list[str], known: list[str]) -> tuple[DataFrame, list[str]]:
    """Columns under their canonical names, and the unknown ones left out. Two columns of one name, or a required one missing, are errors."""
    names = [aliases.get(n, n) for n in map(X.column_name, df.columns)]
    if twice := sorted({n for n in names if names.count(n) > 1}):
        raise ValueError(f"columns that stand twice: {', '.join(twice)}")
    if gone := sorted(set(required) - set(names)):
        raise ValueError(f"missing columns: {', '.join(gone)}")
    unknown = sorted(set(names) - set(known))
    return df.toDF(*names).drop(*unknown), unknown


def with_columns(df: DataFrame, names: list[str], value: str = "") -> DataFrame:
    """Columns of ``names`` in that order, those that are missing filled with ``value``."""
    return df.select(*[F.col(c) if c in df.columns else F.lit(value).alias(c) for c in names])


def _at(df: DataFrame, name: str | None) -> Column:
    return F.col(name).cast("string") if name and name in df.columns else F.lit(None).cast("string")


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def metadata_rows(sheets: dict[str, DataFrame], specs: list[MetadataSheet] = METADATA_SHEETS) -> DataFrame:
    """One row per named row of the metadata sheets, values parsed."""
    out = []
    for s in (s for s in specs if s.name in sheets):
        df = sheets[s.name]
        get = lambda c, df=df: X.clean_text(_at(df, c))
        rows = df.select(
            F.lit(s.name).alias("source"), "row_no", get(s.place).alias("place_name"), F.lit(s.category).alias("category"), get(s.type).alias("place_type"), get(s.address).alias("address"), get(s.status).alias("status"),
            get(s.facility).alias("facility_text"), P.rating(_at(df, s.rating)).alias("rating"), P.coordinate(_at(df, s.coordinate)).alias("c"), P.price(_at(df, s.price)).alias("p"), _at(df, s.price).alias("price_text"),
        )
        out.append(rows.select("*", F.col("c.latitude").alias("lat"), F.col("c.longitude").alias("lon"), "p.min_price", "p.max_price", "p.is_free").drop("c", "p").withColumn("name", X.place_name(F.col("place_name"))).where("place_name is not null"))
    return _union(out)


def source_places(sheets: dict[str, DataFrame], metadata: DataFrame, specs: list[ReviewSheet] = REVIEW_SHEETS) -> DataFrame:
    """Every (sheet, name) to resolve; metadata sheets come before review sheets."""
    base = metadata.select("source", F.lit(0).alias("priority"), "name", "place_name", "category", "place_type", "lat", "lon")
    extra = []
    for s in (s for s in specs if s.name in sheets):
        name = X.clean_text(_at(sheets[s.name], s.place))
        extra.append(sheets[s.name].select(F.lit(s.name).alias("source"), F.lit(1).alias("priority"), X.place_name(name).alias("name"), name.alias("place_name"), F.lit(s.category).alias("category")).where("name is not null").distinct())
    return _union([base, *extra])


def build(sheets: dict[str, DataFrame], metadata_specs: list[MetadataSheet] = METADATA_SHEETS, review_specs: list[ReviewSheet] = REVIEW_SHEETS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(places, mapping, reviews) from raw sheets: cleaned, parsed, names resolved, duplicates flagged.

    Names are resolved over all categories at once, so a review sheet's broad category finds the places of the metadata sheets.
    """
    clean = {n: clean_sheet(df) for n, df in sheets.items()}
    meta = metadata_rows(clean, metadata_specs)
    named = source_places(clean, meta, review_specs)
    mapping = entities.resolve(named, within=None).select("source", "name", "canonical_id", "canonical_name", "score", "method", "status", "needs_review", "candidate_id")
    joined = named.join(mapping.select("source", "name", "canonical_id"), ["source", "name"])
    order = [F.asc("priority"), F.asc("source"), F.asc("place_name")]
    first = first_by(joined, ["canonical_id"], order).select(F.col("canonical_id").alias("place_id"), "place_name", "category")
    facts = meta.join(mapping.select("source", "name", F.col("canonical_id").alias("place_id")), ["source", "name"]).drop("name", "place_name")
    places = enrich(first, facts.drop("category"), "place_id", [F.asc("source"), F.asc("row_no")]).drop("source", "row_no")
    parts = []
    for i, s in enumerate(s for s in review_specs if s.name in clean):
        df = clean[s.name]
        collected = F.try_to_timestamp(_at(df, s.collected))
        parts.append(df.select(
            F.lit(s.name).alias("source"), F.lit(i).alias("sheet_no"), "row_no", X.place_name(X.clean_text(_at(df, s.place))).alias("name"), F.lit(s.category).alias("sheet_category"), P.rating(_at(df, s.rating)).alias("rating"),
            _at(df, s.text).alias("text_raw"), X.clean_text(_at(df, s.text)).alias("text"), P.review_date(X.clean_text(_at(df, s.published)), collected).alias("d"),
        ))
    rows = _union(parts).join(mapping.select("source", "name", F.col("canonical_id").alias("place_id")), ["source", "name"], "left").join(places.select("place_id", "place_name", F.col("category").alias("_c")), "place_id", "left")
    rows = rows.select(
        F.format_string("%s_%06d", "source", "row_no").alias("review_id"), "place_id", "place_name", F.coalesce("_c", "sheet_category").alias("category"), "rating", "text_raw", "text", F.col("d.review_date").alias("day"),
        F.col("d.source").alias("date_source"), F.col("source").alias("source_sheet"), X.text_length(F.col("text")).alias("text_length"), P.weak_label(F.col("rating")).alias("label"), "sheet_no", "row_no",
    )
    reviews = flag_duplicates(rows, ["place_id", "rating", "text", "day"], [F.col("sheet_no"), F.col("row_no")]).drop("sheet_no", "row_no")
    return places, mapping, reviews


def resolution_audit(mapping: DataFrame) -> DataFrame:
    return mapping.agg(
        F.count(F.lit(1)).alias("mapping_rows"), F.countDistinct("canonical_id").alias("canonical_places"), F.count_if(F.col("status") == "auto").alias("auto_matches"),
        F.count_if(F.col("status").startswith("new")).alias("new_rows"), F.count_if("needs_review").alias("needs_review_rows"),
    )
