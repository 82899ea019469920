"""Uploaded rows: checks, entities, duplicates, and the manifest of published runs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gapline.functions import text as X
from gapline.functions.parse import weak_label
from gapline.operators.relational import first_by, overlay_union

# Fixed values.
LEAST_CHARS, MOST_CHARS, MOST_ROWS, MOST_BYTES = 3, 2000, 5000, 10 * 1024 * 1024
SUFFIXES = (".csv", ".xlsx")
REQUIRED = ["place_name", "place_category", "review_text"]
TEMPLATE = ["place_id", "place_name", "place_category", "place_type", "address", "latitude", "longitude", "place_rating", "status", "facility_text", "min_price", "max_price", "review_id", "review_text", "review_rating", "review_date"]
REVIEW_TEMPLATE = ["review_id", "review_text", "review_rating", "review_date"]
ALIASES = {
    "id_tempat": "place_id", "destination_id": "place_id", "nama_tempat": "place_name", "nama_destinasi": "place_name", "destination_name": "place_name", "kategori": "place_category",
    "kategori_tempat": "place_category", "jenis_tempat": "place_type", "tipe_tempat": "place_type", "alamat": "address", "lat": "latitude", "lng": "longitude", "lon": "longitude",
    "rating_tempat": "place_rating", "fasilitas": "facility_text", "harga_minimum": "min_price", "harga_maksimum": "max_price", "id_ulasan": "review_id", "ulasan": "review_text",
    "teks_ulasan": "review_text", "review_text_raw": "review_text", "rating_ulasan": "review_rating", "reviewer_rating": "review_rating", "tanggal_ulasan": "review_date",
}


def template(columns: list[str] = REVIEW_TEMPLATE) -> str:
    """A CSV file with the header alone."""
    return ",".join(columns) + "\n"


def row_errors() -> dict[str, Column]:
    text = X.clean_text(F.col("review_text"))
    n = F.coalesce(F.length(text), F.lit(0))
    return {
        "place_name": F.coalesce(F.btrim("place_name") == "", F.lit(True)),
        "place_category": F.coalesce(F.btrim("place_category") == "", F.lit(True)),
        "review_text": (n < LEAST_CHARS) | (n > MOST_CHARS),
        "review_rating": F.coalesce(~F.col("review_rating").between(1, 5), F.lit(False)),
    }


def accepted(rows: DataFrame) -> DataFrame:
    """Rows without an error."""
    bad = F.lit(False)
    for c in row_errors().values():
        bad = bad | c
    return rows.where(~bad)


def issues(rows: DataFrame) -> DataFrame:
    """``row_no``, ``field``, ``severity``, ``code``: one row per problem; dates are looked at in rows without errors."""
    errors = row_errors()
    lat, lon = F.col("latitude"), F.col("longitude")
    none = F.lit(True)
    for c in errors.values():
        none = none & ~c
    date = F.to_date(F.coalesce(*[F.try_to_timestamp(F.btrim("review_date"), F.lit(f)) for f in ("yyyy-MM-dd", "yyyy/MM/dd", "yyyy-MM-dd HH:mm:ss")]))
    found = [(c, f, "error", "invalid_value") for f, c in errors.items()]
    found += [(lat.isNull() != lon.isNull(), "coordinates", "warning", "incomplete_coordinate"), (lat.isNotNull() & lon.isNotNull() & ~(lat.between(-90, 90) & lon.between(-180, 180)), "coordinates", "warning", "invalid_coordinate")]
    found += [(none & (F.btrim("review_date") != "") & date.isNull(), "review_date", "warning", "invalid_date")]
    each = F.array_compact(F.array(*[F.when(c, F.struct(F.lit(f).alias("field"), F.lit(s).alias("severity"), F.lit(k).alias("code"))) for c, f, s, k in found]))
    return rows.select("row_no", F.explode(each).alias("i")).select("row_no", "i.*")


def entities(rows: DataFrame) -> DataFrame:
    """One row per place: the first value of each field by row number, the mean rating, and where values conflict."""
    first = lambda c: F.min_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("row_no")))
    differ = lambda c: F.countDistinct(c) > 1
    return rows.groupBy("place").agg(
        first("place_category").alias("category"), first("latitude").alias("lat"), first("longitude").alias("lon"), F.avg("review_rating").alias("rating"),
        differ("place_category").alias("category_conflict"), differ("latitude").alias("lat_conflict"), F.count(F.lit(1)).alias("n"),
    )


def new_texts(rows: DataFrame, existing: DataFrame) -> DataFrame:
    """Rows whose text, whatever its case, is neither in ``existing`` nor in an earlier row."""
    key = F.lower(X.clean_text(F.col("review_text")))
    old = existing.select(key.alias("_key")).distinct()
    return first_by(rows.withColumn("_key", key).join(old, "_key", "left_anti"), ["_key"], [F.col("row_no")]).drop("_key")


def repeated(rows: DataFrame) -> DataFrame:
    """A warning (``row_no``, ``field``, ``severity``, ``code``) for each accepted row whose place and text an earlier row has.

    Rows of one text and place are compared with the first of them; no group is gathered.
    """
    clean = accepted(rows).select("row_no", F.col("place_name").alias("_p"), X.clean_text(F.col("review_text")).alias("_t"))
    first = clean.groupBy("_p", "_t").agg(F.min("row_no").alias("_first"))
    late = clean.join(first, ["_p", "_t"]).where("row_no > _first")
    return late.select("row_no", F.lit("review_text").alias("field"), F.lit("warning").alias("severity"), F.lit("duplicate_review").alias("code"))


def review_ids(rows: DataFrame, import_id: str) -> DataFrame:
    """``row_no`` and ``review_id``: the run and the given id (else the row number) as a slug; an id that an earlier row has gets the row number after it."""
    given = F.nullif(F.btrim(F.coalesce(F.col("review_id").cast("string"), F.lit(""))), F.lit(""))
    ident = F.concat(F.lit(f"{import_id}-"), X.slug(F.coalesce(given, F.format_string("r%05d", F.col("row_no") - 1))))
    named = rows.select("row_no", ident.alias("review_id"))
    first = named.groupBy("review_id").agg(F.min("row_no").alias("_first"))
    again = F.concat("review_id", F.lit("-"), (F.col("row_no") - 1).cast("string"))
    return named.join(first, "review_id").select("row_no", F.when(F.col("row_no") == F.col("_first"), F.col("review_id")).otherwise(again).alias("review_id"))


def reviews_of(rows: DataFrame, import_id: str) -> DataFrame:
    """Accepted rows as reviews of a run: an id per row number and a weak label by rating."""
    ident = F.format_string(f"{import_id}-r%05d", F.col("row_no"))
    return accepted(rows).select(F.lit(import_id).alias("import_id"), ident.alias("review_id"), X.clean_text(F.col("review_text")).alias("review_text"), "review_rating", weak_label(F.col("review_rating")).alias("label"))


@dataclass(frozen=True)
class Manifest:
    """Published runs in order. Publishing twice is publishing once; withdrawing what isn't there does nothing."""

    runs: tuple[str, ...] = ()

    def publish(self, run: str) -> Manifest:
        return self if run in self.runs else Manifest((*self.runs, run))

    def unpublish(self, run: str) -> Manifest:
        return Manifest(tuple(r for r in self.runs if r != run))

    def view(self, base: DataFrame, imported: DataFrame, keys: list[str]) -> DataFrame:
        """``base`` and the published rows of ``imported`` (by ``import_id``), one row per key: base first, then in order of publishing."""
        parts = [imported.where(F.col("import_id") == r).drop("import_id") for r in self.runs]
        return overlay_union([base, *parts], keys)
