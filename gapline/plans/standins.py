"""Stand-ins of the review domain on the test tables, as DataFrames and as SQL."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gapline.operators import gap, spatial

AS_OF = datetime.date(2002, 1, 1)
KM, LEAST = 5.0, 4


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def places(spark: SparkSession, d: str) -> DataFrame:
    s, n, r = (table(spark, d, t) for t in ("supplier", "nation", "region"))
    k = F.col("s_suppkey")
    far = k % 11 == 0
    lat = 2.0 + (k * k % 7) * 0.15 + (k * 31 % 17) * 0.006
    lon = 98.5 + (k * k * 3 % 5) * 0.15 + (k * 17 % 23) * 0.006
    rows = s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.select(
        k.alias("place_id"), F.col("s_name").alias("place_name"), F.col("r_name").alias("category"), F.col("n_name").alias("place_type"),
        F.when(k % 7 != 0, (k % 5 + 1).cast("double")).alias("rating"), F.when(~far, lat).alias("lat"), F.when(~far, lon).alias("lon"),
        F.when(k % 4 == 0, "").otherwise(F.concat(F.lit("Jl. "), k.cast("string"))).alias("address"), F.when(k % 3 != 0, "open").alias("status"),
        F.when(k % 5 == 0, "nan").otherwise(F.concat((k * 1000).cast("string"), F.lit(" - "), (k * 2500).cast("string"))).alias("price_text"),
        F.when(k % 6 == 0, "None").otherwise("wifi").alias("facility_text"),
    )


PLACES = """place AS (
  SELECT s_suppkey AS place_id, s_name AS place_name, r_name AS category, n_name AS place_type,
    CASE WHEN s_suppkey % 7 <> 0 THEN (s_suppkey % 5 + 1)::DOUBLE END AS rating,
    CASE WHEN s_suppkey % 11 <> 0 THEN 2e0 + (s_suppkey * s_suppkey % 7) * 15e-2 + (s_suppkey * 31 % 17) * 6e-3 END AS lat,
    CASE WHEN s_suppkey % 11 <> 0 THEN 985e-1 + (s_suppkey * s_suppkey * 3 % 5) * 15e-2 + (s_suppkey * 17 % 23) * 6e-3 END AS lon,
    CASE WHEN s_suppkey % 4 = 0 THEN '' ELSE 'Jl. ' || s_suppkey END AS address, CASE WHEN s_suppkey % 3 <> 0 THEN 'open' END AS status,
    CASE WHEN s_suppkey % 5 = 0 THEN 'nan' ELSE (s_suppkey * 1000) || ' - ' || (s_suppkey * 2500) END AS price_text,
    CASE WHEN s_suppkey % 6 = 0 THEN 'None' ELSE 'wifi' END AS facility_text
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def mentions(spark: SparkSession, d: str) -> DataFrame:
    """A mention per line item: of an aspect (the part's type) of a place (its supplier) in a review (its order)."""
    li, part = table(spark, d, "lineitem"), table(spark, d, "part")
    rows = li.join(part.select("p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
    return rows.select(F.col("l_suppkey").alias("place_id"), F.col("l_orderkey").alias("review_id"), F.col("l_shipdate").cast("date").alias("day"), F.col("p_type").alias("aspect"), (F.col("l_returnflag") == "R").alias("negative"))


MENTIONS = """mention AS (
  SELECT l_suppkey AS place_id, l_orderkey AS review_id, l_shipdate::DATE AS day, p_type AS aspect, l_returnflag = 'R' AS negative
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""


def reviews(spark: SparkSession, d: str) -> DataFrame:
    """A review per line item: its place, order and day; no join."""
    li = table(spark, d, "lineitem")
    return li.select(F.col("l_suppkey").alias("place_id"), F.col("l_orderkey").alias("review_id"), F.col("l_shipdate").cast("date").alias("day"))


REVIEWS = "review AS (SELECT l_suppkey AS place_id, l_orderkey AS review_id, l_shipdate::DATE AS day FROM lineitem)"


def aspects(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_type").alias("aspect")).distinct()


def texts(spark: SparkSession, d: str) -> DataFrame:
    """Documents as reviews: id, text, category (language), place (source) and a rating of one to five."""
    docs = table(spark, d, "documents")
    return docs.select(F.col("doc_id").alias("review_id"), "text", F.col("lang").alias("category"), F.col("source").alias("place"), (F.col("doc_id") % 5 + 1).cast("double").alias("rating"))


TEXTS = "review AS (SELECT doc_id AS review_id, text, lang AS category, source AS place, (doc_id % 5 + 1)::DOUBLE AS rating FROM documents)"

DISTANCE = """2 * 63710088e-4 * asin(least(1e0, sqrt(pow(sin((radians(b.lat) - radians(a.lat)) / 2), 2)
    + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin((radians(b.lon) - radians(a.lon)) / 2), 2))))"""

SCARCITY = f"""sound AS (SELECT * FROM place WHERE lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180),
dens AS (
  SELECT p.place_id, coalesce(n.n, 0) AS density FROM place p LEFT JOIN (
    SELECT a.place_id, count(*) - 1 AS n FROM sound a JOIN sound b ON a.category = b.category AND {DISTANCE} <= 5
    GROUP BY a.place_id) n USING (place_id)),
scarce AS (SELECT place_id, density, greatest(0e0, least(1e0, 1e0 - density / (SELECT greatest(max(density), 1) FROM dens)::DOUBLE)) AS scarcity FROM dens)"""


def positions(spark: SparkSession, d: str) -> DataFrame:
    return places(spark, d).where("lat is not null and lon is not null").select(F.col("place_id").alias("id"), "lat", "lon")


def scarcity(spark: SparkSession, d: str) -> DataFrame:
    return spatial.scarcity(places(spark, d).select(F.col("place_id").alias("id"), "lat", "lon", "category"), KM)


def scores(spark: SparkSession, d: str) -> DataFrame:
    return gap.gap_scores(places(spark, d), reviews(spark, d), mentions(spark, d), aspects(spark, d), scarcity(spark, d), AS_OF)


def _r(e: str, n: int) -> str:
    return f"floor(({e}) * 1e{n} + 5e-1) / 1e{n}"


SCORES = f"""{PLACES}, {MENTIONS}, {SCARCITY},
cnt AS (SELECT place_id, aspect, count(*) AS mentions, count(*) FILTER (negative) AS negatives FROM mention GROUP BY ALL),
most AS (SELECT greatest(coalesce(max(mentions), 0), 1) AS most FROM cnt),
seen AS (SELECT l_suppkey AS place_id, count(DISTINCT l_orderkey) AS review_count, max(l_shipdate::DATE) AS latest FROM lineitem GROUP BY 1),
fact0 AS (
  SELECT p.*, coalesce(review_count, 0) AS review_count,
    greatest(0e0, least(1e0, ln(1 + coalesce(review_count, 0)::DOUBLE) / ln(31e0))) AS volume,
    ((category IS NOT NULL AND trim(category) NOT IN ('', 'nan', 'None'))::INT + (place_type IS NOT NULL AND trim(place_type) NOT IN ('', 'nan', 'None'))::INT
     + (address IS NOT NULL AND trim(address) NOT IN ('', 'nan', 'None'))::INT + (lat IS NOT NULL)::INT + (lon IS NOT NULL)::INT + (rating IS NOT NULL)::INT
     + (status IS NOT NULL AND trim(status) NOT IN ('', 'nan', 'None'))::INT + (price_text IS NOT NULL AND trim(price_text) NOT IN ('', 'nan', 'None'))::INT
     + (facility_text IS NOT NULL AND trim(facility_text) NOT IN ('', 'nan', 'None'))::INT) / 9e0 AS completeness,
    CASE WHEN rating IS NULL THEN 5e-1 ELSE greatest(0e0, least(1e0, (5e0 - rating) / 4e0)) END AS rating_gap,
    CASE WHEN latest IS NULL THEN 5e-1 ELSE greatest(0e0, least(1e0, 1e0 - greatest(DATE '2002-01-01' - latest, 0) / 365e0)) END AS recency
  FROM place p LEFT JOIN seen USING (place_id)),
fact AS (SELECT *, greatest(0e0, least(1e0, (completeness + volume) / 2e0)) AS reliability FROM fact0),
row0 AS (
  SELECT fact.*, a.aspect, coalesce(mentions, 0) AS mentions, coalesce(negatives, 0) AS negatives, scarcity,
    (coalesce(negatives, 0) + 1e0) / (coalesce(mentions, 0) + 1e0 + 4e0) AS rate,
    least(1e0, coalesce(mentions, 0) / greatest(review_count, 1)::DOUBLE) AS frequency, least(1e0, coalesce(mentions, 0) / most::DOUBLE) AS frequency_norm
  FROM fact CROSS JOIN (SELECT DISTINCT p_type AS aspect FROM part) a CROSS JOIN most LEFT JOIN cnt USING (place_id, aspect) LEFT JOIN scarce USING (place_id)
  WHERE coalesce(mentions, 0) > 0 OR review_count >= 3),
row1 AS (
  SELECT *, 3e-1 * rate + 2e-1 * frequency_norm + 15e-2 * scarcity + 15e-2 * volume + 1e-1 * rating_gap + 5e-2 * recency + 5e-2 * (1e0 - completeness) AS base FROM row0),
row2 AS (
  SELECT place_id, place_name, category, place_type, lat, lon, aspect, review_count, mentions, negatives,
    {_r("greatest(0e0, least(1e0, base)) * 100e0 * reliability", 4)} AS score,
    CASE WHEN (volume + reliability) / 2 >= 75e-2 THEN 'high' WHEN (volume + reliability) / 2 >= 45e-2 THEN 'medium' ELSE 'low' END AS confidence,
    {_r("rate", 6)} AS rate, {_r("frequency", 6)} AS frequency, {_r("frequency_norm", 6)} AS frequency_norm, {_r("scarcity", 6)} AS scarcity, {_r("volume", 6)} AS volume,
    {_r("completeness", 6)} AS completeness, {_r("reliability", 6)} AS reliability, {_r("rating_gap", 6)} AS rating_gap, {_r("recency", 6)} AS recency, {_r("base", 6)} AS base
  FROM row1),
score AS (
  SELECT *, CASE WHEN score >= 70 THEN 'tinggi' WHEN score >= 40 THEN 'menengah' ELSE 'rendah' END AS priority,
    coalesce(nullif(concat_ws('|', CASE WHEN rate >= 35e-2 THEN 'HIGH_NEGATIVE_RATE' END, CASE WHEN frequency >= 15e-2 THEN 'FREQUENT_COMPLAINT' END,
      CASE WHEN scarcity >= 7e-1 THEN 'LOW_NEARBY_SERVICE_DENSITY' END, CASE WHEN volume >= 7e-1 THEN 'HIGH_REVIEW_CONFIDENCE' END,
      CASE WHEN reliability <= 55e-2 THEN 'LOW_DATA_RELIABILITY' END), ''), 'BASELINE_SIGNAL') AS reasons,
    row_number() OVER (ORDER BY score DESC, negatives DESC, mentions DESC, place_id, aspect) AS rank
  FROM row2)"""


def clusters(spark: SparkSession, d: str) -> DataFrame:
    return spatial.dbscan(positions(spark, d), KM, LEAST).select(F.col("id").alias("place_id"), F.col("cluster").cast("long").alias("cluster"))


CLUSTERS = f"""pt AS (SELECT place_id, lat, lon FROM place WHERE lat IS NOT NULL AND lon IS NOT NULL),
near AS (SELECT a.place_id AS a, b.place_id AS b FROM pt a JOIN pt b ON {DISTANCE} <= 5),
core AS (SELECT a AS id FROM near GROUP BY a HAVING count(*) >= 4),
ce AS (SELECT a, b FROM near WHERE a IN (SELECT id FROM core) AND b IN (SELECT id FROM core)),
reach AS (SELECT id AS a, id AS b FROM core UNION SELECT reach.a, ce.b FROM reach JOIN ce ON reach.b = ce.a),
root AS (SELECT a AS id, min(b) AS root FROM reach GROUP BY a),
lab AS (SELECT id, dense_rank() OVER (ORDER BY root) - 1 AS cluster FROM root),
bord AS (SELECT near.a AS id, min(cluster) AS cluster FROM near JOIN lab ON near.b = lab.id GROUP BY near.a),
clus AS (SELECT pt.place_id, coalesce(bord.cluster, -1) AS cluster FROM pt LEFT JOIN bord ON pt.place_id = bord.id)"""
