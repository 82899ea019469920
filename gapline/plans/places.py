"""Queries on positions, clusters and maps."""

from __future__ import annotations

from pyspark.sql import functions as F

from gapline.functions import geo
from gapline.functions import score as S
from gapline.operators import spatial
from gapline.plans import standins as st
from gapline.plans.registry import query, r


@query(f"WITH {st.PLACES} SELECT place_id, coalesce(lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180, false) AS valid FROM place")
def valid_coordinates(spark, d):
    return st.places(spark, d).select("place_id", geo.valid(F.col("lat"), F.col("lon")).alias("valid"))


@query(f"WITH {st.PLACES}, pt AS (SELECT * FROM place WHERE lat IS NOT NULL) SELECT a.place_id AS a, b.place_id AS b, {r(st.DISTANCE, 4)} AS km FROM pt a JOIN pt b ON a.place_id < b.place_id WHERE {st.DISTANCE} <= 5")
def haversine_pairs(spark, d):
    return spatial.pairs_within(st.positions(spark, d), st.KM).where("a < b").select("a", "b", S.half_up(F.col("km"), 4).alias("km"))


@query(f"WITH {st.PLACES}, {st.SCARCITY} SELECT place_id, density, {r('scarcity', 6)} AS scarcity FROM scarce")
def service_scarcity(spark, d):
    return st.scarcity(spark, d).select(F.col("id").alias("place_id"), "density", S.half_up(F.col("scarcity"), 6).alias("scarcity"))


@query(f"WITH RECURSIVE {st.PLACES}, {st.CLUSTERS} SELECT place_id, cluster FROM clus")
def dbscan_clusters(spark, d):
    return st.clusters(spark, d)


NEGATIVES = """neg AS (SELECT place_id, aspect, count(*) AS n FROM mention WHERE negative GROUP BY ALL),
ptop AS (SELECT place_id, aspect, n FROM neg QUALIFY row_number() OVER (PARTITION BY place_id ORDER BY n DESC, aspect) <= 5)"""


def place_top_aspects(spark, d):
    n = st.mentions(spark, d).where("negative").groupBy("place_id", "aspect").agg(F.count(F.lit(1)).alias("n"))
    from gapline.operators.relational import first_by

    return first_by(n, ["place_id"], [F.desc("n"), F.asc("aspect")], 5)


@query(f"WITH {st.MENTIONS}, {NEGATIVES} SELECT place_id, string_agg(aspect, '|' ORDER BY n DESC, aspect) AS aspects FROM ptop GROUP BY 1")
def dominant_aspects(spark, d):
    n = st.mentions(spark, d).where("negative").groupBy("place_id", "aspect").agg(F.count(F.lit(1)).alias("n"))
    return spatial.top_items(n, "place_id", "aspect", "n", 5, "aspects")


@query(f"""WITH RECURSIVE {st.PLACES}, {st.MENTIONS}, {st.CLUSTERS}, {NEGATIVES},
  ca AS (SELECT cluster, aspect, count(*) AS n FROM clus JOIN ptop USING (place_id) GROUP BY ALL),
  ct AS (SELECT cluster, string_agg(aspect, '|' ORDER BY n DESC, aspect) AS aspects FROM (SELECT * FROM ca QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY n DESC, aspect) <= 5) GROUP BY 1),
  cc AS (SELECT cluster, category, count(*) AS n FROM clus JOIN place USING (place_id) GROUP BY ALL),
  cj AS (SELECT cluster, '{{' || string_agg('"' || category || '":' || n, ',' ORDER BY category) || '}}' AS categories FROM cc GROUP BY 1)
  SELECT cluster, count(*) AS size, {r('avg(lat)', 6)} AS lat, {r('avg(lon)', 6)} AS lon, any_value(aspects) AS aspects, any_value(categories) AS categories, cluster = -1 AS is_noise
  FROM clus JOIN place USING (place_id) LEFT JOIN ct USING (cluster) LEFT JOIN cj USING (cluster) GROUP BY cluster""")
def cluster_summary(spark, d):
    c = st.clusters(spark, d).join(st.places(spark, d).select("place_id", "category", "lat", "lon"), "place_id")
    counted = c.select("place_id", "cluster").join(place_top_aspects(spark, d), "place_id").groupBy("cluster", "aspect").agg(F.count(F.lit(1)).alias("n"))
    aspects = spatial.top_items(counted, "cluster", "aspect", "n", 5, "aspects")
    cats = spatial.category_json(c, "cluster", "category", "categories")
    mid = c.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"), S.half_up(F.avg("lat"), 6).alias("lat"), S.half_up(F.avg("lon"), 6).alias("lon"))
    return mid.join(aspects, "cluster", "left").join(cats, "cluster", "left").withColumn("is_noise", F.col("cluster") == -1)


@query(f"WITH {st.PLACES} SELECT category, count(*) AS n, count(lat) AS located, {r('count(lat) / count(*)::DOUBLE', 4)} AS share FROM place GROUP BY 1")
def coordinate_coverage(spark, d):
    ok = F.count_if(geo.valid(F.col("lat"), F.col("lon")))
    return st.places(spark, d).groupBy("category").agg(F.count(F.lit(1)).alias("n"), ok.alias("located"), S.half_up(ok / F.count(F.lit(1)).cast("double"), 4).alias("share"))


@query(f"""WITH {st.PLACES}, t AS (SELECT place_id, (lon + 180e0) / 360e0 * 1024e0 AS x, (1e0 - ln(tan(radians(lat)) + sqrt(tan(radians(lat)) * tan(radians(lat)) + 1e0)) / pi()) / 2e0 * 1024e0 AS y FROM place WHERE lat IS NOT NULL)
  SELECT place_id, {r('x', 4)} AS x, {r('y', 4)} AS y, floor(x)::BIGINT AS tile_x, floor(y)::BIGINT AS tile_y, {r('floor(x) / 1024e0 * 360e0 - 180e0', 4)} AS west,
  {r('degrees(atan((exp(pi() * (1e0 - 2e0 * floor(y) / 1024e0)) - exp(-pi() * (1e0 - 2e0 * floor(y) / 1024e0))) / 2e0))', 4)} AS north FROM t""")
def mercator_tiles(spark, d):
    x, y = geo.tile(F.col("lat"), F.col("lon"), 10)
    t = st.places(spark, d).where("lat is not null").select("place_id", x.alias("x"), y.alias("y"))
    west, north = geo.tile_origin(F.floor("x"), F.floor("y"), 10)
    return t.select("place_id", S.half_up(F.col("x"), 4).alias("x"), S.half_up(F.col("y"), 4).alias("y"), F.floor("x").alias("tile_x"), F.floor("y").alias("tile_y"), S.half_up(west, 4).alias("west"), S.half_up(north, 4).alias("north"))


@query(f"""WITH RECURSIVE {st.PLACES}, {st.CLUSTERS},
  f AS (SELECT 'place' AS kind, place_id AS id, place_name AS name, cluster, {r('place.lat', 6)} AS lat, {r('place.lon', 6)} AS lon FROM clus JOIN place USING (place_id)
    UNION ALL SELECT 'cluster', cluster, 'cluster ' || cluster, cluster, {r('avg(place.lat)', 6)}, {r('avg(place.lon)', 6)} FROM clus JOIN place USING (place_id) WHERE cluster >= 0 GROUP BY cluster)
  SELECT kind, id, lon AS x, lat AS y, '"properties":{{"cluster":' || cluster || ',"kind":"' || kind || '","name":"' || name || '"}}' AS properties FROM f""")
def places_geojson(spark, d):
    """GeoJSON features of places and of the centres of clusters that aren't noise; the properties object as it stands in the feature."""
    c = st.clusters(spark, d).join(st.places(spark, d).select("place_id", "place_name", "lat", "lon"), "place_id")
    place = c.select(F.lit("place").alias("kind"), F.col("place_id").alias("id"), F.col("place_name").alias("name"), "cluster", S.half_up(F.col("lat"), 6).alias("y"), S.half_up(F.col("lon"), 6).alias("x"))
    mid = c.where("cluster >= 0").groupBy("cluster").agg(S.half_up(F.avg("lat"), 6).alias("y"), S.half_up(F.avg("lon"), 6).alias("x"))
    centre = mid.select(F.lit("cluster").alias("kind"), F.col("cluster").alias("id"), F.concat(F.lit("cluster "), F.col("cluster")).alias("name"), "cluster", "y", "x")
    text = F.concat(F.lit('"properties":'), F.to_json(F.struct("cluster", "kind", "name")))
    return place.unionByName(centre).select("kind", "id", "x", "y", text.alias("properties"))


@query(f"WITH RECURSIVE {st.PLACES}, {st.CLUSTERS} SELECT DISTINCT cluster FROM clus WHERE cluster >= 0 ORDER BY 1")
def cluster_ids(spark, d):
    return st.clusters(spark, d).where("cluster >= 0").select("cluster").distinct().orderBy("cluster")
