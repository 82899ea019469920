"""Queries on the service-gap score and its parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from gapline.functions import score as S
from gapline.operators import gap
from gapline.operators.relational import first_by
from gapline.plans import standins as st
from gapline.plans.registry import query, r

FULL = ["place_id", "place_name", "category", "aspect", "score", "confidence", "review_count", "mentions", "negatives", "rate", "frequency", "frequency_norm", "scarcity", "volume", "completeness", "reliability", "rating_gap", "recency", "base", "priority", "rank"]


@query(f"WITH RECURSIVE {st.SCORES} SELECT {', '.join(FULL)} FROM score")
def service_gap_ranking(spark, d):
    return st.scores(spark, d).select(*FULL)


@query(f"WITH RECURSIVE {st.SCORES} SELECT place_id, aspect, priority, reasons FROM score")
def service_gap_reasons(spark, d):
    return st.scores(spark, d).select("place_id", "aspect", "priority", "reasons")


@query(f"WITH {st.MENTIONS} SELECT place_id, aspect, count(*) AS mentions, count(*) FILTER (negative) AS negatives, {r('(count(*) FILTER (negative) + 1e0) / (count(*) + 5e0)', 6)} AS rate FROM mention GROUP BY ALL")
def mention_rates(spark, d):
    counts = st.mentions(spark, d).groupBy("place_id", "aspect").agg(F.count(F.lit(1)).alias("mentions"), F.count_if("negative").alias("negatives"))
    return counts.withColumn("rate", S.half_up(S.smoothed_rate(F.col("negatives"), F.col("mentions")), 6))


@query(f"WITH {st.REVIEWS} SELECT place_id, count(DISTINCT review_id) AS review_count, {r('greatest(0e0, least(1e0, ln(1 + count(DISTINCT review_id)::DOUBLE) / ln(31e0)))', 6)} AS volume FROM review GROUP BY 1")
def volume_confidence(spark, d):
    n = st.reviews(spark, d).groupBy("place_id").agg(F.countDistinct("review_id").alias("review_count"))
    return n.withColumn("volume", S.half_up(S.volume_confidence(F.col("review_count")), 6))


DUPLICATES = """dup AS (
  SELECT *, row_number() OVER (PARTITION BY place, rating, text ORDER BY review_id) > 1 AS is_duplicate FROM review)"""


@query(f"WITH {st.TEXTS}, {DUPLICATES} SELECT place, count(DISTINCT review_id) AS scored, count(DISTINCT review_id) FILTER (NOT is_duplicate AND coalesce(len(text), 0) > 0) AS shown FROM dup GROUP BY 1")
def review_counts_by_consumer(spark, d):
    """Scoring counts all reviews of a place; readers see those with text that are no duplicates."""
    from gapline.operators.relational import flag_duplicates

    rows = flag_duplicates(st.texts(spark, d), ["place", "rating", "text"], [F.col("review_id")]).withColumn("seen", ~F.col("is_duplicate") & (F.coalesce(F.length("text"), F.lit(0)) > 0))
    return rows.groupBy("place").agg(F.countDistinct("review_id").alias("scored"), F.countDistinct(F.when(F.col("seen"), F.col("review_id"))).alias("shown"))


@query(f"WITH {st.MENTIONS}, c AS (SELECT place_id, aspect, count(*) AS mentions FROM mention GROUP BY ALL) SELECT place_id, aspect, mentions, {r('mentions / greatest((SELECT max(mentions) FROM c), 1)::DOUBLE', 6)} AS scaled FROM c")
def max_mentions_scaled(spark, d):
    c = st.mentions(spark, d).groupBy("place_id", "aspect").agg(F.count(F.lit(1)).alias("mentions"))
    most = c.agg(F.greatest(F.max("mentions"), F.lit(1)).alias("most"))
    return c.crossJoin(F.broadcast(most)).select("place_id", "aspect", "mentions", S.half_up(F.col("mentions") / F.col("most").cast("double"), 6).alias("scaled"))


@query(f"WITH {st.PLACES} SELECT place_id, rating, CASE WHEN rating IS NULL THEN 5e-1 ELSE greatest(0e0, least(1e0, (5e0 - rating) / 4e0)) END AS gap FROM place")
def rating_gap(spark, d):
    return st.places(spark, d).select("place_id", "rating", S.rating_gap(F.col("rating")).alias("gap"))


@query(f"WITH {st.PLACES}, {st.REVIEWS}, l AS (SELECT place_id, max(day) AS latest FROM review GROUP BY 1) SELECT place_id, latest, {r('CASE WHEN latest IS NULL THEN 5e-1 ELSE greatest(0e0, least(1e0, 1e0 - greatest(DATE ' + chr(39) + '2002-01-01' + chr(39) + ' - latest, 0) / 365e0)) END', 6)} AS recency FROM place LEFT JOIN l USING (place_id)")
def recency_factor(spark, d):
    latest = st.reviews(spark, d).groupBy("place_id").agg(F.max("day").alias("latest"))
    return st.places(spark, d).select("place_id").join(latest, "place_id", "left").withColumn("recency", S.half_up(S.recency(F.col("latest"), F.lit(st.AS_OF)), 6))


@query(f"""WITH {st.PLACES} SELECT place_id, {r('''(1 + 1 + (address <> '')::INT + 2 * (lat IS NOT NULL)::INT + (rating IS NOT NULL)::INT + (status IS NOT NULL)::INT
  + (price_text <> 'nan')::INT + (facility_text <> 'None')::INT) / 9e0''', 6)} AS completeness FROM place""")
def metadata_completeness(spark, d):
    p = st.places(spark, d)
    return p.select("place_id", S.half_up(S.completeness([F.col(c) for c in gap.METADATA]), 6).alias("completeness"))


@query(f"""WITH RECURSIVE {st.SCORES} SELECT place_id, aspect, place_name || ' memiliki prioritas ' || priority || ' pada aspek ' || aspect || ' karena '
  || (floor(rate * 1000.0::DOUBLE + 0.5::DOUBLE)::BIGINT // 10) || '.' || (floor(rate * 1000.0::DOUBLE + 0.5::DOUBLE)::BIGINT % 10)
  || '% penyebutan aspek tersebut bersentimen negatif setelah smoothing, berdasarkan ' || review_count || ' ulasan, dan ketersediaan layanan terkait di sekitar lokasi tergolong '
  || CASE WHEN scarcity >= 7e-1 THEN 'tinggi' WHEN scarcity >= 35e-2 THEN 'menengah' ELSE 'rendah' END || '.' AS explanation FROM score""")
def explanations(spark, d):
    s = st.scores(spark, d)
    text = S.explanation(F.col("place_name"), F.col("priority"), F.col("aspect"), F.col("rate"), F.col("review_count"), F.col("scarcity"))
    return s.select("place_id", "aspect", text.alias("explanation"))


@query(f"WITH RECURSIVE {st.SCORES}, {st.CLUSTERS}, t AS (SELECT place_id, max(score) AS top FROM score GROUP BY 1), m AS (SELECT cluster, avg(top) AS mean FROM clus LEFT JOIN t USING (place_id) GROUP BY 1) SELECT place_id, cluster, {r('mean', 3)} AS average_gap_score FROM clus JOIN m USING (cluster)")
def cluster_average_gap(spark, d):
    top = st.scores(spark, d).groupBy("place_id").agg(F.max("score").alias("top"))
    c = st.clusters(spark, d)
    mean = c.join(top, "place_id", "left").groupBy("cluster").agg(F.avg("top").alias("mean"))
    return c.join(mean, "cluster").select("place_id", "cluster", S.half_up(F.col("mean"), 3).alias("average_gap_score"))


@query(f"WITH RECURSIVE {st.SCORES} SELECT category, count(*) AS n, {r('avg(score)', 4)} AS mean, max(score) AS largest, {r('coalesce(stddev_samp(score), 0)', 4)} AS deviation FROM score GROUP BY 1")
def category_stability(spark, d):
    s = st.scores(spark, d)
    return s.groupBy("category").agg(F.count(F.lit(1)).alias("n"), S.half_up(F.avg("score"), 4).alias("mean"), F.max("score").alias("largest"), S.half_up(F.coalesce(F.stddev_samp("score"), F.lit(0.0)), 4).alias("deviation"))


@query(f"""WITH RECURSIVE {st.SCORES} SELECT count(*) AS n, count(DISTINCT place_id) AS places, count(DISTINCT aspect) AS aspects, min(score) AS least, max(score) AS largest,
  count(DISTINCT place_id) FILTER (rank <= 50) AS top_places, count(DISTINCT aspect) FILTER (rank <= 50) AS top_aspects FROM score""")
def score_stability(spark, d):
    s = st.scores(spark, d).select("place_id", "aspect", "score", "rank")
    top = lambda c: F.countDistinct(F.when(F.col("rank") <= 50, F.col(c)))
    return s.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("place_id").alias("places"), F.countDistinct("aspect").alias("aspects"), F.min("score").alias("least"), F.max("score").alias("largest"), top("place_id").alias("top_places"), top("aspect").alias("top_aspects"))


GAP = ["rank", "place_id", "place_name", "category", "aspect", "score", "confidence", "review_count"]


@query(f"""WITH RECURSIVE {st.SCORES}, {st.CLUSTERS} SELECT {', '.join(GAP)} FROM score WHERE score >= 5 AND lower(category) = 'asia' AND contains(lower(place_name), 'supplier')
  AND review_count >= 10 AND place_id IN (SELECT place_id FROM clus WHERE cluster = 0) ORDER BY score DESC, rank LIMIT 20 OFFSET 2""")
def list_service_gaps(spark, d):
    from gapline.operators.relational import page, scan_filter

    rows = scan_filter(st.scores(spark, d), {"category": "Asia"}, {"place_name": "SUPPLIER"}, {"score": 5.0, "review_count": 10})
    rows = rows.join(st.clusters(spark, d).where("cluster = 0"), "place_id", "left_semi")
    return page(rows, [F.desc("score"), F.asc("rank")], 20, 2).select(*GAP)


@query(f"""WITH RECURSIVE {st.SCORES}, {st.CLUSTERS}, n AS (SELECT place_id, count(DISTINCT review_id) AS reviews FROM mention GROUP BY 1),
  t AS (SELECT place_id, aspect, score, confidence FROM score QUALIFY row_number() OVER (PARTITION BY place_id ORDER BY rank) = 1)
  SELECT place_id, place_name, category, coalesce(reviews, 0) AS reviews, aspect, score, confidence, cluster FROM place LEFT JOIN n USING (place_id) LEFT JOIN t USING (place_id) LEFT JOIN clus USING (place_id)""")
def place_views(spark, d):
    n = st.reviews(spark, d).groupBy("place_id").agg(F.countDistinct("review_id").alias("reviews"))
    top = first_by(st.scores(spark, d).select("place_id", "aspect", "score", "confidence", "rank"), ["place_id"], [F.col("rank")]).drop("rank")
    p = st.places(spark, d).select("place_id", "place_name", "category")
    return p.join(n, "place_id", "left").join(top, "place_id", "left").join(st.clusters(spark, d), "place_id", "left").select("place_id", "place_name", "category", F.coalesce("reviews", F.lit(0)).cast("long").alias("reviews"), "aspect", "score", "confidence", "cluster")


@query(f"""WITH RECURSIVE {st.SCORES}, {st.CLUSTERS}, t AS (SELECT place_id, aspect, score FROM score QUALIFY row_number() OVER (PARTITION BY place_id ORDER BY rank) = 1)
  SELECT place_id, place_name, category, cluster, aspect, score FROM place LEFT JOIN t USING (place_id) LEFT JOIN clus USING (place_id)
  WHERE coalesce(score, 0) >= 1 AND contains(lower(place_name), '0') ORDER BY coalesce(score, 0) DESC, place_name LIMIT 25 OFFSET 5""")
def list_places(spark, d):
    from gapline.operators.relational import page

    top = first_by(st.scores(spark, d).select("place_id", "aspect", "score", "rank"), ["place_id"], [F.col("rank")]).drop("rank")
    rows = st.places(spark, d).select("place_id", "place_name", "category").join(top, "place_id", "left").join(st.clusters(spark, d), "place_id", "left")
    rows = rows.where((F.coalesce("score", F.lit(0.0)) >= 1) & F.lower("place_name").contains("0"))
    return page(rows, [F.coalesce("score", F.lit(0.0)).desc(), F.asc("place_name")], 25, 5)


@query(f"WITH RECURSIVE {st.SCORES} SELECT place_id, aspect, score, rank FROM score QUALIFY row_number() OVER (PARTITION BY place_id ORDER BY rank) = 1")
def top_gap_per_place(spark, d):
    return first_by(st.scores(spark, d).select("place_id", "aspect", "score", "rank"), ["place_id"], [F.col("rank")])


@query(f"WITH RECURSIVE {st.SCORES} SELECT {', '.join(GAP)} FROM score ORDER BY rank LIMIT 15")
def top_n_gaps(spark, d):
    return st.scores(spark, d).select(*GAP).orderBy("rank").limit(15)


@query(f"WITH RECURSIVE {st.SCORES} SELECT count(*) FILTER (confidence = 'high') AS sure, sum(mentions)::BIGINT AS evidence, count(*) FILTER (score >= 40) AS urgent, count(*) FILTER (score >= 60) AS critical FROM score")
def kpi_rollup(spark, d):
    s = st.scores(spark, d)
    return s.agg(F.count_if(F.col("confidence") == "high").alias("sure"), F.sum("mentions").alias("evidence"), F.count_if(F.col("score") >= 40).alias("urgent"), F.count_if(F.col("score") >= 60).alias("critical"))


@query(f"""WITH RECURSIVE {st.SCORES}, {st.TEXTS}, {DUPLICATES},
  v AS (SELECT * FROM dup WHERE NOT is_duplicate AND coalesce(len(text), 0) > 0),
  a AS (SELECT aspect, sum(negatives)::BIGINT AS n FROM score GROUP BY 1 ORDER BY n DESC, aspect LIMIT 6)
  SELECT 'total' AS kind, 'reviews' AS key, count(*)::DOUBLE AS value FROM v UNION ALL SELECT 'total', 'places', count(*)::DOUBLE FROM place
  UNION ALL SELECT 'total', 'gaps', count(*)::DOUBLE FROM score UNION ALL SELECT 'mean', 'rating', {r('avg(rating)', 2)} FROM place
  UNION ALL SELECT 'total', 'located', count(lat)::DOUBLE FROM place UNION ALL SELECT 'category', category, count(*)::DOUBLE FROM place GROUP BY category
  UNION ALL SELECT 'sentiment', CASE WHEN rating <= 2 THEN 'negative' WHEN rating = 3 THEN 'neutral' ELSE 'positive' END, count(*)::DOUBLE FROM v GROUP BY 2
  UNION ALL SELECT 'aspect', aspect, n::DOUBLE FROM a""")
def dashboard_summary(spark, d):
    from gapline.functions.parse import weak_label
    from gapline.operators.relational import flag_duplicates

    s, p = st.scores(spark, d), st.places(spark, d)
    v = flag_duplicates(st.texts(spark, d), ["place", "rating", "text"], [F.col("review_id")]).where(~F.col("is_duplicate") & (F.coalesce(F.length("text"), F.lit(0)) > 0))
    one = lambda df, kind, key, value: df.agg(value.cast("double").alias("value")).select(F.lit(kind).alias("kind"), F.lit(key).alias("key"), "value")
    many = lambda df, kind, key: df.groupBy(key.alias("key")).agg(F.count(F.lit(1)).cast("double").alias("value")).select(F.lit(kind).alias("kind"), "key", "value")
    top = s.groupBy(F.col("aspect").alias("key")).agg(F.sum("negatives").alias("n")).orderBy(F.desc("n"), "key").limit(6).select(F.lit("aspect").alias("kind"), "key", F.col("n").cast("double").alias("value"))
    n = F.count(F.lit(1))
    parts = [one(v, "total", "reviews", n), one(p, "total", "places", n), one(s, "total", "gaps", n), one(p, "mean", "rating", S.half_up(F.avg("rating"), 2)), one(p, "total", "located", F.count("lat")), many(p, "category", F.col("category")), many(v, "sentiment", weak_label(F.col("rating"))), top]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out
