"""Queries on duplicates, overlays, joins, cleaning and imports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from gapline.functions import parse as P
from gapline.functions import score as S
from gapline.functions import text as X
from gapline.operators import relational as R
from gapline.plans import standins as st
from gapline.plans.registry import query, r

EVIDENCE = """evid AS (SELECT l_suppkey AS place_id, p_type AS aspect, l_orderkey * 10 + l_linenumber AS clause, l_extendedprice AS p, l_quantity AS q, l_discount AS c
  FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag = 'R')"""


def evidence(spark, d):
    li, part = st.table(spark, d, "lineitem"), st.table(spark, d, "part").select("p_partkey", "p_type")
    rows = li.where("l_returnflag = 'R'").join(part, F.col("l_partkey") == F.col("p_partkey"))
    return rows.select(F.col("l_suppkey").alias("place_id"), F.col("p_type").alias("aspect"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("clause"), F.col("l_extendedprice").alias("p"), F.col("l_quantity").alias("q"), F.col("l_discount").alias("c"))


@query("SELECT doc_id, row_number() OVER (PARTITION BY source, doc_id % 5, text ORDER BY doc_id) > 1 AS is_duplicate FROM documents")
def duplicate_flag(spark, d):
    rows = st.texts(spark, d)
    return R.flag_duplicates(rows, ["place", "rating", "text"], [F.col("review_id")]).select(F.col("review_id").alias("doc_id"), "is_duplicate")


@query("SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def dedup_keep_last(spark, d):
    return R.first_by(st.table(spark, d, "events"), ["user_id"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_id", "event_type", "value")


@query(f"WITH {EVIDENCE} SELECT clause, aspect, p, q FROM evid QUALIFY row_number() OVER (PARTITION BY clause, aspect ORDER BY p DESC, q DESC, c DESC, place_id) = 1")
def best_evidence(spark, d):
    return R.first_by(evidence(spark, d), ["clause", "aspect"], [F.desc("p"), F.desc("q"), F.desc("c"), F.asc("place_id")]).select("clause", "aspect", "p", "q")


@query(f"""WITH {EVIDENCE}, k AS (SELECT place_id, aspect, clause, row_number() OVER (PARTITION BY place_id, aspect ORDER BY p DESC, q DESC, clause) AS i FROM evid QUALIFY i <= 3)
  SELECT place_id, aspect, max(clause) FILTER (i = 1) AS first, max(clause) FILTER (i = 2) AS second, max(clause) FILTER (i = 3) AS third FROM k GROUP BY ALL""")
def topk_evidence_pivot(spark, d):
    order = [F.desc("p"), F.desc("q"), F.asc("clause")]
    top = R.first_by(evidence(spark, d), ["place_id", "aspect"], order, 3)
    lists = top.groupBy("place_id", "aspect").agg(F.array_sort(F.collect_list(F.struct((-F.col("p")).alias("a"), (-F.col("q")).alias("b"), "clause"))).alias("l"))
    return lists.select("place_id", "aspect", *[F.get("l", F.lit(i)).getField("clause").alias(n) for i, n in enumerate(("first", "second", "third"))])


@query(f"""WITH {EVIDENCE}, f AS (SELECT clause, aspect, max(p) AS p, max(q) AS q FROM evid WHERE place_id = 1 GROUP BY ALL),
  g AS (SELECT clause, aspect, p, q FROM f WHERE contains(lower(aspect), 'a') AND p >= 2000 AND q >= 5) SELECT *, (SELECT count(*) FROM g) AS total, (SELECT count(*) FROM f) AS total_all FROM g ORDER BY p DESC, q DESC, aspect, clause LIMIT 20 OFFSET 3""")
def place_evidence_page(spark, d):
    """One place's best evidence per clause and aspect, filtered, counted and paged; the place filter reaches the scan."""
    f = evidence(spark, d).where("place_id = 1").groupBy("clause", "aspect").agg(F.max("p").alias("p"), F.max("q").alias("q"))
    g = R.scan_filter(f, None, {"aspect": "A"}, {"p": 2000, "q": 5})
    counts = g.agg(F.count(F.lit(1)).alias("total")).crossJoin(f.agg(F.count(F.lit(1)).alias("total_all")))
    return R.page(g.crossJoin(F.broadcast(counts)), [F.desc("p"), F.desc("q"), F.asc("aspect"), F.asc("clause")], 20, 3)


RUNS = """base AS (SELECT event_id AS id, user_id, value, 0 AS src FROM events WHERE event_id % 3 <> 0),
run1 AS (SELECT event_id AS id, user_id, value + 1 AS value, 1 AS src FROM events WHERE event_id % 2 = 0), run2 AS (SELECT event_id AS id, user_id, value + 2 AS value, 2 AS src FROM events WHERE event_id % 5 = 0)"""


def runs(spark, d):
    e = st.table(spark, d, "events")
    pick = lambda cond, add: e.where(cond).select(F.col("event_id").alias("id"), "user_id", (F.col("value") + add).alias("value"))
    return [pick("event_id % 3 <> 0", 0), pick("event_id % 2 = 0", 1), pick("event_id % 5 = 0", 2)]


@query(f"WITH {RUNS}, u AS (SELECT * FROM base UNION ALL SELECT * FROM run1 UNION ALL SELECT * FROM run2) SELECT id, user_id, value FROM u QUALIFY row_number() OVER (PARTITION BY id ORDER BY src) = 1")
def overlay_union(spark, d):
    return R.overlay_union(runs(spark, d), ["id"])


@query(f"WITH {RUNS}, manifest AS (SELECT 2 AS src), u AS (SELECT * FROM base UNION ALL SELECT * FROM run1 WHERE src IN (SELECT src FROM manifest) UNION ALL SELECT * FROM run2 WHERE src IN (SELECT src FROM manifest)) SELECT user_id, count(DISTINCT id) AS n FROM u GROUP BY 1")
def publish_manifest_view(spark, d):
    """Base rows and the runs that the manifest lists (run 1 was published and withdrawn), one row per id."""
    from gapline.operators.imports import Manifest

    base, one, two = runs(spark, d)
    manifest = Manifest().publish("run-1").publish("run-2").publish("run-2").unpublish("run-1")
    view = manifest.view(base, one.withColumn("import_id", F.lit("run-1")).unionByName(two.withColumn("import_id", F.lit("run-2"))), ["id"])
    return view.groupBy("user_id").agg(F.countDistinct("id").alias("n"))


@query("SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_custkey % 4 = 0)")
def anti_test_places(spark, d):
    test = st.table(spark, d, "customer").where("c_custkey % 4 = 0").select(F.col("c_custkey").alias("o_custkey"))
    return st.table(spark, d, "orders").select("o_orderkey", "o_custkey").join(test, "o_custkey", "left_anti").select("o_orderkey")


@query(f"WITH RECURSIVE {st.PLACES}, {st.CLUSTERS} SELECT l_suppkey AS place_id, count(*) AS n FROM lineitem WHERE l_suppkey IN (SELECT place_id FROM clus WHERE cluster >= 0) GROUP BY 1")
def semi_cluster(spark, d):
    inside = st.clusters(spark, d).where("cluster >= 0").select("place_id")
    return st.reviews(spark, d).join(inside, "place_id", "left_semi").groupBy("place_id").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT doc_id FROM labels EXCEPT SELECT doc_id FROM documents WHERE doc_id % 3 <> 0")
def gold_regression_diff(spark, d):
    """Ids of the gold set that a new export would lose."""
    kept = st.table(spark, d, "documents").where("doc_id % 3 <> 0").select("doc_id")
    return st.table(spark, d, "labels").select("doc_id").exceptAll(kept).distinct()


@query(r"""WITH s AS (SELECT regexp_extract(url, '://([^/?#]*)/([a-z]+)/', 1) AS name, regexp_extract(url, '://([^/?#]*)/([a-z]+)/', 2) AS sheet FROM pages),
  t AS (SELECT name, count(DISTINCT sheet) AS sheets, min(sheet) AS one FROM s WHERE name <> '' GROUP BY 1) SELECT name, sheets, CASE WHEN sheets = 1 THEN one END AS only_in FROM t""")
def only_here_names(spark, d):
    """Names (hosts) and the sheet (section) they stand in, if they stand in one alone."""
    part = lambda i: F.regexp_extract("url", r"://([^/?#]*)/([a-z]+)/", i)
    rows = st.table(spark, d, "pages").select(part(1).alias("name"), part(2).alias("sheet")).where("name <> ''")
    seen = rows.groupBy("name").agg(F.countDistinct("sheet").alias("sheets"), F.min("sheet").alias("one"))
    return seen.select("name", "sheets", F.when(F.col("sheets") == 1, F.col("one")).alias("only_in"))


SPLIT = "split AS (SELECT doc_id, quality, ['train', 'validation', 'test'][(doc_id % 7 // 3)::INT + 1] AS split, source FROM labels JOIN documents USING (doc_id))"


def split(spark, d):
    name = F.get(F.array(*[F.lit(x) for x in ("train", "validation", "test")]), F.floor(F.col("doc_id") % 7 / 3).cast("int"))
    return st.table(spark, d, "labels").select("doc_id", "quality").join(st.table(spark, d, "documents").select("doc_id", "source"), "doc_id").withColumn("split", name)


@query(f"WITH {SPLIT} SELECT source, count(DISTINCT split) AS splits, string_agg(DISTINCT split, '|' ORDER BY split) AS names FROM split GROUP BY 1 HAVING count(DISTINCT split) > 1")
def split_leakage(spark, d):
    s = split(spark, d).groupBy("source").agg(F.countDistinct("split").alias("splits"), F.array_join(F.array_sort(F.collect_set("split")), "|").alias("names"))
    return s.where("splits > 1")


@query(f"WITH {SPLIT} SELECT split, count(*) FILTER (quality = 0) AS label_0, count(*) FILTER (quality = 1) AS label_1 FROM split GROUP BY 1")
def split_crosstab(spark, d):
    wide = split(spark, d).groupBy("split").pivot("quality", [0, 1]).count().fillna(0)
    return wide.select("split", F.col("0").alias("label_0"), F.col("1").alias("label_1"))


@query("SELECT sha256(string_agg(doc_id || ',' || quality || ',' || toxic, chr(10) ORDER BY doc_id)) AS digest, count(*) AS n FROM labels")
def semantic_hash(spark, d):
    """One digest of a small table whatever the order of its rows."""
    row = F.concat_ws(",", F.col("doc_id"), F.col("quality"), F.col("toxic"))
    rows = st.table(spark, d, "labels").select("doc_id", row.alias("row"))
    return rows.agg(F.sha2(F.expr("listagg(row, '\n') within group (order by doc_id)"), 256).alias("digest"), F.count(F.lit(1)).alias("n"))


@query("""WITH s AS (SELECT doc_id, trim(regexp_replace(CASE WHEN doc_id % 6 = 0 THEN NULL WHEN doc_id % 6 = 1 THEN ' n/a ' ELSE source END, '\\s+', ' ', 'g')) AS a, CASE WHEN doc_id % 12 < 2 THEN '--' ELSE lang END AS b FROM documents),
  c AS (SELECT doc_id, CASE WHEN a IN ('n/a', '--') THEN NULL ELSE a END AS a, CASE WHEN b IN ('n/a', '--') THEN NULL ELSE b END AS b FROM s) SELECT doc_id, a AS source_name, b AS language FROM c WHERE a IS NOT NULL OR b IS NOT NULL""")
def clean_sheet(spark, d):
    """Column names to snake case, text cells cleaned, rows without any value dropped."""
    k = F.col("doc_id")
    raw = st.table(spark, d, "documents").select(k, F.when(k % 6 == 0, F.lit(None)).when(k % 6 == 1, " n/a ").otherwise(F.col("source")).alias("Source Name"), F.when(k % 12 < 2, "--").otherwise(F.col("lang")).alias(" Language!"))
    named = raw.toDF(*X.column_names(raw.columns))
    cells = [c for c in named.columns if c != "doc_id"]
    return named.select("doc_id", *[X.clean_text(F.col(c)).alias(c) for c in cells]).dropna("all", subset=cells)


@query(f"WITH {st.TEXTS}, f AS (SELECT *, row_number() OVER (PARTITION BY place, rating, text ORDER BY review_id) > 1 AS dup FROM review) SELECT review_id, CASE WHEN rating <= 2 THEN 'negative' WHEN rating = 3 THEN 'neutral' ELSE 'positive' END AS label FROM f WHERE text IS NOT NULL AND len(text) > 0 AND NOT dup AND place IS NOT NULL")
def usable_reviews(spark, d):
    rows = R.flag_duplicates(st.texts(spark, d), ["place", "rating", "text"], [F.col("review_id")])
    usable = rows.where(F.col("text").isNotNull() & (F.length("text") > 0) & ~F.col("is_duplicate") & F.col("place").isNotNull())
    return usable.select("review_id", P.weak_label(F.col("rating")).alias("label")).where("label is not null")


@query("""SELECT 'customer' AS sheet, c_custkey AS row_id, c_name AS name, c_nationkey AS nation, c_acctbal AS amount, c_mktsegment AS segment FROM customer
  UNION ALL SELECT 'supplier', s_suppkey, s_name, s_nationkey, s_acctbal, NULL FROM supplier UNION ALL SELECT 'part', p_partkey, p_name, NULL, p_retailprice, p_type FROM part""")
def sheet_union(spark, d):
    """Sheets mapped by a declared spec to one schema; what a sheet lacks is null."""
    specs = {
        "customer": {"row_id": "c_custkey", "name": "c_name", "nation": "c_nationkey", "amount": "c_acctbal", "segment": "c_mktsegment"},
        "supplier": {"row_id": "s_suppkey", "name": "s_name", "nation": "s_nationkey", "amount": "s_acctbal"},
        "part": {"row_id": "p_partkey", "name": "p_name", "amount": "p_retailprice", "segment": "p_type"},
    }
    frames = [st.table(spark, d, t).select(F.lit(t).alias("sheet"), *[F.col(c).alias(n) for n, c in spec.items()]) for t, spec in specs.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames).select("sheet", "row_id", "name", "nation", "amount", "segment")


@query(f"""WITH {st.PLACES}, q AS (SELECT a.place_id AS a, b.place_id AS b, 100e0 * (1e0 - levenshtein(a.place_name, b.place_name) / greatest(len(a.place_name), len(b.place_name))::DOUBLE) AS base,
    (CASE WHEN a.category = b.category THEN 2e0 ELSE 0e0 END) + (CASE WHEN a.place_type = b.place_type THEN 1e0 ELSE 0e0 END) + (CASE WHEN abs(a.lat - b.lat) <= 2e-3 AND abs(a.lon - b.lon) <= 2e-3 THEN 3e0 ELSE 0e0 END) AS bonus
  FROM place a JOIN place b ON a.category = b.category AND a.place_id < b.place_id)
  SELECT a, b, {r('least(base + bonus, 100e0)', 4)} AS score, CASE WHEN base + bonus >= 94 THEN 'auto' WHEN base + bonus >= 88 THEN 'new_needs_manual_review' ELSE 'new' END AS status FROM q WHERE base >= 80""")
def match_evidence_bonus(spark, d):
    from gapline.operators.entities import evidence_bonus, match_status, similar_names

    p = st.places(spark, d).select("place_id", "place_name", "category", "place_type", "lat", "lon")
    rows = similar_names(p, "place_id", "place_name", "category", 80.0).withColumn("total", F.col("base") + evidence_bonus("a_", "b_"))
    return rows.select(F.col("a_place_id").alias("a"), F.col("b_place_id").alias("b"), S.half_up(F.least("total", F.lit(100.0)), 4).alias("score"), match_status(F.col("total")).alias("status"))


@query(f"""WITH {st.PLACES}, m AS (SELECT s_suppkey AS place_id, s_acctbal AS fee, 'meta ' || s_suppkey AS address, CASE WHEN s_suppkey % 2 = 0 THEN 'closed' END AS status FROM supplier WHERE s_suppkey % 3 <> 1)
  SELECT place_id, place_name, coalesce(place.address, m.address) AS address, coalesce(place.status, m.status) AS status, fee FROM place LEFT JOIN m USING (place_id)""")
def enrich_places(spark, d):
    k = F.col("s_suppkey")
    meta = st.table(spark, d, "supplier").where("s_suppkey % 3 <> 1").select(k.alias("place_id"), F.col("s_acctbal").alias("fee"), F.concat(F.lit("meta "), k.cast("string")).alias("address"), F.when(k % 2 == 0, "closed").alias("status"))
    return R.enrich(st.places(spark, d).select("place_id", "place_name", "address", "status"), meta, "place_id", [F.col("fee")])


@query("""WITH m AS (SELECT s_suppkey, s_suppkey % 40 AS place_id FROM supplier WHERE s_suppkey % 4 <> 0), p AS (SELECT s_suppkey AS place_id, s_name AS name, CASE WHEN s_suppkey % 5 <> 0 THEN n_name END AS category FROM supplier JOIN nation ON s_nationkey = n_nationkey)
  SELECT l_orderkey, l_linenumber, m.place_id, name, coalesce(category, 'unmatched') AS category, count(*) AS n FROM lineitem LEFT JOIN m ON l_suppkey = s_suppkey LEFT JOIN p USING (place_id) GROUP BY ALL""")
def attach_reviews(spark, d):
    """Reviews looked up in the mapping of names and then in the places; a default category where nothing matched."""
    s, n = st.table(spark, d, "supplier"), st.table(spark, d, "nation")
    m = s.where("s_suppkey % 4 <> 0").select(F.col("s_suppkey").alias("l_suppkey"), (F.col("s_suppkey") % 40).alias("place_id"))
    p = s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("place_id"), F.col("s_name").alias("name"), F.when(F.col("s_suppkey") % 5 != 0, F.col("n_name")).alias("category"))
    rows = st.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey").join(m, "l_suppkey", "left").join(p, "place_id", "left")
    return rows.groupBy("l_orderkey", "l_linenumber", "place_id", "name", F.coalesce("category", F.lit("unmatched")).alias("category")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT d.doc_id, CASE WHEN l.quality = 1 AND d.doc_id % 3 <> 0 THEN 'good' WHEN l.quality = 0 THEN 'bad' ELSE d.lang END AS label FROM documents d LEFT JOIN labels l USING (doc_id)")
def annotation_overlay(spark, d):
    saved = st.table(spark, d, "labels").select("doc_id", F.when((F.col("quality") == 1) & (F.col("doc_id") % 3 != 0), "good").when(F.col("quality") == 0, "bad").otherwise(" ").alias("label"))
    return R.merge_filled(st.table(spark, d, "documents").select("doc_id", F.col("lang").alias("label")), saved, "doc_id", ["label"])


@query("SELECT doc_id, quality, toxic, lang, source FROM labels JOIN documents USING (doc_id)")
def gold_join(spark, d):
    """Gold labels and their reviews, one to one: a repeated id on either side stops the query."""
    return R.one_to_one(st.table(spark, d, "labels"), st.table(spark, d, "documents").select("doc_id", "lang", "source"), "doc_id").select("doc_id", "quality", "toxic", "lang", "source")


IMPORT = """imp AS (SELECT event_id AS row_no, CASE WHEN event_id % 11 = 0 THEN ' ' ELSE 'Place ' || (user_id % 50) END AS place_name, CASE WHEN event_id % 13 = 0 THEN NULL ELSE event_type END AS place_category,
  CASE WHEN event_id % 7 = 0 THEN 'ok' ELSE 'text ' || (event_id % 400) END AS review_text, CASE WHEN event_id % 5 = 0 THEN NULL ELSE value END AS latitude, CASE WHEN event_id % 9 = 0 THEN NULL ELSE value * 3 END AS longitude,
  (event_id % 8)::DOUBLE AS review_rating, CASE WHEN event_id % 17 = 0 THEN 'soon' ELSE '2024-01-02' END AS review_date FROM events)"""


def uploads(spark, d):
    k = F.col("event_id")
    return st.table(spark, d, "events").select(
        k.alias("row_no"), F.when(k % 11 == 0, " ").otherwise(F.concat(F.lit("Place "), (F.col("user_id") % 50).cast("string"))).alias("place_name"), F.when(k % 13 != 0, F.col("event_type")).alias("place_category"),
        F.when(k % 7 == 0, "ok").otherwise(F.concat(F.lit("text "), (k % 400).cast("string"))).alias("review_text"), F.when(k % 5 != 0, F.col("value")).alias("latitude"), F.when(k % 9 != 0, F.col("value") * 3).alias("longitude"),
        (k % 8).cast("double").alias("review_rating"), F.when(k % 17 == 0, "soon").otherwise("2024-01-02").alias("review_date"),
    )


@query(f"""WITH {IMPORT}, x AS (SELECT * FROM imp) SELECT row_no, 'place_name' AS field, 'error' AS severity, 'invalid_value' AS code FROM x WHERE trim(place_name) = ''
  UNION ALL SELECT row_no, 'place_category', 'error', 'invalid_value' FROM x WHERE place_category IS NULL UNION ALL SELECT row_no, 'review_text', 'error', 'invalid_value' FROM x WHERE len(review_text) < 3 OR len(review_text) > 2000
  UNION ALL SELECT row_no, 'review_rating', 'error', 'invalid_value' FROM x WHERE review_rating NOT BETWEEN 1 AND 5 UNION ALL SELECT row_no, 'coordinates', 'warning', 'incomplete_coordinate' FROM x WHERE (latitude IS NULL) <> (longitude IS NULL)
  UNION ALL SELECT row_no, 'coordinates', 'warning', 'invalid_coordinate' FROM x WHERE latitude IS NOT NULL AND longitude IS NOT NULL AND NOT (latitude BETWEEN -90 AND 90 AND longitude BETWEEN -180 AND 180)
  UNION ALL SELECT row_no, 'review_date', 'warning', 'invalid_date' FROM x WHERE review_date = 'soon' AND trim(place_name) <> '' AND place_category IS NOT NULL AND len(review_text) >= 3 AND review_rating BETWEEN 1 AND 5""")
def import_validate_issues(spark, d):
    from gapline.operators.imports import issues

    return issues(uploads(spark, d)).select("row_no", "field", "severity", "code")


OK_ROWS = "ok AS (SELECT * FROM imp WHERE trim(place_name) <> '' AND place_category IS NOT NULL AND len(review_text) >= 3 AND review_rating BETWEEN 1 AND 5)"


@query(f"""WITH {IMPORT}, {OK_ROWS}, g AS (SELECT trim(place_name) AS place, arg_min(place_category, row_no) AS category, arg_min(latitude, row_no) FILTER (latitude IS NOT NULL) AS lat, arg_min(longitude, row_no) FILTER (longitude IS NOT NULL) AS lon,
    avg(review_rating) AS rating, count(DISTINCT place_category) > 1 AS category_conflict, count(DISTINCT latitude) > 1 AS lat_conflict, count(*) AS n FROM ok GROUP BY 1)
  SELECT place, category, lat, lon, {r('rating', 4)} AS rating, category_conflict, lat_conflict, n FROM g""")
def import_build_entities(spark, d):
    from gapline.operators.imports import accepted, entities

    return entities(accepted(uploads(spark, d)).withColumn("place", F.btrim("place_name"))).withColumn("rating", S.half_up(F.col("rating"), 4))


@query(f"""WITH {IMPORT}, {OK_ROWS}, old AS (SELECT DISTINCT lower('TEXT ' || (event_id % 400)) AS t FROM events WHERE event_id % 400 < 50)
  SELECT row_no, review_text FROM ok WHERE lower(review_text) NOT IN (SELECT t FROM old) QUALIFY row_number() OVER (PARTITION BY lower(review_text) ORDER BY row_no) = 1""")
def import_dedupe(spark, d):
    from gapline.operators.imports import accepted, new_texts

    old = st.table(spark, d, "events").where("event_id % 400 < 50").select(F.concat(F.lit("TEXT "), (F.col("event_id") % 400).cast("string")).alias("review_text"))
    return new_texts(accepted(uploads(spark, d)), old).select("row_no", "review_text")


@query(f"""WITH {IMPORT}, {OK_ROWS} SELECT (SELECT count(*) FROM imp) AS rows_received, count(*) AS rows_accepted, (SELECT count(*) FROM imp) - count(*) AS rows_rejected, count(DISTINCT trim(place_name)) AS place_count,
  count(*) FILTER (review_rating <= 2) AS negative, count(*) FILTER (review_rating = 3) AS neutral, count(*) FILTER (review_rating >= 4) AS positive FROM ok""")
def import_summary(spark, d):
    from gapline.operators.imports import accepted

    rows = uploads(spark, d)
    ok = accepted(rows).withColumn("label", P.weak_label(F.col("review_rating")))
    got = ok.agg(F.count(F.lit(1)).alias("rows_accepted"), F.countDistinct(F.btrim("place_name")).alias("place_count"), *[F.count_if(F.col("label") == x).alias(x) for x in ("negative", "neutral", "positive")])
    return rows.agg(F.count(F.lit(1)).alias("rows_received")).crossJoin(got).withColumn("rows_rejected", F.col("rows_received") - F.col("rows_accepted"))
