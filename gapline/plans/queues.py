"""Queries on annotation queues, imports and report helpers."""

from __future__ import annotations

from pyspark.sql import functions as F

from gapline.functions import parse as P
from gapline.functions import score as S
from gapline.functions import text as X
from gapline.operators import imports, learning, metrics, queues, reports
from gapline.plans import standins as st
from gapline.plans.evidence import TAXONOMY
from gapline.plans.registry import query, r

# Reviews of the annotation domain: every document, its place, rating and weak label; every seventh text is held to be a repeat.
REVIEWS = """rev AS (SELECT doc_id AS review_id, source AS place_id, lang AS category, (doc_id % 5 + 1)::DOUBLE AS rating, text AS text_raw, coalesce(len(text), 0) AS text_length, doc_id % 7 = 3 AS is_duplicate,
  CASE WHEN doc_id % 5 + 1 <= 2 THEN 'negative' WHEN doc_id % 5 + 1 = 3 THEN 'neutral' ELSE 'positive' END AS label FROM documents)"""


def reviews(spark, d):
    docs, rating = st.table(spark, d, "documents"), (F.col("doc_id") % 5 + 1).cast("double")
    return docs.select(
        F.col("doc_id").alias("review_id"), F.col("source").alias("place_id"), F.col("lang").alias("category"), rating.alias("rating"), F.col("text").alias("text_raw"), F.col("text"), X.text_length(F.col("text")).alias("text_length"),
        (F.col("doc_id") % 7 == 3).alias("is_duplicate"), P.weak_label(rating).alias("label"),
    )


@query(f"WITH {REVIEWS} SELECT review_id, label, place_id FROM rev WHERE label IS NOT NULL AND text_raw IS NOT NULL AND text_length > 0 AND NOT is_duplicate")
def label_candidates(spark, d):
    return queues.label_candidates(reviews(spark, d)).select("review_id", "label", "place_id")


@query(f"WITH {REVIEWS} SELECT review_id, md5(text_raw) AS text FROM rev WHERE text_raw IS NOT NULL AND text_length > 0 AND NOT is_duplicate")
def topic_corpus(spark, d):
    return learning.topic_corpus(reviews(spark, d)).select("review_id", F.md5("text").alias("text"))


@query()
def sentiment_queue(spark, d):
    return queues.sentiment_queue(reviews(spark, d)).select("review_id", "place_id", "selection_reason", "selection_place")


ASPECT_OF = "['access', 'price', 'service', 'staff']"
LISTED = f"clause AS (SELECT doc_id AS clause_id, source AS place_id, CASE WHEN doc_id % 6 = 0 THEN ['other'] WHEN doc_id % 6 = 1 THEN ['access', {ASPECT_OF}[(doc_id % 3)::INT + 2]] ELSE [{ASPECT_OF}[(doc_id % 4)::INT + 1]] END AS weak_aspects FROM documents)"


def clauses(spark, d):
    k, names = F.col("doc_id"), F.array(*[F.lit(a) for a in ("access", "price", "service", "staff")])
    pick = lambda n: F.get(names, n.cast("int"))
    listed = F.when(k % 6 == 0, F.array(F.lit("other"))).when(k % 6 == 1, F.array(F.lit("access"), pick(k % 3 + 1))).otherwise(F.array(pick(k % 4)))
    return st.table(spark, d, "documents").select(k.alias("clause_id"), F.col("source").alias("place_id"), listed.alias("weak_aspects"))


@query()
def clause_queue(spark, d):
    return queues.clause_queue(clauses(spark, d), sorted(TAXONOMY), 120, 40, other="other").select("clause_id", "place_id", "selection_reason", "selection_place")


@query(f"""WITH {LISTED}, o AS (SELECT clause_id, weak_aspects, md5(clause_id || ':42') AS o FROM clause),
  f AS (SELECT clause_id, a, row_number() OVER (PARTITION BY a ORDER BY o) AS n FROM (SELECT clause_id, o, unnest(weak_aspects) AS a FROM o)),
  s AS (SELECT clause_id, min(a) AS a FROM f WHERE n <= 3 GROUP BY 1)
  SELECT clause_id FROM o LEFT JOIN s USING (clause_id) ORDER BY a ASC NULLS LAST, o.o LIMIT 60""")
def aspect_sample(spark, d):
    return queues.aspect_sample(clauses(spark, d), "clause_id", 60).select("clause_id")


@query(f"""WITH s AS (SELECT s_suppkey AS clause_id, a AS label, (s_suppkey * 37 + len(a) * 113) % 100 / 100e0 AS p FROM supplier, (SELECT unnest(['access', 'price', 'service', 'staff', 'view "x"', 'zoo']) AS a) t),
  k AS (SELECT *, row_number() OVER (PARTITION BY clause_id ORDER BY p DESC, label) AS n FROM s)
  SELECT clause_id, coalesce(string_agg(label, '|' ORDER BY n) FILTER (p >= 45e-2 AND n <= 3), 'none') AS ai_suggested_aspects,
  '{{' || string_agg(to_json(label)::VARCHAR || ': ' || p::VARCHAR, ', ' ORDER BY n) FILTER (n <= 5) || '}}' AS ai_aspect_probabilities FROM k GROUP BY 1""")
def suggested_aspects(spark, d):
    names = ["access", "price", "service", "staff", 'view "x"', "zoo"]
    each = F.explode(F.array(*[F.struct(F.lit(a).alias("label"), ((F.col("s_suppkey") * 37 + len(a) * 113) % 100 / 100.0).alias("p")) for a in names]))
    return queues.suggested_aspects(st.table(spark, d, "supplier").select(F.col("s_suppkey").alias("clause_id"), each.alias("x")).select("clause_id", "x.*"), "clause_id", 0.45)


AREA_CASES = " ".join(f"WHEN {k} THEN '{v}'" for k, v in reports.AREAS.items())


@query(f"WITH c AS (SELECT s_suppkey, CASE WHEN s_suppkey % 13 <> 0 THEN s_suppkey % 12 END AS cluster FROM supplier) SELECT s_suppkey, CASE WHEN cluster IS NULL THEN '{reports.NO_AREA}' ELSE CASE cluster {AREA_CASES} ELSE '{reports.OTHER_AREA}' || (cluster + 1) END END AS area FROM c")
def area_names(spark, d):
    k = F.col("s_suppkey")
    return st.table(spark, d, "supplier").select(k, reports.area_name(F.when(k % 13 != 0, k % 12)).alias("area"))


TAG_LISTS = ["VERY_SHORT_TEXT|NEGATION", "TYPO_OR_INFORMAL", "", "UNKNOWN", "GENERAL_MODEL_ERROR|SHORT_TEXT", "X|MIXED_SENTIMENT|NEGATION"]
CAUSE_CASES = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in reports.CAUSES.items())


@query(f"""WITH v AS (SELECT event_id, {TAG_LISTS!r}[(event_id % {len(TAG_LISTS)})::INT + 1] AS tags FROM events),
  c AS (SELECT event_id, list_filter(list_transform(string_split(tags, '|'), lambda t: CASE t {CAUSE_CASES} END), lambda x: x IS NOT NULL) AS l FROM v) SELECT event_id, coalesce(l[1], '{reports.NO_CAUSE}') AS cause FROM c""")
def likely_cause(spark, d):
    tags = F.get(F.array(*[F.lit(x) for x in TAG_LISTS]), (F.col("event_id") % len(TAG_LISTS)).cast("int"))
    return st.table(spark, d, "events").select("event_id", reports.likely_cause(tags).alias("cause"))


UPLOAD = "up AS (SELECT doc_id + 2 AS row_no, source AS place_name, lang AS place_category, CASE WHEN doc_id % 5 = 0 THEN 'Bagus sekali' ELSE text END AS review_text, 4e0 AS review_rating, CASE WHEN doc_id % 3 = 0 THEN 'R ' || (doc_id % 50) END AS review_id FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL)"


def upload(spark, d):
    """Rows as a form takes them; longer texts than an upload may have are not accepted later."""
    k = F.col("doc_id")
    text = F.when(k % 5 == 0, "Bagus sekali").otherwise(F.col("text"))
    return st.table(spark, d, "documents").where("lang is not null and source is not null").select((k + 2).alias("row_no"), F.col("source").alias("place_name"), F.col("lang").alias("place_category"), text.alias("review_text"), F.lit(4.0).alias("review_rating"), F.when(k % 3 == 0, F.concat(F.lit("R "), (k % 50).cast("string"))).alias("review_id"))


@query(rf"""WITH {UPLOAD}, c AS (SELECT row_no, place_name, trim(regexp_replace(regexp_replace(nfc_normalize(review_text), '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]', ' ', 'g'), '\s+', ' ', 'g')) AS t FROM up WHERE trim(place_name) <> '' AND trim(place_category) <> ''),
  n AS (SELECT *, row_number() OVER (PARTITION BY place_name, t ORDER BY row_no) AS k FROM c WHERE len(t) BETWEEN 3 AND 2000 AND t NOT IN ('', '-', '--', 'nan', 'NaN', 'None', 'none', 'null', 'NULL', 'n/a', 'N/A'))
  SELECT row_no, 'review_text' AS field, 'warning' AS severity, 'duplicate_review' AS code FROM n WHERE k > 1""")
def import_repeats(spark, d):
    return imports.repeated(upload(spark, d))


@query(rf"""WITH {UPLOAD}, s AS (SELECT row_no, 'imp-7-' || substr(regexp_replace(regexp_replace(lower(coalesce(nullif(trim(review_id), ''), printf('r%05d', row_no - 1))), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 48) AS id FROM up)
  SELECT row_no, CASE WHEN row_number() OVER (PARTITION BY id ORDER BY row_no) = 1 THEN id ELSE id || '-' || (row_no - 1) END AS review_id FROM s""")
def import_review_ids(spark, d):
    return imports.review_ids(upload(spark, d), "imp-7")


@query(f"""WITH g AS (SELECT (l_returnflag = 'R')::INT AS y, (l_orderkey * 7919 + l_linenumber * 31) % 997 / 997e0 AS p FROM lineitem),
  c AS (SELECT p, sum(y) AS pos, count(*) AS n FROM g GROUP BY 1), u AS (SELECT p, sum(pos) OVER w AS tp, sum(n) OVER w AS seen, sum(pos) OVER () AS every FROM c WINDOW w AS (ORDER BY p DESC))
  SELECT {r('p', 6)} AS threshold, {r('tp / seen::DOUBLE', 6)} AS "precision", {r('CASE WHEN every = 0 THEN 0e0 ELSE tp / every::DOUBLE END', 6)} AS recall FROM u""")
def pr_curve(spark, d):
    li = st.table(spark, d, "lineitem")
    rows = li.select((F.col("l_returnflag") == "R").cast("int").alias("y"), ((F.col("l_orderkey") * 7919 + F.col("l_linenumber") * 31) % 997 / 997.0).alias("p"))
    out = metrics.pr_curve(rows, "y", "p")
    return out.select(S.half_up(F.col("threshold"), 6).alias("threshold"), S.half_up(F.col("precision"), 6).alias("precision"), S.half_up(F.col("recall"), 6).alias("recall"))


NUMBERS = ["12", " 3,5 ", "4.25", "-0,1", "x", "", "1.000,5", "7e2"]


@query(f"WITH v AS (SELECT event_id, {NUMBERS!r}[(event_id % {len(NUMBERS)})::INT + 1] AS raw FROM events) SELECT event_id, try_cast(replace(trim(raw), ',', '.') AS DOUBLE) AS number, abs(try_cast(replace(trim(raw), ',', '.') AS DOUBLE) - 35e-1) <= 1e-10 AS near FROM v")
def parse_number(spark, d):
    raw = F.get(F.array(*[F.lit(x) for x in NUMBERS]), (F.col("event_id") % len(NUMBERS)).cast("int"))
    return st.table(spark, d, "events").select("event_id", P.number(raw).alias("number"), reports.close(P.number(raw), F.lit(3.5)).alias("near"))
