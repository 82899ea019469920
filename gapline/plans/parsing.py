"""Queries on values read out of text."""

from __future__ import annotations

from pyspark.sql import functions as F

from gapline.functions import parse as P
from gapline.functions import text as X
from gapline.plans import standins as st
from gapline.plans.registry import query

PLACEHOLDERS = "('', '-', '--', 'nan', 'NaN', 'None', 'none', 'null', 'NULL', 'n/a', 'N/A')"


def squeeze(e: str) -> str:
    return f"trim(regexp_replace(regexp_replace({e}, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]', ' ', 'g'), '\\s+', ' ', 'g'))"


DIRTY = "dirty AS (SELECT doc_id, CASE doc_id % 9 WHEN 0 THEN ' n/a ' WHEN 1 THEN NULL WHEN 2 THEN '  ' || text || chr(9) || '  x ' ELSE text END AS raw FROM documents)"


def dirty(spark, d):
    docs, k = st.table(spark, d, "documents"), F.col("doc_id") % 9
    raw = F.when(k == 0, " n/a ").when(k == 1, F.lit(None)).when(k == 2, F.concat(F.lit("  "), F.col("text"), F.lit("\t  x "))).otherwise(F.col("text"))
    return docs.select("doc_id", raw.alias("raw"))


@query(f"WITH {DIRTY}, c AS (SELECT doc_id, CASE WHEN raw IS NULL OR trim(raw) IN {PLACEHOLDERS} OR {squeeze('nfc_normalize(raw)')} IN {PLACEHOLDERS} THEN NULL ELSE {squeeze('nfc_normalize(raw)')} END AS clean FROM dirty) SELECT doc_id, md5(clean) AS clean, coalesce(len(clean), 0) AS n, clean IS NULL AS missing FROM c")
def clean_text(spark, d):
    c = dirty(spark, d).select("doc_id", X.clean_text(F.col("raw")).alias("clean"))
    return c.select("doc_id", F.md5("clean").alias("clean"), X.text_length(F.col("clean")).alias("n"), F.col("clean").isNull().alias("missing"))


@query(r"""WITH s AS (SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN 'Pantai Bul-Bul, ' || s_name WHEN 1 THEN '  Lumban   BUL bul #' || s_suppkey WHEN 2 THEN '!!' ELSE s_name END AS name FROM supplier)
  SELECT s_suppkey, nullif(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(name), '\bbul[\s\-]+bul\b', 'bul bul', 'g'), '\blumban\s+bul\s+bul\b', 'lumban bulbul', 'g'), '[^\w\s]', ' ', 'g'), '\s+', ' ', 'g')), '') AS place_name FROM s""")
def place_name_norm(spark, d):
    k = F.col("s_suppkey")
    name = F.when(k % 4 == 0, F.concat(F.lit("Pantai Bul-Bul, "), "s_name")).when(k % 4 == 1, F.concat(F.lit("  Lumban   BUL bul #"), k.cast("string"))).when(k % 4 == 2, "!!").otherwise(F.col("s_name"))
    return st.table(spark, d, "supplier").select(k, X.place_name(name).alias("place_name"))


RATINGS = ["4", "4,5", "4.2 bintang", "2025", "-3", "n/a", "rating: 5/5", "0,9", "", "abc"]
PRICES = ["Gratis", "5.000 - 10.000", "Rp 15.000", "1.234,50", "1,000", "10,000,000", "free entry", "-", "mulai 2.5 sampai 3", "tanya", "Rp1.000.000"]
COORDINATES = ["2.61, 99.12", "200, 99", "2,61 99,12", "n/a", "lat 1.5", "-3.25;120.5", "x", "90 180", "-91 0"]
DATES = ["2024-03-05", "3 days ago", "a month ago", "yesterday", "2 years ago", "an hour ago", "2024/02/29", "", "someday", "one week ago", "2023-01-31 22:15:00"]


def literals(spark, d, values, name):
    """Events, each with one of the values in turn."""
    at = (F.col("event_id") % len(values)).cast("int")
    return st.table(spark, d, "events").select("event_id", F.get(F.array(*[F.lit(v) for v in values]), at).alias(name), F.col("ts").alias("ts"))


def sql_list(values):
    return "[" + ", ".join("'" + v + "'" for v in values) + "]"


def lit_cte(values, name):
    return f"v AS (SELECT event_id, {sql_list(values)}[(event_id % {len(values)})::INT + 1] AS {name}, ts FROM events)"


@query(f"WITH {lit_cte(RATINGS, 'raw')}, p AS (SELECT event_id, try_cast(replace(regexp_extract(raw, '([0-9]+(?:[.,][0-9]+)?)', 1), ',', '.') AS DOUBLE) AS x FROM v WHERE trim(raw) NOT IN {PLACEHOLDERS}) SELECT v.event_id, CASE WHEN x BETWEEN 1 AND 5 THEN x END AS rating FROM v LEFT JOIN p USING (event_id)")
def parse_rating(spark, d):
    return literals(spark, d, RATINGS, "raw").select("event_id", P.rating(F.col("raw")).alias("rating"))


PRICE_TOKEN = """CASE WHEN contains(t, '.') AND contains(t, ',') THEN replace(replace(t, '.', ''), ',', '.')
  WHEN contains(t, '.') AND regexp_full_match(t, '[^.]*([.][^.]{3})+') THEN replace(t, '.', '') WHEN contains(t, ',') THEN replace(t, ',', '.') ELSE t END"""


@query(f"""WITH {lit_cte(PRICES, 'raw')}, k AS (SELECT event_id, raw, unnest(regexp_extract_all(raw, '[0-9][0-9.,]*')) AS t FROM v),
  n AS (SELECT event_id, min(x) AS lo, max(x) AS hi, count(x) AS c FROM (SELECT event_id, try_cast({PRICE_TOKEN} AS DOUBLE) AS x FROM k) GROUP BY 1),
  f AS (SELECT v.event_id, trim(raw) IN {PLACEHOLDERS} AS gone, NOT (trim(raw) IN {PLACEHOLDERS}) AND regexp_matches(lower(raw), 'gratis|free') AS free, lo, hi, coalesce(c, 0) AS c FROM v LEFT JOIN n USING (event_id))
  SELECT event_id, CASE WHEN free THEN 0e0 WHEN NOT gone THEN lo END AS min_price, CASE WHEN free THEN 0e0 WHEN NOT gone THEN hi END AS max_price, free AS is_free,
  free OR (NOT gone AND c > 0) AS parsing_success, gone AS is_missing, NOT gone AND NOT free AND c = 1 AS is_inferred FROM f""")
def parse_price(spark, d):
    return literals(spark, d, PRICES, "raw").select("event_id", P.price(F.col("raw")).alias("p")).select("event_id", "p.*")


@query(f"""WITH {lit_cte(COORDINATES, 'raw')}, k AS (SELECT event_id, raw, trim(raw) IN {PLACEHOLDERS} AS gone, regexp_extract_all(raw, '-?[0-9]+(?:\\.[0-9]+)?') AS t FROM v),
  n AS (SELECT *, try_cast(t[1] AS DOUBLE) AS a, try_cast(t[2] AS DOUBLE) AS b, NOT gone AND len(t) >= 2 AS two FROM k),
  o AS (SELECT *, coalesce(two AND a BETWEEN -90 AND 90 AND b BETWEEN -180 AND 180, false) AS ok FROM n)
  SELECT event_id, CASE WHEN ok THEN a END AS latitude, CASE WHEN ok THEN b END AS longitude, ok AS parsing_success, gone AS is_missing,
  CASE WHEN gone THEN 'missing' WHEN NOT two THEN 'could_not_find_two_numbers' WHEN NOT ok THEN 'coordinate_out_of_range' END AS error FROM o""")
def parse_coordinate(spark, d):
    return literals(spark, d, COORDINATES, "raw").select("event_id", P.coordinate(F.col("raw")).alias("p")).select("event_id", "p.*")


AGO = r"'([0-9]+|a|an|one)\s+(day|week|month|year|hour|minute)s?\s+ago'"


@query(f"""WITH {lit_cte(DATES, 'raw')}, c AS (SELECT event_id, nullif(trim(raw), '') AS p, CASE WHEN event_id % 13 <> 0 THEN ts END AS col FROM v),
  k AS (SELECT *, coalesce(try_strptime(p, ['%Y-%m-%d %H:%M:%S', '%Y-%m-%d', '%Y/%m/%d']), NULL) AS ab, regexp_extract(p, {AGO}, 1) AS n, regexp_extract(p, {AGO}, 2) AS u FROM c),
  s AS (SELECT *, CASE WHEN u <> '' THEN coalesce(try_cast(n AS DOUBLE), 1e0) * CASE u WHEN 'minute' THEN 60 WHEN 'hour' THEN 3600 WHEN 'day' THEN 86400 WHEN 'week' THEN 604800 WHEN 'month' THEN 2592000 ELSE 31536000 END WHEN p LIKE '%yesterday%' THEN 86400 END AS back FROM k),
  q AS (SELECT *, (date_trunc('second', col) - to_seconds(back))::DATE AS rel FROM s)
  SELECT event_id, CASE WHEN p IS NULL THEN col::DATE ELSE coalesce(ab::DATE, rel) END AS review_date,
  CASE WHEN p IS NULL AND col IS NOT NULL THEN true WHEN p IS NULL THEN false ELSE ab IS NULL AND rel IS NOT NULL END AS is_inferred,
  CASE WHEN p IS NULL AND col IS NOT NULL THEN 'collect_date_fallback' WHEN p IS NULL THEN NULL WHEN ab IS NOT NULL THEN 'published_at_absolute' WHEN rel IS NOT NULL THEN 'published_at_relative_to_collect_date' ELSE 'unparsed' END AS source FROM q""")
def parse_review_date(spark, d):
    v = literals(spark, d, DATES, "raw")
    collected = F.when(F.col("event_id") % 13 != 0, F.col("ts"))
    return v.select("event_id", P.review_date(X.clean_text(F.col("raw")), collected).alias("p")).select("event_id", "p.*")


@query(f"WITH {st.TEXTS} SELECT review_id, CASE WHEN review_id % 17 = 0 THEN NULL WHEN rating <= 2 THEN 'negative' WHEN rating = 3 THEN 'neutral' WHEN rating >= 4 THEN 'positive' END AS label, CASE WHEN review_id % 17 = 0 THEN 'rating_missing' ELSE 'rating_' || rating::INT END AS rating_class FROM review")
def weak_sentiment(spark, d):
    rating = F.when(F.col("review_id") % 17 != 0, F.col("rating"))
    return st.texts(spark, d).select("review_id", P.weak_label(rating).alias("label"), P.rating_class(rating).alias("rating_class"))


@query("SELECT conv_id, turn, CASE WHEN coalesce(len(text), 0) <= 0 THEN 'empty' WHEN len(text) <= 30 THEN 'very_short' WHEN len(text) <= 100 THEN 'short' WHEN len(text) <= 250 THEN 'medium' ELSE 'long' END AS bucket FROM conversations")
def length_bucket(spark, d):
    return st.table(spark, d, "conversations").select("conv_id", "turn", X.length_bucket(F.length("text")).alias("bucket"))


WORDS_EN = "['the', 'and', 'was', 'good', 'bad', 'room', 'food']"
WORDS_ID = "['yang', 'dan', 'tidak', 'bagus', 'buruk', 'kamar']"
MIXED = "m AS (SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN text || ' tidak bagus' WHEN 1 THEN 'Kamar bagus dan bersih yg ' || doc_id WHEN 2 THEN 'Bagus sekali but dirty room, toba ' || doc_id WHEN 3 THEN NULL ELSE text END AS text, lang, (doc_id % 5 + 1)::DOUBLE AS rating, doc_id % 8 AS place_reviews FROM documents)"


def mixed(spark, d):
    k = F.col("doc_id") % 6
    n = F.col("doc_id").cast("string")
    text = F.when(k == 0, F.concat("text", F.lit(" tidak bagus"))).when(k == 1, F.concat(F.lit("Kamar bagus dan bersih yg "), n)).when(k == 2, F.concat(F.lit("Bagus sekali but dirty room, toba "), n)).when(k == 3, F.lit(None)).otherwise(F.col("text"))
    return st.table(spark, d, "documents").select("doc_id", text.alias("text"), "lang", (F.col("doc_id") % 5 + 1).cast("double").alias("rating"), (F.col("doc_id") % 8).alias("place_reviews"))


@query(f"WITH {MIXED}, t AS (SELECT doc_id, string_split_regex(lower(coalesce(text, 'none')), '\\s+') AS w FROM m) SELECT doc_id, CASE WHEN list_has_any(w, {WORDS_EN}) AND list_has_any(w, {WORDS_ID}) THEN 'mixed_id_en' WHEN list_has_any(w, {WORDS_EN}) THEN 'english_signal' ELSE 'indonesian_or_local' END AS bucket FROM t")
def language_bucket(spark, d):
    return mixed(spark, d).select("doc_id", X.language_bucket(F.col("text")).alias("bucket"))


def has_word(e, words):
    """Whole words among the runs of letters, digits and underscores."""
    return f"list_has_any(string_split_regex(lower({e}), '[^\\p{{L}}\\p{{M}}\\p{{N}}_]+'), [{', '.join(repr(w) for w in words)}])"


@query(f"WITH {MIXED} SELECT doc_id, {has_word('text', X.ENGLISH_WORDS)} AND {has_word('text', X.INDONESIAN_WORDS)} AS mixed FROM m WHERE text IS NOT NULL")
def mixed_language(spark, d):
    return mixed(spark, d).where("text is not null").select("doc_id", X.mixed_language(F.col("text")).alias("mixed"))


GOOD, BAD = has_word("text", X.POSITIVE_HINTS), has_word("text", X.NEGATIVE_HINTS)


@query(f"""WITH {MIXED} SELECT doc_id, coalesce(nullif(concat_ws('|', CASE WHEN len(text) <= 30 THEN 'VERY_SHORT_TEXT' END, CASE WHEN {GOOD} AND {BAD} THEN 'MIXED_POSITIVE_NEGATIVE' END,
  CASE WHEN (contains(lower(text), 'mantap sekali') OR contains(lower(text), 'bagus sekali')) AND doc_id % 2 = 0 THEN 'POSSIBLE_SARCASM_OR_RATING_TEXT_MISMATCH' END,
  CASE WHEN {has_word('text', X.ENGLISH_WORDS)} AND {has_word('text', X.INDONESIAN_WORDS)} THEN 'MIXED_ID_EN' END, CASE WHEN {has_word('text', X.LOCAL_HINTS)} THEN 'LOCAL_NAME_OR_TERM' END,
  CASE WHEN {has_word('text', X.INFORMAL)} THEN 'TYPO_OR_INFORMAL_ABBREVIATION' END, CASE WHEN rating >= 4 AND {BAD} THEN 'HIGH_RATING_WITH_NEGATIVE_TEXT' END,
  CASE WHEN rating <= 2 AND {GOOD} THEN 'LOW_RATING_WITH_POSITIVE_TEXT' END, CASE WHEN place_reviews < 5 THEN 'LOW_PLACE_REVIEW_COUNT' END), ''), 'GENERAL_MODEL_ERROR') AS tags FROM m WHERE text IS NOT NULL""")
def error_tags(spark, d):
    actual = F.when(F.col("doc_id") % 2 == 0, "negative").otherwise("positive")
    tags = X.error_tags(F.col("text"), F.col("rating"), actual, F.col("place_reviews"))
    return mixed(spark, d).where("text is not null").select("doc_id", F.array_join(tags, "|").alias("tags"))


PHONE_SQL = r"(^|[^0-9])(?:\+?62|0)[\s.-]?(?:[0-9][\s.-]?){8,13}($|[^0-9])"
PRIVATE = "priv AS (SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN 'hub 0812-3456-7890 / A.b@c.co.id  ' || text WHEN 1 THEN '+62 812 3456 789, ' || text WHEN 2 THEN text || ' (a_1@b-c.org, 0812 999 888 77)' WHEN 3 THEN 'lihat HTTPS://x.id ' || text ELSE text END AS text FROM documents)"


def private(spark, d):
    k, text = F.col("doc_id") % 7, F.col("text")
    tail = F.lit(" (a_1@b-c.org, 0812 999 888 77)")
    text = F.when(k == 0, F.concat(F.lit("hub 0812-3456-7890 / A.b@c.co.id  "), text)).when(k == 1, F.concat(F.lit("+62 812 3456 789, "), text)).when(k == 2, F.concat(text, tail)).when(k == 3, F.concat(F.lit("lihat HTTPS://x.id "), text)).otherwise(text)
    return st.table(spark, d, "documents").select("doc_id", text.alias("text"))


@query(rf"""WITH {PRIVATE}, t AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM priv)
  SELECT doc_id, md5(regexp_replace(regexp_replace(t, '{X.EMAIL}', '{X.EMAIL_HIDDEN}', 'g'), '{PHONE_SQL}', '\1{X.PHONE_HIDDEN}\2', 'g')) AS clean,
  coalesce(len(t) BETWEEN 20 AND 180 AND NOT regexp_matches(t, '{X.EMAIL}') AND NOT regexp_matches(t, '{PHONE_SQL}') AND NOT regexp_matches(t, '{X.URL}'), false) AS safe FROM t""")
def pii_redact(spark, d):
    return private(spark, d).select("doc_id", F.md5(X.redact(F.col("text"))).alias("clean"), X.shareable(F.col("text")).alias("safe"))


LABELS = ["harga", "toilet", "parkir", "pelayanan"]
LISTS = ["toilet, harga", "none", "none|harga", "foo;harga", "", "Parkir | PARKIR | toilet", "pelayanan;toilet,harga", " harga "]


@query(f"""WITH {lit_cte(LISTS, 'raw')}, k AS (SELECT event_id, list_distinct(list_filter(list_transform(string_split(replace(replace(lower(trim(raw)), ',', '|'), ';', '|'), '|'), lambda x: trim(x)), lambda x: x <> '')) AS l FROM v),
  e AS (SELECT *, list_sort(list_filter(l, lambda x: NOT list_contains(['harga', 'toilet', 'parkir', 'pelayanan', 'none'], x))) AS w FROM k),
  g AS (SELECT *, CASE WHEN len(w) > 0 THEN 'invalid labels: ' || array_to_string(w, ', ') WHEN list_contains(l, 'none') AND len(l) > 1 THEN 'none must be the only label' END AS error FROM e)
  SELECT event_id, CASE WHEN error IS NULL THEN array_to_string(list_filter(['harga', 'toilet', 'parkir', 'pelayanan', 'none'], lambda x: list_contains(l, x)), '|') ELSE '' END AS labels, error FROM g""")
def label_list_norm(spark, d):
    labels, error = X.label_list(F.col("raw"), LABELS)
    return literals(spark, d, LISTS, "raw").select("event_id", F.array_join(labels, "|").alias("labels"), error.alias("error"))


@query(f"WITH {lit_cte([' a | b||c ', '', 'x', '| |y|'], 'raw')} SELECT event_id, array_to_string(list_filter(list_transform(string_split(raw, '|'), lambda x: trim(x)), lambda x: x <> ''), ';') AS items FROM v")
def split_aspect_list(spark, d):
    return literals(spark, d, [" a | b||c ", "", "x", "| |y|"], "raw").select("event_id", F.array_join(X.split_list(F.col("raw")), ";").alias("items"))


@query(r"""SELECT s_suppkey, printf('sheet_%06d', s_suppkey) AS row_id, 'r' || s_suppkey || printf('::c%03d', s_nationkey) AS clause_id, printf('imp-r%05d', s_suppkey) AS review_id,
  'upload-' || substr(regexp_replace(regexp_replace(lower(s_name || '|' || s_nationkey), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 48) || '-' || substr(sha1(lower(s_name || '|' || s_nationkey)), 1, 10) AS place_key FROM supplier""")
def composite_keys(spark, d):
    k, n = F.col("s_suppkey"), F.col("s_nationkey")
    return st.table(spark, d, "supplier").select(k, F.format_string("sheet_%06d", k).alias("row_id"), F.format_string("r%d::c%03d", k, n).alias("clause_id"), F.format_string("imp-r%05d", k).alias("review_id"), X.place_key(F.concat_ws("|", "s_name", n.cast("string"))).alias("place_key"))


@query(r"SELECT doc_id, md5(trim(regexp_replace(regexp_replace(lower(text), '[^0-9a-zA-Z_\s]+', ' ', 'g'), '\s+', ' ', 'g'))) AS norm FROM documents")
def matching_norm(spark, d):
    return st.table(spark, d, "documents").select("doc_id", F.md5(X.matching(F.col("text"))).alias("norm"))
