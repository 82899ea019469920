"""Queries on profiles, annotation work, classifier metrics and details of single things."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from gapline.functions import parse as P
from gapline.functions import score as S
from gapline.functions import text as X
from gapline.operators import metrics as M
from gapline.operators import profile as Pr
from gapline.operators import relational as R
from gapline.operators import sampling as Sa
from gapline.plans import standins as st
from gapline.plans.parsing import has_word
from gapline.plans.registry import query, r


@query(f"""SELECT count(*) AS rows, count(DISTINCT source) AS unique_places, count(*) - (SELECT count(*) FROM (SELECT DISTINCT text, lang, source FROM documents)) AS duplicate_rows, count(*) FILTER (coalesce(len(text), 0) > 0) AS with_text, count(*) FILTER (coalesce(len(text), 0) = 0) AS without_text,
  min(coalesce(len(text), 0))::INT AS shortest, median(coalesce(len(text), 0))::DOUBLE AS median, {r('avg(coalesce(len(text), 0))', 4)} AS mean, max(coalesce(len(text), 0))::INT AS longest FROM documents""")
def sheet_profile(spark, d):
    docs = st.table(spark, d, "documents")
    distinct = docs.select(F.md5("text").alias("t"), "lang", "source").distinct().agg(F.count(F.lit(1)).alias("distinct_rows"))
    one = docs.agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("source").alias("unique_places"), *Pr.lengths(F.col("text")))
    return one.crossJoin(distinct).withColumn("duplicate_rows", F.col("rows") - F.col("distinct_rows")).drop("distinct_rows")


GAPPY = "gappy AS (SELECT event_id, CASE WHEN event_id % 4 = 0 THEN ' n/a' ELSE event_type END AS kind, CASE WHEN event_id % 3 = 0 THEN NULL ELSE value END AS value, CASE WHEN event_id % 10 = 0 THEN '' ELSE props END AS props FROM events)"


def gappy(spark, d):
    k = F.col("event_id")
    return st.table(spark, d, "events").select(k, F.when(k % 4 == 0, " n/a").otherwise(F.col("event_type")).alias("kind"), F.when(k % 3 != 0, F.col("value")).alias("value"), F.when(k % 10 == 0, "").otherwise(F.col("props")).alias("props"))


HOLES = "trim(kind) IN ('', 'n/a') OR kind IS NULL"


@query(f"""WITH {GAPPY}, m AS (SELECT count(*) AS rows, count(*) FILTER ({HOLES}) + count(*) FILTER (value IS NULL) + count(*) FILTER (trim(props) = '' OR props IS NULL) AS missing FROM gappy)
  SELECT 'events' AS sheet, rows, 4::BIGINT AS columns, missing AS missing_cells, rows * 4 AS cells, {r('1e0 - missing / (rows * 4)::DOUBLE', 4)} AS ratio FROM m
  UNION ALL SELECT 'nation', count(*), 3, 0, count(*) * 3, 1e0 FROM nation""")
def metadata_quality(spark, d):
    return Pr.completeness(gappy(spark, d), "events").unionByName(Pr.completeness(st.table(spark, d, "nation"), "nation"))


@query(f"WITH {GAPPY}, m AS (SELECT count(*) AS rows, count(*) FILTER ({HOLES}) AS a, count(*) FILTER (value IS NULL) AS b, count(*) FILTER (trim(props) = '' OR props IS NULL) AS c FROM gappy) SELECT 'kind' AS column, a AS missing, {r('a / rows::DOUBLE', 4)} AS ratio FROM m UNION ALL SELECT 'value', b, {r('b / rows::DOUBLE', 4)} FROM m UNION ALL SELECT 'props', c, {r('c / rows::DOUBLE', 4)} FROM m UNION ALL SELECT 'event_id', 0, 0e0 FROM m")
def missing_ratio(spark, d):
    return Pr.missing(gappy(spark, d)).select("column", "missing", S.half_up(S.ratio(F.col("missing"), F.col("rows")), 4).alias("ratio"))


@query("SELECT (least(len(text), 1000) - 1) // 25 AS bin, count(*) AS n FROM documents WHERE len(text) > 0 GROUP BY 1")
def length_histogram(spark, d):
    n = F.length("text")
    bins = F.floor((F.least(n, F.lit(1000)) - 1) / 25)
    return R.histogram(st.table(spark, d, "documents").where(n > 0), bins, "bin")


@query("SELECT month, n FROM (SELECT date_trunc('month', o_orderdate)::DATE AS month, count(*) AS n FROM orders GROUP BY 1 ORDER BY 1 DESC LIMIT 36)")
def monthly_histogram(spark, d):
    return R.histogram(st.table(spark, d, "orders"), F.trunc("o_orderdate", "month"), "month").orderBy(F.desc("month")).limit(36)


@query(f"WITH {st.PLACES}, {st.TEXTS}, f AS (SELECT *, row_number() OVER (PARTITION BY place, rating, text ORDER BY review_id) > 1 AS dup FROM review) SELECT (SELECT count(*) FROM review) AS reviews, (SELECT count(*) FROM review WHERE len(text) > 0) AS with_text, (SELECT count(*) FROM f WHERE dup) AS duplicates, count(*) AS places, count(lat) AS located, count(rating) AS rated, count(address) AS addressed FROM place")
def completeness_counts(spark, d):
    t = R.flag_duplicates(st.texts(spark, d), ["place", "rating", "text"], [F.col("review_id")])
    a = t.agg(F.count(F.lit(1)).alias("reviews"), F.count_if(F.length("text") > 0).alias("with_text"), F.count_if("is_duplicate").alias("duplicates"))
    b = st.places(spark, d).agg(F.count(F.lit(1)).alias("places"), F.count("lat").alias("located"), F.count("rating").alias("rated"), F.count("address").alias("addressed"))
    return a.crossJoin(b)


@query("SELECT source AS value, min(doc_id) AS first FROM documents WHERE source IS NOT NULL GROUP BY 1 ORDER BY 2, 1 LIMIT 5")
def format_examples(spark, d):
    return Pr.examples(st.table(spark, d, "documents"), "source", "doc_id")


# Annotation: labels of a first and a second annotator and an approval, all derived from the id.
CLASSES = ["negative", "neutral", "positive"]
QUEUE = """queue AS (SELECT doc_id, source, [' Negative', 'neutral', 'positive', '', 'bogus'][(doc_id % 5)::INT + 1] AS a0, ['negative', '', 'positive', 'neutral'][(doc_id % 4)::INT + 1] AS b0, ['yes', 'no', 'TRUE ', '1', ''][(doc_id % 7 % 5)::INT + 1] AS ok0 FROM documents),
q AS (SELECT *, lower(trim(a0)) AS a, lower(trim(b0)) AS b, lower(trim(ok0)) IN ('yes', 'true', '1', 'approved') AS ok FROM queue),
v AS (SELECT *, a IN ('negative', 'neutral', 'positive') AS av, b IN ('negative', 'neutral', 'positive') AS bv FROM q)"""


def queue(spark, d):
    k = F.col("doc_id")
    pick = lambda xs, i: F.get(F.array(*[F.lit(x) for x in xs]), i.cast("int"))
    return st.table(spark, d, "documents").select(k, "source", pick([" Negative", "neutral", "positive", "", "bogus"], k % 5).alias("first"), pick(["negative", "", "positive", "neutral"], k % 4).alias("second"), pick(["yes", "no", "TRUE ", "1", ""], k % 7 % 5).alias("approval"))


@query("""WITH %s SELECT doc_id, a AS label, CASE WHEN NOT av AND NOT (a <> '' AND NOT av OR b <> '' AND NOT bv) THEN 'pending' WHEN a <> '' AND NOT av OR b <> '' AND NOT bv THEN 'invalid_label' WHEN av AND bv AND a <> b THEN 'adjudication_required' WHEN ok THEN 'completed' ELSE 'awaiting_human_approval' END AS status FROM v""" % QUEUE)
def annotation_status(spark, d):
    from gapline.operators.annotation import with_status

    return with_status(queue(spark, d), "first", "second", "approval", CLASSES).select("doc_id", F.col("first").alias("label"), "status")


@query(f"""WITH {QUEUE}, o AS (SELECT a, b FROM v WHERE av AND bv), n AS (SELECT count(*) AS n, count(*) FILTER (a = b) AS same FROM o),
  m AS (SELECT sum(x.c * y.c) AS xs FROM (SELECT a, count(*) AS c FROM o GROUP BY 1) x JOIN (SELECT b, count(*) AS c FROM o GROUP BY 1) y ON a = b)
  SELECT n, same, {r('(same / n::DOUBLE - xs / (n * n)::DOUBLE) / (1e0 - xs / (n * n)::DOUBLE)', 6)} AS kappa FROM n, m""")
def cohen_kappa(spark, d):
    clean = lambda c: F.lower(F.btrim(c))
    rows = queue(spark, d).select(clean("first").alias("a"), clean("second").alias("b")).where(F.col("a").isin(CLASSES) & F.col("b").isin(CLASSES))
    return M.kappa(rows, "a", "b").withColumn("kappa", S.half_up(F.col("kappa"), 6))


@query(f"""WITH s AS (SELECT ['yes', 'no', ''][(doc_id % 3)::INT + 1] AS e, ['valid', '', 'no', '1'][(doc_id % 4)::INT + 1] AS p FROM documents),
  t AS (SELECT e <> '' AS er, p <> '' AS pr, e IN ('yes', 'true', '1', 'valid') AS ev, p IN ('yes', 'true', '1', 'valid') AS pv FROM s)
  SELECT count(*) AS sample_rows, count(*) FILTER (er) AS evidence_reviewed, count(*) FILTER (pr) AS priority_reviewed, {r('count(*) FILTER (er AND ev) / count(*) FILTER (er)::DOUBLE', 4)} AS evidence_rate,
  {r('count(*) FILTER (pr AND pv) / count(*) FILTER (pr)::DOUBLE', 4)} AS priority_rate, CASE WHEN bool_and(er AND pr) THEN {r('count(*) FILTER (er AND pr AND ev AND pv) / count(*)::DOUBLE', 4)} END AS overall_rate, bool_and(er AND pr) AS fully_reviewed FROM t""")
def validation_rates(spark, d):
    from gapline.operators.annotation import validation

    k = F.col("doc_id")
    pick = lambda xs: F.get(F.array(*[F.lit(x) for x in xs]), (k % len(xs)).cast("int"))
    return validation(st.table(spark, d, "documents").select(pick(["yes", "no", ""]).alias("evidence"), pick(["valid", "", "no", "1"]).alias("priority")))


@query(f"""WITH {QUEUE} SELECT count(*) AS n, count(DISTINCT source) AS places, count(*) FILTER (NOT av) AS invalid_labels, count(*) FILTER (NOT ok) AS unapproved, count(*) - count(DISTINCT doc_id) AS duplicate_ids, count(*) FILTER (coalesce(trim(source), '') = '') AS missing_groups,
  count(*) FILTER (a = 'negative') AS negative, count(*) FILTER (a = 'neutral') AS neutral, count(*) FILTER (a = 'positive') AS positive,
  count(*) > 0 AND bool_and(av) AND bool_and(ok) AS valid, count(*) >= 300 AND count(*) FILTER (a = 'negative') >= 50 AND count(*) FILTER (a = 'neutral') >= 50 AND count(*) FILTER (a = 'positive') >= 50 AS ready FROM v""")
def gold_validation(spark, d):
    from gapline.operators.annotation import gold_report

    return gold_report(queue(spark, d), "doc_id", "first", "approval", "source", CLASSES)


@query("""WITH s AS (SELECT doc_id, lang, source, len(text) AS n, doc_id % 9 = 0 AS hard FROM documents WHERE len(text) > 0), c AS (SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY NOT hard, n, md5(doc_id || ':42')) > 4 AS over FROM s)
  SELECT doc_id, lang, CASE WHEN hard THEN 'prior_model_error' ELSE 'stratified_random' END AS reason FROM c QUALIFY row_number() OVER (PARTITION BY lang ORDER BY over, NOT hard, n, md5(doc_id || ':42')) <= 30""")
def balanced_queue(spark, d):
    rows = st.table(spark, d, "documents").where(F.length("text") > 0).select("doc_id", "lang", "source", F.length("text").alias("n"), (F.col("doc_id") % 9 == 0).alias("hard"))
    order = [F.asc(~F.col("hard")), F.asc("n"), F.asc(Sa.shuffled(F.col("doc_id"), 42))]
    return Sa.capped_quota(rows, "lang", "source", order, 4, 30).select("doc_id", "lang", F.when(F.col("hard"), "prior_model_error").otherwise("stratified_random").alias("reason"))


@query("""WITH c AS (SELECT lang AS stratum, count(*) AS n FROM documents GROUP BY 1), w AS (SELECT stratum, n, greatest(1, round_even(n / (SELECT count(*) FROM documents)::DOUBLE * 90, 0))::BIGINT AS want FROM c),
  s AS (SELECT *, sum(want) OVER () AS total, row_number() OVER (ORDER BY want DESC, stratum) AS big, row_number() OVER (ORDER BY n - want DESC, stratum) AS room FROM w)
  SELECT stratum, n, want - CASE WHEN total > 90 AND big <= total - 90 THEN 1 ELSE 0 END + CASE WHEN total < 90 AND room <= 90 - total THEN 1 ELSE 0 END AS target FROM s""")
def stratified_allocation(spark, d):
    sizes = {row[0]: row[1] for row in st.table(spark, d, "documents").groupBy("lang").count().orderBy("lang").collect()}  # a row per stratum
    want = Sa.allocate(sizes, 90)
    return spark.createDataFrame([(k, n, want[k]) for k, n in sizes.items()], "stratum string, n long, target long")


GOLD = "gold AS (SELECT doc_id, 1 - quality AS y, (doc_id * 7919 % 1000) / 1000e0 AS p FROM labels)"


def gold(spark, d):
    return st.table(spark, d, "labels").select("doc_id", (1 - F.col("quality")).alias("y"), ((F.col("doc_id") * 7919 % 1000) / 1000.0).alias("p"))


def f1(tp, fp, fn, beta=1):
    b = beta * beta
    return f"CASE WHEN {1 + b} * {tp} + {b} * {fn} + {fp} = 0 THEN 0e0 ELSE ({1 + b} * {tp})::DOUBLE / ({1 + b} * {tp} + {b} * {fn} + {fp}) END"


def div(a, b):
    return f"CASE WHEN {b} = 0 THEN 0e0 ELSE ({a})::DOUBLE / ({b}) END"


RATES = ", ".join(f"{r(e, 6)} AS {n}" for n, e in {
    "precision": div("tp", "(tp + fp)"), "recall": div("tp", "(tp + fn)"), "f1": f1("tp", "fp", "fn"), "f_beta": f1("tp", "fp", "fn", 2), "macro_f1": f"({f1('tp', 'fp', 'fn')} + {f1('tn', 'fn', 'fp')}) / 2e0",
    "weighted_f1": f"({f1('tp', 'fp', 'fn')} * (tp + fn) + {f1('tn', 'fn', 'fp')} * (tn + fp)) / (tp + fp + fn + tn)::DOUBLE", "balanced_accuracy": f"({div('tp', '(tp + fn)')} + {div('tn', '(tn + fp)')}) / 2e0"}.items())
RATE_NAMES = ["precision", "recall", "f1", "f_beta", "macro_f1", "weighted_f1", "balanced_accuracy"]


def rounded(df, names=RATE_NAMES):
    return df.withColumns({c: S.half_up(F.col(c), 6) for c in names})


@query(f"""WITH {GOLD}, t AS (SELECT (50 + 5 * i) / 1000e0 AS threshold FROM range(181) x(i)), c AS (SELECT threshold, count(*) FILTER (y = 1 AND p >= threshold) AS tp, count(*) FILTER (y = 0 AND p >= threshold) AS fp, count(*) FILTER (y = 1 AND p < threshold) AS fn, count(*) FILTER (y = 0 AND p < threshold) AS tn FROM gold CROSS JOIN t GROUP BY 1)
  SELECT threshold, tp, fp, fn, tn, {RATES} FROM c""")
def threshold_sweep(spark, d):
    return rounded(M.threshold_sweep(gold(spark, d), "y", "p"))


CONF = "c AS (SELECT count(*) FILTER (y = 1 AND p >= 505e-3) AS tp, count(*) FILTER (y = 0 AND p >= 505e-3) AS fp, count(*) FILTER (y = 1 AND p < 505e-3) AS fn, count(*) FILTER (y = 0 AND p < 505e-3) AS tn, avg((p - y) * (p - y)) AS brier FROM gold)"


@query(f"""WITH {GOLD}, {CONF}, s AS (SELECT p, count(*) FILTER (y = 1) AS pos, count(*) AS n FROM gold GROUP BY 1), w AS (SELECT pos, sum(pos) OVER o AS tp, sum(n) OVER o AS seen, sum(pos) OVER () AS total FROM s WINDOW o AS (ORDER BY p DESC)),
  a AS (SELECT sum(pos / total::DOUBLE * (tp / seen::DOUBLE)) AS ap FROM w) SELECT tp, fp, fn, tn, {RATES}, {r('brier', 6)} AS brier, {r('ap', 6)} AS average_precision FROM c, a""")
def binary_metrics(spark, d):
    g = gold(spark, d)
    predicted = (F.col("p") >= 0.505).cast("int")
    c = g.agg(*M.confusion(F.col("y"), predicted), F.avg((F.col("p") - F.col("y")) * (F.col("p") - F.col("y"))).alias("brier"))
    return rounded(M.rates(c).crossJoin(M.average_precision(g, "y", "p")), [*RATE_NAMES, "brier", "average_precision"])


@query(f"""WITH e AS (SELECT lang AS y, CASE WHEN doc_id % 4 = 0 THEN 'en' WHEN doc_id % 9 = 0 THEN 'xx' ELSE lang END AS p FROM documents), l AS (SELECT y AS label FROM e UNION SELECT p FROM e),
  c AS (SELECT label, count(*) FILTER (y = label) AS support, count(*) FILTER (y = label AND p = label) AS tp, count(*) FILTER (p = label) AS pred FROM l CROSS JOIN e GROUP BY 1)
  SELECT label, support, {r(div('tp', 'pred'), 6)} AS precision, {r(div('tp', 'support'), 6)} AS recall, {r(f1('tp', '(pred - tp)', '(support - tp)'), 6)} AS f1 FROM c""")
def multiclass_metrics(spark, d):
    guess = F.when(F.col("doc_id") % 4 == 0, "en").when(F.col("doc_id") % 9 == 0, "xx").otherwise(F.col("lang"))
    return rounded(M.multiclass(st.table(spark, d, "documents").select(F.col("lang").alias("y"), guess.alias("p")), "y", "p"), ["precision", "recall", "f1"])


MULTI = """multi AS (SELECT doc_id, k, (doc_id * (k + 3) % 7 < 2)::INT AS y, (doc_id * (k + 11) * 31 % 100) / 100e0 AS p FROM labels CROSS JOIN range(4) t(k)), mm AS (SELECT *, (p >= 45e-2)::INT AS q FROM multi)"""


@query(f"""WITH {MULTI}, a AS (SELECT k, count(*) FILTER (y = 1 AND q = 1) AS tp, count(*) FILTER (y = 0 AND q = 1) AS fp, count(*) FILTER (y = 1 AND q = 0) AS fn FROM mm GROUP BY 1),
  d AS (SELECT doc_id, sum(y) = 0 AS tn, sum(q) = 0 AS pn, bool_and(y = q) AS exact, count(*) FILTER (y <> q) AS wrong FROM mm GROUP BY 1),
  s AS (SELECT k, p, count(*) FILTER (y = 1) AS pos, count(*) AS n FROM mm GROUP BY ALL), w AS (SELECT k, pos, sum(pos) OVER o AS tp, sum(n) OVER o AS seen, sum(pos) OVER (PARTITION BY k) AS total FROM s WINDOW o AS (PARTITION BY k ORDER BY p DESC)),
  ap AS (SELECT k, sum(pos / total::DOUBLE * (tp / seen::DOUBLE)) AS ap FROM w GROUP BY 1), n AS (SELECT count(*) FILTER (tn AND pn) AS tp, count(*) FILTER (NOT tn AND pn) AS fp, count(*) FILTER (tn AND NOT pn) AS fn, avg(exact::INT) AS exact, sum(wrong) / (count(*) * 4)::DOUBLE AS hamming FROM d)
  SELECT {r('(SELECT 2 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn))::DOUBLE FROM a)', 6)} AS micro_f1, {r('(SELECT avg(' + f1('tp', 'fp', 'fn') + ') FROM a)', 6)} AS macro_f1, {r('hamming', 6)} AS hamming_loss, {r('exact', 6)} AS subset_accuracy,
  {r('(SELECT avg(ap) FROM ap)', 6)} AS macro_average_precision, {r(div('tp', '(tp + fp)'), 6)} AS none_precision, {r(div('tp', '(tp + fn)'), 6)} AS none_recall, {r(f1('tp', 'fp', 'fn'), 6)} AS none_f1 FROM n""")
def multilabel_metrics(spark, d):
    k = F.col("k")
    rows = st.table(spark, d, "labels").select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("k")).withColumn("y", (F.col("doc_id") * (k + 3) % 7 < 2).cast("int")).withColumn("p", (F.col("doc_id") * (k + 11) * 31 % 100) / 100.0).withColumn("q", (F.col("p") >= 0.45).cast("int"))
    per = rows.groupBy("k").agg(*M.confusion(F.col("y"), F.col("q")))
    totals = per.agg(S.f_score(F.sum("tp"), F.sum("fp"), F.sum("fn")).alias("micro_f1"), F.avg(S.f_score(F.col("tp"), F.col("fp"), F.col("fn"))).alias("macro_f1"))
    docs = rows.groupBy("doc_id").agg((F.sum("y") == 0).cast("int").alias("tn"), (F.sum("q") == 0).cast("int").alias("pn"), F.bool_and(F.col("y") == F.col("q")).cast("int").alias("exact"), F.count_if(F.col("y") != F.col("q")).alias("wrong"))
    none = docs.agg(*M.confusion(F.col("tn"), F.col("pn")), F.avg("exact").alias("subset_accuracy"), (F.sum("wrong") / (F.count(F.lit(1)) * 4).cast("double")).alias("hamming_loss"))
    none = M.rates(none).select("hamming_loss", "subset_accuracy", F.col("precision").alias("none_precision"), F.col("recall").alias("none_recall"), F.col("f1").alias("none_f1"))
    ap = M.average_precision(rows, "y", "p", ["k"]).agg(F.avg("average_precision").alias("macro_average_precision"))
    out = totals.crossJoin(none).crossJoin(ap)
    return rounded(out, out.columns)


@query(f"""WITH {GOLD}, j AS (SELECT y, p, lang, CASE WHEN len(text) <= 250 THEN 'short' ELSE 'long' END AS size FROM gold JOIN documents USING (doc_id)),
  s AS (SELECT 'lang' AS slice, lang AS value, y, p FROM j UNION ALL SELECT 'size', size, y, p FROM j),
  c AS (SELECT slice, value, count(*) AS n, count(*) FILTER (y = 1 AND p >= 505e-3) AS tp, count(*) FILTER (y = 0 AND p >= 505e-3) AS fp, count(*) FILTER (y = 1 AND p < 505e-3) AS fn, count(*) FILTER (y = 0 AND p < 505e-3) AS tn FROM s GROUP BY ALL HAVING count(*) >= 10 AND count(DISTINCT y) = 2)
  SELECT slice, value, n, tp, fp, fn, tn, {RATES} FROM c""")
def slice_metrics(spark, d):
    docs = st.table(spark, d, "documents").select("doc_id", "lang", F.when(F.length("text") <= 250, "short").otherwise("long").alias("size"))
    j = gold(spark, d).join(docs, "doc_id")
    parts = F.explode(F.array(*[F.struct(F.lit(c).alias("slice"), F.col(c).alias("value")) for c in ("lang", "size")]))
    g = j.select("y", "p", parts.alias("s")).select("y", "p", "s.*").groupBy("slice", "value")
    c = g.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("y").alias("classes"), *M.confusion(F.col("y"), (F.col("p") >= 0.505).cast("int")))
    return rounded(M.rates(c.where("n >= 10 and classes = 2").drop("classes")))


@query(f"WITH {GOLD}, b AS (SELECT y, p, ntile(10) OVER (ORDER BY p, doc_id) AS bin FROM gold) SELECT bin::INT AS bin, count(*) AS n, {r('avg(p)', 6)} AS predicted, {r('avg(y)', 6)} AS observed FROM b GROUP BY 1")
def calibration_bins(spark, d):
    bins = M.quantile_bins(gold(spark, d), "p", ["doc_id"])
    return bins.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), S.half_up(F.avg("p"), 6).alias("predicted"), S.half_up(F.avg("y"), 6).alias("observed"))


@query(f"""WITH m AS (SELECT p_brand AS model, avg(p_retailprice) AS f1, avg(p_size) AS recall, stddev_pop(p_retailprice) AS spread, count(*)::DOUBLE AS speed, max(p_size)::DOUBLE AS size FROM part GROUP BY 1),
  z AS (SELECT model, (f1 - min(f1) OVER ()) / (max(f1) OVER () - min(f1) OVER ()) AS a, (recall - min(recall) OVER ()) / (max(recall) OVER () - min(recall) OVER ()) AS b, (max(spread) OVER () - spread) / (max(spread) OVER () - min(spread) OVER ()) AS c,
    (speed - min(speed) OVER ()) / (max(speed) OVER () - min(speed) OVER ()) AS e, CASE WHEN max(size) OVER () = min(size) OVER () THEN 1e0 ELSE (max(size) OVER () - size) / (max(size) OVER () - min(size) OVER ()) END AS g FROM m)
  SELECT model, {r('45e-2 * a + 2e-1 * b + 15e-2 * c + 1e-1 * e + 1e-1 * g', 5)} AS champion_score FROM z""")
def champion_score(spark, d):
    m = st.table(spark, d, "part").groupBy(F.col("p_brand").alias("model")).agg(F.avg("p_retailprice").alias("f1"), F.avg("p_size").alias("recall"), F.stddev_pop("p_retailprice").alias("spread"), F.count(F.lit(1)).cast("double").alias("speed"), F.max("p_size").cast("double").alias("size"))
    total = 0.45 * M.scaled("f1") + 0.20 * M.scaled("recall") + 0.15 * M.scaled("spread", False) + 0.10 * M.scaled("speed") + 0.10 * M.scaled("size", False)
    return m.select("model", S.half_up(total, 5).alias("champion_score"))


@query(f"WITH {GOLD}, g AS (SELECT 'rows' AS gate, count(*) >= 300 AS passed FROM gold UNION ALL SELECT 'classes', count(DISTINCT y) = 2 FROM gold UNION ALL SELECT 'brier', avg((p - y) * (p - y)) <= 5e-1 FROM gold UNION ALL SELECT 'unique', count(*) = count(DISTINCT doc_id) FROM gold UNION ALL SELECT 'located', avg((lat IS NOT NULL)::INT) >= 8e-1 FROM (WITH {st.PLACES} SELECT lat FROM place)) SELECT gate, passed, bool_and(passed) OVER () AS ready FROM g")
def readiness_gate(spark, d):
    from pyspark.sql import Window

    g = gold(spark, d)
    checks = {"rows": F.count(F.lit(1)) >= 300, "classes": F.countDistinct("y") == 2, "brier": F.avg((F.col("p") - F.col("y")) * (F.col("p") - F.col("y"))) <= 0.5, "unique": F.count(F.lit(1)) == F.countDistinct("doc_id")}
    row = g.agg(*[c.alias(n) for n, c in checks.items()]).crossJoin(st.places(spark, d).agg((F.avg(F.col("lat").isNotNull().cast("int")) >= 0.8).alias("located")))
    each = row.select(F.explode(F.array(*[F.struct(F.lit(n).alias("gate"), F.col(n).alias("passed")) for n in row.columns])).alias("g")).select("g.*")
    return each.withColumn("ready", F.bool_and("passed").over(Window.partitionBy()))


@query(f"""WITH {GOLD}, e AS (SELECT gold.doc_id, CASE WHEN y = 1 THEN 'negative' ELSE 'positive' END AS actual, CASE WHEN p >= 5e-1 THEN 'negative' ELSE 'positive' END AS predicted, text, doc_id % 5 + 1 AS rating FROM gold JOIN documents USING (doc_id))
  SELECT doc_id, actual || '_as_' || predicted AS error_type, coalesce(nullif(concat_ws('|', CASE WHEN len(text) <= 30 THEN 'VERY_SHORT_TEXT' END, CASE WHEN {has_word('text', X.POSITIVE_HINTS)} AND {has_word('text', X.NEGATIVE_HINTS)} THEN 'MIXED_POSITIVE_NEGATIVE' END,
  CASE WHEN {has_word('text', X.ENGLISH_WORDS)} AND {has_word('text', X.INDONESIAN_WORDS)} THEN 'MIXED_ID_EN' END, CASE WHEN {has_word('text', X.LOCAL_HINTS)} THEN 'LOCAL_NAME_OR_TERM' END,
  CASE WHEN {has_word('text', X.INFORMAL)} THEN 'TYPO_OR_INFORMAL_ABBREVIATION' END, CASE WHEN doc_id % 8 < 5 THEN 'LOW_PLACE_REVIEW_COUNT' END), ''), 'GENERAL_MODEL_ERROR') AS tags FROM e WHERE actual <> predicted ORDER BY doc_id LIMIT 500""")
def error_analysis(spark, d):
    docs = st.table(spark, d, "documents").select("doc_id", "text")
    e = gold(spark, d).join(docs, "doc_id").withColumn("actual", F.when(F.col("y") == 1, "negative").otherwise("positive")).withColumn("predicted", F.when(F.col("p") >= 0.5, "negative").otherwise("positive")).where("actual <> predicted")
    tags = X.error_tags(F.col("text"), F.lit(None).cast("double"), F.col("actual"), F.col("doc_id") % 8)
    return e.select("doc_id", F.concat("actual", F.lit("_as_"), "predicted").alias("error_type"), F.array_join(tags, "|").alias("tags")).orderBy("doc_id").limit(500)


@query(f"""WITH RECURSIVE {st.SCORES}, rv AS (SELECT CASE WHEN doc_id % 3 = 0 THEN 'positive' WHEN doc_id % 5 + 1 <= 2 THEN 'negative' WHEN doc_id % 5 + 1 = 3 THEN 'neutral' ELSE 'positive' END AS label FROM documents WHERE source = 'src7'),
  t AS (SELECT aspect, score FROM score WHERE place_id = 7 ORDER BY rank LIMIT 6)
  SELECT 'place' AS kind, place_name AS key, rating AS value FROM place WHERE place_id = 7 UNION ALL SELECT 'sentiment', label, count(*)::DOUBLE FROM rv GROUP BY label UNION ALL SELECT 'gap', aspect, score FROM t""")
def place_detail(spark, d):
    p = st.places(spark, d).where("place_id = 7").select(F.lit("place").alias("kind"), F.col("place_name").alias("key"), F.col("rating").alias("value"))
    t = st.texts(spark, d).where("place = 'src7'")
    label = F.coalesce(F.when(F.col("review_id") % 3 == 0, "positive"), P.weak_label(F.col("rating")))
    s = R.histogram(t, label, "key").select(F.lit("sentiment").alias("kind"), "key", F.col("n").cast("double").alias("value"))
    g = st.scores(spark, d).where("place_id = 7").orderBy("rank").limit(6).select(F.lit("gap").alias("kind"), F.col("aspect").alias("key"), F.col("score").alias("value"))
    return reduce(lambda a, b: a.unionByName(b), [p, s, g])


@query("SELECT doc_id, CASE WHEN l.quality IS NOT NULL THEN 1 - l.quality ELSE (doc_id % 5 + 1 <= 2)::INT END AS target, CASE WHEN l.quality IS NOT NULL THEN 'human_gold' ELSE 'weak_rating' END AS source FROM documents LEFT JOIN labels l USING (doc_id) WHERE l.quality IS NOT NULL OR doc_id % 5 + 1 <> 3")
def complaint_target(spark, d):
    gold_rows = st.table(spark, d, "labels").select("doc_id", "quality")
    t = st.table(spark, d, "documents").select("doc_id").join(gold_rows, "doc_id", "left")
    weak = P.weak_label(F.col("doc_id") % 5 + 1)
    rows = t.where(F.col("quality").isNotNull() | (weak != "neutral"))
    return rows.select("doc_id", F.coalesce(1 - F.col("quality"), (weak == "negative").cast("int")).alias("target"), F.when(F.col("quality").isNotNull(), "human_gold").otherwise("weak_rating").alias("source"))


SAFE = rf"safe AS (SELECT doc_id, lang, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM documents WHERE len(trim(regexp_replace(text, '\s+', ' ', 'g'))) BETWEEN 20 AND 400 AND NOT regexp_matches(text, '{X.EMAIL}') AND NOT regexp_matches(text, '{X.URL}'))"


@query(rf"WITH {SAFE}, u AS (SELECT * FROM safe QUALIFY row_number() OVER (PARTITION BY t ORDER BY doc_id) = 1) SELECT doc_id, lang, md5(t) AS text FROM u QUALIFY row_number() OVER (PARTITION BY lang ORDER BY doc_id) <= 3")
def demo_examples(spark, d):
    """The first shareable texts of each label, each text once."""
    rows = st.table(spark, d, "documents").select("doc_id", "lang", X.redact(F.col("text")).alias("t"), X.shareable(F.col("text"), 400).alias("ok")).where("ok")
    unique = R.first_by(rows, ["t"], [F.col("doc_id")])
    return R.first_by(unique, ["lang"], [F.col("doc_id")], 3).select("doc_id", "lang", F.md5("t").alias("text"))


WHY = {"HIGH_NEGATIVE_RATE": "Banyak keluhan", "FREQUENT_COMPLAINT": "Sering disebut", "LOW_NEARBY_SERVICE_DENSITY": "Layanan jarang", "HIGH_REVIEW_CONFIDENCE": "Ulasan cukup", "LOW_DATA_RELIABILITY": "Data kurang"}


@query(f"""WITH RECURSIVE {st.SCORES} SELECT rank, place_name, aspect, {r('score', 2)} AS score, CASE string_split(reasons, '|')[1] {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in WHY.items())} ELSE 'Sinyal dasar' END AS reason FROM score ORDER BY rank LIMIT 10""")
def demo_top10(spark, d):
    names = F.create_map(*[F.lit(x) for kv in WHY.items() for x in kv])
    first = F.get(F.split("reasons", r"\|"), F.lit(0))
    top = st.scores(spark, d).orderBy("rank").limit(10)
    return top.select("rank", "place_name", "aspect", S.half_up(F.col("score"), 2).alias("score"), F.coalesce(F.element_at(names, first), F.lit("Sinyal dasar")).alias("reason"))
