import datetime

import pytest
from pyspark.sql import functions as F

from gapline.functions import geo
from gapline.functions import parse as P
from gapline.functions import score as S
from gapline.functions import text as X


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(f(F.col("v")).alias("r")).first()[0]


@pytest.mark.parametrize(("raw", "want"), [("4,5", 4.5), ("4.2", 4.2), ("2025", None), ("-4", 4.0), ("n/a", None), (None, None), ("", None), ("rating 5/5", 5.0)])
def test_rating(spark, raw, want):
    assert one(spark, raw, P.rating) == want


@pytest.mark.parametrize(("raw", "lo", "hi", "free", "inferred"), [("5.000 - 10.000", 5000.0, 10000.0, False, False), ("Gratis", 0.0, 0.0, True, False), ("1,000", 1.0, 1.0, False, True), ("10,000,000", None, None, False, False), ("1.234,50", 1234.5, 1234.5, False, True), (None, None, None, False, False)])
def test_price(spark, raw, lo, hi, free, inferred):
    r = one(spark, raw, P.price)
    assert (r.min_price, r.max_price, r.is_free, r.is_inferred) == (lo, hi, free, inferred)
    assert r.is_missing == (raw is None)


def test_coordinate(spark):
    r = one(spark, "2.61, 99.12", P.coordinate)
    assert (r.latitude, r.longitude, r.parsing_success, r.error) == (2.61, 99.12, True, None)
    assert one(spark, "200, 99", P.coordinate).error == "coordinate_out_of_range"
    assert one(spark, "x", P.coordinate).error == "could_not_find_two_numbers"
    assert one(spark, None, P.coordinate).error == "missing"


@pytest.mark.parametrize(("raw", "day", "source"), [("3 days ago", 7, "published_at_relative_to_collect_date"), ("yesterday", 9, "published_at_relative_to_collect_date"), ("2024-01-02", 2, "published_at_absolute"), (None, 10, "collect_date_fallback"), ("someday", None, "unparsed")])
def test_review_date(spark, raw, day, source):
    df = spark.createDataFrame([(raw, datetime.datetime(2024, 1, 10, 12))], "p string, c timestamp")
    r = df.select(P.review_date(F.col("p"), F.col("c")).alias("r")).first()[0]
    assert (r.review_date and r.review_date.day, r.source) == (day, source)


def test_clean_text(spark):
    assert one(spark, " ｆｕｌｌ\x07 width\t x ", X.clean_text) == "full width x"
    assert one(spark, " n/a ", X.clean_text) is None
    assert one(spark, "tidak  bersih", X.clean_text) == "tidak bersih"


def test_place_name(spark):
    assert one(spark, "Pantai Bul-Bul!", X.place_name) == "pantai bul bul"
    assert one(spark, "Lumban  Bul Bul", X.place_name) == "lumban bulbul"
    assert one(spark, "!!", X.place_name) is None


def test_clauses(spark):
    assert one(spark, "Toilet kotor tetapi kamar bagus. Parkir sempit | ok", X.clauses) == ["Toilet kotor", "kamar bagus", "Parkir sempit", "ok"]
    assert one(spark, None, X.clauses) == []
    assert one(spark, " .. , ", X.clauses) == []


def test_names():
    assert X.column_names(["Place Name", "review-text", "RATING BPODT", None, "place_name"]) == ["place_name", "review_text", "rating_bpodt", "unnamed", "place_name_2"]


def test_redaction(spark):
    assert one(spark, "hub 0812-3456-7890, a@b.co", X.redact) == f"hub {X.PHONE_HIDDEN}, {X.EMAIL_HIDDEN}"
    assert one(spark, "lihat https://x.id ya semua orang", X.shareable) is False


def test_labels(spark):
    df = spark.createDataFrame([("Parkir;toilet, PARKIR",), ("none|toilet",), ("zzz",), (None,)], "v string")
    labels, error = X.label_list(F.col("v"), ["toilet", "parkir"])
    assert [tuple(r) for r in df.select(labels, error).collect()] == [(["toilet", "parkir"], None), ([], "none must be the only label"), ([], "invalid labels: zzz"), ([], None)]


def test_scores(spark):
    r = spark.range(1).select(S.smoothed_rate(F.lit(0), F.lit(0)), S.volume_confidence(F.lit(30)), S.rating_gap(F.lit(None).cast("double")), S.rating_gap(F.lit(1.0)), S.priority(F.lit(70.0)), S.recency(F.lit(None).cast("date"), F.current_date())).first()
    assert tuple(r) == (0.2, 1.0, 0.5, 1.0, "tinggi", 0.5)


def test_haversine(spark):
    d = spark.range(1).select(geo.haversine_km(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0))).first()[0]
    assert abs(d - 111.195) < 0.01
    rows = spark.createDataFrame([(2.0, 99.0), (91.0, 99.0), (None, 99.0)], "lat double, lon double")
    assert [r[0] for r in rows.select(geo.valid(F.col("lat"), F.col("lon"))).collect()] == [True, False, False]
