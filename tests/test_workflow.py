"""From raw sheets to ranked gaps, and the read side over the result."""

import datetime

import pytest
from pyspark.sql import functions as F

from gapline import workflow
from gapline.operators import cleaning
from gapline.store import Store

TAXONOMY = {"kebersihan": (["bersih"], ["kotor"], []), "parkir": (["parkir"], ["parkir sempit"], []), "lainnya": ([], [], [])}
DAY = datetime.date(2024, 6, 1)


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    meta = [(2, "Pantai Indah", "2.61, 99.05", "4,5", "Jl. A", "5.000 - 10.000", "open"), (3, "Bukit Toba", "2.62, 99.06", "4.0", None, "Gratis", None), (4, " - ", None, None, None, None, None)]
    meta = spark.createDataFrame(meta, "row_no long, `Place Name` string, `Lat Long` string, `Place-Rating` string, Address string, `Entry Fee` string, Status string")
    rows = [(2, "pantai indah!", "1", "Kotor tetapi parkir luas.", "2024-05-01"), (3, "Pantai Indah", "1", "Kotor tetapi parkir luas.", "2024-05-01"), (4, "Pantai Indah", "5", "Bersih sekali", "3 days ago"), (5, "Bukit Toba", "n/a", None, None), (6, "Pulau Baru", "2", "parkir sempit dan kotor", "2024-05-02")]
    rv = spark.createDataFrame([(*r, datetime.datetime(2024, 5, 20)) for r in rows], "row_no long, place_name string, reviewer_rating string, review_text string, published_at string, collect_date timestamp")
    c = workflow.Context(spark, str(tmp_path_factory.mktemp("tables")), {"wisata-metadata": meta, "wisata-v2": rv}, TAXONOMY, ["kotor"], DAY, cluster_least=2)
    took = workflow.run(c)
    assert list(took) == list(workflow.STAGES)
    assert all(a["exists"] for a in workflow.artifacts(c))
    return c


def test_cleaning(made):
    places = {r.place_name: r for r in made.get("places").collect()}
    assert set(places) == {"Pantai Indah", "Bukit Toba", "Pulau Baru"}
    a = places["Pantai Indah"]
    assert (a.rating, a.lat, a.min_price, a.category) == (4.5, 2.61, 5000.0, "wisata")
    reviews = {r.review_id: r for r in made.get("reviews").collect()}
    assert len(reviews) == 5
    assert [reviews[f"wisata-v2_{i:06d}"].is_duplicate for i in range(2, 7)] == [False, True, False, False, False]
    assert reviews["wisata-v2_000004"].day == datetime.date(2024, 5, 17)
    assert reviews["wisata-v2_000005"].text_length == 0
    audit = cleaning.resolution_audit(made.get("entity_mapping")).first()
    assert (audit.canonical_places, audit.mapping_rows) == (3, 5)


def test_ranking(made):
    gaps = made.get("service_gaps").orderBy("rank").collect()
    assert [g.rank for g in gaps] == list(range(1, len(gaps) + 1))
    assert {(g.place_name, g.aspect): g.negatives for g in gaps}["Pantai Indah", "kebersihan"] == 1
    assert [g.score for g in gaps] == sorted((g.score for g in gaps), reverse=True)


def test_missing_table_stops_a_stage(made, tmp_path):
    c = workflow.Context(made.spark, str(tmp_path), made.sheets, TAXONOMY, [], DAY)
    with pytest.raises(FileNotFoundError):
        workflow.run(c, "scores")
    with pytest.raises(ValueError):
        workflow.resolve("nothing")


def test_aliases(spark):
    df = spark.createDataFrame([("a", "b", "c")], "`Nama Tempat` string, ulasan string, extra string")
    out, unknown = cleaning.rename_aliases(df, {"nama_tempat": "place_name", "ulasan": "review_text"}, ["place_name"], ["place_name", "review_text"])
    assert (out.columns, unknown) == (["place_name", "review_text"], ["extra"])
    with pytest.raises(ValueError, match="twice"):
        cleaning.rename_aliases(spark.createDataFrame([("a", "b")], "ulasan string, `Review Text` string"), {"ulasan": "review_text"}, [], [])
    with pytest.raises(ValueError, match="missing"):
        cleaning.rename_aliases(df, {}, ["place_name"], [])
    assert cleaning.with_columns(df, ["extra", "note"]).first().asDict() == {"extra": "c", "note": ""}
    assert cleaning.roles(["Place", "x", "Review Text"])["review"] == ["Review Text"]


def test_store(made):
    spark = made.spark
    place = made.get("places").where("place_name = 'Pulau Baru'").first().place_id
    new = spark.createDataFrame([("imp-1", "n1", place, "Pulau Baru", "wisata", 1.0, "kotor sekali", datetime.date(2024, 5, 30), "negative", False)], "import_id string, review_id string, place_id string, place_name string, category string, rating double, text string, day date, label string, is_duplicate boolean")
    clause = spark.createDataFrame([("imp-1", "n1", place, 0, "kebersihan", "kotor sekali", True, 0.9, 0.95)], "import_id string, review_id string, place_id string, clause_index int, aspect string, clause_text string, is_negative boolean, complaint_probability double, prediction_confidence double")
    aspects = spark.createDataFrame([("kebersihan",), ("parkir",)], "aspect string")
    store = Store(made.get("places"), made.get("reviews"), made.get("evidence"), aspects, made.get("clusters"), DAY, new, clause)
    before = store.place_evidence(place)[1].first()
    store.publish("imp-1")
    store.publish("imp-1")
    page, totals, counts = store.place_evidence(place, search="SEKALI")
    assert (totals.first().total, totals.first().total_all) == (1, before.total_all + 1)
    assert page.first().clause_text == "kotor sekali"
    assert {r.aspect: r.n for r in counts.collect()}["kebersihan"] == 2
    rows, total = store.list_places(search="PULAU")
    assert (rows.first().reviews, total.first().total) == (2, 1)
    gaps, total = store.list_service_gaps(aspect="Kebersihan", limit=1, offset=1)
    assert (gaps.count(), total.first().total) == (1, 2)
    assert store.list_places(aspect="parkir")[1].first().total == 2
    assert {r.properties.kind for r in store.features().collect()} == {"place", "cluster"}
    detail = store.place_detail(place)
    assert detail["place"].count() == 1
    assert detail["gaps"].agg(F.max("negatives")).first()[0] == 2
    store.unpublish("imp-1")
    assert store.place_evidence(place)[1].first().total_all == before.total_all
