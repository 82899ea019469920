import datetime
import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gapline.operators import annotation, entities, gap, graph, imports, learning, metrics, sampling, spatial
from gapline.operators import evidence as ev
from gapline.operators import relational as R


def test_duplicates_see_null_as_equal(spark):
    df = spark.createDataFrame([(1, "a", None), (2, "a", None), (3, "b", 1.0)], "id int, t string, x double")
    assert {r.id: r.is_duplicate for r in R.flag_duplicates(df, ["t", "x"], [F.col("id")]).collect()} == {1: False, 2: True, 3: False}


def test_overlay_keeps_the_earliest(spark):
    a = spark.createDataFrame([(1, "base")], "id int, v string")
    b = spark.createDataFrame([(1, "new", 5), (2, "new", 6)], "id int, v string, w int")
    assert {tuple(r) for r in R.overlay_union([a, b], ["id"]).collect()} == {(1, "base", None), (2, "new", 6)}


def test_one_to_one_stops_on_repeats(spark):
    a, b = spark.createDataFrame([(1,), (1,)], "id int"), spark.createDataFrame([(1, 2)], "id int, x int")
    with pytest.raises(Exception, match="not unique"):
        R.one_to_one(a, b, "id").collect()


def test_publish_and_withdraw(spark):
    base = spark.createDataFrame([("r1", "base")], "id string, v string")
    runs = spark.createDataFrame([("imp-1", "r1", "again"), ("imp-1", "r2", "new"), ("imp-2", "r3", "new")], "import_id string, id string, v string")
    m = imports.Manifest().publish("imp-1").publish("imp-1")
    assert {r.id for r in m.view(base, runs, ["id"]).collect()} == {"r1", "r2"}
    assert {r.id for r in m.unpublish("imp-1").view(base, runs, ["id"]).collect()} == {"r1"}
    assert m.unpublish("nothing") == m


def brute_dbscan(points, km, least):
    def dist(p, q):
        (a, b), (c, d) = (map(math.radians, x) for x in (p, q))
        h = math.sin((c - a) / 2) ** 2 + math.cos(a) * math.cos(c) * math.sin((d - b) / 2) ** 2
        return 2 * 6371.0088 * math.asin(min(1, math.sqrt(h)))

    near = {i: [j for j, q in enumerate(points) if dist(p, q) <= km] for i, p in enumerate(points)}
    label, n = {}, 0
    for i in range(len(points)):
        if i in label or len(near[i]) < least:
            continue
        stack, label[i] = [i], n
        while stack:
            for j in near[stack.pop()]:
                if j not in label:
                    label[j] = n
                    if len(near[j]) >= least:
                        stack.append(j)
        n += 1
    return [label.get(i, -1) for i in range(len(points))]


def test_dbscan(spark):
    random.seed(4)
    points = [(2 + random.random() * 0.5, 99 + random.random() * 0.5) for _ in range(120)]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(points)], "id long, lat double, lon double")
    got = {r.id: r.cluster for r in spatial.dbscan(df, 4.0, 4).collect()}
    assert [got[i] for i in range(len(points))] == brute_dbscan(points, 4.0, 4)


def test_dbscan_fixture(spark):
    df = spark.createDataFrame([(0, 2.0, 99.0), (1, 2.001, 99.001), (2, 2.002, 99.002), (3, 3.0, 98.0)], "id long, lat double, lon double")
    assert [r.cluster for r in spatial.dbscan(df, 1.0, 2).orderBy("id").collect()] == [0, 0, 0, -1]


@pytest.mark.parametrize("where", ["repeated", "meridian", "north"])
def test_dbscan_in_odd_places(spark, where):
    """Many points on one spot and around it, clusters over the 180th meridian, and far from the equator."""
    rng = random.Random(6)
    spots = {"repeated": lambda: (2.0, 99.0) if rng.random() < 0.4 else (2 + rng.random() * 0.2, 99 + rng.random() * 0.2), "meridian": lambda: (rng.random() * 0.3, (179.85 + rng.random() * 0.3 + 180) % 360 - 180), "north": lambda: (68 + rng.random() * 0.3, 20 + rng.random() * 0.8)}
    points = [spots[where]() for _ in range(110)]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(points)], "id long, lat double, lon double")
    got = {r.id: r.cluster for r in spatial.dbscan(df, 3.0, 4).collect()}
    assert [got[i] for i in range(len(points))] == brute_dbscan(points, 3.0, 4)


def test_pairs_over_the_meridian(spark):
    df = spark.createDataFrame([(1, 0.0, 179.995), (2, 0.0, -179.995), (3, 0.0, 179.0)], "id long, lat double, lon double")
    assert sorted((r.a, r.b) for r in spatial.pairs_within(df, 2.0).collect()) == [(1, 1), (1, 2), (2, 1), (2, 2), (3, 3)]
    wide = spark.createDataFrame([(1, 89.9, 0.0), (2, 89.9, 179.0), (3, 89.9, -90.0)], "id long, lat double, lon double")
    assert sorted((r.a, r.b) for r in spatial.pairs_within(wide, 300.0).collect()) == [(a, b) for a in (1, 2, 3) for b in (1, 2, 3)]


def test_precision_recall_curve(spark):
    rng = random.Random(1)
    rows = [(rng.randrange(2), round(rng.random(), 2)) for _ in range(200)]
    got = {r.threshold: (r.precision, r.recall) for r in metrics.pr_curve(spark.createDataFrame(rows, "y int, p double"), "y", "p").collect()}
    total = sum(y for y, _ in rows)
    for t in {p for _, p in rows}:
        chosen = [y for y, p in rows if p >= t]
        assert got[t] == pytest.approx((sum(chosen) / len(chosen), sum(chosen) / total))


@pytest.mark.parametrize("n", [3, 10, 27, 100])
def test_quantile_bins(spark, n):
    rng = random.Random(n)
    rows = [(i, rng.choice([0.1, 0.2, rng.random()])) for i in range(n)]
    got = {r.id: r.bin for r in metrics.quantile_bins(spark.createDataFrame(rows, "id long, p double"), "p", ["id"]).collect()}
    want = {}
    for at, (i, _) in enumerate(sorted(rows, key=lambda r: (r[1], r[0]))):
        q, more = divmod(n, 10)
        want[i] = at // (q + 1) + 1 if at < more * (q + 1) else more + (at - more * (q + 1)) // q + 1
    assert got == want


def test_plans_name_texts_once(spark, tiny):
    """Aspect detection and date parsing compute each normalised value in one place of the plan."""
    from gapline.plans import QUERIES

    plan = lambda q: QUERIES[q](spark, tiny)._jdf.queryExecution().optimizedPlan().toString()
    for q in ("aspect_coverage", "weak_aspects", "tag_histogram"):
        assert plan(q).lower().count("regexp_replace") <= 4
        assert "rlike" not in plan(q).lower()
    assert plan("parse_review_date").lower().count("rlike") <= 9


def test_scarcity_corners(spark):
    df = spark.createDataFrame([(1, 2.0, 99.0, "a"), (2, 2.001, 99.0, "a"), (3, None, 99.0, "a"), (4, 2.0, 99.0, None)], "id long, lat double, lon double, category string")
    assert {r.id: (r.density, r.scarcity) for r in spatial.scarcity(df, 5).collect()} == {1: (1, 0.0), 2: (1, 0.0), 3: (0, 1.0), 4: (-1, 1.0)}


def test_gap_scores(spark):
    p = spark.createDataFrame([(1, "A", "wisata", "t", "x", 2.0, 99.0, 4.0, "open", "5", "wc"), (2, "B", "wisata", "t", "x", 2.01, 99.01, 5.0, "open", "5", "wc")], "place_id long, place_name string, category string, place_type string, address string, lat double, lon double, rating double, status string, price_text string, facility_text string")
    day = datetime.date(2025, 1, 1)
    rv = spark.createDataFrame([(1, 1, day), (1, 2, day)], "place_id long, review_id long, day date")
    m = spark.createDataFrame([(1, "toilet", True), (1, "parkir", False)], "place_id long, aspect string, negative boolean")
    a = spark.createDataFrame([("toilet",), ("parkir",)], "aspect string")
    s = spatial.scarcity(p.select(F.col("place_id").alias("id"), "lat", "lon", "category"), 5)
    rows = gap.gap_scores(p, rv, m, a, s, day).orderBy("rank").collect()
    assert [(r.place_id, r.aspect) for r in rows] == [(1, "toilet"), (1, "parkir")]
    assert all(0 <= r.score <= 100 for r in rows)


def test_least_reachable(spark):
    random.seed(2)
    edges = [(random.randrange(60), random.randrange(60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 140)]
    got = {r.id: r.root for r in graph.least_reachable(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {n: n for e in edges for n in e}
    for _ in root:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    assert got == root


def test_kappa_and_average_precision(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("b", "b")], "x string, y string")
    assert abs(metrics.kappa(df, "x", "y").first().kappa - 0.5) < 1e-12
    rows = spark.createDataFrame([(1, 0.9), (0, 0.8), (1, 0.8), (0, 0.1)], "y int, p double")
    assert abs(metrics.average_precision(rows, "y", "p").first()[0] - (0.5 + 0.5 * 2 / 3)) < 1e-12


def test_threshold_choice(spark):
    rows = spark.createDataFrame([(1, 0.9), (1, 0.8), (0, 0.7), (1, 0.6), (0, 0.2), (0, 0.1)], "y int, p double")
    best = metrics.choose_threshold(metrics.threshold_sweep(rows, "y", "p"), 0.75).first()
    assert best.precision >= 0.75
    assert best.recall == 1.0
    assert best.threshold == 0.205


def test_allocation():
    assert sampling.allocate({"a": 50, "b": 30, "c": 1}, 10) == {"a": 5, "b": 4, "c": 1}


def test_capped_quota(spark):
    df = spark.createDataFrame([(i, "s", i % 3) for i in range(30)], "id int, s string, g int")
    rows = sampling.capped_quota(df, "s", "g", [F.asc("id")], 2, 8).collect()
    assert len(rows) == 8
    assert sum(r.id < 6 for r in rows) == 6


def test_annotation_status(spark):
    df = spark.createDataFrame([("negative", "", "yes"), ("negative", "positive", "yes"), ("bogus", "", ""), ("", "", ""), ("neutral", "", "no")], "a string, b string, ok string")
    got = [r.status for r in annotation.with_status(df, "a", "b", "ok", ["negative", "neutral", "positive"]).collect()]
    assert got == ["completed", "adjudication_required", "invalid_label", "pending", "awaiting_human_approval"]


def test_validation(spark):
    df = spark.createDataFrame([("yes", "yes"), ("yes", "yes")], "evidence string, priority string")
    assert annotation.validation(df).first().overall_rate == 1.0
    assert annotation.validation(df.union(spark.createDataFrame([("", "")], df.schema))).first().overall_rate is None


def test_detect(spark):
    taxonomy = {"toilet": (["toilet"], ["toilet kotor"], []), "parkir": (["parkir"], ["parkir sempit"], []), "lainnya": ([], [], [])}
    df = spark.createDataFrame([("Toilet kotor dan parkir sempit",), ("halo",), (None,), (" ",)], "t string")
    rows = ev.detect(df, "t", taxonomy, ["kotor"], "lainnya").collect()
    assert [(r.weak_aspects, r.negative_aspects) for r in rows] == [(["parkir", "toilet"], ["parkir", "toilet"]), (["lainnya"], []), ([], []), ([], [])]


def test_resolution_cases(spark):
    schema = "source string, priority int, name string, category string, place_type string, lat double, lon double"
    same = spark.createDataFrame([("a", 1, "air terjun", "wisata", "t", 2.0, 99.0), ("b", 2, "air terjun", "wisata", "t", None, None)], schema)
    rows = entities.resolve(same).collect()
    assert len({r.canonical_id for r in rows}) == 1
    assert {r.method for r in rows} == {"new_canonical", "normalized_exact"}
    near = spark.createDataFrame([("a", 1, "pantai indah lestari", "wisata", None, None, None), ("b", 2, "pantai indah lestary", "wisata", None, None, None)], schema)
    assert len({r.canonical_id for r in entities.resolve(near).collect()}) == 1


def test_weighted_ratio():
    assert entities.ratio("this is a test", "this is a test!") == pytest.approx(2800 / 29)
    assert entities.common("abcbdab", "bdcaba") == 4
    assert entities.partial("this is a test", "this is a test!") == 100
    assert entities.partial("abcd", "xxabydxx") == pytest.approx(75)
    assert entities.token_ratio("fuzzy wuzzy was a bear", "wuzzy fuzzy was a bear") == 100
    assert entities.token_ratio("fuzzy was a bear", "fuzzy fuzzy was a bear") == 100
    assert entities.name_similarity("new york mets", "new york mets at atlanta braves") == pytest.approx(90)
    assert entities.name_similarity("", "x") == 0
    rng = random.Random(2)
    for _ in range(200):
        a, b = ("".join(rng.choice("ab c") for _ in range(rng.randrange(9))) for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert entities.common(a, b) == table[-1][-1]


def test_cosines_of_letter_runs():
    """Against the sums written out, with the weights of the names so far."""
    names, probe = ["pantai indah", "pantai baru", "air terjun"], "pantai indah sekali"
    index = entities.GramIndex()
    for n in names:
        index.add(n)
    grams = [entities.word_grams(n) for n in names]
    weight = lambda g: math.log(4 / (1 + sum(g in x for x in grams))) + 1
    row = lambda c: {g: n * weight(g) for g, n in c.items() if any(g in x for x in grams)}
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    q = row(entities.word_grams(probe))
    cosines = [sum(q.get(g, 0) * x for g, x in row(c).items()) / (norm(q) * norm(row(c))) for c in grams]
    assert index.best(probe, range(3)) == (0, pytest.approx(cosines[0]))
    assert entities.word_grams("ab abcd") == {" ab": 1, "ab ": 1, " ab ": 1, " abc": 1, "abcd": 1, "bcd ": 1, " abcd": 1, "abcd ": 1} | {" ab": 2, "abc": 1, "bcd": 1, "cd ": 1}


def test_names_are_compared_at_once(monkeypatch):
    """The nearest name and its likeness as by all pairs, with few of them worked out."""
    rng, words = random.Random(5), ["pantai", "indah", "danau", "toba", "hotel", "air", "raya", "0001", "0012", "aa", "ab"]
    names = {" ".join(rng.choice(words) for _ in range(rng.randrange(1, 6))) for _ in range(60)} | {f"supplier {i:09d}" for i in range(0, 90, 7)} | {"pantai indah " * 7 + "x"}
    index, grams, so_far, asked = entities.NameIndex(3), entities.GramIndex(), [], []
    similarity = entities.name_similarity
    monkeypatch.setattr(entities, "name_similarity", lambda a, b: asked.append(a) or similarity(a, b))
    pairs = matched = 0
    for name in sorted(names, key=lambda n: rng.random()):
        runs = lambda n: {n[i : i + 3] for i in range(max(1, len(n) - 2))}
        near = [i for i, other in enumerate(so_far) if runs(name) & runs(other)]
        pairs += len(near)
        if near:
            alike = [similarity(name, so_far[i]) for i in near]
            wanted = near[alike.index(max(alike))], max(alike)
            other, cosine = grams.best(name, near)
            wanted = (other, 100 * cosine) if other is not None and 100 * cosine > wanted[1] else wanted
            got = index.nearest(name)
            assert got == wanted or max(got[1], wanted[1]) < entities.LEAST
            matched += wanted[1] >= entities.LEAST
        so_far.append(name), index.add(name), grams.add(name)
    assert matched > 40
    assert len(asked) < pairs / 2


def test_edit_distances_of_many_texts():
    rng = random.Random(8)
    for longest in (6, 40, 75):
        texts = sorted(("".join(rng.choice("abé ") for _ in range(rng.randrange(longest))) for _ in range(40)), key=len)
        codes = np.zeros((max(map(len, texts)), len(texts)), np.int32)
        for i, t in enumerate(texts):
            codes[: len(t), i] = [*map(ord, t)]
        for a in ["", "ab", *texts[-3:]]:
            wanted = []
            for b in texts:
                row = list(range(len(b) + 1))
                for i, x in enumerate(a):
                    last, row = row, [i + 1]
                    for j, y in enumerate(b):
                        row.append(min(row[j] + 1, last[j + 1] + 1, last[j] + (x != y)))
                wanted.append(row[-1])
            assert entities.edits(a, codes, np.array([*map(len, texts)])).tolist() == wanted


def test_similar_names_are_dealt_by_blocks(spark):
    """All pairs of all blocks, over more tasks than there are groups; nulls and empty names have none."""
    rng = random.Random(4)
    rows = [(i, "".join(rng.choice("ab") for _ in range(rng.randrange(4, 7))) if i % 50 else None, "g" if i % 9 else None) for i in range(300)] + [(300, "", "g"), (301, "", "g")]
    df = spark.createDataFrame(rows, "id long, name string, g string")
    got = entities.similar_names(df, "id", "name", "g", 80.0, block=40).select("a_id", "b_id", "base", F.spark_partition_id().alias("task")).collect()
    a, b = (df.where("name <> ''").select(*[F.col(c).alias(f"{p}_{c}") for c in df.columns]) for p in "ab")
    share = 100.0 * (1.0 - F.levenshtein("a_name", "b_name") / F.greatest(F.length("a_name"), F.length("b_name")).cast("double"))
    wanted = a.join(b, (F.col("a_g") == F.col("b_g")) & (F.col("a_id") < F.col("b_id"))).select("a_id", "b_id", share.alias("base")).where("base >= 80").collect()
    assert len(got) == len(wanted) > 1000
    assert {tuple(r)[:3] for r in got} == {tuple(r) for r in wanted}
    assert len({r.task for r in got}) > 1


def test_each_fold_has_its_own_task(spark):
    schema = "source string, priority int, name string, category string, place_type string, lat double, lon double"
    rows = [("a", 1, f"pantai {i}", f"c{i % 5}", None, None, None) for i in range(40)]
    tasks = entities.resolve(spark.createDataFrame(rows, schema)).select(F.spark_partition_id().alias("task")).distinct().count()
    assert tasks > 1


def test_resolution_by_words_and_position(spark):
    schema = "source string, priority int, name string, category string, place_type string, lat double, lon double"
    rows = [("a", 0, "hotel danau toba", "hotel", "h", 2.0, 99.0), ("b", 1, "danau toba hotel", "hotel", None, None, None), ("b", 1, "hotel danau tobba raya", "restoran", None, 2.001, 99.0), ("c", 2, "air terjun efrata", "wisata", None, None, None)]
    got = {r.name: r for r in entities.resolve(spark.createDataFrame(rows, schema), within=None).collect()}
    assert got["danau toba hotel"].canonical_id == got["hotel danau toba"].canonical_id
    assert got["air terjun efrata"].method == "new_canonical"
    assert len({r.canonical_id for r in got.values()}) in (2, 3)


def test_import_issues(spark):
    rows = spark.createDataFrame([(2, "P", "c", "ok text", 5.0, 1.0, 2.0, "2024-01-01"), (3, "", None, "x", 9.0, 1.0, None, "soon"), (4, "P", "c", "ok text", None, 95.0, 2.0, "soon")], "row_no long, place_name string, place_category string, review_text string, review_rating double, latitude double, longitude double, review_date string")
    got = {(r.row_no, r.field, r.code) for r in imports.issues(rows).collect()}
    assert got == {(3, f, "invalid_value") for f in ("place_name", "place_category", "review_text", "review_rating")} | {(3, "coordinates", "incomplete_coordinate"), (4, "coordinates", "invalid_coordinate"), (4, "review_date", "invalid_date")}


def test_grouped_split_balances(spark):
    df = spark.createDataFrame([(g, "ab"[g % 2]) for g, _ in itertools.product(range(20), range(3))], "g int, y string")
    folds = learning.grouped_split(df, "g", "y", 5).groupBy("fold").count().collect()
    assert [r["count"] for r in folds] == [4] * 5


def test_grid_search(spark):
    rows = [(f"kotor buruk {i}", 1.0) for i in range(12)] + [(f"bagus bersih {i}", 0.0) for i in range(12)]
    df = spark.createDataFrame(rows, "text string, label double")
    setting, model, best = learning.grid_search(df, df, [{"c": 1.0}, {"c": 1.0, "chars": True}])
    assert best["f1"] == 1.0
    assert setting["c"] == 1.0
    assert learning.probability(model, df).where("label = 1").agg(F.min("p")).first()[0] > 0.5


def test_topics_part_planted_themes(spark):
    rows = [(i, f"kamar bersih hotel nyaman kasur {i % 3}") for i in range(20)] + [(100 + i, f"ikan bakar enak makanan pedas {i % 3}") for i in range(20)] + [(999, None)]
    assigned, terms = learning.topics(spark.createDataFrame(rows, "id long, text string"), "id", k=2)
    got = {r.id: (r.topic, r.strength) for r in assigned.collect()}
    assert len({got[i][0] for i in range(20)}) == 1
    assert len({got[100 + i][0] for i in range(20)}) == 1
    assert got[0][0] != got[100][0]
    assert got[999] == (0, 0.0)
    assert "hotel" in {r.term for r in terms.where(F.col("topic") == got[0][0]).collect()}


def test_topic_terms_are_counted_as_numbers(spark):
    """The most frequent words and pairs as counted by hand, ties as text; each text's counts of them."""
    from collections import Counter

    rng = random.Random(3)
    texts = [" ".join(rng.choice(["air", "air-terjun", "danau", "toba", "é1", "x"]) for _ in range(rng.randrange(7))) for _ in range(60)]
    df = spark.createDataFrame([*enumerate(texts), (99, None)], "id long, text string").repartition(3)
    terms = []
    for t in texts:
        w = [x for x in t.lower().replace("-", " ").split() if len(x) > 1]
        terms.append(Counter(w + [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)]))
    for most, vocabulary in ((0.9, 8), (0.3, 100), (0.9, 3)):
        seen = Counter(x for c in terms for x in c)
        wanted = sorted(((x, n) for x, n in seen.items() if 2 <= n <= 61 * most), key=lambda x: (-x[1], x[0]))[:vocabulary]
        known, codes, n = learning._frequent_terms(df, "text", 61, 2, most, vocabulary)
        names = [known[c // (len(known) + 1)] + (f" {known[c % (len(known) + 1) - 1]}" if c % (len(known) + 1) else "") for c in codes]
        assert list(zip(names, n, strict=True)) == wanted
        got = {r.key: dict(zip(r.terms, r.often, strict=True)) for r in learning._term_counts(df, "id", "text", known, codes).collect()}
        assert got == {i: {j: c[x] for j, x in enumerate(names) if x in c} for i, c in enumerate([*terms, *[{}] * 39, {}]) if i < 60 or i == 99}


def test_rounds_of_topics_shuffle_nothing(spark):
    """As many shuffles, which stay on disk, for many rounds as for one."""
    df = spark.createDataFrame([(i, f"kamar {i % 7} hotel {i % 5} ikan {i % 3} bakar") for i in range(60)], "id long, text string")
    shuffles = lambda: int(spark._jsc.sc().newShuffleId())
    used = []
    for rounds in (1, 12):
        before = shuffles()
        learning.topics(df, "id", k=2, rounds=rounds, tolerance=0.0)
        used.append(shuffles() - before)
    assert used[0] == used[1]


def bad_and_good(spark, n=12):
    rows = [(i, i % 4, f"kotor buruk rusak {i % 5}", 1.0) for i in range(n)] + [(100 + i, i % 4, f"bagus bersih indah {i % 5}", 0.0) for i in range(n)]
    return spark.createDataFrame(rows, "id long, place long, text string, label double")


def test_word_features_have_the_reference_sizes(spark):
    """More words than 20,000 are kept, and one in every text is not."""
    from pyspark.ml import Pipeline

    parts = [" ".join(f"w{i}" for i in range(j * 600, j * 600 + 600)) for j in range(20)]
    rows = [(f"always {p}",) for p in parts for _ in range(2)]
    words = Pipeline(stages=learning.word_features()).fit(spark.createDataFrame(rows, "text string")).stages[3].vocabulary
    # 12,000 words, 599 pairs in each of 20 texts, and 'always' with the first word of each
    assert len(words) == 12_000 + 20 * 599 + 20
    assert "always" not in words


def test_bundle_and_analysis(spark, tmp_path):
    df = bad_and_good(spark)
    with pytest.raises(ValueError):
        learning.save_bundle(learning.train_binary(df), str(tmp_path / "m"), threshold=0.5)
    learning.save_bundle(learning.train_binary(df), str(tmp_path / "m"), threshold=0.5, margin=0.1, label_source="human_gold", version="1")
    bundle = learning.load_bundle(spark, str(tmp_path / "m"))
    assert bundle[1]["margin"] == 0.1
    rows = df.withColumn("kebersihan", (F.col("label") == 1).cast("int")).withColumn("lainnya", (F.col("label") == 0).cast("int"))
    features, models = learning.train_multilabel(rows, ["kebersihan", "lainnya"])
    got = {r.id: r for r in learning.analyse(df, "id", bundle, features, models).collect()}
    assert (got[0].complaint, [a.label for a in got[0].aspects]) == ("detected", ["kebersihan"])
    assert (got[100].complaint, [a.label for a in got[100].aspects]) == ("not_detected", ["lainnya"])


def test_cross_validation_and_comparison(spark):
    df = bad_and_good(spark)
    got = learning.cross_validated_f1(df, "place", folds=2)
    assert got["folds"] == [1.0, 1.0]
    assert got["std"] == 0.0
    rows = learning.weak_versus_gold(df, df.where("place <> 0"), df.where("place = 0"), "place").collect()
    assert {r.label_source: r.macro_f1 for r in rows} == {"weak_rating": 1.0, "human_gold": 1.0}


def test_gold_is_never_lost(spark, tmp_path):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    assert annotation.keep_all(old, old, "id").count() == 2
    with pytest.raises(Exception, match="1 gold rows would be lost"):
        annotation.keep_all(old, old.where("id = 1"), "id").collect()
    queue = spark.createDataFrame([(1, ""), (2, ""), (3, "own")], "id int, v string")
    assert {tuple(r) for r in annotation.restore(queue, old, "id", ["v"]).collect()} == {(1, "a"), (2, "b"), (3, "own")}
    path = annotation.snapshot(old, str(tmp_path), "id", ["v"])
    assert annotation.snapshot(old.orderBy(F.desc("id")), str(tmp_path), "id", ["v"]) == path
    assert spark.read.parquet(path).count() == 2


def test_suggestions_leave_approved_rows(spark):
    queue = spark.createDataFrame([(1, "yes", "old"), (2, "", "old")], "id int, ok string, ai_label string")
    new = spark.createDataFrame([(i, "new", "high", "why") for i in (1, 2)], "id int, ai_label string, ai_confidence string, ai_rationale string")
    assert {r.id: (r.ai_label, r.ai_confidence) for r in annotation.suggest(queue, new, "id", "ok").collect()} == {1: ("old", None), 2: ("new", "high")}


def test_template():
    assert imports.template() == "review_id,review_text,review_rating,review_date\n"
    assert len(imports.ALIASES) == 24


def marked_texts(spark, n=120):
    words = ["kotor", "bersih", "mahal", "murah", "ramai", "sepi", "toilet", "parkir"]
    rows = []
    for i in range(n):
        picked = [words[(i * 5 + j * j) % 8] for j in range(2 + i % 4)]
        rows.append((i, " ".join(picked) + f" n{i % 9} n{i % 9}", int("kotor" in picked or i % 10 == 0), int("mahal" in picked)))
    return spark.createDataFrame(rows, "id long, text string, bad int, dear int")


def test_multilabel_is_the_least_of_the_reference_loss(spark):
    """Same terms and weights of terms, and the same probabilities, as MLlib's stages with a regression for each label."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import vector_to_array

    df = marked_texts(spark)
    features, models = learning.train_multilabel(df, ["bad", "dear"])
    got = {(r.id, r.label): r.p for r in learning.label_probabilities(features, models, df, "id").collect()}
    stages = Pipeline(stages=learning.word_features()).fit(df)
    assert len(features["codes"]) == len(stages.stages[3].vocabulary)
    data = stages.transform(df)
    for x in ("bad", "dear"):
        m = LogisticRegression(labelCol=x, regParam=1.0 / (3.0 * 120), standardization=False, maxIter=1000, tol=1e-12).fit(data.withColumn(x, F.col(x).cast("double")))
        for r in m.transform(data).select("id", vector_to_array("probability")[1].alias("p")).collect():
            assert abs(got[r.id, x] - r.p) < 2e-3


def test_most_used_terms_stay(spark):
    """Where the vocabulary is full, what stands there most often stays, however few texts have it, as in the reference's vectorizer."""
    rows = [("rare rare rare rare rare rare",)] * 2 + [(f"often w{i % 3}",) for i in range(5)] + [("x y",)] * 5
    df = spark.createDataFrame(rows, "text string")
    known, codes, seen = learning._frequent_terms(df, "text", 12, 2, 0.95, 2, by="uses")
    first, second = np.divmod(codes, len(known) + 1)
    assert [known[i] + (f" {known[j - 1]}" if j else "") for i, j in zip(first, second, strict=True)] == ["rare", "rare rare"]
    assert seen.tolist() == [2, 2]


def test_labels_step_together(spark):
    """A label more costs no pass more over the texts."""
    df = marked_texts(spark)
    for i in range(6):
        df = df.withColumn(f"copy{i}", F.col("bad"))
    sc, jobs = spark.sparkContext, []
    for labels in (["bad"], ["bad", *[f"copy{i}" for i in range(6)]]):
        group = f"labels-{len(labels)}"
        sc.setJobGroup(group, group)
        _, models = learning.train_multilabel(df, labels)
        sc.setLocalProperty("spark.jobGroup.id", None)
        assert set(models) == set(labels)
        jobs.append(len(sc.statusTracker().getJobIdsForGroup(group)))
    assert jobs[1] <= jobs[0]


def test_training_splits_a_text_once(spark):
    """Words, pairs and cells all come from one reading of the texts."""
    from pyspark.sql.types import StringType

    read = spark.sparkContext.accumulator(0)

    def seen(x):
        read.add(1)
        return x

    df = marked_texts(spark).withColumn("text", F.udf(seen, StringType())("text"))
    learning.train_multilabel(df, ["bad", "dear"])
    assert read.value == 120


def test_labels_settle_in_few_passes(spark):
    """Terms of very different frequency, labels that single words give and next to no penalty: many small steps."""
    rng = np.random.default_rng(5)
    rows = []
    for i in range(400):
        words = [f"w{int(j)}" for j in rng.zipf(1.2, 120) if j < 3000]
        rows.append((i, " ".join(words), int("w9" in words), int("w40" in words or "w41" in words)))
    df = spark.createDataFrame(rows, "id long, text string, bad int, dear int")
    sc = spark.sparkContext
    sc.setJobGroup("passes", "passes")
    learning.train_multilabel(df, ["bad", "dear"], c=1000.0)
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert len(sc.statusTracker().getJobIdsForGroup("passes")) <= 88  # 99 with the curvature of the start alone


def test_blocks_hold_all_texts(spark):
    """More texts than a block has, a text longer than one, and empty ones: each is counted whole."""
    from collections import Counter

    texts = [f"aa b{i % 50} b{i % 7}" for i in range(6000)] + ["", None, "."] + [" ".join(f"b{i % 50}" for i in range(300_000))]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string").coalesce(1)
    uses, seen = Counter(), Counter()
    for x in texts:
        words = (x or "").replace(".", "").split()
        each = words + [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]
        uses.update(each)
        seen.update(set(each))
    known, codes, counts = learning._frequent_terms(df, "text", len(texts), 2, 1.0, 50000, by="uses")
    first, second = np.divmod(codes, len(known) + 1)
    names = [known[i] + (f" {known[j - 1]}" if j else "") for i, j in zip(first, second, strict=True)]
    assert dict(zip(names, counts.tolist(), strict=True)) == {x: k for x, k in seen.items() if k >= 2}
    assert [uses[x] for x in names] == sorted((uses[x] for x in names), reverse=True)
    rows = learning._term_counts(df, "id", "text", known, codes).collect()
    assert sorted(r.key for r in rows) == list(range(len(texts)))
    assert sum(sum(r.often) for r in rows) == sum(k for x, k in uses.items() if seen[x] >= 2)
    assert {r.key for r in rows if not r.terms} == {6000, 6001, 6002}
