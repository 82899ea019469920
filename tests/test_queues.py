import hashlib
import os
import random
import threading
from collections import Counter

import pytest
from pyspark.sql import functions as F

from gapline.operators import learning, queues, reports, sampling
from gapline.plans import QUERIES
from gapline.sources import files
from tests.test_sources import workbook


def seeded(keys, seed=42):
    return sorted(keys, key=lambda k: (hashlib.md5(f"{k}:{seed}".encode()).hexdigest(), k))


def brute_draw(rows, passes, total, cap):
    """Row by row: ``rows`` is key -> (place, what it is); ``passes`` are (reason, test, target, spare, capped)."""
    taken, given = {}, Counter()
    for reason, test, target, spare, capped in passes:
        here, held = 0, []
        for k in seeded(rows):
            place, what = rows[k]
            if here >= target or len(taken) >= total:
                break
            if not test(what) or k in taken:
                continue
            if capped and given[place] >= cap:
                held.append(k)
                continue
            taken[k] = reason
            given[place] += 1
            here += 1
        for k in held if spare else ():
            if here < target and len(taken) < total:
                taken[k] = reason
                here += 1
    return taken


@pytest.mark.parametrize(("n", "total", "cap"), [(400, 60, 3), (400, 390, 4), (30, 60, 1), (500, 40, 30)])
def test_draw_against_row_by_row(spark, n, total, cap):
    rng = random.Random(n + total)
    rows = {i: (rng.choice("aaaaaabcdefgh"), rng.choice([("x",), ("y",), ("x", "y"), ("z",), ()])) for i in range(n)}
    df = spark.createDataFrame([(i, p, list(w)) for i, (p, w) in rows.items()], "id long, place string, w array<string>")
    total = min(total, n)
    passes = [queues.Pass("x", F.array_contains("w", "x"), total // 4, spare=True), queues.Pass("y", F.array_contains("w", "y"), total // 4), queues.Pass("any", F.lit(True), total), queues.Pass("rest", F.lit(True), total, capped=False)]
    brute = [("x", lambda w: "x" in w, total // 4, True, True), ("y", lambda w: "y" in w, total // 4, False, True), ("any", lambda w: True, total, False, True), ("rest", lambda w: True, total, False, False)]
    got = {r.id: r.selection_reason for r in queues.draw(df, "id", F.col("place"), passes, total, cap).collect()}
    assert got == brute_draw(rows, brute, total, cap)
    assert len(got) == total


def test_sentiment_queue_spreads(spark, tiny):
    rows = QUERIES["sentiment_queue"](spark, tiny).collect()
    some = len(rows)
    assert some == min(300, QUERIES["label_candidates"](spark, tiny).count())
    assert len({r.review_id for r in rows}) == some
    clauses = QUERIES["clause_queue"](spark, tiny).collect()
    assert {r.selection_reason.split(":")[0] for r in clauses} <= {"weak_aspect", "taxonomy_unmatched", "stratified_fill"}
    assert max(Counter(r.place_id for r in clauses).values()) <= 40


def test_candidates_fall_back_to_repeats(spark):
    schema = "review_id long, label string, text_raw string, text_length long, is_duplicate boolean"
    rows = spark.createDataFrame([(1, "negative", "x", 1, True), (2, None, "x", 1, False), (3, "neutral", "", 0, False)], schema)
    assert [r.review_id for r in queues.label_candidates(rows).collect()] == [1]


def test_gold_of_an_edited_queue(spark):
    queue = spark.createDataFrame([("a", "negative", "yes"), ("b", " ", "yes"), ("c", "neutral", "no"), ("a", "negative", "Approved ")], "id string, label string, ok string")
    assert [r.id for r in queues.gold_of(queue, "id", "label", "ok").collect()] == ["a"]
    old = spark.createDataFrame([("z",)], "id string")
    with pytest.raises(Exception, match="1 gold rows would be lost"):
        queues.gold_of(queue, "id", "label", "ok", old).collect()


def complaints(spark, n=120):
    bad, good = "kotor buruk rusak lambat", "bagus bersih indah nyaman"
    rows = [(i, i % 15, f"{bad if i % 3 == 0 else good} nomor{i % 7}", float(i % 3 == 0)) for i in range(n)]
    return spark.createDataFrame(rows, "id long, place long, text string, label double")


def test_complaint_flow(spark):
    grid = [{"c": 1.0}, {"c": 3.0, "heavier": 2.0}]
    model, report = learning.complaint_flow(complaints(spark), "place", grid, margin=0.0)
    assert report["accepted"] is True
    assert report["operational"]["recall"] == 1.0
    assert sum(report["rows"].values()) == 120
    _, strict = learning.complaint_flow(complaints(spark), "place", grid[:1], gates={"coverage": 1.01})
    assert (strict["accepted"], strict["gates"]) == (False, {"coverage": False})


def test_aspect_flow(spark):
    rows = [(i, i % 10, " ".join(w for w, on in (("toilet kotor", i % 2), ("parkir luas", i % 3 == 0)) if on) + f" n{i % 5}", i % 2, int(i % 3 == 0)) for i in range(100)]
    df = spark.createDataFrame(rows, "clause_id long, place long, text string, toilet int, parkir int")
    _, models, report = learning.aspect_flow(df, ["toilet", "parkir"], "place")
    assert set(models) == {"toilet", "parkir"}
    assert report["micro_f1"] > 0.95
    assert report["accepted"]


def test_nested_and_locked_splits(spark):
    df = complaints(spark, 300).withColumn("place", F.col("id") % 40)
    parts = {r.place: r.split for r in learning.nested_split(df, "place", "label").collect()}
    assert len(parts) == 40
    assert set(parts.values()) == {"train", "validation", "test"}
    locked = learning.locked_three_way(df, "place", ["label"]).collect()
    assert Counter(r.split for r in locked) == {"test": 8, "validation": 8, "train": 24}
    assert sorted(r.place for r in locked) == list(range(40))
    with pytest.raises(ValueError, match="five groups"):
        learning.locked_three_way(df.where("place < 4"), "place", ["label"])


def test_representatives(spark):
    rows = [(i, f"kamar bersih hotel nyaman {i % 3} " + "x" * 400) for i in range(20)] + [(100 + i, f"ikan bakar enak pedas {i % 3}") for i in range(20)] + [(999, None)]
    df = spark.createDataFrame(rows, "id long, text string")
    assigned, _ = learning.topics(df, "id", k=2)
    found = learning.representatives(assigned, df, "id").collect()
    assert Counter(r.topic for r in found) == {0: 3, 1: 3}
    assert max(len(r.example) for r in found) == 300
    assert 999 not in {r.id for r in found}


def test_report_pieces(spark):
    figures = reports.collate({"a": {"test": {"f1": 0.5}}, "b": {"n": 3}}, {"f1": "a/test/f1", "rows": "b/n"})
    assert figures == {"f1": 0.5, "rows": 3}
    with pytest.raises(KeyError, match="rows: no b/m"):
        reports.collate({"b": {}}, {"rows": "b/m"})
    assert reports.differing({"x": 1.0, "y": "a", "z": 1}, {"x": 1.0 + 1e-12, "y": "b"}) == ["y", "z"]
    errors = spark.createDataFrame([(i, "Tempat bagus sekali di danau" if i else "hubungi 0812 3456 7890 segera ya", "negative", "positive", "false_positive", "X|NEGATION") for i in range(6)], "id long, text string, actual_label string, predicted_label string, error_type string, analysis_tags string")
    got = reports.error_examples(errors, "id").collect()
    assert len(got) == 4
    assert 0 not in {r.id for r in got}
    assert {r.error_type for r in got} == {"False Positive"}


def test_privacy(spark):
    rows = [("a", "x" * 50_000 + " mail a@b.co"), ("b", "C:\\Users\\x and /home/me/y"), ("c", "fine"), ("d", "by rina.s, call +62 812 3456 7890"), ("e", '"Reviewer_ID": 3'), ("f", "rinas")]
    found = reports.privacy_findings(spark.createDataFrame(rows, "path string, text string"), "path", "text", ["reviewer_id"], "Rina.S")
    assert sorted((r.path, r.finding) for r in found.collect()) == [("a", "email"), ("b", "absolute_path"), ("d", "account"), ("d", "phone"), ("e", "field:reviewer_id")]


def test_unresolved_cells(spark, tmp_path):
    path = workbook(tmp_path / "a.xlsx")
    spark.dataSource.register(files.WorkbookSource)
    cells = spark.read.format("workbook_cells").load(path)
    got = [tuple(r) for r in files.unresolved_cells(cells, {"Review": ["rating", "review-text"]}).orderBy("cell").collect()]
    assert got == [("Review", "B2", "formula_in_review_text", "=2+2"), ("Review", "B3", "excel_error", "#REF!")]
    letters = spark.createDataFrame([(n,) for n in (0, 25, 26, 701, 702, 16383)], "n int").select(files.cell_letters(F.col("n"))).collect()
    assert [r[0] for r in letters] == ["A", "Z", "AA", "ZZ", "AAA", "XFD"]
    assert files.first_examples(cells, ["sheet"], ["row_no", "column_no"], 2).count() == 2


def test_settings_and_locked_files(tmp_path, monkeypatch):
    (tmp_path / "c.yaml").write_text("a: {b: 2}\n")
    assert files.load_settings(str(tmp_path / "c.yaml"), ("a",)) == {"a": {"b": 2}}
    with pytest.raises(ValueError, match="lacks z"):
        files.load_settings(str(tmp_path / "c.yaml"), ("z",))
    seen = []

    def work(i):
        with files.run_lock(str(tmp_path)):
            seen.append(("in", i))
            seen.append(("out", i))

    threads = [threading.Thread(target=work, args=(i,)) for i in range(5)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert all(seen[i][1] == seen[i + 1][1] for i in range(0, 10, 2))
    assert not os.path.exists(tmp_path / ".lock")
    (tmp_path / ".lock").touch()
    with pytest.raises(TimeoutError), files.run_lock(str(tmp_path), 0.1):
        pass
    real = type(tmp_path).write_text

    def locked(self, *args, **kwargs):
        if self.name == "queue.csv":
            raise PermissionError
        return real(self, *args, **kwargs)

    monkeypatch.setattr(type(tmp_path), "write_text", locked)
    assert files.write_or_pend("a,b\n", str(tmp_path / "queue.csv")) == ("pending", tmp_path / "queue.pending.csv")
    assert files.write_or_pend("a,b\n", str(tmp_path / "other.csv"))[0] == "written"


def test_runs_by_id(tmp_path):
    (tmp_path / "imp-1.summary.json").write_text('{"rows": 3}')
    assert files.read_run(str(tmp_path), "imp-1", ".summary.json") == {"rows": 3}
    with pytest.raises(FileNotFoundError):
        files.read_run(str(tmp_path), "imp-2", ".summary.json")
    with pytest.raises(ValueError, match="import id"):
        files.read_run(str(tmp_path), "../imp-1", ".summary.json")


def test_allocation_is_what_passes_ask_for():
    assert sum(sampling.allocate({"a": 10, "b": 3, "c": 1}, 7).values()) == 7
