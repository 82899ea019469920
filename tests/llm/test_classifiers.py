import math
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from gapline.llm import langid, quality
from gapline.llm.queries import QUERIES


def test_kneser_ney_is_a_distribution():
    """Of a seen context, the probabilities of all letters sum to one, at every order."""
    classes = langid.letter_classes([ord(c) for c in "abcde"])
    texts = ["abcabcabd ace", "bcd abcab", "eee abc"]
    gram, _ = langid.codes(texts, classes)
    g, n = np.unique(gram, return_counts=True)
    model = langid.kneser_ney(g, n)
    for ctx in np.unique(g >> np.uint64(langid.BITS)):
        full = (ctx << np.uint64(langid.BITS)) | np.arange(1 << langid.BITS, dtype=np.uint64)
        assert math.isclose(np.exp(langid.log_probability(model, full)).sum(), 1.0, rel_tol=1e-9)


def test_grams_by_hand():
    classes = langid.letter_classes([ord("a"), ord("b")])
    gram, ends = langid.codes(["A-b", None, ""], classes)
    a, b, e, w = 2, 3, langid.EDGE, langid.BITS
    assert ends.tolist() == [4, 5, 6]
    assert gram.tolist() == [a, e | a << w, b | e << w | a << 2 * w, e | b << w | e << 2 * w | a << 3 * w, e, e]


def test_language_held_out(spark, tiny):
    got = QUERIES["op3_language_id"](spark, tiny).join(spark.read.parquet(f"{tiny}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert len(got) > 20
    assert (got.lang == got.lang_pred).mean() >= 0.95
    assert got.score.between(0, 1).all()


def test_language_corner_cases(spark, docs, clash):
    model = langid.train(docs.select("text", "lang"))
    rows = [(1, None), (2, ""), (3, "12 34 !?"), (4, "the and of that with this"), (4, "the and of that with this"), (5, "日本"), (6, "der und die nicht " * 30_000), (7, "\x00é")]
    df = clash(spark.createDataFrame(rows, "doc_id long, text string"), ("lang_pred", "score", "row"))
    got = sorted((r.doc_id, r.lang_pred, r.rejected) for r in langid.identify(df, model).collect())
    assert [x for x in got if x[0] < 4] == [(i, "und", True) for i in (1, 2, 3)]
    assert [x[1] for x in got if x[0] in (4, 6)] == ["en", "en", "de"]
    assert len(got) == len(rows)
    assert langid.train(docs.limit(0)) is None
    none = langid.identify(df.select("doc_id", "text"), None).collect()
    assert {r.lang_pred for r in none} == {"und"}
    assert langid.identify(df.limit(0), model).collect() == []


def test_no_gram_is_left_out(spark):
    """A gram seen once counts, however much text there is."""
    rows = spark.createDataFrame([("the quick brown fox " * 60_000, "en"), ("zyxwv", "en")], "text string, lang string")
    model = langid.train(rows)
    gram, ends = langid.codes(["zyxwv"], model["classes"])
    five, one = model["models"][0][4], model["models"][0][0]
    assert np.isin(gram, five[0]).all()
    assert len(five[0]) == len(np.unique(langid.codes(["the quick brown fox " * 3, "zyxwv"], model["classes"])[0]))
    # continuation counts and the discount are those of all grams
    assert len(one[0]) == len(set("the quick brown fox" + "zyxwv"))


def test_rare_languages_have_letters_and_calibration(spark):
    """Scripts of a few documents among thousands are told apart, and each language is calibrated on its own texts."""
    common = [(f"the and of that with this number {'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10]} {i}", "en") for i in range(3000)]
    rare = [("καλημέρα κόσμε και πάλι", "el"), ("καλημέρα σε όλο τον κόσμο", "el"), ("สวัสดีชาวโลก", "th"), ("สวัสดีตอนเช้าทุกคน", "th")]
    model = langid.train(spark.createDataFrame(common + rare, "text string, lang string"), calibration=20)
    assert model["names"] == ["el", "en", "th"]
    assert np.isfinite(model["ceiling"]).all()
    own = model["classes"][[ord(c) for c in "κσสช"]]
    assert (own > langid.OTHER).all()
    assert len(set(own.tolist())) == 4
    probe = spark.createDataFrame([(1, "κόσμε"), (2, "ชาวโลก"), (3, "that number")], "doc_id long, text string")
    assert [r.lang_pred for r in langid.identify(probe, model).orderBy("doc_id").collect()] == ["el", "th", "en"]


def brute_models(texts, classes):
    """Kneser-Ney by dictionaries: of each order the counts, of lower orders how many letters a gram follows."""
    grams = []
    for t in texts:
        kinds = [int(classes[ord(c)]) for c in t.lower()] + [langid.EDGE]
        # of a run of other characters the one before a letter stays, and the text's end
        row = [langid.EDGE] * (langid.ORDER - 1)
        row += [k for i, k in enumerate(kinds) if k != langid.EDGE or i == len(kinds) - 1 or kinds[i + 1] != langid.EDGE]
        grams += [tuple(row[i : i + langid.ORDER]) for i in range(len(row) - langid.ORDER + 1)]
    counts = {langid.ORDER: Counter(grams)}
    for k in range(langid.ORDER - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    return grams, counts


def brute_probability(counts, gram):
    """From letters alike up to the whole gram, each order interpolated with the one below."""
    p = 1 / (1 << langid.BITS)
    for k in range(1, langid.ORDER + 1):
        c = counts[k]
        one, two = sum(n == 1 for n in c.values()), sum(n == 2 for n in c.values())
        d = one / (one + 2 * two) if one and two else 0.5
        part = gram[-k:]
        same = {g: n for g, n in c.items() if g[:-1] == part[:-1]}
        if total := sum(same.values()):
            p = max(same.get(part, 0) - d, 0) / total + d * len(same) / total * p
    return p


def test_cross_entropy_against_brute_force():
    classes = langid.letter_classes([ord(c) for c in "abcdeé"])
    train = ["abcabcabd ace, bad", "bcd  abcab é!", "eee abc", "xyz abc"]
    gram, _ = langid.codes(train, classes)
    model = langid.kneser_ney(*np.unique(gram, return_counts=True))
    _, counts = brute_models(train, classes)
    for text in ["abc", "dab bad ace", "éé x q", "", "...", "A-b"]:
        grams, _ = brute_models([text], classes)
        want = -sum(math.log(brute_probability(counts, g)) for g in grams) / len(grams)
        assert math.isclose(langid.cross_entropies([text], classes, [model])[0, 0], want, rel_tol=1e-9)


def test_unseen_scripts_are_rejected(spark, docs):
    model = langid.train(docs.select("text", "lang"))
    texts = ["Καλημέρα κόσμε, τι κάνεις σήμερα", "Съешь же ещё этих мягких французских булок", "日本語の文章です、元気ですか", "สวัสดีชาวโลกทุกคน"]
    got = langid.identify(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()
    assert all(r.rejected for r in got)


def test_equal_cross_entropies_go_to_the_first_name(spark):
    model = langid.train(spark.createDataFrame([("ein zwei drei", "b"), ("ein zwei drei", "a")], "text string, lang string"))
    got = langid.identify(spark.createDataFrame([(1, "zwei ein")], "doc_id long, text string"), model).first()
    assert (got.lang_pred, got.score) == ("a", 0.5)


def test_quality_held_out(spark, tiny):
    marks = spark.read.parquet(f"{tiny}/labels.parquet")
    got = QUERIES["op5_quality"](spark, tiny).join(marks, "doc_id").where("held_out").toPandas()
    assert (got.predicted == got.quality).mean() >= 0.9
    assert ((got.score >= 0.3) == (got.predicted == 1)).all()


def test_votes_against_brute_force(spark, docs, tiny):
    model = quality.fit(docs, spark.read.parquet(f"{tiny}/labels.parquet"), k=7)
    texts = [r.text for r in docs.orderBy("doc_id").limit(40).collect()]
    got = quality.vote(quality.look(texts), model)
    points = model["points"].astype(float)
    for i, t in enumerate(texts):
        v = quality.embed(quality.look([t]), model)[0].astype(float)
        s = points @ v
        best = np.argsort(-s)[:7]
        w = np.maximum(s[best], 0) ** quality.SHARPNESS
        assert abs(got[i] - (w * model["label"][best]).sum() / w.sum()) < 1e-3


def test_features_by_hand():
    row = quality.features(["abcabc", "", "ab", None])
    assert row.sum(axis=1).tolist() == [4, 0, 0, 0]
    assert sorted(Counter(row[0][row[0] > 0].tolist()).items()) == [(1.0, 2), (2.0, 1)]


def test_shapes_and_occurrences_by_hand():
    same = quality.shapes(["abc Def 12!", "xyz Qrs 98!", "abc def 12!", None])
    assert (same[0] == same[1]).all()
    assert (same[0] != same[2]).any()
    assert same.sum(axis=1).tolist() == [9, 9, 9, 0]
    row = quality.occurrences(["a a b a a a c", "", None, "x"])
    assert row[0][:4].tolist() == [3, 1, 2, 1]
    assert row[0][-2:].tolist() == [3, 4]
    assert row[1:3].sum() == 0
    assert row[3][0] == 1


def test_quality_corner_cases(spark, docs, tiny, clash):
    marks = spark.read.parquet(f"{tiny}/labels.parquet")
    model = quality.fit(docs, marks)
    df = clash(spark.createDataFrame([(1, None), (2, ""), (3, "a"), (4, "the of and " * 50_000), (4, "x"), (None, "x")], "doc_id long, text string"), ("score", "predicted"))
    got = quality.score(df, model).collect()
    assert len(got) == 6
    assert all(0 <= r.score <= 1 for r in got)
    assert abs(next(r.score for r in got if r.doc_id == 2) - next(r.score for r in got if r.doc_id == 1)) < 1e-12
    assert quality.fit(docs, marks.limit(0)) is None
    assert {r.predicted for r in quality.score(df, None).collect()} == {1}
    assert quality.score(df.limit(0), model).collect() == []
    twice = marks.unionByName(marks.withColumn("quality", F.lit(None).cast("int"))).unionByName(marks)
    assert quality.fit(docs, twice)["label"].tolist() == model["label"].tolist()


def test_fit_holds_its_terms_once(spark):
    """The driver's Python has one matrix of the labelled texts' terms, not one for each step, and the model is that of the whole matrices."""
    import tracemalloc

    rows = [(i, f"{'good plain words' if i % 2 else 'BUY!! $$$'} {i * 7919 % 1000} text {i % 13}", i % 2) for i in range(2400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    tracemalloc.start()
    model = quality.fit(df.select("doc_id", "text"), df.select("doc_id", "quality"))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 2 * len(rows) * quality.TERMS * 4
    texts = [t for v in (0, 1) for i, t, x in rows if x == v]
    seen = quality.look(texts)
    idf = [(np.log((1 + len(texts)) / (1 + (c > 0).sum(axis=0))) + 1).astype(np.float32) for c in seen[:2]]
    assert all((a == b).all() for a, b in zip(idf, model["idf"], strict=False))
    assert np.allclose(quality.embed(seen, model), model["points"], atol=1e-5)
