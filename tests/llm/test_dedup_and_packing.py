import hashlib
import itertools
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from gapline.llm import langid, minhash, mixing, packing, quality
from gapline.llm.queries import QUERIES, tokenizer_path


def weighted(text, n=5):
    w = (text or "").lower().split()
    out = {}
    for i in range(max(1, len(w) - n + 1) if w else 0):
        k = tuple(w[i : i + n])
        out[k] = out.get(k, 0) + 1
    return {k: 1 + np.log(v) for k, v in out.items()}


def brute_similarity(a, b):
    keys = set(a) | set(b)
    return sum(1 / sum(max(a.get(k, 0) / a[d], b.get(k, 0) / b[d]) for k in keys) for d in set(a) & set(b))


words = st.lists(st.sampled_from("abc"), max_size=14).map(" ".join)


@settings(max_examples=60, deadline=None)
@given(words, words)
def test_similarity_against_its_definition(x, y):
    doc, sh, w = minhash.shingles(pa.array([x, y]), 2)
    cut = np.searchsorted(doc, [0, 1, 2])
    parts = [(sh[a:b], w[a:b]) for a, b in itertools.pairwise(cut)]
    assert abs(minhash.similarity(*parts[0], *parts[1]) - brute_similarity(weighted(x, 2), weighted(y, 2))) < 1e-9


def test_signatures_estimate_similarity():
    rng = random.Random(1)
    base = [f"w{rng.randrange(500)}" for _ in range(300)]
    texts = [" ".join(base)]
    for rate in (0.01, 0.05, 0.1):
        texts.append(" ".join(w if rng.random() > rate else f"v{rng.randrange(500)}" for w in base))
    doc, sh, w = minhash.shingles(pa.array(texts))
    sig = minhash.signatures(doc, sh, w, len(texts), 2000)
    for i in range(1, 4):
        assert abs((sig[0] == sig[i]).mean() - brute_similarity(weighted(texts[0]), weighted(texts[i]))) < 0.05


def groups(texts):
    """Classes by all pairs: equal texts, or a similarity of 0.8."""
    ids = range(len(texts))
    root = list(ids)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    sets = [weighted(t) for t in texts]
    for i, j in itertools.combinations(ids, 2):
        if texts[i] is not None and texts[i] == texts[j] or (sets[i] and sets[j] and brute_similarity(sets[i], sets[j]) >= 0.8):
            a, b = sorted((find(i), find(j)))
            root[b] = a
    return [find(i) for i in ids]


def test_classes_against_brute_force(spark, clash):
    rng = random.Random(7)
    texts = [None, None, "", "", "one two", "one two", "ONE two", "!!"]
    for _ in range(12):
        base = [f"w{rng.randrange(90)}" for _ in range(rng.choice([6, 40, 120]))]
        texts.append(" ".join(base))
        for _ in range(rng.randrange(6)):
            c = list(base)
            for _ in range(rng.choice([0, 1, 2, 6])):
                c[rng.randrange(len(c))] = f"x{rng.randrange(99)}"
            texts.append(" ".join(c))
    df = clash(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), ("digest", "key", "class_id", "kept", "sig", "bands"))
    got = {r.doc_id: r.class_id for r in minhash.near_duplicates(df, block=4).collect()}
    want = groups(texts)
    assert [got[i] for i in range(len(texts))] == want


def test_hot_group(spark):
    """Many near copies of one text, and texts near some of them only, end in the classes of brute force."""
    rng = random.Random(3)
    base = [f"w{i}" for i in range(60)]
    texts = []
    for _ in range(90):
        c = list(base)
        for _ in range(rng.choice([0, 1, 1, 2, 3])):
            c[rng.randrange(len(c))] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(c))
    got = {r.doc_id: r.class_id for r in minhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), block=8).collect()}
    assert [got[i] for i in range(len(texts))] == groups(texts)


def test_dedup_corner_cases(spark):
    df = spark.createDataFrame([(2, "a b c"), (1, "a b c"), (1, "a b c"), (None, "a b c"), (3, "x " * 150_000)], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.class_id, r.kept) for r in minhash.near_duplicates(df).collect())
    assert got == [(0, None, True), (1, 1, True), (1, 1, True), (2, 1, False), (3, 3, True)]
    assert minhash.near_duplicates(df.limit(0)).collect() == []


def test_ids_with_several_texts(spark):
    """Rows of one id and different texts are documents of their own, in any order of rows."""
    rng = random.Random(11)
    base = [f"w{i}" for i in range(50)]
    near = lambda: " ".join(base[:20] + [f"y{rng.randrange(99)}"] + base[21:])
    other = " ".join(f"z{i}" for i in range(40))
    rows = [(1, " ".join(base)), (1, other), (2, near()), (2, other), (2, "alone in the world"), (3, near()), (3, near()), (0, "one two three"), (1, other)]
    texts = [t for _, t in rows]
    root = groups(texts)
    want = []
    for (i, t), r in zip(rows, root, strict=True):
        members = [rows[k] for k in range(len(rows)) if root[k] == r]
        first = min(members, key=lambda x: (x[0], hashlib.md5(x[1].encode()).hexdigest()))
        want.append((i, t, first[0], (i, t) == first))
    for seed in range(4):
        order = list(range(len(rows)))
        random.Random(seed).shuffle(order)
        df = spark.createDataFrame([rows[k] for k in order], "doc_id long, text string")
        found = minhash.near_duplicates(df).select("doc_id", "digest", "class_id", "kept")
        got = sorted((r.doc_id, r.digest, r.class_id, r.kept) for r in found.collect())
        assert got == sorted((i, hashlib.md5(t.encode()).hexdigest(), c, k) for i, t, c, k in want)


def test_recall_by_edit_rate(spark):
    """Of pairs whose similarity reaches 0.8, every one is linked at any rate of edits; under it, none is."""
    rng = random.Random(5)
    texts, rate_of = [], []
    for rate in (0.002, 0.005, 0.01, 0.02, 0.03, 0.05):
        for _ in range(25):
            base = [f"w{rng.randrange(10**6)}" for _ in range(rng.choice([80, 300]))]
            copy = [w if rng.random() > rate else f"v{rng.randrange(10**6)}" for w in base]
            texts += [" ".join(base), " ".join(copy)]
            rate_of += [rate, rate]
    got = {r.doc_id: r.class_id for r in minhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i in range(0, len(texts), 2):
        near = brute_similarity(weighted(texts[i]), weighted(texts[i + 1])) >= 0.8
        assert (got[i] == got[i + 1]) == near, rate_of[i]


@pytest.fixture(scope="module")
def coder():
    with open(tokenizer_path(), "rb") as f:
        return packing.WordCoder(f.read())


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=40) | st.text(alphabet="abZÀé's .,<|>0\x02\n", max_size=40) | st.none(), max_size=6))
def test_ids_are_the_tokenizers(coder, texts):
    ids, ends = packing.encode_texts(pa.array(texts, pa.string()), coder, 2)
    start = 0
    for t, end in zip(texts, ends, strict=True):
        assert ids[start:end].tolist() == [*coder.tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
        start = end


def test_special_tokens_in_text(coder):
    texts = ["a<|endoftext|>b", "<|startoftext|> x"]
    ids, ends = packing.encode_texts(pa.array(texts), coder, 2)
    assert ids[: ends[0]].tolist() == [*coder.tokenizer.encode(texts[0], add_special_tokens=False).ids, 2]


def check_packing(pieces, want):
    """Each id in exactly one piece, sequences gapless, full windows of a power of two."""
    seen, sequences = {}, {}
    for p in pieces:
        ids = want[p.doc_id]
        assert p.doc_tokens == len(ids)
        assert p.ids_crc32 == zlib.crc32(np.array(ids[p.start : p.start + p.length], "<u4").tobytes())
        seen.setdefault(p.doc_id, []).append((p.start, p.length))
        sequences.setdefault(p.sequence_id, []).append((p.offset, p.length, p.window))
    for doc, ids in want.items():
        at = 0
        for start, n in sorted(seen[doc]):
            assert start == at
            at += n
        assert at == len(ids)
    for parts in sequences.values():
        at = 0
        for offset, n, window in sorted(parts):
            assert offset == at
            at += n
        assert at == window <= 4096
        assert at & (at - 1) == 0


def test_packing(spark, coder, docs, clash):
    rows = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(10_001, None), (10_002, ""), (10_003, "word " * 60_000)], "doc_id long, text string"))
    pieces = packing.pack(clash(rows.repartition(3), ("start", "length", "window")), tokenizer_path()).collect()
    want = {r.doc_id: [*coder.tokenizer.encode(r.text or "", add_special_tokens=False).ids, 2] for r in rows.collect()}
    check_packing(pieces, want)
    assert len({p.sequence_id for p in pieces if p.window < 512}) <= 3 * 9  # only the ends of tasks


def test_packing_corner_cases(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (None, "b")], "doc_id long, text string")
    got = packing.pack(df.coalesce(1), tokenizer_path()).collect()
    assert sorted(p.length for p in got) == [2, 2, 2]
    assert packing.pack(df.limit(0), tokenizer_path()).collect() == []


def test_step_groups_weigh_the_same():
    packer = packing.Packer(0, packing.TIERS, 8192)
    rng = np.random.default_rng(1)
    for i in range(300):
        packer.add(i, rng.integers(0, 100, int(rng.integers(1, 6000))).astype(np.uint32))
    packer.flush()
    packer.flush(last=True)
    weight = {}
    for r in packer.rows:
        weight[r[8]] = weight.get(r[8], 0) + r[2]
    assert max(weight.values()) == 8192
    assert sum(w < 8192 for w in weight.values()) <= 4 + 9


def test_pipeline_stages(spark, tiny, docs, coder):
    """Each stage keeps what its operator, applied by itself to the stage's input, says."""
    run = dict(corpus_pipeline.STAGES)
    key = lambda df: sorted((r.doc_id, r.text) for r in df.select("doc_id", "text").collect())
    good = run["quality classifier"](spark, docs, tiny).persist()
    assert good.columns == docs.columns
    marks = spark.read.parquet(f"{tiny}/labels.parquet")
    scored = quality.score(docs, quality.fit(docs, marks))
    assert key(good) == key(scored.where("score >= 0.3"))
    clean = docs.join(marks.where("quality = 1"), "doc_id").count()
    assert good.join(marks.where("quality = 1"), "doc_id").count() >= 0.98 * clean
    spoken = run["language id"](spark, good, tiny).persist()
    assert key(spoken) == key(langid.identify(good, langid.train(good)).where("not rejected"))
    assert spoken.count() >= 0.98 * good.count()
    one = run["minhash near-dedup"](spark, spoken, tiny).persist()
    rows = spoken.orderBy("doc_id").collect()
    lab = groups([r.text for r in rows])
    assert sorted(r.doc_id for r in one.collect()) == [rows[i].doc_id for i in sorted(set(lab))]
    mixed = run["mixing"](spark, one, tiny).persist()
    want = {r.doc_id: r.copies for r in mixing.mix(one).collect()}
    assert {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()} == {d: n for d, n in want.items() if n}
    pieces = run["packing"](spark, mixed, tiny)
    texts = {r.doc_id: r.text for r in one.collect()}
    total = sum(n * (len(coder.tokenizer.encode(texts[d] or "", add_special_tokens=False).ids) + 1) for d, n in want.items())
    assert pieces.agg(F.sum("length")).first()[0] == total


def test_pipeline_keeps_one_row_of_a_group(spark, tiny):
    """Repeated rows, ids with several texts, and null ids and texts."""
    rows = [(1, "a b c d e f", "en", "s"), (1, "a b c d e f", "en", "s"), (1, "g h i j k l", "en", "s"), (2, "a b c d e f", "en", "s"), (3, None, "en", "s"), (3, None, "en", "s"), (None, "a b c d e f", "en", "s"), (2, "m n o p q r", "en", "t")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text"))
    got = dict(corpus_pipeline.STAGES)["minhash near-dedup"](spark, docs, tiny).collect()
    assert sorted((str(r.doc_id), str(r.text)) for r in got) == [("1", "a b c d e f"), ("1", "g h i j k l"), ("2", "m n o p q r"), ("3", "None"), ("3", "None"), ("None", "a b c d e f")]


def test_pipeline_runs(spark, tiny):
    assert QUERIES["pipeline"](spark, tiny).count() > 0
