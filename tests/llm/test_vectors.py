import numpy as np
import pytest
from pyspark.sql import functions as F

from gapline.llm import embedding_dedup, topk
from gapline.llm.common import components
from gapline.llm.queries import ORACLE_SQL, QUERIES
from tests.oracle import compare, connect

SCHEMA = "vec_id long, embedding array<float>"


def clusters(seed=1, n=400, dims=16):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((n // 4, dims))
    x = np.concatenate([base, *[base[: n // 4] + rng.normal(0, s, (n // 4, dims)) for s in (0.05, 0.15, 0.3)]]).astype(np.float32)
    return x[rng.permutation(len(x))]


def brute(x, threshold):
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    link = u @ u.T >= threshold
    np.fill_diagonal(link, False)
    lab = np.arange(len(x))
    while True:
        new = np.array([min(lab[i], *lab[link[i]]) if link[i].any() else lab[i] for i in range(len(x))])
        if (new == lab).all():
            return link.sum(axis=1), lab
        lab = new


def test_links_against_brute_force(spark, clash):
    x = clusters()
    df = clash(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], SCHEMA))
    got = embedding_dedup.near_duplicate_vectors(df, 0.95, target=120, block=16).orderBy("vec_id").toPandas()
    n, lab = brute(x, 0.95)
    assert got.n_links.sum() <= n.sum()
    assert got.n_links.sum() >= 0.9 * n.sum()  # recall of links
    assert (got.n_links.values <= n).all()
    assert (got.kept == (got.component_id == got.vec_id)).all()
    if got.n_links.sum() == n.sum():
        assert (got.component_id.values == lab).all()


def test_recall_with_thousands_of_cells(spark):
    """Two rows a cell on average, as many cells as the bound allows."""
    rng = np.random.default_rng(2)
    base = rng.standard_normal((1500, 48))
    x = np.concatenate([base, base + rng.normal(0, 0.1, base.shape), base + rng.normal(0, 0.2, base.shape), base + rng.normal(0, 0.3, base.shape)]).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], SCHEMA)
    got = embedding_dedup.near_duplicate_vectors(df, 0.95, target=5).orderBy("vec_id").toPandas()
    n, _ = brute(x, 0.95)
    assert (got.n_links.values <= n).all()
    assert got.n_links.sum() >= 0.9 * n.sum()


def test_ids_with_several_vectors(spark):
    """Rows are vectors of their own, whatever their ids."""
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.01]), (3, [0.02, 1.0]), (0, [0.01, 1.0]), (2, [-1.0, 0.0]), (2, [-1.0, 0.0])]
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_duplicate_vectors(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == sorted([(1, 1, 1, True), (2, 1, 1, False), (1, 2, 0, False), (3, 2, 0, False), (0, 2, 0, True), (2, 1, 2, True), (2, 1, 2, True)])


def test_vector_corner_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [1.0, 0.0]), (3, [1.0, 0.0]), (4, None), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [None, 1.0]), (9, [1.0]), (10, []), (None, [1.0, 0.0]), (11, [3e38, 0.0])]
    got = sorted((r.vec_id or 0, r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_duplicate_vectors(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == [(0, 0, None, True), (1, 4, 1, True), (2, 4, 1, False), (3, 4, 1, False), (3, 4, 1, False), *[(i, 0, i, True) for i in range(4, 11)], (11, 4, 1, False)]
    assert embedding_dedup.near_duplicate_vectors(spark.createDataFrame([], SCHEMA)).collect() == []


def test_top_k_against_brute_force(spark, clash):
    rng = np.random.default_rng(3)
    x = np.round(rng.standard_normal((150, 6)), 1).astype(np.float32)  # many ties
    x[70:90] = x[70]
    df = clash(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], SCHEMA), ("score", "v", "q"))
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in topk.top_k(df, df.where("vec_id % 10 = 0"), 5, block=4).collect()}
    q = np.floor(256 * x.astype(float)).astype(np.int64)
    want = {}
    for i in range(0, 150, 10):
        s = q @ q[i]
        for k, j in enumerate([j for j in np.lexsort((np.arange(150), -s)) if j != i][:5]):
            want[i, k + 1] = (j, s[j])
    assert got == want


def test_top_k_corner_cases(spark):
    nan = float("nan")
    rows = [(0, [1.0, 1.0]), (1, [1.0, 0.0]), (2, None), (3, [nan, 1.0]), (4, [None, 1.0]), (5, [1.0]), (None, [1.0, 1.0]), (6, [-1.0, -1.0]), (6, [-1.0, -1.0])]
    df = spark.createDataFrame(rows, SCHEMA)
    got = [tuple(r) for r in topk.top_k(df, df.where("vec_id in (0, 3, 5)"), 5).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1, 65536), (0, 2, 6, -131072), (0, 3, 6, -131072)]
    assert topk.top_k(df.limit(0), df.limit(0), 5).collect() == []
    assert topk.top_k(df, df.limit(0), 5).collect() == []
    big = spark.createDataFrame([(0, [6e6, 1.0]), (1, [6e6, 2.0])], "vec_id long, embedding array<double>")
    assert sorted(r.score for r in topk.top_k(big, big, 5).collect()) == [(6_000_000 * 256) ** 2 + 2 * 256 * 256] * 2


def test_top_k_with_repeated_ids(spark):
    """Rows are queries and candidates, whatever their ids; only one row of a query's id and vector is its own."""
    rng = np.random.default_rng(9)
    x = rng.integers(-2, 3, (60, 3)).astype(float)
    ids = [int(i) for i in rng.integers(0, 20, 60)]
    ids[3:6] = [10, 10, 10]
    x[3:6] = [2.0, -0.0, 1.0]
    x[4, 1] = 0.0
    df = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<double>").repartition(7)
    got = sorted(tuple(r) for r in topk.top_k(df, df.where("vec_id % 10 = 0"), 5, block=3).collect())
    q = np.floor(256 * x).astype(np.int64)
    want = []
    for i in range(60):
        if ids[i] % 10 == 0:
            best = sorted((-int(q[j] @ q[i]), ids[j]) for j in range(60) if j != i)[:5]
            want += [(ids[i], k + 1, v, -s) for k, (s, v) in enumerate(best)]
    assert got == sorted(want)


def test_top_k_when_queries_are_no_candidates(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [3.0]), (2, [2.0])], SCHEMA)
    ask = spark.createDataFrame([(0, [2.0]), (7, [1.0])], SCHEMA)
    got = sorted(tuple(r) for r in topk.top_k(df, ask, 2).collect())
    assert got == [(0, 1, 1, 512 * 768), (0, 2, 2, 512 * 512), (7, 1, 1, 256 * 768), (7, 2, 2, 256 * 512)]


def test_scores_beyond_a_long_are_an_error():
    with pytest.raises(ArithmeticError, match="beyond a long"):
        topk._scores(np.array([[2.0**40, 1.0]]), np.array([[2.0**40, 1.0]]))
    assert topk._scores(np.array([[2.0**30 + 1, 1.0]]), np.array([[2.0**30, 3.0]])).tolist() == [[2**60 + 2**30 + 3]]


@pytest.mark.parametrize("few", [0, 1000])
def test_components(spark, few):
    edges = [(i, i + 1) for i in range(30)] + [(100, 101), (101, 100), (50, 50)] + [(200, i) for i in range(150, 190)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long"), few=few).collect()}
    assert got == {**dict.fromkeys(range(31), 0), 100: 100, 101: 100, 200: 150, **dict.fromkeys(range(150, 190), 150)}
    assert components(spark.createDataFrame([], "a long, b long"), few=few).collect() == []


@pytest.mark.parametrize("name", ["op1_embedding_near_dedup", "op10_top_k"])
def test_parity(name, spark, tiny):
    compare(connect(tiny), QUERIES[name](spark, tiny), ORACLE_SQL[name])


def test_hot_vectors_leave_few_rows(spark):
    """A third of all vectors almost equal: every count is right though no pair is listed."""
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.standard_normal((200, 8)), np.ones((100, 8)) + rng.normal(0, 0.01, (100, 8))]).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], SCHEMA).withColumn("label", F.lit(1))
    got = embedding_dedup.near_duplicate_vectors(df, block=16).orderBy("vec_id").toPandas()
    assert (got.n_links.values[200:] >= 99).all()
    assert (got.component_id.values[200:] <= 200).all()
