"""Exact top-k search by distributed histogram selection.

Every candidate is scored against every query. A few passes of score histograms narrow, for each query, the interval
that holds its kth best score until the interval is one integer wide; a last pass keeps what reaches that score and breaks
ties by the smaller id. No pass moves scores: a task sends at most k + 1 histogram bins, and at last k + 1 rows, for a query.

Queries and candidates are rows, not ids: a query's own row is one candidate row of its id and vector, which every pass counts and
the driver takes off its bin again, so no row needs a number of its own.

Bounds: queries go out in blocks of ``block`` rows (``block`` x dimension doubles are broadcast at a time); the driver
gets one interval per query of a block. What a block finds is appended to a table in the shared folder, so the plan of the
result does not grow with the number of blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gapline.llm.common import cut, discard, new_path, written
from gapline.llm.vectors import matrices

CHUNK = 2048
BINS = 1024
FOUND = "block int, q int, times long, query_id long, vec_id long, score long, own boolean"


def quantise(x: np.ndarray) -> np.ndarray:
    """floor(256 x), kept as whole doubles."""
    return np.floor(256.0 * x)


def _scores(c: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Integer inner products; exact in doubles below 2**53, else by whole numbers. An inner product beyond a long is an error."""
    most = float(np.abs(c).max(initial=0)) * float(np.abs(q).max(initial=0)) * c.shape[1]
    if most < 2**53:
        return (c @ q.T).astype(np.int64)
    ints = lambda m: np.array([[int(v) for v in r] for r in m], dtype=object).reshape(m.shape)
    whole = ints(c) @ ints(q).T
    if any(abs(v) >= 2**62 for v in whole.flat):
        raise ArithmeticError("a score is beyond a long: scale the vectors down")
    return whole.astype(np.int64)


def _blocks(batches: Iterator[pa.RecordBatch], queries: dict) -> Iterator[tuple]:
    """Yield ``(positions of the queries, candidate ids, scores with a row per query, which pairs are equal in id and vector)``."""
    for b in batches:
        for _, ids, m in matrices(b.column(0), b.column(1)):
            if (q := queries.get(m.shape[1])) is None:
                continue
            for i in range(0, len(ids), CHUNK):
                part, x = ids[i : i + CHUNK], m[i : i + CHUNK]
                s = _scores(quantise(x), q["quantised"]).T
                r, c = np.nonzero(q["ids"][:, None] == part[None, :])
                same = (q["matrix"][r] == x[c]).all(axis=1)
                own = np.zeros(s.shape, bool)
                own[r[same], c[same]] = True
                yield q["at"], part, s, own


def _histogram(queries, low, width, bins_in_use, k):
    def run(batches):
        lo, w = low.value, width
        n = len(lo)
        counts = np.zeros((n, BINS), np.int64)
        own_rows = np.zeros(n, np.int64)
        for at, _, s, own in _blocks(batches, queries.value):
            bins = (s - lo[at][:, None]) // w
            r, c = np.nonzero((bins >= 0) & (bins < bins_in_use))
            counts += np.bincount(at[r] * BINS + bins[r, c], minlength=n * BINS).reshape(n, BINS)
            own_rows[at] += own.sum(axis=1)
        # what lies under a task's own best k and a query's own row can't hold the kth best of all
        above = np.cumsum(counts[:, ::-1], axis=1)[:, ::-1] - counts
        r, c = np.nonzero((counts > 0) & (above < k + 1))
        mine = np.flatnonzero(own_rows)
        q, b, m = np.concatenate([r, mine]), np.concatenate([c, np.full(len(mine), -1)]), np.concatenate([counts[r, c], own_rows[mine]])
        yield pa.RecordBatch.from_arrays([pa.array(q.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(m)], ["q", "bin", "n"])

    return run


def _best(at, ids, score, own, k):
    """Of each query the ``k`` best rows, a query's own among equals first."""
    order = np.lexsort((~own, ids, -score, at))
    at, ids, score, own = at[order], ids[order], score[order], own[order]
    if not len(at):
        return at, ids, score, own
    first = np.r_[True, at[1:] != at[:-1]]
    keep = np.arange(len(at)) - np.maximum.accumulate(np.where(first, np.arange(len(at)), 0)) < k
    return at[keep], ids[keep], score[keep], own[keep]


def _collect(queries, floor, names, block, k):
    def run(batches):
        least, (called, times) = floor.value, names.value
        held = (np.zeros(0, np.int64),) * 3 + (np.zeros(0, bool),)
        for at, ids, s, own in _blocks(batches, queries.value):
            r, c = np.nonzero(s >= least[at][:, None])
            new = _best(at[r], ids[c], s[r, c], own[r, c], k + 1)
            held = _best(*(np.concatenate(x) for x in zip(held, new, strict=True)), k + 1)
        q = held[0]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(q), block, np.int32)), pa.array(q.astype(np.int32)), pa.array(times[q]), pa.array(called[q]), pa.array(held[1]), pa.array(held[2]), pa.array(held[3])],
            [c.split()[0] for c in FOUND.split(", ")],
        )

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, block: int = 1024, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """The ``k`` best candidates of every query by integer inner product of ``floor(256 x)``.

    ``vectors`` and ``queries`` hold a long id and an array of numbers; other columns are ignored. Returns ``query_id``,
    ``rank`` (from 1), ``vec_id``, ``score``; ties go to the smaller id. Defined cases: null ids or vectors and vectors with
    null or non-finite components take no part; vectors of different lengths aren't compared; every query row is a query of its own,
    whatever its id, and every vector row a candidate; of the candidates with a query's id and vector one, the query's own
    row, is left out; a query with fewer candidates returns them all; no queries or no candidates give an empty result; a score
    beyond 2**62 is an error, never a rounded value.
    """
    spark = vectors.sparkSession
    sc = spark.sparkContext
    data = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v"))
    sound = "vec_id is not null and v is not null and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))"
    asked = queries.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v")).where(sound)
    # 0.0 and -0.0 are one value
    asked = cut(asked.withColumn("v", F.expr("transform(v, x -> x + 0.0D)")).groupBy("vec_id", "v").agg(F.count(F.lit(1)).alias("times")))
    size = F.aggregate(F.transform("v", lambda x: F.pow(F.abs(F.floor(x * 256.0).cast("double")) + 1.0, 2)), F.lit(0.0), lambda a, x: a + x)
    longest = data.where(sound).agg(F.max(size)).first()[0]
    path, last, number = new_path(spark), None, 0
    while True:
        part = asked if last is None else asked.where(F.struct("vec_id", "v") > F.struct(F.lit(last[0]).alias("vec_id"), F.lit(last[1]).cast("array<double>").alias("v")))
        rows = part.orderBy("vec_id", "v").limit(block).toArrow()
        if not rows.num_rows:
            break
        last = (rows.column(0)[-1].as_py(), rows.column(1)[-1].as_py())
        _block(data, rows, number, k, longest or 0.0, sc).write.mode("append").parquet(path)
        number += 1
        if rows.num_rows < block:
            break
    if not number:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    found = written(spark, FOUND, path)
    of = lambda *more: Window.partitionBy("block", "q", *more).orderBy(F.desc("score"), "vec_id", F.desc("own"))
    found = found.withColumn("_nth", F.row_number().over(of("own"))).where("not (own and _nth = 1)")
    best = found.withColumn("rank", F.row_number().over(of())).where(F.col("rank") <= k)
    return best.withColumn("_again", F.explode(F.expr("sequence(1L, times)"))).select("query_id", "rank", "vec_id", "score")


def _block(data: DataFrame, rows: pa.Table, number: int, k: int, longest: float, sc) -> DataFrame:
    by_size, names, self_score = {}, [], []
    order = pa.array(np.arange(rows.num_rows), pa.int64())
    for _, at, m in matrices(order, rows.column(1).combine_chunks()):
        q = quantise(m)
        by_size[m.shape[1]] = {"ids": rows.column(0).to_numpy()[at], "matrix": m, "quantised": q, "at": at}
        names.extend(at.tolist())
        self_score.extend(int(_scores(x[None], x[None])[0, 0]) for x in q)
    n = rows.num_rows
    own_score = np.zeros(n, np.int64)
    own_score[names] = self_score
    queries = sc.broadcast(by_size)
    power = max(1, math.ceil(math.log2(longest + 2))) if longest < 2.0**61 else 62  # |score| <= the longest vector's square
    low, span = np.full(n, -(2**power), np.int64), 2 ** (power + 1)
    need, has_own = np.full(n, k, np.int64), None
    while span > 1:
        width = max(1, span // BINS)
        run = _histogram(queries, sc.broadcast(low.copy()), width, span // width, k)
        counts = cut(data.mapInArrow(run, "q int, bin int, n long").groupBy("q", "bin").agg(F.sum("n").alias("n")))
        if has_own is None:
            has_own = np.zeros(n, bool)
            has_own[[r.q for r in counts.where("bin = -1").select("q").collect()]] = True
        own_bin = np.where(has_own & (own_score >= low) & (own_score - low <= span - 1), (own_score - low) // width, -2)
        wanted = data.sparkSession.createDataFrame(pa.table({"q": pa.array(np.arange(n, dtype=np.int32)), "need": pa.array(need), "own_bin": pa.array(own_bin.astype(np.int32))}))
        each = counts.where("bin >= 0").join(F.broadcast(wanted), "q").withColumn("n", F.expr("n - if(bin = own_bin, 1, 0)"))
        each = each.withColumn("upto", F.sum("n").over(Window.partitionBy("q").orderBy(F.desc("bin"))))
        kth = each.where("upto >= need and upto - n < need").select("q", "bin", F.expr("need - (upto - n)").alias("left")).toArrow().to_pydict()
        discard(counts)
        q, b = np.array(kth["q"], np.int64), np.array(kth["bin"], np.int64)
        low[q] += b * width
        need[q] = kth["left"]
        span = width
    called, times = rows.column(0).to_numpy(), rows.column(2).to_numpy()
    return data.mapInArrow(_collect(queries, sc.broadcast(low), sc.broadcast((called, times)), number, k), FOUND)
