"""Near-duplicate vectors: spherical k-means cells, blocked cosine products inside cells, one representative a group.

Equal vectors are collapsed first, into one node a vector; ids come back at the end, so an id may have several vectors. Cell
centres are fitted by rounds of Lloyd's algorithm over a bounded sample (``per_cell`` vectors a cell, chosen by hash): a
round is one distributed pass in which each task sums the vectors nearest to each centre, so the driver holds centres
and never the sample. Every vector is then put in all cells whose centre is within ``margin`` of its best cosine. Two vectors are
compared in the smallest cell they share, so a link is counted once however many cells they share. A cell is cut into blocks of
``block`` rows and each pair of blocks is one task's product: no task holds a whole cell, and a task returns one row per
vector (its number of links and the smallest node linked inside the pair of blocks), never the pairs.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapline.llm.common import components, cut, discard
from gapline.llm.vectors import matrices

#: Rows that meet all centres at a time: at 4,096 centres a product of 16 MB.
ROWS = 512


def _unit(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows with a direction, scaled to length 1, and which they are; scaled by the largest component first, against overflow."""
    top = np.abs(m).max(axis=1, initial=0.0)
    rows = np.flatnonzero(top > 0)
    x = m[rows] / top[rows, None]
    return x / np.linalg.norm(x, axis=1, keepdims=True), rows


def _sums(centres):
    """Of each centre, the sum and the number of the rows nearest to it."""

    def run(batches):
        c = centres.value
        total, size = np.zeros_like(c), np.zeros(len(c), np.int64)
        for b in batches:
            for _, _, m in matrices(b.column("node"), b.column("v")):
                x, _ = _unit(m)
                for i in range(0, len(x), ROWS):
                    part = x[i : i + ROWS]
                    near = (part @ c.T).argmax(axis=1)
                    order = np.argsort(near, kind="stable")
                    cell, first = np.unique(near[order], return_index=True)
                    total[cell] += np.add.reduceat(part[order], first, axis=0)
                    size += np.bincount(near, minlength=len(c))
        on = np.flatnonzero(size)
        n = c.shape[1]
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(on) + 1, dtype=np.int32) * n), pa.array(total[on].ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(on.astype(np.int32)), pa.array(size[on]), lists], ["cell", "n", "total"])

    return run


def _add(key, table):
    xs = table.column("total").combine_chunks()
    total = xs.flatten().to_numpy(zero_copy_only=False).reshape(table.num_rows, -1).sum(axis=0)
    return pa.table({"cell": pa.array([key[0].as_py()], pa.int32()), "total": pa.array([total.tolist()], pa.list_(pa.float64()))})


def spherical_kmeans(sample: DataFrame, k: int, rounds: int = 8) -> np.ndarray:
    """At most ``k`` unit centres of vectors of one length (``node``, ``h``, ``v``) by cosine.

    The first centres are the ``k`` vectors with the smallest ``h``; a cell that no vector is nearest to goes. The driver gets
    ``k`` vectors a round.
    """
    sc = sample.sparkSession.sparkContext
    start = sample.orderBy("h").limit(k).select("node", "v").toArrow()
    c = np.concatenate([_unit(m)[0] for _, _, m in matrices(*start.columns)])
    for _ in range(rounds):
        parts = sample.select("node", "v").mapInArrow(_sums(sc.broadcast(c)), "cell int, n long, total array<double>")
        got = parts.groupBy("cell").applyInArrow(_add, "cell int, total array<double>").orderBy("cell").toArrow().column("total").combine_chunks()
        total = got.flatten().to_numpy(zero_copy_only=False).reshape(len(got), -1)
        c = total / np.maximum(np.linalg.norm(total, axis=1, keepdims=True), 1e-30)
    return c


def _assign(centres, margin):
    def run(batches):
        for b in batches:
            for at, ids, m in matrices(b.column("node"), b.column("v")):
                if (c := centres.value.get(m.shape[1])) is None:
                    continue
                x, rows = _unit(m)
                weight = b.column("copies").to_numpy(zero_copy_only=False)[at]
                for i in range(0, len(rows), ROWS):
                    part, r = x[i : i + ROWS], rows[i : i + ROWS]
                    s = part @ c.T
                    near, cell = np.nonzero(s >= s.max(axis=1, keepdims=True) - margin)
                    ends = np.searchsorted(near, np.arange(len(r) + 1)).astype(np.int32)
                    lists = lambda off, v: pa.ListArray.from_arrays(pa.array(off), pa.array(v))
                    n = m.shape[1]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ids[r]), pa.array(weight[r]), lists(ends, cell.astype(np.int32)), lists(np.arange(len(r) + 1, dtype=np.int32) * n, part.ravel())],
                        ["node", "copies", "cells", "x"],
                    )

    return run


def _labels(adj: np.ndarray) -> np.ndarray:
    """Smallest reachable row of each row of a symmetric boolean matrix."""
    lab = np.arange(len(adj))
    while True:
        new = np.minimum(lab, np.where(adj, lab[None, :], len(adj)).min(axis=1))
        new = new[new]
        if (new == lab).all():
            return lab
        lab = new


def _tile(threshold):
    def run(key, table):
        cell, i, j = (k.as_py() for k in key[:3])
        part = table.column("part").to_numpy()
        ids = table.column("node").to_numpy()
        weight = table.column("copies").to_numpy()
        xs = table.column("x").combine_chunks()
        x = xs.values.to_numpy(zero_copy_only=False).reshape(len(ids), -1)
        order = np.argsort(ids, kind="stable")
        part, ids, weight, x = part[order], ids[order], weight[order], x[order]
        a = np.flatnonzero(part == i)
        b = np.flatnonzero(part == j)
        link = np.zeros((len(ids), len(ids)), bool)
        link[np.ix_(a, b)] = (x[a] @ x[b].T) >= threshold
        link |= link.T
        np.fill_diagonal(link, False)
        rows = np.flatnonzero(link.any(axis=1))
        link = link[np.ix_(rows, rows)]
        if len(rows):
            # a pair that shares a smaller cell is counted there
            cells = table.column("cells").combine_chunks().take(pa.array(order[rows]))
            of = np.repeat(np.arange(len(rows)), np.diff(cells.offsets.to_numpy()))
            vals = cells.flatten().to_numpy()
            low = vals < cell
            if low.any():
                names, col = np.unique(vals[low], return_inverse=True)
                member = np.zeros((len(rows), len(names)), np.float32)
                member[of[low], col] = 1
                link &= (member @ member.T) < 0.5
        lab = _labels(link) if len(rows) else rows
        n = link @ weight[rows] if len(rows) else np.zeros(0, np.int64)
        on = n > 0
        return pa.table({"node": pa.array(ids[rows][on]), "n": pa.array(n[on].astype(np.int64)), "least": pa.array(ids[rows][lab][on])})

    return run


def near_duplicate_vectors(vectors: DataFrame, threshold: float = 0.95, margin: float = 0.05, target: int = 1024, block: int = 1024, per_cell: int = 64, max_cells: int = 4096, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """One row per vector: ``vec_id``, ``n_links`` (other vectors at cosine >= ``threshold``), ``component_id``, ``kept``.

    ``margin`` is how far below its best cell's cosine a vector still joins a cell: the larger, the higher the recall
    (tests measure it against brute force, at few and at many cells). ``max_cells`` bounds the broadcast centres; beyond it cells grow and take more
    blocks. Defined cases: null, zero and non-finite vectors, and vectors with null components, have no links and are their
    own component; vectors of different lengths don't link; repeated rows are vectors of their own and link with each
    other, and so do rows of one id with different vectors (their components may then have the same smallest id); a null id is
    kept with a null component; an empty table gives an empty result; other columns are ignored.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v"))
    sound = F.expr("v is not null and vec_id is not null and size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(v, x -> x <> 0)")
    rows = rows.withColumn("key", F.when(sound, F.md5(F.concat_ws(",", "v"))))
    distinct = rows.where("key is not null").groupBy("key").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("copies"), F.min("v").alias("v"))
    # a node's number is fixed by its being written
    distinct = cut(distinct.withColumn("node", F.monotonically_increasing_id()).withColumn("h", F.xxhash64("key")))
    # each length has cells of its own: the exchange sees (length, cell)
    sizes = distinct.groupBy(F.size("v").alias("n")).agg(F.count(F.lit(1)).alias("rows"))
    centres = {}
    for n, rows_n in sorted((r.n, r.rows) for r in sizes.toLocalIterator()):
        k = min(max_cells, math.ceil(3 * rows_n / target))
        # hashes low enough for twice the sample, so that only those are ranked
        low = distinct.where((F.size("v") == n) & ((F.col("h") / F.lit(2.0**64) + 0.5) * F.lit(float(rows_n)) <= 2.0 * per_cell * k + 1000))
        sample = cut(low.select("node", "h", "v").orderBy("h", "node").limit(per_cell * k + 500))
        centres[n] = spherical_kmeans(sample, k)
        discard(sample)
    if not centres:
        centres[0] = np.zeros((1, 0))
    run = _assign(spark.sparkContext.broadcast(centres), margin)
    placed = cut(distinct.mapInArrow(run, "node long, copies long, cells array<int>, x array<double>"))
    width = F.size("x").alias("width")
    each = placed.select("node", "copies", "cells", "x", width, F.explode("cells").alias("cell"))
    blocks = each.groupBy("cell", "width").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    tiles = each.join(blocks, ["cell", "width"]).withColumn("part", F.pmod(F.xxhash64("node", "cell"), F.col("blocks")).cast("int"))
    tiles = tiles.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    tiles = tiles.select("cell", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "width", "part", "node", "copies", "cells", "x")
    found = cut(tiles.groupBy("cell", "i", "j", "width").applyInArrow(_tile(threshold), "node long, n long, least long"))
    discard(placed)
    links = found.groupBy("node").agg(F.sum("n").alias("n"))
    roots = components(found.select(F.col("node").alias("a"), F.col("least").alias("b")))
    ids = distinct.select("node", "key", "copies", F.col("least").alias("own"))
    smallest = roots.join(ids, "node").groupBy("root").agg(F.min("own").alias("component_id"))
    linked = roots.join(smallest, "root").select("node", "component_id")
    groups = ids.join(links, "node", "left").join(linked, "node", "left").select("key", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("component_id", "own").alias("component_id"))
    out = rows.select("vec_id", "key").join(cut(groups), "key", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
