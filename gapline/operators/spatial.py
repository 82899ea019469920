"""Distance joins on a grid, density clusters and their summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gapline.functions import geo
from gapline.operators.graph import least_reachable, materialise

KM_PER_DEGREE = 110.5  # a little under the least length of a degree, so a cell is never too small


def pairs_within(points: DataFrame, km: float, on: list[str] | None = None, left: DataFrame | None = None) -> DataFrame:
    """``a``, ``b`` and ``km`` for points at most ``km`` apart, each point with itself included, both directions.

    ``points``: ``id``, ``lat``, ``lon`` (valid positions) and the columns ``on`` that must agree; ``left``, the points that ``a`` may be, defaults to all.
    Points fall into grid cells no smaller than ``km`` on either axis; one side is copied to the nine cells around it, so the join is an
    equality join on cells with the distance as a residual condition. Points near the 180th meridian stand on both sides of it.
    """
    on = on or []
    widest = points.agg(F.max(F.abs("lat")).alias("_top"))
    step = km / KM_PER_DEGREE
    narrow = F.greatest(F.lit(0.01), F.cos(F.radians(F.least(F.lit(89.5), F.col("_top") + step))))
    cell = lambda df: df.withColumn("cy", F.floor(F.col("lat") / step)).withColumn("cx", F.floor(F.col("lon") / (step / F.col("_narrow"))))
    wide = lambda df: df.crossJoin(F.broadcast(widest)).withColumn("_narrow", narrow)
    first = cell(wide(points if left is None else left)).select(F.col("id").alias("a"), F.col("lat").alias("a_lat"), F.col("lon").alias("a_lon"), "cx", "cy", *on)
    # once more with the longitude of the other side, if that is within reach
    turned = F.when(F.col("lon") < -180.0 + step / F.col("_narrow"), F.col("lon") + 360.0).when(F.col("lon") > 180.0 - step / F.col("_narrow"), F.col("lon") - 360.0)
    second = wide(points).withColumn("lon", F.explode(F.array_compact(F.array(F.col("lon"), turned))))
    around = F.array(*[F.struct((F.col("cx") + dx).alias("cx"), (F.col("cy") + dy).alias("cy")) for dx in (-1, 0, 1) for dy in (-1, 0, 1)])
    second = cell(second).select(F.col("id").alias("b"), F.col("lat").alias("b_lat"), F.col("lon").alias("b_lon"), F.explode(around).alias("c"), *on).select("b", "b_lat", "b_lon", "c.cx", "c.cy", *on)
    d = geo.haversine_km(F.col("a_lat"), F.col("a_lon"), F.col("b_lat"), F.col("b_lon"))
    apart = F.col("a_lon") - F.col("b_lon")
    found = first.join(second, ["cx", "cy", *on]).where((apart >= -180.0) & (apart < 180.0)).withColumn("km", d).where(F.col("km") <= km)
    return found.select("a", "b", "km")


def scarcity(places: DataFrame, km: float) -> DataFrame:
    """``id``, ``density`` (others of the category within ``km``) and ``scarcity`` = 1 - density / largest density.

    ``places``: ``id``, ``lat``, ``lon``, ``category``. A place without a valid position has density 0; one without a category -1.
    """
    sound = places.where(geo.valid(F.col("lat"), F.col("lon")))
    near = pairs_within(sound.where("category is not null").select("id", "lat", "lon", "category"), km, ["category"])
    counts = near.groupBy(F.col("a").alias("id")).agg((F.count(F.lit(1)) - 1).alias("n"))
    ok = geo.valid(F.col("lat"), F.col("lon"))
    density = F.when(ok & F.col("category").isNull(), F.lit(-1).cast("long")).otherwise(F.coalesce("n", F.lit(0).cast("long")))
    each = places.join(counts, "id", "left").select("id", density.alias("density"))
    most = each.agg(F.greatest(F.max("density"), F.lit(1)).alias("most"))
    share = 1.0 - F.col("density") / F.col("most")
    return each.crossJoin(F.broadcast(most)).select("id", "density", F.greatest(F.lit(0.0), F.least(F.lit(1.0), share)).alias("scarcity"))


def _tiles(points: DataFrame, km: float) -> DataFrame:
    """``points`` with the tile (``ty``, ``tx``) of each; any two points of a tile lie within ``km``. For ``km`` up to a few hundred."""
    side = km / 1.5 / KM_PER_DEGREE
    row = F.floor(F.col("lat") / side)
    # the parallel of the row's side nearest the equator is its longest
    nearest = F.radians(F.when(row >= 0, row * side).otherwise((row + 1) * -side))
    return points.withColumn("ty", row).withColumn("tx", F.floor(F.col("lon") * F.greatest(F.cos(nearest), F.lit(1e-6)) / side))


def dbscan(points: DataFrame, km: float, least: int) -> DataFrame:
    """``id`` and ``cluster``: density clusters numbered by their smallest core id, border points to the lowest, noise -1.

    A core point has ``least`` neighbours within ``km``, itself included. Equal positions are one place with a weight, and all places of a tile lie
    within ``km`` of each other: in a tile of ``least`` points all are core and need no neighbours, and a tile's core points are one
    node of the graph. So dense places cost no pairs inside them, and what is kept of pairs between tiles is one row per pair of tiles.
    """
    spots = points.groupBy("lat", "lon").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n"))
    spots = _tiles(spots, km)
    full = spots.groupBy("ty", "tx").agg(F.sum("n").alias("_all"))
    spots = materialise(spots.join(full, ["ty", "tx"]))
    weight = spots.select(F.col("id").alias("b"), "n")
    sparse = spots.where(F.col("_all") < least)
    counted = pairs_within(spots.select("id", "lat", "lon"), km, left=sparse.select("id", "lat", "lon")).select("a", "b").join(weight, "b").groupBy("a").agg(F.sum("n").alias("n"))
    found = counted.where(F.col("n") >= least).select(F.col("a").alias("id"))
    core = materialise(spots.where(F.col("_all") >= least).unionByName(sparse.join(found, "id", "left_semi")))
    # a tile's node is its smallest core id
    nodes = core.groupBy("ty", "tx").agg(F.min("id").alias("node"))
    core = core.join(nodes, ["ty", "tx"]).select("id", "lat", "lon", "node")
    of = lambda c: core.select(F.col("id").alias(c), F.col("node").alias(f"node_{c}"))
    between = pairs_within(core.select("id", "lat", "lon"), km).select("a", "b").join(of("a"), "a").join(of("b"), "b").where("node_a <> node_b")
    links = between.select(F.col("node_a").alias("a"), F.col("node_b").alias("b")).distinct()
    roots = least_reachable(links.unionByName(nodes.select(F.col("node").alias("a"), F.col("node").alias("b"))))
    labels = roots.select("root").distinct().withColumn("cluster", F.row_number().over(Window.orderBy("root")) - 1)
    named = core.join(roots.join(labels, "root").select(F.col("id").alias("node"), "cluster"), "node").select("id", "cluster")
    rest = spots.join(named, "id", "left_anti").select("id", "lat", "lon")
    border = pairs_within(core.select("id", "lat", "lon").unionByName(rest), km, left=rest).join(named.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("cluster").alias("cluster"))
    cluster = spots.select("id", "lat", "lon").join(named.unionByName(border), "id", "left").select(F.col("lat").alias("_lat"), F.col("lon").alias("_lon"), "cluster")
    same = F.col("lat").eqNullSafe(F.col("_lat")) & F.col("lon").eqNullSafe(F.col("_lon"))
    return points.select("id", "lat", "lon").join(cluster, same, "left").select("id", F.coalesce("cluster", F.lit(-1)).alias("cluster"))


def top_items(counted: DataFrame, group: str, item: str, n: str, k: int, name: str) -> DataFrame:
    """The ``k`` items of each group by (-n, item), joined by pipes."""
    rank = F.row_number().over(Window.partitionBy(group).orderBy(F.desc(n), item))
    top = counted.withColumn("_r", rank).where(F.col("_r") <= k)
    return top.groupBy(group).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_r", item))), lambda x: x[item]), "|").alias(name))


def category_json(rows: DataFrame, group: str, item: str, name: str) -> DataFrame:
    """A JSON object of counts per group, items in name order."""
    counts = rows.groupBy(group, item).agg(F.count(F.lit(1)).alias("n"))
    pairs = F.array_sort(F.collect_list(F.struct(item, "n")))
    return counts.groupBy(group).agg(F.to_json(F.map_from_entries(pairs)).alias(name))
