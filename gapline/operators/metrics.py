"""Classifier metrics as aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gapline.functions.score import f_score, ratio


def confusion(truth: Column, predicted: Column) -> list[Column]:
    t, p = truth == 1, predicted == 1
    n = lambda c, name: F.count_if(c).alias(name)
    return [n(t & p, "tp"), n(~t & p, "fp"), n(t & ~p, "fn"), n(~t & ~p, "tn")]


def rates(df: DataFrame, beta: float = 2.0) -> DataFrame:
    """From tp, fp, fn, tn: precision, recall, f1, f_beta, macro_f1, weighted_f1 and balanced accuracy; 0 for 0 / 0."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    f1, f0 = f_score(tp, fp, fn), f_score(tn, fn, fp)
    cols = {
        "precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "f1": f1, "f_beta": f_score(tp, fp, fn, beta), "macro_f1": (f1 + f0) / 2.0,
        "weighted_f1": ratio(f1 * (tp + fn) + f0 * (tn + fp), tp + fp + fn + tn), "balanced_accuracy": (ratio(tp, tp + fn) + ratio(tn, tn + fp)) / 2.0,
    }
    return df.withColumns(cols)


def threshold_sweep(df: DataFrame, truth: str, p: str, low: int = 50, high: int = 950, step: int = 5, beta: float = 2.0) -> DataFrame:
    """Metrics at each threshold (in thousandths). Rows are first counted by the number of thresholds they reach, so the
    few counts, not the rows, meet the thresholds."""
    n = (high - low) // step + 1
    reached = F.least(F.lit(n), F.greatest(F.lit(0), F.floor((F.col(p) * 1000.0 - low + 1e-6) / step) + 1)).cast("int")
    counts = df.groupBy(reached.alias("reached")).agg(F.count_if(F.col(truth) == 1).alias("pos"), F.count_if(F.col(truth) != 1).alias("neg"))
    grid = df.sparkSession.range(n).select(F.col("id").cast("int").alias("i"))
    at = grid.join(F.broadcast(counts), F.lit(True), "left").groupBy("i").agg(
        *[F.coalesce(F.sum(F.when(cond, F.col(c))), F.lit(0)).alias(name) for name, cond, c in (("tp", F.col("reached") > F.col("i"), "pos"), ("fp", F.col("reached") > F.col("i"), "neg"), ("fn", F.col("reached") <= F.col("i"), "pos"), ("tn", F.col("reached") <= F.col("i"), "neg"))]
    )
    return rates(at.select(((F.col("i") * step + low) / 1000.0).alias("threshold"), "tp", "fp", "fn", "tn"), beta)


def choose_threshold(sweep: DataFrame, floor: float) -> DataFrame:
    """The best row by (f_beta, recall, precision, smaller threshold) among those of enough precision, or among all if none has it."""
    order = [F.when(F.col("precision") >= floor, 0).otherwise(1), F.desc("f_beta"), F.desc("recall"), F.desc("precision"), F.asc("threshold")]
    return sweep.orderBy(*order).limit(1)


def _running(each: DataFrame, by: list[str], p: str, sums: list[str]) -> DataFrame:
    """``each`` (a row per distinct ``p``) with the running sums of ``sums`` from the largest ``p`` down, named ``upto_`` them.

    Rows add up inside thousandths of the score and a thousandth starts from the sum of all higher ones, so no task orders all scores.
    """
    each = each.withColumn("_step", F.floor(F.col(p) * 1000.0))
    steps = each.groupBy(*by, "_step").agg(*[F.sum(c).alias(f"_{c}") for c in sums])
    above = Window.partitionBy(*by).orderBy(F.desc("_step")).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(*by)
    steps = steps.select(*by, "_step", *[F.coalesce(F.sum(f"_{c}").over(above), F.lit(0)).alias(f"_above_{c}") for c in sums], *[F.sum(f"_{c}").over(every).alias(f"all_{c}") for c in sums])
    inside = Window.partitionBy(*by, "_step").orderBy(F.desc(p))
    joined = each.alias("e").join(steps.alias("s"), [F.col(f"e.{c}").eqNullSafe(F.col(f"s.{c}")) for c in (*by, "_step")])
    out = joined.select("e.*", *[F.col(f"s.{x}{c}") for c in sums for x in ("_above_", "all_")])
    return out.withColumns({f"upto_{c}": F.col(f"_above_{c}") + F.sum(c).over(inside) for c in sums}).drop("_step", *[f"_above_{c}" for c in sums])


def pr_curve(df: DataFrame, truth: str, p: str, by: list[str] | None = None) -> DataFrame:
    """Precision and recall with every distinct score as the threshold (rows with that score or more are predicted)."""
    by = by or []
    each = df.groupBy(*by, p).agg(F.count_if(F.col(truth) == 1).alias("pos"), F.count(F.lit(1)).alias("n"))
    part = _running(each, by, p, ["pos", "n"])
    return part.select(*by, F.col(p).alias("threshold"), "pos", ratio(F.col("upto_pos"), F.col("upto_n")).alias("precision"), ratio(F.col("upto_pos"), F.col("all_pos")).alias("recall"), "all_pos")


def average_precision(df: DataFrame, truth: str, p: str, by: list[str] | None = None) -> DataFrame:
    """Average precision: the sum of precision times the step in recall over distinct scores; equal scores are one threshold."""
    by = by or []
    part = pr_curve(df, truth, p, by).withColumn("_step", ratio(F.col("pos"), F.col("all_pos")) * F.col("precision"))
    return part.groupBy(*by).agg(F.sum("_step").alias("average_precision")) if by else part.agg(F.sum("_step").alias("average_precision"))


def quantile_bins(df: DataFrame, p: str, ties: list[str], bins: int = 10) -> DataFrame:
    """``df`` with ``bin`` from 1: equal numbers of rows by ``p`` and ``ties``, the first bins one larger where they don't divide."""
    ranked_rows = ranked(df.withColumn("_s", 100.0 - 100.0 * F.col(p)).withColumn("_n", -F.col(p)), "_s", ["_n"], ties)
    size = df.agg(F.count(F.lit(1)).alias("_all"))
    at, q, more = F.col("rank") - 1, F.floor(F.col("_all") / bins), F.col("_all") % bins
    wide = at < more * (q + 1)
    place = F.when(wide, F.floor(at / (q + 1))).otherwise(more + F.floor((at - more * (q + 1)) / F.greatest(q, F.lit(1))))
    return ranked_rows.crossJoin(F.broadcast(size)).withColumn("bin", (place + 1).cast("int")).drop("_s", "_n", "_all", "rank")


def ranked(rows: DataFrame, score: str, more: list[str], ties: list[str]) -> DataFrame:
    """``rank`` by ``score`` and ``more`` descending, then ``ties``, without an ordering of all rows in one task.

    Scores lie in 0..100. Rows are ranked inside tenths of a point; a tenth starts after all rows of higher tenths, which a
    running sum over the thousand tenths tells.
    """
    rows = rows.withColumn("_tenth", F.floor(F.col(score) * 10.0).cast("int"))
    above = Window.orderBy(F.desc("_tenth")).rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("_tenth").agg(F.count(F.lit(1)).alias("_n_rows")).select("_tenth", F.coalesce(F.sum("_n_rows").over(above), F.lit(0)).alias("_above"))
    inside = Window.partitionBy("_tenth").orderBy(*[F.desc(c) for c in (score, *more)], *ties)
    out = rows.join(F.broadcast(starts), "_tenth").withColumn("rank", (F.col("_above") + F.row_number().over(inside)).cast("long"))
    return out.drop("_tenth", "_above")


def multiclass(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Precision, recall, f1 and support of each class that is true or predicted somewhere."""
    cells = df.groupBy(truth, predicted).agg(F.count(F.lit(1)).alias("n"))
    t = cells.groupBy(F.col(truth).alias("label")).agg(F.sum("n").alias("support"))
    q = cells.groupBy(F.col(predicted).alias("label")).agg(F.sum("n").alias("predicted"))
    hit = cells.where(F.col(truth) == F.col(predicted)).select(F.col(truth).alias("label"), F.col("n").alias("tp"))
    out = t.join(q, "label", "full").join(hit, "label", "left").fillna(0)
    tp, fp, fn = F.col("tp"), F.col("predicted") - F.col("tp"), F.col("support") - F.col("tp")
    return out.select("label", "support", ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), f_score(tp, fp, fn).alias("f1"))


def kappa(df: DataFrame, a: str, b: str) -> DataFrame:
    """Cohen's kappa of two annotators from the contingency table; null under two rows or where either used one class."""
    cells = df.groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))
    rows = cells.groupBy(F.col(a).alias("label")).agg(F.sum("n").alias("ra"))
    cols = cells.groupBy(F.col(b).alias("label")).agg(F.sum("n").alias("rb"))
    both = rows.join(cols, "label", "full").agg(F.sum(F.coalesce("ra", F.lit(0)) * F.coalesce("rb", F.lit(0))).alias("cross"), F.count("ra").alias("ka"), F.count("rb").alias("kb"))
    agree = cells.agg(F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.col(a) == F.col(b), F.col("n"))), F.lit(0)).alias("same"))
    pe = F.col("cross") / (F.col("n") * F.col("n")).cast("double")
    value = (F.col("same") / F.col("n").cast("double") - pe) / (1.0 - pe)
    return agree.crossJoin(both).select("n", "same", F.when((F.col("n") >= 2) & (F.col("ka") > 1) & (F.col("kb") > 1), value).alias("kappa"))


def scaled(c: str, up: bool = True) -> Column:
    """Min-max over all rows, 1 where all are equal; ``up``: whether more is better."""
    every = Window.partitionBy()
    lo, hi = F.min(c).over(every), F.max(c).over(every)
    part = (F.col(c) - lo) if up else (hi - F.col(c))
    return F.when(F.abs(hi - lo) <= 1e-8 + 1e-5 * F.abs(lo), F.lit(1.0)).otherwise(part / (hi - lo))
