"""Annotation queues: status, validation reports, gold checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gapline.functions.score import half_up, ratio
from gapline.functions.text import approved, judged_valid


def label(c: str) -> Column:
    return F.lower(F.btrim(F.coalesce(F.col(c), F.lit(""))))


def with_status(df: DataFrame, first: str, second: str, approval: str | None, classes: list[str]) -> DataFrame:
    """Labels normalised, and ``status``: pending without a valid first label, invalid_label for one that is not a class,
    adjudication_required where two valid ones differ, completed where approved (or no approval is asked), else awaiting_human_approval."""
    a, b = label(first), label(second)
    a_ok, b_ok = a.isin(classes), b.isin(classes)
    invalid = ((a != "") & ~a_ok) | ((b != "") & ~b_ok)
    ok = approved(F.col(approval)) if approval else F.lit(True)
    status = F.when(invalid, "invalid_label").when(~a_ok, "pending").when(a_ok & b_ok & (a != b), "adjudication_required").when(ok, "completed").otherwise("awaiting_human_approval")
    return df.withColumn("status", status).withColumn(first, a).withColumn(second, b)


def validation(df: DataFrame, evidence: str = "evidence", priority: str = "priority") -> DataFrame:
    """Review rates of a sample; the overall rate is null until all rows are reviewed."""
    seen = lambda c: F.coalesce(F.btrim(c) != "", F.lit(False))
    e, p, ev, pv = seen(evidence), seen(priority), judged_valid(F.col(evidence)), judged_valid(F.col(priority))
    all_seen = F.bool_and(e & p)
    return df.agg(
        F.count(F.lit(1)).alias("sample_rows"), F.count_if(e).alias("evidence_reviewed"), F.count_if(p).alias("priority_reviewed"),
        half_up(F.when(F.count_if(e) > 0, ratio(F.count_if(e & ev), F.count_if(e))), 4).alias("evidence_rate"), half_up(F.when(F.count_if(p) > 0, ratio(F.count_if(p & pv), F.count_if(p))), 4).alias("priority_rate"),
        F.when(all_seen, half_up(ratio(F.count_if(e & p & ev & pv), F.count(F.lit(1))), 4)).alias("overall_rate"), all_seen.alias("fully_reviewed"),
    )


def gold_report(df: DataFrame, key: str, first: str, approval: str, group: str, classes: list[str], rows: int = 300, per_class: int = 50) -> DataFrame:
    """Counts of what is wrong with a gold set, whether it is valid, and whether it is large enough to train on."""
    a, ok = label(first), approved(F.col(approval))
    n = F.count(F.lit(1))
    no_group = F.coalesce(F.btrim(group) == "", F.lit(True))
    twice = n - F.countDistinct(key)
    valid = (n > 0) & F.bool_and(a.isin(classes)) & F.bool_and(ok) & (twice == 0) & (F.count_if(no_group) == 0)
    ready = n >= rows
    for c in classes:
        ready = ready & (F.count_if(a == c) >= per_class)
    return df.agg(
        n.alias("n"), F.countDistinct(group).alias("places"), F.count_if(~a.isin(classes)).alias("invalid_labels"), F.count_if(~ok).alias("unapproved"), twice.alias("duplicate_ids"), F.count_if(no_group).alias("missing_groups"),
        *[F.count_if(a == c).alias(c) for c in classes], valid.alias("valid"), ready.alias("ready"),
    )


SUGGESTED = ["ai_label", "ai_confidence", "ai_rationale"]


def suggest(queue: DataFrame, suggestions: DataFrame, key: str, approval: str) -> DataFrame:
    """The queue with suggestions beside rows that no human has approved; approved rows keep theirs."""
    side = suggestions.select(key, *[F.col(c).alias(f"_s_{c}") for c in SUGGESTED])
    out = queue.join(side, key, "left")
    for c in SUGGESTED:
        old = F.col(c) if c in queue.columns else F.lit(None).cast("string")
        out = out.withColumn(c, F.when(approved(F.col(approval)), old).otherwise(F.coalesce(f"_s_{c}", old)))
    return out.drop(*[f"_s_{c}" for c in SUGGESTED])


def keep_all(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``new``, or an error at run time if a key of ``old`` is not in it: gold labels are never lost by an export."""
    lost = old.select(key).distinct().join(new.select(key), key, "left_anti").agg(F.count(F.lit(1)).alias("_lost"))
    checked = lost.select(F.assert_true(F.col("_lost") == 0, F.format_string("%d gold rows would be lost", "_lost")).alias("_ok"))
    return new.crossJoin(F.broadcast(checked)).where(F.col("_ok").isNull()).drop("_ok")


def restore(queue: DataFrame, snapshot: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """The queue with the human columns of a snapshot; every row of the snapshot must be in the queue."""
    from gapline.operators.relational import merge_filled

    return keep_all(snapshot, merge_filled(queue, snapshot, key, columns), key)


def digest(df: DataFrame, key: str, columns: list[str]) -> str:
    """One digest of the rows whatever their order: of sorted row digests, so only those are gathered."""
    row = F.sha2(F.concat_ws("\x1f", key, *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in columns]), 256)
    return df.agg(F.sha2(F.concat_ws("", F.sort_array(F.collect_list(row))), 256)).first()[0]


def snapshot(df: DataFrame, root: str, key: str, columns: list[str]) -> str:
    """Written once under its digest; a snapshot that is there already stays as it is. Returns its path."""
    path = f"{root.rstrip('/')}/{digest(df, key, columns)}"
    df.select(key, *columns).write.mode("ignore").parquet(path)
    return path
