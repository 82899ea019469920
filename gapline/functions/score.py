"""Arithmetic of scores. Rounding is floor(x * 10^d + 0.5) / 10^d, which is the same in every engine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gapline.functions.text import flags

# Fixed values.
ALPHA, BETA = 1.0, 4.0
WEIGHTS = {"negative_rate": 0.30, "mention_frequency": 0.20, "scarcity": 0.15, "volume": 0.15, "rating_gap": 0.10, "recency": 0.05, "metadata_gap": 0.05}
HIGH_NEGATIVE_RATE, FREQUENT_COMPLAINT, LOW_DENSITY, HIGH_CONFIDENCE, LOW_RELIABILITY = 0.35, 0.15, 0.70, 0.70, 0.55
VOLUME_REVIEWS, RECENCY_DAYS, REVIEW_FLOOR, RADIUS_KM = 30, 365, 3, 5.0
PRIORITY_HIGH, PRIORITY_MEDIUM, SURE_HIGH, SURE_MEDIUM = 70, 40, 0.75, 0.45


def half_up(c: Column, digits: int) -> Column:
    return F.floor(c * float(10**digits) + 0.5) / float(10**digits)


def clamp(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """``c`` kept within bounds; null stays null, which ``greatest`` and ``least`` alone would turn into a bound."""
    return F.when(c.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), c)))


def smoothed_rate(negative: Column, total: Column, alpha: float = ALPHA, beta: float = BETA) -> Column:
    return (negative + alpha) / (total + alpha + beta)


def volume_confidence(reviews: Column, full: int = VOLUME_REVIEWS) -> Column:
    return clamp(F.log1p(reviews) / F.log1p(F.lit(float(full)))) if full > 0 else F.lit(1.0)


def rating_gap(rating: Column) -> Column:
    return F.coalesce(clamp((5.0 - rating) / 4.0), F.lit(0.5))


def completeness(fields: list[Column]) -> Column:
    """Share of fields that are neither null nor, as text, empty, ``nan`` or ``None``."""
    present = [F.when(F.btrim(c.cast("string")).isin("", "nan", "None") | c.isNull(), 0).otherwise(1) for c in fields]
    return sum(present[1:], present[0]) / float(len(fields))


def recency(latest: Column, as_of: Column, days: int = RECENCY_DAYS) -> Column:
    age = F.greatest(F.datediff(as_of, latest), F.lit(0))
    return F.when(latest.isNull(), F.lit(0.5)).otherwise(clamp(1.0 - age / float(max(days, 1))))


def priority(score: Column) -> Column:
    return F.when(score >= PRIORITY_HIGH, "tinggi").when(score >= PRIORITY_MEDIUM, "menengah").otherwise("rendah")


def confidence(volume: Column, reliability: Column) -> Column:
    mean = (volume + reliability) / 2
    return F.when(mean >= SURE_HIGH, "high").when(mean >= SURE_MEDIUM, "medium").otherwise("low")


def reason_codes(rate: Column, frequency: Column, scarcity: Column, volume: Column, reliability: Column) -> Column:
    return flags(
        [
            (rate >= HIGH_NEGATIVE_RATE, "HIGH_NEGATIVE_RATE"),
            (frequency >= FREQUENT_COMPLAINT, "FREQUENT_COMPLAINT"),
            (scarcity >= LOW_DENSITY, "LOW_NEARBY_SERVICE_DENSITY"),
            (volume >= HIGH_CONFIDENCE, "HIGH_REVIEW_CONFIDENCE"),
            (reliability <= LOW_RELIABILITY, "LOW_DATA_RELIABILITY"),
        ],
        "BASELINE_SIGNAL",
    )


def scarcity_word(c: Column) -> Column:
    return F.when(c >= 0.7, "tinggi").when(c >= 0.35, "menengah").otherwise("rendah")


def explanation(name: Column, level: Column, aspect: Column, rate: Column, reviews: Column, scarcity: Column) -> Column:
    """The sentence that explains a row; the percentage has one decimal."""
    tenths = F.floor(rate * 1000.0 + 0.5).cast("long")
    percent = F.concat(F.floor(tenths / 10).cast("long").cast("string"), F.lit("."), (tenths % 10).cast("string"))
    parts = [name, " memiliki prioritas ", level, " pada aspek ", aspect, " karena ", percent, "% penyebutan aspek tersebut bersentimen negatif setelah smoothing, berdasarkan ", reviews.cast("string"), " ulasan, dan ketersediaan layanan terkait di sekitar lokasi tergolong ", scarcity_word(scarcity), "."]
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def abstain(p: Column, threshold: float, margin: float) -> Column:
    """negative above the margin, non_negative below it, else uncertain."""
    return F.when(p >= min(1.0, threshold + margin), "negative").when(p <= max(0.0, threshold - margin), "non_negative").otherwise("uncertain")


def ratio(a: Column, b: Column) -> Column:
    """a / b as a double, 0 where b is 0."""
    return F.when(b == 0, F.lit(0.0)).otherwise(a.cast("double") / b)


def f_score(tp: Column, fp: Column, fn: Column, beta: float = 1.0) -> Column:
    b = beta * beta
    return ratio((1 + b) * tp, (1 + b) * tp + b * fn + fp)
