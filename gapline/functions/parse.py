"""Values read out of free text: ratings, prices, coordinates, dates, numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gapline.functions import text as X
from gapline.functions.text import missing_like


def number(c: Column) -> Column:
    """A double with a comma or a point; null if it isn't one."""
    return F.replace(F.btrim(c), F.lit(","), F.lit(".")).try_cast("double")


def rating(c: Column) -> Column:
    """The first number of a text, if from 1 to 5; a sign is not looked at."""
    found = F.regexp_extract(c, r"([0-9]+(?:[.,][0-9]+)?)", 1)
    value = F.replace(found, F.lit(","), F.lit(".")).try_cast("double")
    return F.when(~missing_like(c) & value.between(1, 5), value)


def price_number(token: Column) -> Column:
    """Points group thousands and commas are decimal where both stand, or where all groups after a point have three digits."""
    point, comma = token.contains("."), token.contains(",")
    plain = F.replace(token, F.lit("."), F.lit(""))
    text = F.when(point & comma, F.replace(plain, F.lit(","), F.lit("."))).when(point & token.rlike(r"^[^.]*(\.[^.]{3})+$"), plain).when(comma, F.replace(token, F.lit(","), F.lit("."))).otherwise(token)
    return text.try_cast("double")


def price(c: Column) -> Column:
    """min_price, max_price, is_free, parsing_success, is_missing, is_inferred."""
    gone = missing_like(c)
    free = ~gone & F.lower(c).rlike("gratis|free")
    values = F.filter(F.transform(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"([0-9][0-9.,]*)"), 1), price_number), lambda x: x.isNotNull())
    some = ~gone & ~free & (F.size(values) > 0)
    zero = F.when(free, F.lit(0.0))
    return F.struct(
        F.coalesce(zero, F.when(some, F.array_min(values))).alias("min_price"),
        F.coalesce(zero, F.when(some, F.array_max(values))).alias("max_price"),
        free.alias("is_free"),
        (free | some).alias("parsing_success"),
        gone.alias("is_missing"),
        (some & (F.size(values) == 1)).alias("is_inferred"),
    )


def coordinate(c: Column) -> Column:
    """latitude, longitude, parsing_success, is_missing, error from the first two numbers of a text."""
    gone = missing_like(c)
    found = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"(-?[0-9]+(?:\.[0-9]+)?)"), 1)
    lat, lon = F.get(found, F.lit(0)).try_cast("double"), F.get(found, F.lit(1)).try_cast("double")
    two = ~gone & (F.size(found) >= 2)
    ok = F.coalesce(two & lat.between(-90, 90) & lon.between(-180, 180), F.lit(False))
    error = F.when(gone, "missing").when(~two, "could_not_find_two_numbers").when(~ok, "coordinate_out_of_range")
    return F.struct(F.when(ok, lat).alias("latitude"), F.when(ok, lon).alias("longitude"), ok.alias("parsing_success"), gone.alias("is_missing"), error.alias("error"))


#: Layouts of absolute dates, each with the shape a text must have to be tried with it.
LAYOUTS = {
    "yyyy-MM-dd HH:mm:ss": r"^\d{4,}-\d\d-\d\d \d\d:", "yyyy-MM-dd'T'HH:mm:ss": r"^\d{4,}-\d\d-\d\dT", "yyyy-MM-dd": r"^\d{4,}-\d\d-\d\d$", "yyyy/MM/dd": r"^\d{4,}/\d\d/\d\d$",
    "MM/dd/yyyy": r"^\d\d/\d\d/\d{4,}$", "d MMM yyyy": r"^\d+ \w{3} \d{4,}$", "MMM d, yyyy": r"^\w{3} \d+, \d{4,}$",
}
SECONDS = {"minute": 60, "hour": 3600, "day": 86400, "week": 7 * 86400, "month": 30 * 86400, "year": 365 * 86400}


def _absolute(c: Column) -> Column:
    """Layouts exclude each other by shape, so a text is parsed at most once."""
    out = F.lit(None).cast("timestamp")
    for layout, shape in LAYOUTS.items():
        out = F.when(c.rlike(shape), F.try_to_timestamp(c, F.lit(layout))).otherwise(out)
    return out


def _back(c: Column) -> Column:
    """Seconds that "N units ago" or yesterday lie back; null for other texts."""

    def of(found: Column) -> Column:
        unit = F.get(found, F.lit(1))
        seconds = F.lit(None).cast("int")
        for name, n in SECONDS.items():
            seconds = F.when(unit == name, n).otherwise(seconds)
        return F.coalesce(F.get(found, F.lit(0)).try_cast("double"), F.lit(1.0)) * seconds

    found = lambda t: F.split(F.regexp_extract(t, r"((?:\d+|a|an|one)\s+(?:day|week|month|year|hour|minute))s?\s+ago", 1), r"\s+")
    return X.bind(F.lower(c), lambda t: F.coalesce(F.when(t.contains("ago"), X.bind(found(t), of)), F.when(t.contains("yesterday"), F.lit(86400.0))))


def review_date(published: Column, collected: Column) -> Column:
    """review_date, is_inferred, source: an absolute date, else "N units ago" counted back from ``collected`` (months of 30 days,
    years of 365), else ``collected`` where nothing was published. ``published`` is clean text, ``collected`` a timestamp.
    """

    def told(x: Column) -> Column:
        relative = F.to_date(F.timestamp_seconds(F.unix_timestamp(x.collected) - x.back))
        return X.bind(F.struct(x.published.isNull().alias("gone"), F.to_date(x.absolute).alias("absolute"), relative.alias("relative"), x.collected.alias("collected")), dated)

    def dated(x: Column) -> Column:
        fallback = x.gone & x.collected.isNotNull()
        source = F.when(fallback, "collect_date_fallback").when(x.gone, F.lit(None)).when(x.absolute.isNotNull(), "published_at_absolute").when(x.relative.isNotNull(), "published_at_relative_to_collect_date").otherwise("unparsed")
        date = F.when(fallback, F.to_date(x.collected)).otherwise(F.coalesce(x.absolute, x.relative))
        return F.struct(date.alias("review_date"), (date.isNotNull() & x.absolute.isNull()).alias("is_inferred"), source.alias("source"))

    parts = lambda p: F.struct(p.alias("published"), _absolute(p).alias("absolute"), _back(p).alias("back"), collected.cast("timestamp").alias("collected"))
    return X.bind(published, lambda p: X.bind(parts(p), told))


def weak_label(c: Column) -> Column:
    """A label by rating; between the whole steps there is none."""
    return F.when(c <= 2, "negative").when(c == 3, "neutral").when(c >= 4, "positive")


def rating_class(c: Column) -> Column:
    return F.when(c.isNull() | F.isnan(c), "rating_missing").otherwise(F.concat(F.lit("rating_"), F.bround(c).cast("int").cast("string")))
