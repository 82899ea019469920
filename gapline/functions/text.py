"""Text columns: missing values, cleaning, names, clauses, hints, labels and keys."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Fixed values.
PLACEHOLDERS = ["", "-", "--", "nan", "NaN", "None", "none", "null", "NULL", "n/a", "N/A"]
CONTRAST = ["akan tetapi", "tetapi", "tapi", "namun", "sedangkan", "walaupun", "meskipun", "but", "however", "although"]
POSITIVE_HINTS = ["bagus", "indah", "enak", "ramah", "bersih", "nyaman", "mantap", "keren", "recommended", "good", "nice", "beautiful"]
NEGATIVE_HINTS = ["tidak", "kurang", "buruk", "kotor", "mahal", "sempit", "jelek", "lambat", "rusak", "bad", "dirty", "worst"]
LOCAL_HINTS = ["toba", "balige", "samosir", "parapat", "batak", "bulbul", "lumban", "sipiso", "pangururan"]
INFORMAL = ["yg", "tdk", "gk", "ga", "bgt", "tmpt", "sdh", "krn", "dgn"]
ENGLISH_WORDS = ["the", "and", "is", "was", "food", "room", "hotel", "view", "good", "bad", "service"]
INDONESIAN_WORDS = ["dan", "yang", "tidak", "bagus", "makanan", "kamar", "pelayanan", "tempat"]
ENGLISH_TOKENS = ["the", "and", "was", "good", "bad", "room", "food"]
INDONESIAN_TOKENS = ["yang", "dan", "tidak", "bagus", "buruk", "kamar"]
SARCASM = ["mantap sekali", "bagus sekali"]
EMAIL = r"(?i)[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}"
PHONE = r"(?<!\d)(?:\+?62|0)[\s.-]?(?:\d[\s.-]?){8,13}(?!\d)"
URL = r"(?i)https?://|www\."
# The same matches, tried only where a run of such letters begins: long runs without an @ stay linear.
EMAIL_START = r"(?<![A-Za-z0-9._%+-])" + EMAIL
EMAIL_HIDDEN, PHONE_HIDDEN = "[email disamarkan]", "[nomor disamarkan]"
CONTROLS = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"


@F.pandas_udf(StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def nfkc(c: Column) -> Column:
    """NFKC form; there is no built-in, so texts beyond ASCII go through an Arrow batch and the rest stay in the JVM."""
    return F.when(c.rlike(r"[^\x00-\x7F]"), _nfkc(c)).otherwise(c)


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once a row however often ``body`` names it.

    The optimizer writes an expression out wherever its column is named, so a chain of named steps can grow without bound; the
    variable of a lambda stays one.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def any_of(words: list[str]) -> str:
    return "|".join(words)


def missing_like(c: Column) -> Column:
    """Null or, trimmed, one of the placeholders (case matters)."""
    return F.coalesce(F.btrim(c).isin(PLACEHOLDERS), F.lit(True))


def squeeze(c: Column) -> Column:
    return F.btrim(F.regexp_replace(c, r"(?U)\s+", " "))


def clean_text(c: Column, compose: bool = True) -> Column:
    """Composed, control characters and white space to single spaces, trimmed; placeholders become null."""
    text = squeeze(F.regexp_replace(nfkc(c) if compose else c, CONTROLS, " "))
    return F.when(~missing_like(c) & ~text.isin(PLACEHOLDERS), text)


def text_length(c: Column) -> Column:
    return F.coalesce(F.length(c), F.lit(0)).cast("long")


def place_name(c: Column) -> Column:
    """A name for matching: lower case, the two spellings of one local name, punctuation to spaces; empty becomes null."""
    name = F.regexp_replace(F.lower(c), r"(?U)\bbul[\s\-]+bul\b", "bul bul")
    name = F.regexp_replace(name, r"(?U)\blumban\s+bul\s+bul\b", "lumban bulbul")
    name = squeeze(F.regexp_replace(name, r"(?U)[^\w\s]", " "))
    return F.nullif(name, F.lit(""))


def matching(c: Column) -> Column:
    """Lower case with everything but ASCII letters, digits, underscores and spaces gone."""
    return F.btrim(F.regexp_replace(F.regexp_replace(F.lower(c), r"(?U)[^0-9a-zA-Z_\s]+", " "), r"(?U)\s+", " "))


def keyword(word: str) -> str:
    """A pattern for a whole keyword, with any white space where it has spaces."""
    return r"(?U)(?<!\w)" + r"\s+".join(word.lower().split()) + r"(?!\w)"


def clauses(c: Column) -> Column:
    """Clauses in order: cut after sentence ends, at pipes and at contrast words; trimmed of ``" ,.-"``, none empty."""
    sentences = F.split(F.coalesce(c, F.lit("")), r"(?U)(?<=[.!?;])\s+|\s*\|\s*")
    parts = F.flatten(F.transform(sentences, lambda s: F.split(s, rf"(?iU)\s+(?:{any_of(CONTRAST)})\s+")))
    tidy = F.transform(parts, lambda p: F.btrim(F.regexp_replace(p, r"(?U)\s+", " "), F.lit(" ,.-")))
    return F.filter(tidy, lambda p: p != "")


def length_bucket(n: Column) -> Column:
    return F.when(F.coalesce(n, F.lit(0)) <= 0, "empty").when(n <= 30, "very_short").when(n <= 100, "short").when(n <= 250, "medium").otherwise("long")


def language_bucket(c: Column) -> Column:
    """By whole white-space tokens: both lists, the English one, else local."""
    words = F.split(F.lower(F.coalesce(c, F.lit("none"))), r"(?U)\s+")
    has = lambda xs: F.arrays_overlap(words, F.array(*[F.lit(x) for x in xs]))
    return F.when(has(ENGLISH_TOKENS) & has(INDONESIAN_TOKENS), "mixed_id_en").when(has(ENGLISH_TOKENS), "english_signal").otherwise("indonesian_or_local")


def has_word(c: Column, words: list[str]) -> Column:
    return F.lower(c).rlike(rf"(?U)\b({any_of(words)})\b")


def mixed_language(c: Column) -> Column:
    return has_word(c, ENGLISH_WORDS) & has_word(c, INDONESIAN_WORDS)


def flags(pairs: list[tuple[Column, str]], fallback: str) -> Column:
    """The names of the conditions that hold, in order; ``fallback`` alone if none does."""
    found = F.array_compact(F.array(*[F.when(cond, name) for cond, name in pairs]))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(fallback)))


def error_tags(text: Column, rating: Column, actual: Column, place_reviews: Column) -> Column:
    """What may explain a wrong prediction, as an array of tags."""
    good, bad = has_word(text, POSITIVE_HINTS), has_word(text, NEGATIVE_HINTS)
    sarcasm = reduce(lambda a, b: a | b, [F.lower(text).contains(m) for m in SARCASM])
    return flags(
        [
            (F.length(text) <= 30, "VERY_SHORT_TEXT"),
            (good & bad, "MIXED_POSITIVE_NEGATIVE"),
            (sarcasm & (actual == "negative"), "POSSIBLE_SARCASM_OR_RATING_TEXT_MISMATCH"),
            (mixed_language(text), "MIXED_ID_EN"),
            (has_word(text, LOCAL_HINTS), "LOCAL_NAME_OR_TERM"),
            (has_word(text, INFORMAL), "TYPO_OR_INFORMAL_ABBREVIATION"),
            ((rating >= 4) & bad, "HIGH_RATING_WITH_NEGATIVE_TEXT"),
            ((rating <= 2) & good, "LOW_RATING_WITH_POSITIVE_TEXT"),
            (place_reviews < 5, "LOW_PLACE_REVIEW_COUNT"),
        ],
        "GENERAL_MODEL_ERROR",
    )


def redact(c: Column) -> Column:
    """White space squeezed, e-mail addresses and phone numbers replaced by a note."""
    return F.regexp_replace(F.regexp_replace(squeeze(c), EMAIL_START, EMAIL_HIDDEN), PHONE, PHONE_HIDDEN)


def shareable(c: Column, most: int = 180) -> Column:
    """20 to ``most`` characters, white space squeezed, without e-mail address, phone number or URL."""
    text = squeeze(c)
    return F.coalesce(F.length(text).between(20, most) & ~text.rlike(EMAIL_START) & ~text.rlike(PHONE) & ~text.rlike(URL), F.lit(False))


def split_list(c: Column) -> Column:
    """Items of a pipe-delimited value, trimmed, without empty ones; null gives an empty array."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), r"\|"), lambda x: F.btrim(x)), lambda x: x != "")


def label_list(c: Column, valid: list[str], none: str = "none") -> tuple[Column, Column]:
    """(labels in the order of ``valid``, error): separators unified, distinct, ``none`` alone or not at all."""
    labels = F.array_distinct(split_list(F.regexp_replace(F.lower(F.btrim(c)), "[,;]", "|")))
    known = F.array(*[F.lit(x) for x in valid])
    wrong = F.array_sort(F.array_except(labels, F.concat(known, F.array(F.lit(none)))))
    error = F.when(F.size(wrong) > 0, F.concat(F.lit("invalid labels: "), F.array_join(wrong, ", "))).when(F.array_contains(labels, none) & (F.size(labels) > 1), "none must be the only label")
    inside = F.filter(F.concat(known, F.array(F.lit(none))), lambda x: F.array_contains(labels, x))
    return F.when(error.isNull(), inside).otherwise(F.array().cast("array<string>")), error


def approved(c: Column) -> Column:
    return F.coalesce(F.lower(F.btrim(c)).isin("yes", "true", "1", "approved"), F.lit(False))


def judged_valid(c: Column) -> Column:
    return F.coalesce(F.lower(F.btrim(c)).isin("yes", "true", "1", "valid"), F.lit(False))


def slug(c: Column, most: int = 48) -> Column:
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(c), r"[^a-z0-9]+", "-"), r"^-+|-+$", ""), 1, most)


def place_key(identity: Column) -> Column:
    """A place id from its identity: a readable part and ten digits of a hash."""
    return F.concat(F.lit("upload-"), slug(identity), F.lit("-"), F.substring(F.sha1(F.lower(identity)), 1, 10))


def display(c: Column) -> Column:
    return F.initcap(F.replace(c, F.lit("_"), F.lit(" ")))


def column_name(name: object) -> str:
    """A snake_case column name; of nothing, ``unnamed``."""
    text = unicodedata.normalize("NFKC", "" if name is None else str(name)).lower()
    word = "".join(ch if ch.isascii() and ch.isalnum() else " " for ch in text)
    return "_".join(word.split()) or "unnamed"


def column_names(names: list) -> list[str]:
    """Snake-case names made unique: the second of a name ends in _2, and so on."""
    seen: dict[str, int] = {}
    out = []
    for n in map(column_name, names):
        seen[n] = seen.get(n, 0) + 1
        out.append(n if seen[n] == 1 else f"{n}_{seen[n]}")
    return out
