"""What reports are put together from: figures of several files, examples of errors, names of areas, privacy findings."""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gapline.functions import text as X
from gapline.operators.sampling import shuffled

# Fixed values.
AREAS = {
    0: "Pangururan - Sianjur Mula-mula", 1: "Bakti Raja - Tipang", 2: "Silalahi - Paropo", 3: "Balige dan Sekitarnya", 4: "Tuktuk - Tomok",
    5: "Parapat - Ajibata", 6: "Porsea - Sigumpar - Silaen", 7: "Tigaras - Simarjarunjung", 8: "Tarutung dan Sekitarnya",
}
NO_AREA, OTHER_AREA = "Koordinat belum tersedia", "Klaster lokasi "
CAUSES = {
    "SHORT_TEXT": "Teks sangat pendek memberi konteks terbatas", "MIXED_SENTIMENT": "Sinyal positif dan negatif muncul bersamaan", "NEGATION": "Pola negasi masih sulit dibedakan",
    "RATING_TEXT_MISMATCH": "Rating dan isi teks tidak konsisten", "TYPO_OR_INFORMAL": "Bahasa informal atau typo", "GENERAL_MODEL_ERROR": "Pola bahasa belum terwakili dengan baik",
}
NO_CAUSE = "Perlu analisis data tambahan"


def close(a: Column, b: Column, tolerance: float = 1e-10) -> Column:
    """Whether two numbers are equal but for rounding; null if either is."""
    return F.abs(a.cast("double") - b.cast("double")) <= tolerance


def area_name(cluster: Column) -> Column:
    """The name of a cluster's area; a stated default for clusters without one and for places without a position."""
    out = F.concat(F.lit(OTHER_AREA), (cluster + 1).cast("string"))
    for k, name in AREAS.items():
        out = F.when(cluster == k, name).otherwise(out)
    return F.when(cluster.isNull(), NO_AREA).otherwise(out)


def likely_cause(tags: Column) -> Column:
    """The cause of the first tag (of a pipe list) that has one."""
    known = F.create_map(*[F.lit(x) for kv in CAUSES.items() for x in kv])
    return F.coalesce(F.get(F.array_compact(F.transform(X.split_list(tags), lambda t: F.try_element_at(known, t))), F.lit(0)), F.lit(NO_CAUSE))


def error_examples(errors: DataFrame, key: str, most: int = 180, rows: int = 4, seed: int = 42) -> DataFrame:
    """A few wrong predictions that may be shown, in seeded order, with a likely cause.

    ``errors``: ``key``, ``text``, ``actual_label``, ``predicted_label``, ``error_type``, ``analysis_tags``.
    """
    text = X.squeeze(F.col("text"))
    safe = errors.where(X.shareable(F.col("text"), most)).orderBy(shuffled(F.col(key), seed)).limit(rows)
    return safe.select(key, X.redact(text).alias("text"), "actual_label", "predicted_label", X.display(F.col("error_type")).alias("error_type"), likely_cause(F.col("analysis_tags")).alias("likely_cause"))


def collate(reports: Mapping[str, Mapping], wanted: Mapping[str, str]) -> dict[str, object]:
    """Figures of several reports under one roof: ``wanted`` is name -> "report/field/field". A missing one is an error that names it."""
    out = {}
    for name, path in wanted.items():
        value: object = reports
        for part in path.split("/"):
            if not isinstance(value, Mapping) or part not in value:
                raise KeyError(f"{name}: no {path}")
            value = value[part]
        out[name] = value
    return out


def differing(stated: Mapping[str, object], found: Mapping[str, object], tolerance: float = 1e-10) -> list[str]:
    """Names whose stated value is not the one found; numbers may differ by rounding."""
    number = lambda v: isinstance(v, int | float) and not isinstance(v, bool)
    same = lambda a, b: math.isclose(a, b, rel_tol=0, abs_tol=tolerance) if number(a) and number(b) else a == b
    return sorted(n for n in {*stated, *found} if n not in stated or n not in found or not same(stated[n], found[n]))


def privacy_findings(texts: DataFrame, path: str, text: str, forbidden: list[str], account: str | None = None) -> DataFrame:
    """``path`` and ``finding``, a row per kind of thing that must not be in a published file: an address, a phone number, an absolute
    path, the name of an account as a word, a forbidden field. Whole texts are looked at.
    """
    low = F.lower(text)
    checks = {"email": F.col(text).rlike(X.EMAIL_START), "phone": F.col(text).rlike(X.PHONE), "absolute_path": F.col(text).rlike(r"(?i)\b[a-z]:\\[^\s]|/(?:home|users)/[^\s/]+/")}
    if account and len(account.strip()) >= 3:
        plain = "".join(c if c.isalnum() else f"\\{c}" for c in account.strip().lower())
        checks["account"] = low.rlike(rf"(?<![a-z0-9_]){plain}(?![a-z0-9_])")
    checks |= {f"field:{f}": F.contains(low, F.lit(f.lower())) for f in forbidden}
    found = F.array_compact(F.array(*[F.when(c, n) for n, c in checks.items()]))
    return texts.select(path, F.explode(found).alias("finding"))
