"""Language identification by interpolated Kneser-Ney character models, one per language.

Training counts the grams of ``ORDER`` lower-cased letters (a run of anything else is one edge) over every training document, per language, in a map-side
pass and one aggregation; lower orders are continuation counts of those. A gram is packed into 64 bits (12 bits a
character, so grams of up to five), and a model is, per order, one sorted array of packed grams with their interpolated
probabilities and one of packed contexts with their back-off weights, searched by bisection. A document's score for a
language is the cross-entropy per character over its whole text; the lowest wins. Calibration turns cross-entropies
into a probability and bounds what a text of the language may cost; what fails either is rejected.

No gram is left out, so the models grow with the different grams of the training texts: some 50 bytes each in the driver
and in every Python worker. Letters are counted over all training texts; those beyond the ``ALPHABET`` of greatest share in a language
are one class. Calibration uses ``calibration`` different training texts, as many of each language and at least ``LEAST``, chosen by hash.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gapline.llm.common import cut, long_texts
from gapline.llm.packing import slices

BITS, ORDER, ALPHABET = 12, 5, 4000
EDGE, OTHER = 0, 1  # classes of characters: text edges and all that is no letter, rare letters
CHUNK = 1_500_000
LEAST = 100  # calibration texts of a language, if it has them


def held_out(id_col: Column, modulus: int, rest: int) -> Column:
    """Whether crc32 of the id's text leaves ``rest``; a null id is held out."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % modulus == rest, F.lit(True))


def letter_classes(common: list[int]) -> np.ndarray:
    """The class of each code point: letters and marks have their own if ``common``, else OTHER; the rest are EDGE."""
    classes = np.full(0x110000, EDGE, np.uint16)
    classes[[i for i in range(0x110000) if unicodedata.category(chr(i))[0] in "LM"]] = OTHER
    classes[common] = np.arange(2, len(common) + 2)
    return classes


def _letters(batches):
    """Per slice of a batch and language, the lower-cased letters and their counts."""
    for whole in batches:
        for b in slices(whole, "text", CHUNK):
            texts, of = b.column("text").to_pylist(), b.column("lang").to_pylist()
            for lang in dict.fromkeys(of):
                text = "".join(t.lower() for t, x in zip(texts, of, strict=True) if x == lang)
                found = pa.array(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")).value_counts().to_pylist()
                found = [(x["values"], x["counts"]) for x in found if unicodedata.category(chr(x["values"]))[0] in "LM"]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found), pa.string()), pa.array([c for c, _ in found], pa.int32()), pa.array([n for _, n in found], pa.int64())], ["lang", "letter", "n"])


def _alphabet(rows: DataFrame) -> list[int]:
    """The letters of ``rows`` by their greatest share of a language's letters, up to ``ALPHABET``."""
    n = rows.mapInArrow(_letters, "lang string, letter int, n long").groupBy("lang", "letter").agg(F.sum("n").alias("n"))
    n = cut(n)
    share = n.join(n.groupBy("lang").agg(F.sum("n").alias("total")), "lang").groupBy("letter").agg(F.max(F.col("n") / F.col("total")).alias("share"))
    return [r.letter for r in share.orderBy(F.desc("share"), "letter").limit(ALPHABET).collect()]


def _calibration(rows: DataFrame, size: int) -> pa.Table:
    """Different texts of ``rows`` with the smallest hashes of their language: the hashes are chosen, then those texts fetched."""
    hashes = cut(rows.select("lang", F.xxhash64("text").alias("h")).distinct())
    kinds = hashes.groupBy("lang").agg(F.count(F.lit(1)).alias("kinds"))
    each = max(LEAST, -(-size // max(1, kinds.count())))
    # of a language with many texts, only hashes low enough to hold four times as many as wanted are ranked
    low = hashes.join(F.broadcast(kinds), "lang").where((F.col("h") / F.lit(2.0**64) + 0.5) * F.col("kinds") <= 4 * each)
    first = low.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("k") <= each).select("lang", "h")
    found = rows.withColumn("h", F.xxhash64("text")).join(F.broadcast(first), ["lang", "h"])
    return found.groupBy("lang", "h").agg(F.min("text").alias("text")).orderBy("lang", "h").toArrow()


def codes(texts: list[str | None], classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed grams, one per letter, run of other characters and text's end, and where each text's grams end."""
    parts = [(t or "").lower() for t in texts]
    size = np.fromiter(map(len, parts), np.int64, len(parts)) + 1
    chars = np.frombuffer(("\n".join(parts) + "\n").encode("utf-32-le", "surrogatepass"), "<u4")
    c = classes[chars]
    ends = np.cumsum(size)
    keep = c != EDGE
    keep[:-1] |= c[1:] != EDGE
    keep[ends - 1] = True
    c = c[keep].astype(np.uint64)
    ends = np.cumsum(keep)[ends - 1]
    size = np.diff(ends, prepend=0)
    gram = c.copy()
    # characters before a text's first are edges
    place = np.arange(len(c)) - np.repeat(ends - size, size)
    for k in range(1, ORDER):
        prev = np.zeros_like(c)
        prev[k:] = c[:-k]
        prev[place < k] = EDGE
        gram |= prev << np.uint64(BITS * k)
    return gram, ends


def _count(classes):
    def run(batches):
        held: dict[str, list] = {}
        size = 0
        for whole in batches:
            for b in slices(whole, "text", CHUNK):
                texts, of = b.column("text").to_pylist(), b.column("lang").to_pylist()
                for lang in dict.fromkeys(of):
                    gram, _ = codes([t for t, x in zip(texts, of, strict=True) if x == lang], classes.value)
                    coded = pa.array(gram.view(np.int64)).value_counts()
                    held.setdefault(lang, []).append((coded.field(0).to_numpy(), coded.field(1).to_numpy()))
                    size += len(coded)
                if size > 1_000_000:
                    yield from _sums(held)
                    held, size = {}, 0
        yield from _sums(held)

    return run


def _sums(held):
    for lang, parts in held.items():
        g, inv = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        n = np.bincount(inv, np.concatenate([p[1] for p in parts])).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(g), pa.string()), pa.array(g), pa.array(n)], ["lang", "gram", "n"])


def kneser_ney(gram: np.ndarray, n: np.ndarray, order: int = ORDER) -> list[tuple]:
    """From packed grams and counts: per order 1..``order`` sorted (grams, probabilities, contexts, back-off weights)."""
    low = [None] * (order + 1)
    low[order] = (gram, n.astype(np.float64))
    for k in range(order - 1, 0, -1):
        g, c = np.unique(low[k + 1][0] & np.uint64((1 << (BITS * k)) - 1), return_counts=True)
        low[k] = (g, c.astype(np.float64))
    out: list[tuple] = []
    for k in range(1, order + 1):
        g, c = low[k]
        one, two = float((c == 1).sum()), float((c == 2).sum())
        d = one / (one + 2 * two) if one and two else 0.5
        ctx, at = np.unique(g >> np.uint64(BITS), return_inverse=True)
        total, kinds = np.bincount(at, c), np.bincount(at)
        back = d * kinds / total
        below = out[-1][1][np.searchsorted(out[-1][0], g & np.uint64((1 << (BITS * (k - 1))) - 1))] if out else 1.0 / (1 << BITS)
        out.append((g, np.maximum(c - d, 0) / total[at] + back[at] * below, ctx, back))
    return out


def _find(where: np.ndarray, what: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(where, what), len(where) - 1)
    return at, where[at] == what


def log_probability(model: list[tuple], gram: np.ndarray) -> np.ndarray:
    """Natural log of the interpolated probability of each packed gram (sorted input is fastest)."""
    p = np.full(len(gram), 1.0 / (1 << BITS))
    for k, (grams, prob, ctx, back) in enumerate(model, 1):
        part = gram & np.uint64((1 << (BITS * k)) - 1)
        at, seen = _find(grams, part)
        c_at, c_seen = _find(ctx, part >> np.uint64(BITS))
        p = np.where(seen, prob[at], np.where(c_seen, back[c_at] * p, p))
    return np.log(p)


def cross_entropies(texts: list[str | None], classes: np.ndarray, models: list) -> np.ndarray:
    """Nats per character of every text under every model: one row per text."""
    gram, ends = codes(texts, classes)
    coded = pa.array(gram.view(np.int64)).dictionary_encode()
    kinds = coded.dictionary.to_numpy().view(np.uint64)
    at = coded.indices.to_numpy()
    order = np.argsort(kinds)
    size = np.diff(ends, prepend=0)
    out = np.empty((len(texts), len(models)))
    for j, m in enumerate(models):
        lp = np.empty(len(kinds))
        lp[order] = log_probability(m, kinds[order])
        out[:, j] = -np.add.reduceat(lp[at], ends - size) / size if len(texts) else 0
    return out


def _posterior(ce: np.ndarray, slope: float) -> np.ndarray:
    z = -slope * (ce - ce.min(axis=1, keepdims=True))
    e = np.exp(z)
    return e / e.sum(axis=1, keepdims=True)


def _calibrate(ce: np.ndarray, truth: np.ndarray) -> tuple[float, np.ndarray]:
    """The slope of least log loss on a grid, and per language the most that a text of it may cost per character."""
    slopes = np.geomspace(1, 200, 40)
    rows = np.arange(len(truth))
    loss = [-np.log(np.maximum(_posterior(ce, s)[rows, truth], 1e-12)).mean() for s in slopes]
    ceiling = np.array([1.5 * ce[truth == j, j].max() if (truth == j).any() else np.inf for j in range(ce.shape[1])])
    return float(slopes[int(np.argmin(loss))]), ceiling


def train(rows: DataFrame, calibration: int = 2000) -> dict | None:
    """Models from ``text`` and ``lang`` of all rows where both are there; None if there are none."""
    rows = rows.where("text is not null and lang is not null").select("text", F.col("lang").cast("string"))
    long_texts(rows.sparkSession)
    sc = rows.sparkSession.sparkContext
    first = _calibration(rows, calibration)
    if not first.num_rows:
        return None
    classes = letter_classes(_alphabet(rows))
    shared = sc.broadcast(classes)
    grams = rows.mapInArrow(_count(shared), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    table = grams.toArrow()
    names = sorted(pc.unique(table.column("lang")).to_pylist())
    models = []
    for x in names:  # one language at a time, and its name never as an object a row
        mine = table.filter(pc.equal(table.column("lang"), x))
        gram, n = mine.column("gram").to_numpy().view(np.uint64), mine.column("n").to_numpy()
        order = np.argsort(gram)
        models.append(kneser_ney(gram[order], n[order]))
    del table
    truth = np.array([names.index(x) if x in names else -1 for x in first.column("lang").to_pylist()])
    ce = np.concatenate([cross_entropies(first.column("text").to_pylist()[i : i + 100], classes, models) for i in range(0, first.num_rows, 100)])
    slope, ceiling = _calibrate(ce[truth >= 0], truth[truth >= 0])
    return {"names": names, "models": models, "classes": classes, "slope": slope, "ceiling": ceiling}


def identify(documents: DataFrame, model: dict | None, min_score: float = 0.3, unknown: str = "und") -> DataFrame:
    """``documents`` with ``lang_pred``, ``score`` (the calibrated probability), ``cross_entropy`` and ``rejected``.

    ``rejected``: no language, a score under ``min_score``, or a cost per character over what the language may cost. Only
    ``text`` is looked at, all of it. Defined cases: null text and text without a letter are ``unknown`` with score 0, rejected; so
    is every text when there is no model; repeated rows are judged alike; equal cross-entropies go to the first
    language by name; columns of these names that are there already are replaced; an empty table gives an empty result.
    """
    long_texts(documents.sparkSession)
    made = ["lang_pred", "score", "cross_entropy", "rejected"]
    docs = documents.drop(*made)
    keep = docs.columns
    shared = documents.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*docs.schema.fields, *[T.StructField(n, t) for n, t in zip(made, (T.StringType(), T.DoubleType(), T.DoubleType(), T.BooleanType()), strict=True)]])

    def run(batches):
        m = shared.value
        for whole in batches:
            for b in slices(whole, "text", CHUNK):
                texts = b.column("text").to_pylist()
                lettered = np.array(b.column("_letter").to_pylist(), bool)
                pred, score = np.full(len(texts), unknown, object), np.zeros(len(texts))
                cost, out = np.full(len(texts), np.nan), np.ones(len(texts), bool)
                if m is not None and lettered.any():
                    at = np.flatnonzero(lettered)
                    ce = cross_entropies([texts[i] for i in at], m["classes"], m["models"])
                    best = ce.argmin(axis=1)
                    row = np.arange(len(at))
                    pred[at] = np.array(m["names"], object)[best]
                    score[at] = _posterior(ce, m["slope"])[row, best]
                    cost[at] = ce[row, best]
                    out[at] = (score[at] < min_score) | (cost[at] > m["ceiling"][best])
                yield pa.RecordBatch.from_arrays(
                    [b.column(c) for c in keep] + [pa.array(pred, pa.string()), pa.array(score), pa.array(cost, from_pandas=True), pa.array(out)], keep + made
                )

    letter = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    return docs.withColumn("_letter", letter).mapInArrow(run, schema)
