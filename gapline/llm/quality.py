"""Quality scores by nearest-neighbour voting in a latent semantic space.

A text is three bags of terms: hashed character trigrams (case kept, so shouting shows), hashed trigrams of character kinds
(upper, lower, digit, space, each symbol: how a text looks, whatever its words) and occurrences of its words (the first, the
second, the third to fourth and so on, and those that repeat the word before). Counts are damped, weighted by inverse document
frequency and scaled to length 1 in each bag; a truncated SVD over all terms gives the latent space. The space and its labelled
neighbours are fitted on a bounded sample of labelled rows, ``per_label`` of each label chosen by hash, and broadcast (at most
2 x ``per_label`` x ``dims`` floats and ``TERMS`` x ``dims``). Every document's cosine with every neighbour is computed exactly, in
blocks, and its ``k`` nearest vote with their similarity.
"""

from __future__ import annotations

import functools
import itertools
import operator
import unicodedata
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gapline.llm.common import cut, long_texts
from gapline.llm.packing import slices

BUCKETS, SHAPES, OCCURRENCES = 4096, 512, 26
TERMS = BUCKETS + SHAPES + OCCURRENCES
#: What each bag weighs in a text's vector.
BAGS = (1.0, 1.0, 2.0)
#: The power of a neighbour's cosine in its vote, so that of few labelled texts the near ones decide.
SHARPNESS = 32
CHUNK = 1_500_000
ROWS = 256
MIX = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93))


@functools.cache
def kinds() -> np.ndarray:
    """The kind of each character of the basic plane; the last entry is that of all others."""
    names = {"Lu": 1, "Lt": 1, "Ll": 2, "Lo": 2, "Lm": 2, "Nd": 3}
    of = lambda c, k: names.get(k) or (4 if c.isspace() else 8 + ord(c) if k[0] in "PS" else 5)
    return np.array([of(chr(i), unicodedata.category(chr(i))) for i in range(0x10000)] + [2], np.uint64)


def _trigrams(chars: np.ndarray, bits: int) -> np.ndarray:
    """The bucket of each run of three."""
    mixed = (chars[:-2] * MIX[0] ^ chars[1:-1] * MIX[1] ^ chars[2:] * MIX[2]) * MIX[3]
    return (mixed >> np.uint64(64 - bits)).astype(np.int64)


def _bags(texts: list[str | None], bits: int, kind: bool) -> np.ndarray:
    size = np.fromiter((len(t or "") for t in texts), np.int64, len(texts))
    chars = np.frombuffer("".join(t or "" for t in texts).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    out = np.zeros((len(texts), 1 << bits), np.float32)
    if len(chars) < 3:
        return out
    bucket = _trigrams(kinds()[np.minimum(chars, 0x10000)] if kind else chars, bits)
    ends = np.cumsum(size)
    for i, (a, b) in enumerate(zip(ends - size, ends - 2, strict=True)):
        if b > a:
            out[i] = np.bincount(bucket[a:b], minlength=1 << bits)
    return out


def features(texts: list[str | None]) -> np.ndarray:
    """Counts of hashed character trigrams of whole texts, a row per text; texts under three characters have none."""
    return _bags(texts, 12, False)


def shapes(texts: list[str | None]) -> np.ndarray:
    """Counts of hashed trigrams of character kinds."""
    return _bags(texts, 9, True)


def occurrences(texts: list[str | None]) -> np.ndarray:
    """How many words stand there for the 1st, the 2nd, the 3rd to 4th ... time; last, how many do and don't repeat the word before."""
    out = np.zeros((len(texts), OCCURRENCES), np.float32)
    for i, t in enumerate(texts):
        if words := (t or "").split():
            n = np.fromiter(Counter(words).values(), np.int64)
            most = int(n.max())
            out[i, 0] = len(n)
            for k in range(1, OCCURRENCES - 2):
                low = 1 << (k - 1)  # the places low + 1 to 2 low
                if most <= low:
                    break
                out[i, k] = np.clip(n - low, 0, low).sum()
            out[i, -2] = sum(map(operator.eq, words, itertools.islice(words, 1, None)))
            out[i, -1] = len(words) - out[i, -2]
    return out


def look(texts: list[str | None]) -> tuple[np.ndarray, ...]:
    return features(texts), shapes(texts), occurrences(texts)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def weigh(seen: tuple[np.ndarray, ...], idf: tuple[np.ndarray, ...]) -> np.ndarray:
    """The term vectors, scaled to length 1 in each bag and as a whole; a text without terms is the zero row."""
    damped = (np.log1p(seen[0]), np.log1p(seen[1]), np.sqrt(seen[2]))
    return _unit(np.hstack([w * _unit(x * f) for x, f, w in zip(damped, idf, BAGS, strict=True)]))


def embed(seen: tuple[np.ndarray, ...], model: dict) -> np.ndarray:
    """Unit rows of the latent space."""
    return _unit(weigh(seen, model["idf"]) @ model["axes"])


def _blocks(texts):
    """Positions of ``texts`` in runs of at most ROWS rows and CHUNK characters, a row at least."""
    i = 0
    while i < len(texts):
        j, n = i, 0
        while j < len(texts) and j - i < ROWS and (j == i or n + len(texts[j] or "") <= CHUNK):
            n += len(texts[j] or "")
            j += 1
        yield i, j
        i = j


def fit(documents: DataFrame, labels: DataFrame, column: str = "quality", per_label: int = 1500, dims: int = 64, k: int = 25) -> dict | None:
    """A model from at most ``per_label`` documents of each label (0 or 1), or None without labelled documents.

    ``documents``: ``doc_id`` and ``text``; ``labels``: ``doc_id`` and ``column``, the largest of repeated labels holds. Ids are chosen first, by
    hash and without texts, so only the chosen texts move.
    """
    marks = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(column).cast("int").alias("label"))
    ids = cut(documents.where("text is not null").select("doc_id").join(marks.where("label in (0, 1)"), "doc_id").distinct())
    parts = []
    for v in (0, 1):
        few = ids.where(F.col("label") == v).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_label)
        rows = documents.where("text is not null").select("doc_id", "text").join(F.broadcast(few), "doc_id")
        parts.append(rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.min("label").alias("label")).orderBy("doc_id").toArrow())
    texts = [t for p in parts for t in p.column("text").to_pylist()]
    label = np.array([v for p in parts for v in p.column("label").to_pylist()], np.float32)
    if not texts:
        return None
    del parts
    # one matrix of all terms, filled and weighted in blocks in its place: the driver holds it once
    x = np.empty((len(texts), TERMS), np.float32)
    bags = lambda i, j: tuple(np.split(x[i:j], [BUCKETS, BUCKETS + SHAPES], axis=1))
    within = np.zeros(TERMS, np.int64)
    for i, j in _blocks(texts):
        np.concatenate(look(texts[i:j]), axis=1, out=x[i:j])
        within += (x[i:j] > 0).sum(axis=0)
    idf = (np.log((1 + len(texts)) / (1 + within)) + 1).astype(np.float32)
    model = {"idf": (idf[:BUCKETS], idf[BUCKETS : BUCKETS + SHAPES], np.ones(OCCURRENCES, np.float32))}
    for i, j in _blocks(texts):
        x[i:j] = weigh(bags(i, j), model["idf"])
    d = max(1, min(dims, len(texts)))
    probe = np.random.default_rng(5).standard_normal((TERMS, d + 16)).astype(np.float32)
    for _ in range(4):  # randomised range finder with power steps
        probe = x.T @ np.linalg.qr(x @ probe)[0]
    q = np.linalg.qr(x @ probe)[0]
    axes = np.linalg.svd(q.T @ x, full_matrices=False)[2][:d].T
    model["axes"] = np.ascontiguousarray(axes, np.float32)
    model |= {"points": _unit(x @ model["axes"]), "label": label, "k": min(k, len(label)), "base": float(label.mean())}
    return model


def vote(seen: tuple[np.ndarray, ...], model: dict) -> np.ndarray:
    """Share of label 1 among the ``k`` nearest, weighted by similarity (negative: none); the base rate without any weight."""
    s = embed(seen, model) @ model["points"].T
    k = model["k"]
    near = np.argpartition(-s, k - 1, axis=1)[:, :k]
    w = np.maximum(np.take_along_axis(s, near, axis=1), 0).astype(np.float64)
    best = w.max(axis=1, keepdims=True)
    w = (w / np.where(best > 0, best, 1)) ** SHARPNESS
    return np.where(best[:, 0] > 0, (w * model["label"][near]).sum(axis=1) / np.maximum(w.sum(axis=1), 1e-12), model["base"])


def score(documents: DataFrame, model: dict | None, threshold: float = 0.3) -> DataFrame:
    """``documents`` with ``score`` (0 to 1, higher: label 1 likelier) and ``predicted`` (1 if score >= ``threshold``).

    Only ``text`` is looked at, all of it. Defined cases: null, empty and featureless texts score the labelled sample's
    share of label 1; without labelled rows every score is 0.5; repeated rows score alike; columns of
    these names that are there already are replaced; an empty table gives an empty result.
    """
    long_texts(documents.sparkSession)
    docs = documents.drop("score", "predicted")
    keep = docs.columns
    shared = documents.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def run(batches):
        m = shared.value
        for whole in batches:
            for b in slices(whole, "text", CHUNK):
                texts = b.column("text").to_pylist()
                out = np.full(len(texts), 0.5)
                for i, j in _blocks(texts) if m is not None else ():
                    out[i:j] = vote(look(texts[i:j]), m)
                yield pa.RecordBatch.from_arrays([b.column(c) for c in keep] + [pa.array(out), pa.array((out >= threshold).astype(np.int32))], [*keep, "score", "predicted"])

    return docs.mapInArrow(run, schema)
