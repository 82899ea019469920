"""Names to canonical places: similarity, evidence, and the ordered fold that decides."""

from __future__ import annotations

import math
import os
import re
from collections import Counter
from collections.abc import Iterable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

AUTO, REVIEW = 94.0, 88.0
CATEGORY_BONUS, TYPE_BONUS, NEAR_BONUS, NEAR_DEGREES = 2.0, 1.0, 3.0, 0.002
LEAST = REVIEW - CATEGORY_BONUS - TYPE_BONUS - NEAR_BONUS  # less likeness than this founds a place whatever else speaks for it


def evidence_bonus(a: str, b: str) -> Column:
    """What else speaks for two rows being one place; columns carry the prefixes ``a`` and ``b``."""
    same = lambda c, n: F.when((F.col(a + c) == F.col(b + c)) & (F.col(a + c) != ""), n).otherwise(0.0)
    near = (F.abs(F.col(a + "lat") - F.col(b + "lat")) <= NEAR_DEGREES) & (F.abs(F.col(a + "lon") - F.col(b + "lon")) <= NEAR_DEGREES)
    return same("category", CATEGORY_BONUS) + same("place_type", TYPE_BONUS) + F.when(near, NEAR_BONUS).otherwise(0.0)


def match_status(score: Column) -> Column:
    return F.when(score >= AUTO, "auto").when(score >= REVIEW, "new_needs_manual_review").otherwise("new")


def edits(a: str, others: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The edit distances of ``a`` and many texts: the columns of all tables at once, in the bits of one number per text (by rows where ``a`` has more than 64 letters).

    ``others`` has a text's code points down a column, ``lengths`` ascend.
    """
    score = np.full(len(lengths), len(a), np.int64)
    if not a or not len(lengths):
        return lengths.astype(np.int64) if not a else score
    if len(a) > 64:
        row = np.repeat(np.arange(len(a) + 1)[:, None], len(lengths), axis=1)
        for j in range(lengths[-1]):
            at = np.searchsorted(lengths, j, "right")
            last = row[:, at:].copy()
            row[0, at:] = j + 1
            for i, c in enumerate(map(ord, a)):
                row[i + 1, at:] = np.minimum(np.minimum(row[i, at:], last[i + 1]) + 1, last[i] + (others[j, at:] != c))
        return row[-1]
    kind = np.uint32 if len(a) <= 32 else np.uint64
    one, high = kind(1), kind(1 << (len(a) - 1))
    letters = np.unique(np.array([*map(ord, a)], others.dtype))
    masks = np.zeros(len(letters) + 1, kind)
    for i, c in enumerate(a):
        masks[np.searchsorted(letters, ord(c))] |= kind(1 << i)
    place = np.minimum(np.searchsorted(letters, others), len(letters) - 1)
    places = np.where(letters[place] == others, place, len(letters))
    up, down = np.full(len(lengths), ~kind(0)), np.zeros(len(lengths), kind)
    for j in range(lengths[-1]):
        at = np.searchsorted(lengths, j, "right")
        p, m, same = up[at:], down[at:], masks[places[j, at:]]
        x = (((same & p) + p) ^ p) | same
        more, less = m | ~(x | p), p & x
        score[at:] += (more & high) != 0
        score[at:] -= (less & high) != 0
        more, less, x = (more << one) | one, less << one, same | m
        up[at:], down[at:] = less | ~(x | more), more & x
    return score


def similar_names(rows: DataFrame, key: str, name: str, within: str, least: float, block: int = 2048) -> DataFrame:
    """Pairs of rows of one ``within`` whose names are alike by ``base`` >= ``least`` (100 less the share of edits), the smaller ``key`` first: the columns but ``name`` with ``a_`` and ``b_``, and ``base``.

    All pairs are compared, which is quadratic in the largest group. A group is cut by hash into blocks of about ``block`` rows and each pair of blocks is compared on its
    own, so no group is one task's work and a task holds a few pairs of blocks; only pairs that are alike leave it.
    """
    rows = rows.where(F.col(within).isNotNull() & F.col(name).isNotNull() & F.col(key).isNotNull())
    many = rows.groupBy(within).agg(F.ceil(F.count(F.lit(1)) / F.lit(block)).alias("_n"))
    put = rows.join(many, within).withColumn("_i", F.pmod(F.xxhash64(key), F.col("_n")))
    whole = put.groupBy(F.col(within).alias("_w"), "_i", "_n").agg(F.collect_list(F.struct(*rows.columns)).alias("_x"))
    left = whole.select("_w", "_i", "_x", F.explode(F.expr("sequence(_i, _n - 1)")).alias("_j"))
    right = whole.select("_w", F.col("_i").alias("_j"), F.col("_x").alias("_y"))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pairs = left.join(right, ["_w", "_j"]).repartition(parts, "_w", "_i", "_j").select((F.col("_i") == F.col("_j")).alias("same"), F.col("_x").alias("x"), F.col("_y").alias("y"))
    carried = [c for c in rows.columns if c != name]
    schema = ", ".join([*(f"`{p}{c}` {rows.schema[c].dataType.simpleString()}" for p in ("a_", "b_") for c in carried), "base double"])

    def one(same: bool, x: pa.StructArray, y: pa.StructArray):
        x, y = (dict(zip((f.name for f in t.type), t.flatten(), strict=True)) for t in (x, y))
        left, right = x[name].to_pylist(), y[name].to_pylist()
        head = len(os.path.commonprefix([*left, *right]))
        by_length = np.array(sorted(range(len(right)), key=lambda i: len(right[i])), np.int64)
        y = {c: v.take(pa.array(by_length)) for c, v in y.items()}
        texts = [right[i][head:] for i in by_length]
        lengths = np.array([*map(len, texts)], np.int64)
        codes = np.zeros((max(1, lengths[-1]), len(texts)), np.int32)
        for i, t in enumerate(texts):
            codes[: len(t), i] = [*map(ord, t)]
        before, after = x[key].to_numpy(zero_copy_only=False), y[key].to_numpy(zero_copy_only=False)
        held, n = [], 0
        for i, text in enumerate(left):
            size = len(text)
            low, high = np.searchsorted(lengths + head, [size * least / 100 - 1e-6, size * 100 / least + 1e-6])
            most = np.maximum(size, lengths[low:high] + head)
            far = edits(text[head:], codes[:, low:high], lengths[low:high])
            with np.errstate(invalid="ignore"):
                base = 100.0 * (1.0 - far / most.astype(float))
            first = before[i] < after[low:high]
            found = np.flatnonzero((base >= least) & (first if same else first | (before[i] > after[low:high])))
            held.append((np.full(len(found), i), found + low, base[found], first[found]))
            n += len(found)
            if n >= 50_000 or i == len(left) - 1:
                at, to, base, first = (np.concatenate(z) for z in zip(*held, strict=True))
                held, n = [], 0
                for turn, p, q, u, v in ((first, x, y, at, to), (~first, y, x, to, at)):
                    u, v = pa.array(u[turn]), pa.array(v[turn])
                    yield pa.RecordBatch.from_arrays([*(p[c].take(u) for c in carried), *(q[c].take(v) for c in carried), pa.array(base[turn])], [*(f"a_{c}" for c in carried), *(f"b_{c}" for c in carried), "base"])

    def compare(batches):
        for b in batches:
            for i in range(b.num_rows):
                yield from one(b.column("same")[i].as_py(), b.column("x")[i].values, b.column("y")[i].values)

    return pairs.mapInArrow(compare, schema)


def common(a: str, b: str) -> int:
    """Length of the longest common subsequence, all rows of the table at once in the bits of one number."""
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = state = (1 << len(a)) - 1
    for c in b:
        u = state & where.get(c, 0)
        state = ((state + u) | (state - u)) & full
    return len(a) - state.bit_count()


def ratio(a: str, b: str) -> float:
    """0 to 100: twice the common subsequence over both lengths."""
    return 200.0 * common(a, b) / (len(a) + len(b)) if a or b else 100.0


def partial(a: str, b: str) -> float:
    """The best ratio of the shorter text with a part of the longer one that is as long, or shorter at its ends."""
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 0.0
    if a in b:
        return 100.0
    parts = {b[max(0, i) : i + len(a)] for i in range(1 - len(a), len(b))}
    return max(ratio(a, p) for p in parts)


def token_ratio(a: str, b: str) -> float:
    """The better of the ratio of the words in order and of what shared words leave to compare."""
    x, y = set(a.split()), set(b.split())
    shared, only_a, only_b = (" ".join(sorted(w)) for w in (x & y, x - y, y - x))
    best = ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))
    if shared and (not only_a or not only_b):
        return 100.0
    with_a, with_b = f"{shared} {only_a}".strip(), f"{shared} {only_b}".strip()
    # the shared words are equal on both sides, so only the rest can differ
    same = 2 * common(only_a, only_b) + 2 * (len(with_a) - len(only_a))
    best = max(best, 100.0 * same / (len(with_a) + len(with_b)) if with_a or with_b else 0.0)
    if shared:
        best = max(best, *(200.0 * len(shared) / (len(shared) + len(w)) for w in (with_a, with_b)))
    return best


def partial_token_ratio(a: str, b: str) -> float:
    x, y = set(a.split()), set(b.split())
    if x & y:
        return 100.0
    return max(partial(" ".join(sorted(a.split())), " ".join(sorted(b.split()))), partial(" ".join(sorted(x - y)), " ".join(sorted(y - x))))


def name_similarity(a: str, b: str) -> float:
    """0 to 100: the weighted ratio. Names of near lengths: plain, or by words at 95 %; else the best part at 90 % (60 % beyond eight times the length)."""
    if not a or not b:
        return 0.0
    longer = max(len(a), len(b)) / min(len(a), len(b))
    if longer < 1.5:
        return max(ratio(a, b), 0.95 * token_ratio(a, b))
    scale = 0.9 if longer <= 8 else 0.6
    return max(ratio(a, b), scale * partial(a, b), 0.95 * scale * partial_token_ratio(a, b))


def word_grams(name: str, low: int = 3, high: int = 5) -> Counter:
    """Counts of the runs of letters inside each word with a space at both its ends; of a shorter word, the word."""
    out: Counter = Counter()
    for w in name.split():
        padded = f" {w} "
        for n in range(low, high + 1):
            if len(padded) <= n:
                out[padded] += 1
                break
            out.update(padded[i : i + n] for i in range(len(padded) - n + 1))
    return out


NONE = np.empty(0, np.int64)


class Postings:
    """Which places have a key and how often, in arrays that grow."""

    def __init__(self):
        self.lists: dict[str, list] = {}

    def add(self, counts: Counter, place: int) -> None:
        for k, n in counts.items():
            ids, often, size = self.lists.setdefault(k, [np.empty(2, np.int64), np.empty(2, np.int64), 0])
            if size == len(ids):
                self.lists[k][:2] = ids, often = np.resize(ids, 2 * size), np.resize(often, 2 * size)
            ids[size], often[size] = place, n
            self.lists[k][2] += 1

    def of(self, key: str) -> tuple[np.ndarray, np.ndarray]:
        ids, often, size = self.lists.get(key, (NONE, NONE, 0))
        return ids[:size], often[:size]

    def having(self, key: str) -> int:
        return self.lists[key][2] if key in self.lists else 0


class GramIndex:
    """Cosines of names under weights that know only the names so far: count x (ln((1 + n) / (1 + names with the gram)) + 1)."""

    def __init__(self):
        self.grams: list[Counter] = []
        self.index = Postings()
        self.sums = np.zeros((3, 64))  # per name, over its grams: count squared times 1, l and l squared, where l = ln(1 + names with the gram)

    def add(self, name: str) -> None:
        counts, at = word_grams(name), len(self.grams)
        if at == self.sums.shape[1]:
            self.sums = np.hstack([self.sums, np.zeros_like(self.sums)])
        for g, n in counts.items():
            ids, often = self.index.of(g)
            was, now = math.log(1 + len(ids)), math.log(2 + len(ids))
            self.sums[1, ids] += often**2 * (now - was)
            self.sums[2, ids] += often**2 * (now**2 - was**2)
            self.sums[:, at] += n * n, n * n * now, n * n * now**2
        self.index.add(counts, at)
        self.grams.append(counts)

    def _weight(self, gram: str) -> float:
        return math.log((1 + len(self.grams)) / (1 + self.index.having(gram))) + 1

    def best(self, name: str, among: Iterable[int]) -> tuple[int | None, float]:
        """The first of the nearest of ``among`` and its cosine; grams that no name so far has count for nothing."""
        mine = {g: n * self._weight(g) for g, n in word_grams(name).items() if self.index.having(g)}
        size = math.sqrt(sum(v * v for v in mine.values()))
        found, top = None, 0.0
        for i in among if size else ():
            theirs = self.grams[i]
            dot = sum(v * theirs[g] * self._weight(g) for g, v in mine.items() if g in theirs)
            if dot and (c := dot / (size * math.sqrt(sum((n * self._weight(g)) ** 2 for g, n in theirs.items())))) > top:
                found, top = i, c
        return found, top

    def cosines(self, name: str) -> np.ndarray:
        """The cosines of all names so far at once, near 1e-12 of what ``best`` finds: a name's length follows from sums that ``add`` keeps."""
        n, out, size = len(self.grams), np.zeros(len(self.grams)), 0.0
        for g, k in word_grams(name).items():
            ids, often = self.index.of(g)
            if len(ids):
                w = self._weight(g)
                size += (k * w) ** 2
                if len(ids) == n:
                    out += k * w * w * often
                else:
                    out[ids] += k * w * w * often
        top, (a, b, c) = 1 + math.log(1 + n), self.sums[:, :n]
        return out / np.maximum(np.sqrt(np.maximum(top * top * a - 2 * top * b + c, 0.0) * size), 1e-300)


class NameIndex:
    """The names of the places so far, compared with a name at once."""

    LONGEST = 64  # letters of a name that fit the bits of one number

    def __init__(self, block: int):
        self.block, self.names, self.grams = block, [], GramIndex()
        self.runs, self.words, self.letters = Postings(), Postings(), Postings()
        self.codes: dict[str, int] = {}
        self.width = math.ceil(self.LONGEST * self._longer())
        self.table = np.zeros((self.width, 64), np.int32)  # a place's letters, top down; 0 is none
        self.sizes = np.zeros((2, 64), np.int64)  # letters of the name and of its different words with a space between them

    @staticmethod
    def _longer() -> float:
        """Names whose lengths differ by more have no ratio of ``LEAST``."""
        return (200 - LEAST) / LEAST

    def _of(self, name: str) -> tuple[Counter, Counter, Counter, int]:
        words = Counter(set(name.split()))
        runs = Counter({name[i : i + self.block] for i in range(max(1, len(name) - self.block + 1))})
        return runs, words, Counter(" " if c.isspace() else c for c in name), max(0, sum(map(len, words)) + len(words) - 1)

    def add(self, name: str) -> None:
        at = len(self.names)
        if at == self.sizes.shape[1]:
            self.table, self.sizes = np.hstack([self.table, np.zeros_like(self.table)]), np.hstack([self.sizes, np.zeros_like(self.sizes)])
        runs, words, letters, size = self._of(name)
        self.runs.add(runs, at), self.words.add(words, at), self.letters.add(letters, at)
        part = [self.codes.setdefault(c, len(self.codes) + 1) for c in name[: self.width]]
        self.table[: len(part), at] = part
        self.sizes[:, at] = len(name), size
        self.names.append(name)
        self.grams.add(name)

    def _ratios(self, name: str, lengths: np.ndarray) -> np.ndarray:
        """``ratio`` with every name; -1 where it is surely under ``LEAST``."""
        n, width = len(self.names), min(self.width, math.ceil(len(name) * self._longer()))
        masks = np.zeros(len(self.codes) + 1, np.uint64)
        for i, c in enumerate(name):
            if c in self.codes:
                masks[self.codes[c]] |= np.uint64(1 << i)
        full = np.uint64((1 << len(name)) - 1)
        state = np.full(n, full)
        for j in range(min(width, int(lengths.max()))):
            u = state & masks[self.table[j, :n]]
            state = (state + u) | (state - u)
        both = len(name) - np.bitwise_count(state & full).astype(np.int64)
        return np.where(lengths <= width, 200.0 * both / (len(name) + lengths), -1.0)

    def nearest(self, name: str) -> tuple[int | None, float]:
        """The place whose name is most alike, and how much, among those that share a run of letters; ties are the earliest's. Exact from ``LEAST`` on.

        The plain ratio is worked out for all places. ``name_similarity`` is asked only where a bound by shared letters and words says that
        it may reach the best so far, and ``GramIndex.best`` only of the places whose cosine is the largest but for rounding.
        """
        n = len(self.names)
        runs, words, letters, size = self._of(name)
        near = np.zeros(n, bool)
        for r in runs:
            near[self.runs.of(r)[0]] = True
        if not name or not near.any():
            return None, 0.0
        lengths, sizes = self.sizes[:, :n]
        bag, shared = np.zeros(n), np.zeros(n)
        for c, k in letters.items():
            ids, often = self.letters.of(c)
            bag[ids] += np.minimum(often, k)
        for w in words:
            shared[self.words.of(w)[0]] += len(w) + 1
        some, less = np.maximum(shared - 1, 0), np.maximum(np.minimum(size, sizes), 1)
        longer = np.maximum(lengths, len(name)) / np.maximum(np.minimum(lengths, len(name)), 1)
        by_words = 95 * np.minimum(1, np.maximum(2 * bag / np.maximum(size + sizes, 1), 2 * some / (some + less)))
        by_part = np.where(longer <= 8, 90.0, 60.0) * np.maximum(np.minimum(1, 2 * bag / (bag + less)), np.where(shared > 0, 0.95, 0))
        bound = np.where(longer < 1.5, by_words, by_part)
        if len(name) <= self.LONGEST:
            alike = self._ratios(name, lengths)
        else:
            alike, bound = np.full(n, -1.0), np.maximum(bound, 200 * bag / (len(name) + lengths))
        alike[~near] = -1.0
        top = alike.max()
        may = np.flatnonzero(near & (bound >= max(top, LEAST) - 1e-6))
        for i in may[np.argsort(-bound[may], kind="stable")]:
            if bound[i] < max(top, LEAST) - 1e-6:
                break
            alike[i] = name_similarity(name, self.names[i])
            top = max(top, alike[i])
        best = int(alike.argmax())
        top = float(top)
        cosines = np.where(near, self.grams.cosines(name), 0.0)
        if 100 * (most := cosines.max()) >= max(top, LEAST) - 1e-6:
            other, cosine = self.grams.best(name, np.flatnonzero(cosines >= most - 1e-9).tolist())
            if other is not None and 100 * cosine > top:
                best, top = other, 100 * cosine
        return best, top


SCHEMA = "source string, name string, canonical_id string, canonical_name string, score double, method string, status string, needs_review boolean, candidate_id string"


def resolve(rows: DataFrame, block: int = 3, within: str | None = "category") -> DataFrame:
    """Each (source, name) with its canonical place, by category or (``within`` None) over all.

    ``rows``: source, priority, name (normalised), category, place_type, lat, lon. Distinct names are few beside reviews, and each decision depends on
    all earlier ones, so a fold is one task's work. Names are folded in order of (priority, name, source): an exact name joins its place; else, of the places so far that share a
    run of ``block`` letters, the one most alike by weighted ratio or, if that says more, by the cosine of letter runs. Enough likeness with what
    else speaks for it joins that place, a little less is noted for review, otherwise the name founds a place. Ties keep the earliest. A place takes the
    category, type and position of the first row that has them.
    """
    key = F.col(within) if within else F.lit("all")
    each = rows.where("name is not null").withColumn("_fold", key).groupBy("_fold", "source", "name")
    one = each.agg(F.min("priority").alias("priority"), F.min("category").alias("category"), F.min("place_type").alias("place_type"), F.min("lat").alias("lat"), F.min("lon").alias("lon"))

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        made: list[dict] = []
        exact: dict[str, int] = {}
        index = NameIndex(block)
        out = []
        slug = re.sub(r"[^a-z0-9]+", "-", str(pdf["_fold"].iloc[0]).lower())
        for r in pdf.sort_values(["priority", "name", "source"]).rename(columns={"_fold": "fold"}).itertuples(index=False):
            row = {"category": r.category or None, "type": r.place_type or None, "lat": None if pd.isna(r.lat) else r.lat, "lon": None if pd.isna(r.lon) else r.lon}
            place, said, found = None, ("new_canonical", "new", 0.0), None
            if r.name in exact:
                place, said = made[exact[r.name]], ("normalized_exact", "auto", 100.0)
            elif (near := index.nearest(r.name))[0] is not None:
                m = made[near[0]]
                total = near[1] + _bonus(row, m)
                if total >= AUTO:
                    place, said = m, ("fuzzy_auto", "auto", min(total, 100.0))
                elif total >= REVIEW:
                    found, said = m["id"], ("fuzzy_candidate", "new_needs_manual_review", min(total, 100.0))
            if place is None:
                place = {"id": f"place_{slug}_{len(made) + 1:05d}", "name": r.name, **row}
                exact[r.name] = len(made)
                made.append(place)
                index.add(r.name)
            for f in ("category", "type"):
                place[f] = place[f] or row[f]
            if place["lat"] is None:
                place["lat"], place["lon"] = row["lat"], row["lon"]
            out.append((r.source, r.name, place["id"], place["name"], said[2], said[0], said[1], found is not None, found))
        return pd.DataFrame(out, columns=[c.split()[0] for c in SCHEMA.split(", ")])

    # a number of partitions that is given is not merged again, so each fold has its own task
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return one.repartition(parts, "_fold").groupBy("_fold").applyInPandas(fold, SCHEMA)


def _bonus(a: dict, b: dict) -> float:
    same = lambda f: a[f] is not None and a[f] == b[f]
    placed = None not in (a["lat"], a["lon"], b["lat"], b["lon"])
    near = placed and abs(a["lat"] - b["lat"]) <= NEAR_DEGREES and abs(a["lon"] - b["lon"]) <= NEAR_DEGREES
    return CATEGORY_BONUS * same("category") + TYPE_BONUS * same("type") + NEAR_BONUS * near
