"""Near-duplicate documents by ProbMinHash signatures, banding and verification.

Texts are cut into shingles of ``n`` lower-cased words between ASCII white space, weighted 1 + ln(count). Each shingle is a
Poisson process of arrivals whose rate is its weight; every arrival falls in one register, which keeps the shingle of its
first arrival. A shingle is dropped once its next arrival is later than the latest register, so the work is near one
arrival a shingle. The share of equal registers estimates the probability Jaccard similarity of two weighted sets.

Equal texts collapse first, into one node a text; ids come back at the end, so an id may have several texts. Then, over different texts:

1. Every text of a band's bucket is compared with one pivot of the bucket, a text chosen by hash, another in each band; pairs
   whose signatures may reach the threshold are verified on the whole texts. The components of these links absorb groups
   of many copies at linear cost.
2. In the buckets that still hold texts of several components, all texts of different components are compared by their
   signatures, in blocks of ``block`` texts or so many bytes, which tells the texts that may have a link. Only those texts move: inside the same
   blocks their pairs are verified, likeliest first, until the two components have met. A task returns the links that join components.

No step lists the pairs of a bucket, and no task holds a bucket.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapline.llm.common import components, cut, discard, long_texts
from gapline.llm.packing import slices

BANDS, ROWS = 24, 5
REGISTERS = BANDS * ROWS
CHUNK = 2_000_000
#: A pair is verified if its signatures agree in at least the threshold less this (over four standard deviations).
SLACK = 0.16
GOLD = np.uint64(0x9E3779B97F4A7C15)
BLOCK_BYTES = 4_000_000
#: Up to so many ids of texts with a possible partner are broadcast (8 bytes each, twice in a hash table), so that only their texts move.
BROADCAST_IDS = 500_000


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hash(words: list[str]) -> np.ndarray:
    """64-bit hashes of words, the same in every process."""
    return np.frombuffer(b"".join(blake2b(w.encode("utf-8", "surrogatepass"), digest_size=8).digest() for w in words), "<u8").astype(np.uint64)


def shingles(texts: pa.Array, n: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(text, shingle, weight)`` of the different shingles of each text, ordered by text and shingle.

    A text of one to ``n`` - 1 words is one shingle; one without words has none.
    """
    words = pc.ascii_split_whitespace(pc.utf8_lower(pc.fill_null(texts, "")))
    off = words.offsets.to_numpy().astype(np.int64)
    off = off - off[0]
    coded = words.flatten().dictionary_encode()
    names = coded.dictionary.to_pylist()
    h = word_hash(names)[coded.indices.to_numpy()] if names else np.zeros(0, np.uint64)
    of = np.repeat(np.arange(len(texts)), np.diff(off))
    if "" in names:  # from white space at a text's ends
        real = coded.indices.to_numpy() != names.index("")
        h, of = h[real], of[real]
    size = np.bincount(of, minlength=len(texts))
    ends = np.cumsum(size)
    acc = np.zeros(len(h), np.uint64)
    left = np.repeat(ends, size) - np.arange(len(h))  # words from here to the text's end
    for k in range(n):
        nxt = np.zeros(len(h), np.uint64)
        if k < len(h):
            nxt[: len(h) - k] = h[k:]
        acc = np.where(left > k, mix64(acc * GOLD + nxt + np.uint64(k + 1)), acc)
    start = (left >= n) | ((np.repeat(size, size) < n) & (left == np.repeat(size, size)))
    doc, sh = of[start], acc[start]
    order = np.lexsort((sh, doc))
    doc, sh = doc[order], sh[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (sh[1:] != sh[:-1])
    first = np.flatnonzero(new)
    return doc[first], sh[first], 1 + np.log(np.diff(np.append(first, len(doc))))


def signatures(doc: np.ndarray, sh: np.ndarray, weight: np.ndarray, count: int, registers: int = REGISTERS) -> np.ndarray:
    """ProbMinHash registers of each text: the shingle (its hash) that arrives first; 0 for texts without shingles."""
    when = np.full(count * registers, np.inf)
    who = np.zeros(count * registers, np.uint64)
    t = np.zeros(len(doc))
    d, s, w = doc, sh, weight
    step = 0
    while len(d):
        step += 1
        r = mix64(s + np.uint64(step * int(GOLD) % 2**64))
        u = ((r >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53
        t = t - np.log(u) / w
        cell = d * registers + (mix64(r ^ GOLD) % np.uint64(registers)).astype(np.int64)
        np.minimum.at(when, cell, t)
        won = when[cell] == t
        who[cell[won]] = s[won]
        latest = when.reshape(count, registers).max(axis=1)
        on = t < latest[d]
        d, s, w, t = d[on], s[on], w[on], t[on]
    return who.reshape(count, registers)


def similarity(a_sh, a_w, b_sh, b_w) -> float:
    """Probability Jaccard of two weighted sets with sorted keys: over shared d, the sum of 1 / sum of max(a/a_d, b/b_d)."""
    both, i, j = np.intersect1d(a_sh, b_sh, assume_unique=True, return_indices=True)
    if not len(both):
        return 0.0
    a, b = a_w[i], b_w[j]
    only_a, only_b = a_w.sum() - a.sum(), b_w.sum() - b.sum()
    ratio = b / a
    order = np.argsort(ratio, kind="stable")
    ratio, a, b = ratio[order], a[order], b[order]
    upto_a = np.cumsum(a)
    over_b = b.sum() - np.cumsum(b)
    last = np.searchsorted(ratio, ratio, side="right") - 1
    total = (only_a + upto_a[last]) / a + (only_b + over_b[last]) / b
    return float((1.0 / total).sum())


def _sign(n):
    def run(batches):
        for whole in batches:
            for b in slices(whole, "text", CHUNK):
                doc, sh, w = shingles(b.column("text"), n)
                sig = signatures(doc, sh, w, b.num_rows)
                some = np.bincount(doc, minlength=b.num_rows) > 0
                rows = [r.tobytes() if k else None for r, k in zip((sig & np.uint64(0xFFFFFFFF)).astype("<u4"), some, strict=True)]
                part = sig.reshape(b.num_rows, BANDS, ROWS)
                key = np.zeros((b.num_rows, BANDS), np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64)
                for k in range(ROWS):
                    key = mix64(key * GOLD + part[:, :, k])
                keys = [r if k else None for r, k in zip(key.view(np.int64), some, strict=True)]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("digest"), b.column("bytes"), pa.array(rows, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "digest", "bytes", "sig", "bands"])

    return run


def registers(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Stored signatures as a matrix with a row per text."""
    return np.frombuffer(b"".join(column.to_pylist()), "<u4").reshape(-1, REGISTERS)


def least_agreement(threshold: float) -> int:
    return int(np.ceil((threshold - SLACK) * REGISTERS))


def _agree(need):
    def run(batches):
        for b in batches:
            ok = pa.array((registers(b.column("left")) == registers(b.column("right"))).sum(axis=1) >= need)
            yield pa.RecordBatch.from_arrays([b.column(c).filter(ok) for c in ("a", "b")], ["a", "b"])

    return run


def _verify(n, threshold):
    def run(batches):
        for whole in batches:
            for b in slices(whole, "left", CHUNK // 2):
                many = b.num_rows
                names = pa.concat_arrays([b.column("left"), b.column("right")]).dictionary_encode()
                doc, sh, w = shingles(names.dictionary, n)
                cutp = np.searchsorted(doc, np.arange(len(names.dictionary) + 1))
                at = names.indices.to_numpy()
                part = lambda k: (sh[cutp[k] : cutp[k + 1]], w[cutp[k] : cutp[k + 1]])
                ok = np.fromiter((similarity(*part(at[i]), *part(at[many + i])) >= threshold for i in range(many)), bool, many)
                yield pa.RecordBatch.from_arrays([b.column(c).filter(pa.array(ok)) for c in ("a", "b")], ["a", "b"])

    return run


def beside(pairs: DataFrame, facts: DataFrame, column: str) -> DataFrame:
    """``pairs`` (``a``, ``b``) with ``column`` of both nodes as ``left`` and ``right``. Joins may split a hot side; nothing is grouped."""
    left = facts.select(F.col("node").alias("a"), F.col(column).alias("left"))
    right = facts.select(F.col("node").alias("b"), F.col(column).alias("right"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "left", "right")


def verified(pairs: DataFrame, texts: DataFrame, n: int, threshold: float) -> DataFrame:
    """The pairs (``a``, ``b``) whose whole texts (``node``, ``text``) reach the threshold."""
    return beside(pairs, texts, "text").mapInArrow(_verify(n, threshold), "a long, b long")


def _near(key, table, need):
    """Pairs of rows of a pair of blocks that may link, with their agreement: of different components, in the first bucket they share."""
    bucket, i, j = (k.as_py() for k in key)
    part, ids, comp = (table.column(c).to_numpy() for c in ("part", "node", "comp"))
    sig = registers(table.column("sig"))
    bands = table.column("bands").combine_chunks().flatten().to_numpy().reshape(-1, BANDS)
    band = int(np.flatnonzero(bands[0] == bucket)[0])
    left, right = np.flatnonzero(part == i), np.flatnonzero(part == j)
    found = [np.zeros((0, 3), np.int64)]
    for x in left:
        y = right[(comp[right] != comp[x]) & ((ids[right] > ids[x]) | (i != j))]
        agree = (sig[y] == sig[x]).sum(axis=1)
        y, agree = y[agree >= need], agree[agree >= need]
        first = (bands[y] == bands[x]).argmax(axis=1) == band
        found.append(np.column_stack([agree[first], np.full(int(first.sum()), x), y[first]]))
    return np.concatenate(found)


def _flag(threshold):
    def run(key, table):
        at = np.unique(_near(key, table, least_agreement(threshold))[:, 1:])
        fixed = {"key": pa.int64(), "i": pa.int32(), "j": pa.int32()}
        named = {c: pa.array([k.as_py()] * len(at), t) for k, (c, t) in zip(key, fixed.items(), strict=True)}
        return pa.table(named | {"node": table.column("node").take(pa.array(at))})

    return run


def _tile(n, threshold):
    def run(key, table):
        pairs = _near(key, table, least_agreement(threshold))
        links = []
        if len(pairs):
            ids, comp = table.column("node").to_numpy(), table.column("comp").to_numpy()
            texts = table.column("text").combine_chunks()
            rows, at = np.unique(pairs[:, 1:], return_inverse=True)
            doc, sh, w = shingles(texts.take(pa.array(rows)), n)
            ends = np.searchsorted(doc, np.arange(len(rows) + 1))
            sets = [(sh[p:q], w[p:q]) for p, q in zip(ends[:-1], ends[1:], strict=True)]
            names, group = np.unique(comp[rows], return_inverse=True)
            root = list(range(len(names)))

            def top(g):
                while root[g] != g:
                    root[g] = g = root[root[g]]
                return g

            at = at.reshape(-1, 2)
            for k in np.argsort(-pairs[:, 0], kind="stable"):  # likeliest first; components that met here need no more links
                x, y = at[k]
                g, h = top(int(group[x])), top(int(group[y]))
                if g != h and similarity(*sets[x], *sets[y]) >= threshold:
                    root[max(g, h)] = min(g, h)
                    links.append((ids[rows[x]], ids[rows[y]]))
        a, b = zip(*links, strict=True) if links else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def spread_join(rows: DataFrame, facts: DataFrame, ways: int = 16) -> DataFrame:
    """``rows`` joined with the one row of ``facts`` per ``key``; a hot key's rows go to ``ways`` tasks."""
    dealt = rows.withColumn("_way", F.pmod(F.xxhash64("node"), F.lit(ways)).cast("int"))
    copies = facts.withColumn("_way", F.explode(F.expr(f"sequence(0, {ways - 1})")))
    return dealt.join(copies, ["key", "_way"]).drop("_way")


def _fetch(docs: DataFrame, texts: DataFrame, nodes: DataFrame) -> DataFrame:
    """``node`` and ``text`` of ``nodes``: few ids are broadcast, so that only the texts that are wanted move."""
    wanted = cut(texts.join(nodes, "node", "left_semi").select("node", "doc_id", "digest"))
    side = F.broadcast(wanted) if wanted.count() <= BROADCAST_IDS else wanted
    return cut(docs.join(side, ["doc_id", "digest"]).select("node", "text").dropDuplicates(["node"]))


def near_duplicates(documents: DataFrame, n: int = 5, threshold: float = 0.8, block: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document row: ``doc_id``, ``class_id`` (the smallest id of its group), ``kept`` and ``digest`` (MD5 of its text).

    A group is what links join: equal texts, and texts whose weighted shingles have a probability Jaccard similarity of at
    least ``threshold``. Recall of links is that of the banding (over 0.999 for a pair at 0.8). ``kept`` is the row of the group's
    smallest id, of several texts with that id the one with the smallest digest. Defined cases: a null text is a class of
    its own, so is a null id; equal texts without words are one class and link with nothing else; rows with one id and
    different texts are documents of their own, each in the group of its text (groups may then have the same smallest id);
    rows with one id and one text share a class and are kept or not together; an empty table gives an empty result; other
    columns are ignored. Results do not depend on the order of rows.
    """
    long_texts(documents.sparkSession)
    docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    docs = docs.withColumn("digest", F.md5("text"))
    signed = docs.withColumn("bytes", F.octet_length("text")).where("text is not null and doc_id is not null")
    signed = signed.mapInArrow(_sign(n), "doc_id long, digest string, bytes int, sig binary, bands array<long>")
    signed = cut(signed)
    # equal texts have equal signatures; a node's number is fixed by its being written
    texts = signed.groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.max("bytes").alias("bytes"), F.max("sig").alias("sig"), F.max("bands").alias("bands"))
    texts = cut(texts.withColumn("node", F.monotonically_increasing_id()).withColumn("h", F.xxhash64("digest")))
    discard(signed)
    buckets = cut(texts.where("bands is not null").select("node", "h", F.explode("bands").alias("key")))
    pivots = buckets.groupBy("key").agg(F.min(F.struct(F.xxhash64("h", "key").alias("h"), "node")).alias("p"), F.count(F.lit(1)).alias("members")).where("members > 1")
    pivots = cut(pivots.select("key", F.col("p.node").alias("pivot")))
    shared = cut(spread_join(buckets.select("node", "key"), pivots).select("node", "key", "pivot"))
    discard(buckets, pivots)
    pairs = shared.where("node <> pivot").select(F.greatest("node", "pivot").alias("a"), F.least("node", "pivot").alias("b")).distinct()
    pairs = cut(beside(pairs, texts, "sig").mapInArrow(_agree(least_agreement(threshold)), "a long, b long"))
    first = _fetch(docs, texts, pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct())
    links = cut(verified(pairs, first, n, threshold))
    discard(first, pairs)
    roots = components(links)
    placed = shared.join(roots, "node", "left").join(texts.select("node", "bytes"), "node").select("node", "key", "bytes", F.coalesce("root", "node").alias("comp"))
    blocks = F.greatest(F.ceil(F.count(F.lit(1)) / block), F.ceil(F.sum("bytes") / BLOCK_BYTES)).cast("int")
    mixed = placed.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), blocks.alias("blocks")).where("lo < hi")
    rest = spread_join(placed, mixed.select("key", "blocks")).join(texts.select("node", "h", "sig", "bands"), "node")
    rest = rest.withColumn("part", F.pmod(F.xxhash64("h", "key"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    rest = rest.select("key", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "node", "comp", "sig", "bands")
    flagged = cut(rest.groupBy("key", "i", "j").applyInArrow(_flag(threshold), "key long, i int, j int, node long"))
    if not flagged.isEmpty():
        more = _fetch(docs, texts, flagged.select("node").distinct())
        near = rest.join(flagged, ["key", "i", "j", "node"], "left_semi").join(more, "node")
        links = links.unionByName(cut(near.groupBy("key", "i", "j").applyInArrow(_tile(n, threshold), "a long, b long")))
        discard(more)
    discard(shared, flagged)
    groups = components(links)
    # a text without links is its own group
    first_of = groups.join(texts.select("node", "doc_id", "digest"), "node").groupBy("root").agg(F.min(F.struct("doc_id", "digest")).alias("first"))
    linked = spread_join(groups.withColumnRenamed("root", "key"), first_of.withColumnRenamed("root", "key")).select("node", "first")
    named = texts.select("node", "digest", "doc_id").join(linked, "node", "left")
    named = cut(named.select("digest", F.coalesce("first.doc_id", "doc_id").alias("class_id"), F.coalesce("first.digest", "digest").alias("_first")))
    out = docs.select("doc_id", "digest", F.when(F.col("doc_id").isNotNull(), F.col("digest")).alias("_key")).join(named.withColumnRenamed("digest", "_key"), "_key", "left")
    class_id = F.coalesce("class_id", "doc_id")
    kept = F.coalesce((F.col("doc_id") == class_id) & (F.col("digest") == F.col("_first")), F.lit(True))
    return out.select("doc_id", class_id.alias("class_id"), kept.alias("kept"), "digest")
