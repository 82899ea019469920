"""Hierarchical multi-length packing into windows of 512, 1,024, 2,048 and 4,096 tokens.

A document gives whole windows of the longest size first; what is left of it is routed to the smallest tier that holds it.
Windows are filled from the longest tier down: a window starts with a document of its tier, its gap takes the longest
whole rests of any shorter tier that fit, and what gap is left takes a cut from the shortest rest. So every window is
exactly full, a power of two, and needs no padding. Each task packs the rows it reads, so nothing is shuffled; the
last tokens of a task, fewer than one window, are laid in windows of falling powers of two.

Step groups: windows of one tier are numbered in runs that hold ``step_tokens`` tokens each, so all groups of a task but
the last of each tier weigh the same.
"""

from __future__ import annotations

import bisect
import hashlib
import json
import os
import re
import sys
import types
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame

TIERS = (512, 1024, 2048, 4096)
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, window int, step_group long"
#: Bytes of text that are tokenised at a time, and words that a worker remembers.
CHUNK_BYTES, CACHE_WORDS, POOL_TOKENS = 4_000_000, 700_000, 1_500_000


def worker_store() -> types.ModuleType:
    """What a Python worker keeps between tasks."""
    return sys.modules.setdefault("gapline_worker_store", types.ModuleType("gapline_worker_store"))


class WordCoder:
    """Ids of words by a tokenizers file, each different word encoded once while it is remembered.

    New words of ASCII and Latin-1 letters are lower-cased and cut here as the file's normaliser and pre-tokenizer do, and
    only their parts go to the file's model. All other words go through the whole tokenizer, many at a time, as one text with
    a separator between them that is a token of its own; words that hold the separator or a special token go alone.
    A file of another kind than the one this knows always takes the second way.
    """

    SEPARATOR = "\x02"
    PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ]+")
    # Fixed value: the file's pre-tokenizer on lower-cased plain words.
    PARTS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")
    NORMALISER = ["NFC", "Replace", "Lowercase"]
    SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

    def __init__(self, data: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        text = data.decode("utf-8")
        self.tokenizer = Tokenizer.from_str(text)
        self.model = self.tokenizer.model
        self.mark = self.ids(self.SEPARATOR)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        known = json.loads(text)
        steps = [n["type"] for n in (known.get("normalizer") or {}).get("normalizers", [])]
        cutter = ((known.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
        self.direct = steps == self.NORMALISER and cutter.get("pattern", {}).get("Regex") == self.SPLIT
        # a byte's character in a byte-level vocabulary
        level = ByteLevel(add_prefix_space=False, use_regex=False)
        self.bytes = {b: level.pre_tokenize_str(chr(b))[0][0][-1] if b < 128 else None for b in range(128)}
        for c in map(chr, range(0xC0, 0x100)):
            for b, x in zip(c.encode(), level.pre_tokenize_str(c)[0][0], strict=True):
                self.bytes[b] = x
        self.bytes = {b: x for b, x in self.bytes.items() if x and ord(x) != b}
        self.forget()

    def ids(self, text: str) -> list[int]:
        return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.short: dict[str, list[int]] = {}
        self.first, self.size, self.pool = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def part(self, x: str) -> list[int]:
        if (got := self.short.get(x)) is None:
            raw = x if x.isascii() and x.isalpha() else x.encode().decode("latin-1").translate(self.bytes)
            got = [t.id for t in self.model.tokenize(raw)]
            if len(x) <= 4:
                self.short[x] = got
        return got

    def learn(self, words: list[str]) -> None:
        plain = [w for w in words if self.PLAIN.fullmatch(w) and "<|" not in w] if self.direct else []
        flat: list[int] = []
        sizes = []
        for w in plain:
            n = len(flat)
            for x in self.PARTS.findall(w.lower()):
                flat += self.part(x)
            sizes.append(len(flat) - n)
        pools, counts = [np.array(flat, np.uint32)], [np.array(sizes, np.int64)]
        if len(plain) < len(words):
            done = set(plain)
            rest = [w for w in words if w not in done]
            odd = {w for w in rest if len(self.mark) != 1 or any(x in w for x in (self.SEPARATOR, *self.special))}
            many, alone = [w for w in rest if w not in odd], [w for w in rest if w in odd]
            for i in range(0, len(many), 4096):
                part = many[i : i + 4096]
                got = np.array(self.ids(f" {self.SEPARATOR} ".join(part)), np.uint32)
                cuts = np.flatnonzero(got == self.mark[0])
                if len(cuts) != len(part) - 1:
                    raise ValueError("the separator does not stand alone in this vocabulary")
                counts.append(np.diff(np.concatenate([[-1], cuts, [len(got)]])) - 1)
                pools.append(got[got != self.mark[0]])
            for w in alone:
                pools.append(np.array(self.ids(w), np.uint32))
                counts.append(np.array([len(pools[-1])]))
            plain = [*plain, *many, *alone]
        size = np.concatenate(counts)
        start = len(self.pool) + np.cumsum(size) - size
        self.known.update(zip(plain, range(len(self.first), len(self.first) + len(plain)), strict=True))
        self.first, self.size, self.pool = np.concatenate([self.first, start]), np.concatenate([self.size, size]), np.concatenate([self.pool, *pools])

    def places(self, words: list[str]) -> np.ndarray:
        """Where each word's ids are: positions in ``first`` and ``size``."""
        new = [w for w in words if w not in self.known]
        if len(self.known) + len(new) > CACHE_WORDS:
            self.forget()
            new = words
        if new:
            self.learn(new)
        return np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))


def load_tokenizer(data: bytes) -> WordCoder:
    """The coder of a tokenizers file's content, once per worker."""
    store = worker_store()
    key = "coder_" + hashlib.md5(data).hexdigest()
    if not hasattr(store, key):
        setattr(store, key, WordCoder(data))
    return getattr(store, key)


def slices(batch: pa.RecordBatch, column: str, most: int = CHUNK_BYTES):
    """Parts of a batch with about ``most`` bytes of text each, a row at least."""
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    total, i = np.cumsum(size), 0
    while i < len(size):
        j = max(i + 1, int(np.searchsorted(total, (total[i - 1] if i else 0) + most, side="right")))
        yield batch.slice(i, j - i)
        i = j


def encode_texts(texts: pa.Array, coder: WordCoder, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts in one array, ``end_id`` after each, and where each text's ids end.

    This tokenizer drops white space and never joins over it, so a text's ids are those of its words between ASCII white
    space.
    """
    words = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    ends = words.offsets.to_numpy()[1:] - words.offsets.to_numpy()[0]
    coded = pc.dictionary_encode(words.flatten())
    at = coder.places(coded.dictionary.to_pylist())
    # one place more, for the end of a text
    first, size = np.append(coder.first[at], len(coder.pool)), np.append(coder.size[at], 1)
    flat = np.append(coder.pool, np.uint32(end_id))
    at = np.insert(coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), ends, len(first) - 1)
    long = size[at]
    done = np.cumsum(long)
    ids = flat[np.repeat(first[at] - (done - long), long) + np.arange(int(done[-1]) if len(done) else 0)]
    return ids, done[ends + np.arange(len(ends))] if len(ends) else ends


class Packer:
    """Packs the documents of one task; ``rows`` fills with finished pieces, ``seq`` counts windows."""

    def __init__(self, task: int, tiers: tuple[int, ...], step_tokens: int):
        self.tiers, self.top, self.step = tuple(sorted(tiers)), max(tiers), step_tokens
        self.task, self.seq, self.made = task, 0, {}
        self.pool: list[tuple] = []  # (length, order, doc, start, ids, tokens of the document)
        self.held, self.order = 0, 0
        self.rows: list[tuple] = []

    def add(self, doc, ids: np.ndarray) -> None:
        n, at = len(ids), 0
        while n - at >= self.top:
            self._window(self.top, [(doc, at, ids[at : at + self.top], n)])
            at += self.top
        if at < n:
            self._put(doc, at, ids[at:].copy(), n)
            if self.held >= POOL_TOKENS:
                self.flush()

    def _put(self, doc, start, ids, tokens) -> None:
        self.order += 1
        bisect.insort(self.pool, (len(ids), self.order, doc, start, ids, tokens), key=lambda x: x[:2])
        self.held += len(ids)

    def _take(self, i: int) -> tuple:
        x = self.pool.pop(i)
        self.held -= x[0]
        return x

    def _window(self, size: int, parts: list[tuple]) -> None:
        group = self.made.get(size, 0)
        self.made[size] = group + 1
        step = (self.task << 32) | (self.tiers.index(size) if size in self.tiers else len(self.tiers)) << 24 | group * size // self.step
        offset = 0
        for doc, start, ids, tokens in parts:
            self.rows.append((doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), tokens, (self.task << 32) | self.seq, offset, size, step))
            offset += len(ids)
        self.seq += 1

    def flush(self, last: bool = False) -> None:
        """Make all full windows; ``last``: lay the rest in windows of falling powers of two."""
        while self.pool:
            size = next(t for t in self.tiers if t >= self.pool[-1][0])
            if self.held < size:
                break
            gap, parts = size, []
            while gap:
                i = bisect.bisect_right(self.pool, gap, key=lambda x: x[0]) - 1
                if i >= 0:
                    n, _, doc, start, ids, tokens = self._take(i)
                else:  # none fits whole: cut the shortest
                    n, _, doc, start, ids, tokens = self._take(0)
                    self._put(doc, start + gap, ids[gap:], tokens)
                    ids = ids[:gap]
                parts.append((doc, start, ids, tokens))
                gap -= len(ids)
            self._window(size, parts)
        if last and self.pool:
            rest = [self._take(len(self.pool) - 1)[2:] for _ in range(len(self.pool))]
            left = sum(len(x[1 + 1]) for x in rest)
            size = self.top
            while left:
                size //= 2
                if left < size:
                    continue
                parts, gap = [], size
                while gap:
                    doc, start, ids, tokens = rest.pop(0)
                    if len(ids) > gap:
                        rest.insert(0, (doc, start + gap, ids[gap:], tokens))
                        ids = ids[:gap]
                    parts.append((doc, start, ids, tokens))
                    gap -= len(ids)
                self._window(size, parts)
                left -= size

    def batch(self) -> pa.RecordBatch:
        cols = list(zip(*self.rows, strict=True)) or [()] * 9
        self.rows = []
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "window", "step_group"]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if n == "window" else pa.int64()) for n, c in zip(names, cols, strict=True)], names)


def pack(documents: DataFrame, tokenizer_path: str, end_id: int = 2, tiers: tuple[int, ...] = TIERS, step_tokens: int = 1 << 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: ``doc_id``, ``start``, ``length``, ``ids_crc32``, ``doc_tokens``, ``sequence_id``, ``offset``, ``window``, ``step_group``.

    ``tiers`` are window sizes, powers of two. The tokenizers file is read by the driver and broadcast (under 2 MB). Defined
    cases: null and empty texts are the end id alone; a text of any length is cut, never shortened; repeated rows are packed
    again; a null id stays null; an empty table gives an empty result; other columns are ignored.
    """
    with open(tokenizer_path, "rb") as f:
        data = f.read()
    if len(data) > 64_000_000:
        raise ValueError("the tokenizer file is too large to broadcast")
    shared = documents.sparkSession.sparkContext.broadcast(data)

    def run(batches):
        coder = load_tokenizer(shared.value)
        packer = Packer(TaskContext.get().partitionId(), tiers, step_tokens)
        for whole in batches:
            for b in slices(whole, "text"):
                ids, ends = encode_texts(b.column("text"), coder, end_id)
                at = 0
                for doc, to in zip(b.column("doc_id").to_pylist(), ends.tolist(), strict=True):
                    packer.add(doc, ids[at:to])
                    at = to
                if len(packer.rows) > 50_000:
                    yield packer.batch()
        packer.flush()
        packer.flush(last=True)
        yield packer.batch()
        pa.default_memory_pool().release_unused()

    docs = documents.select(documents[id_col].cast("long").alias("doc_id"), documents[text_col].cast("string").alias("text"))
    return docs.mapInArrow(run, SCHEMA)
