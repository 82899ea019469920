"""WARC archives of pages, read back into capture runs and merged to globally ordered capture histories.

Pages become WARC/1.1 records, one gzip member each, in archives of about ``archive_bytes``. An archive is a row of a Parquet
table in the shared folder, so any store that Spark writes will do and any executor can read it. Of pages with an equal
payload of at least ``least`` bytes the smallest id is a ``response`` and the others are ``revisit`` records without payload.

Reading parses the archives' bytes alone. Each archive yields one run of index entries, sorted where it is read by URL key
and time; a range exchange cuts all runs at the same keys, into so many ranges that each holds about ``ENTRIES`` entries however
many there are, and each task merges its slices of the runs with a loser tree. Slices arrive in order and stay as they arrive, in
columns; of each only the entries next to be merged are unpacked. Keys end in archive and offset, so a URL captured very
often, or a row repeated very often, is cut as well.
"""

from __future__ import annotations

import datetime
import gzip
import hashlib
import itertools
import math
import re
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapline.llm.common import cut, long_texts

EPOCH = datetime.datetime(2020, 1, 1)
BROADCAST_REVISITS = 500_000
#: Index entries in a range of the merge (some 15 MB in columns), and how many of a slice are unpacked at a time.
ENTRIES, AHEAD = 50_000, 64
#: For the Parquet table of archives: small row groups and pages, or its writer and reader hold many archives at a time.
LARGE_VALUES = {"compression": "none", "parquet.block.size": 8 << 20, "parquet.page.size.row.check.min": 1, "parquet.block.size.row.check.min": 1}
INDEX = "url_key string, captured string, page_id long, url string, archive string, offset long, length long, payload_bytes long, payload_digest string, record_type string, refers_to long"
NAMES = [c.split()[0] for c in INDEX.split(", ")]
TYPES = {"string": pa.string(), "long": pa.int64()}
URN = "urn:gapline:page:"


def url_key(url: str | None) -> str:
    """Sort-friendly form: host labels reversed, then path and query; lower case, without scheme, ``www.`` and fragment."""
    if url is None:
        return ""
    rest = url.partition("://")[2] or url
    host, tail = re.match(r"([^/?#]*)([^#]*)", rest, re.S).groups()
    host = re.sub(r"^www\d*\.", "", host.rpartition("@")[2].lower())
    name, _, port = host.partition(":")
    return ",".join(reversed(name.split("."))) + (f":{port}" if port not in ("", "80", "443") else "") + ")" + (tail.lower() or "/")


def capture_time(page_id: int | None) -> str:
    """A stated stand-in for pages without a time: a second per page from 2020 on, over ten years."""
    return (EPOCH + datetime.timedelta(seconds=(page_id or 0) % 315_360_000)).strftime("%Y-%m-%dT%H:%M:%SZ")


def record(kind: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", *(f"{k}: {v}" for k, v in headers), f"Content-Length: {len(block)}"]
    return gzip.compress("\r\n".join(lines).encode("utf-8") + b"\r\n\r\n" + block + b"\r\n\r\n", compresslevel=1, mtime=0)


def page_record(page_id, url, payload: bytes, digest: str, refers_to) -> bytes:
    """A response, or a revisit of page ``refers_to``, which has the HTTP header alone."""
    headers = [("WARC-Record-ID", f"<{URN}{'none' if page_id is None else page_id}>"), ("WARC-Date", capture_time(page_id))]
    if url is not None:
        headers.append(("WARC-Target-URI", quote(url, safe="".join(map(chr, range(33, 127))).replace("%", "") + "%")))
    headers += [("WARC-Payload-Digest", f"sha256:{digest}"), ("Payload-Length", str(len(payload))), ("Content-Type", "application/http;msgtype=response")]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if refers_to is None:
        return record("response", headers, http + payload)
    headers += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<{URN}{refers_to}>")]
    return record("revisit", headers, http)


def read_records(data: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """``(offset, length, headers, block)`` of every record of an archive's bytes."""
    at = 0
    while at < len(data):
        member, begin, parts = zlib.decompressobj(31), at, []
        while not member.eof:
            piece = data[at : at + 65536]
            if not piece:
                raise ValueError(f"the record at {begin} is cut off")
            parts.append(member.decompress(piece))
            at += len(piece)
        at -= len(member.unused_data)
        whole = b"".join(parts)
        head, _, rest = whole.partition(b"\r\n\r\n")
        lines = head.decode("utf-8").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at {begin}")
        headers = dict(x.split(": ", 1) for x in lines[1:])
        yield begin, at - begin, headers, rest[: int(headers["Content-Length"])]


def _write(archive_bytes):
    from pyspark import TaskContext

    def run(batches):
        made, size, task, n = [], 0, TaskContext.get().partitionId(), 0

        def done():
            name = f"pages-{task:06d}-{n:05d}.warc.gz"
            info = record("warcinfo", [("WARC-Filename", name), ("Content-Type", "application/warc-fields")], b"software: gapline\r\n")
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([info + b"".join(made)], pa.binary())], ["archive", "data"])

        for b in batches:
            for page_id, url, payload, digest, refers in zip(*(b.column(c) for c in ("page_id", "url", "payload", "digest", "refers_to")), strict=True):
                made.append(page_record(page_id.as_py(), url.as_py(), payload.as_py(), digest.as_py(), refers.as_py()))
                size += len(made[-1])
                if size >= archive_bytes:
                    yield done()
                    made, size, n = [], 0, n + 1
        if made:
            yield done()

    return run


def index_entries(name: str, data: bytes) -> list[tuple]:
    """One archive's run: its captures in order of URL key, time and page id. Payloads are checked against their digests."""
    run = []
    for offset, length, head, block in read_records(data):
        if head["WARC-Type"] not in ("response", "revisit"):
            continue
        ident = head["WARC-Record-ID"][1:-1].removeprefix(URN)
        digest, size = head["WARC-Payload-Digest"].removeprefix("sha256:"), int(head["Payload-Length"])
        payload = block.partition(b"\r\n\r\n")[2]
        if head["WARC-Type"] == "response" and (hashlib.sha256(payload).hexdigest() != digest or len(payload) != size):
            raise ValueError(f"{name}: the payload at {offset} does not fit its digest")
        refers = head.get("WARC-Refers-To")
        url = head.get("WARC-Target-URI")
        run.append((url_key(url), head["WARC-Date"], None if ident == "none" else int(ident), url, name, offset, length, size, digest, head["WARC-Type"], int(refers[1:-1].removeprefix(URN)) if refers else None))
    run.sort(key=order)
    return run


def order(entry: tuple) -> tuple:
    return entry[0].encode("utf-8"), entry[1], entry[2] is not None, entry[2] or 0, entry[4], entry[5]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [()] * len(NAMES)
    kinds = [TYPES[c.split()[1]] for c in INDEX.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], NAMES)


def _read(batches):
    for b in batches:
        for name, data in zip(b.column("archive"), b.column("data"), strict=True):
            yield _batch(index_entries(name.as_py(), data.as_py()))


class LoserTree:
    """Merges sorted runs: inner nodes hold the losers of their matches, so the next entry costs one path from leaf to root."""

    def __init__(self, runs: list[Iterator], key):
        self.runs, self.key, self.k = [iter(r) for r in runs], key, max(1, len(runs))
        self.head = [self._next(i) for i in range(len(runs))] or [None]
        self.loser = [0] * self.k
        win = [0] * (2 * self.k)
        for i in range(self.k):
            win[self.k + i] = i
        for node in range(self.k - 1, 0, -1):
            a, b = win[2 * node], win[2 * node + 1]
            win[node], self.loser[node] = (a, b) if self._before(a, b) else (b, a)
        self.winner = win[1] if self.k > 1 else 0

    def _next(self, i):
        entry = next(self.runs[i], None)
        return None if entry is None else (self.key(entry), entry)

    def _before(self, a: int, b: int) -> bool:
        x, y = self.head[a], self.head[b]
        if x is None or y is None:
            return x is not None
        return (x[0], a) < (y[0], b)

    def __iter__(self):
        while (top := self.head[self.winner]) is not None:
            yield top[1]
            i = self.winner
            self.head[i] = self._next(i)
            node = (self.k + i) // 2
            while node:
                if self._before(self.loser[node], i):
                    i, self.loser[node] = self.loser[node], i
                node //= 2
            self.winner = i


def in_order(part: pa.RecordBatch) -> bool:
    """Whether entries of one archive rise by ``order``, told from the columns in one pass."""
    after, equal = None, None
    ids = pc.fill_null(part.column("page_id"), -(2**63))
    for column in (part.column("url_key").cast(pa.binary()), part.column("captured").cast(pa.binary()), ids, part.column("offset")):
        x, y = column.slice(0, len(column) - 1), column.slice(1)
        rises = pc.less(x, y)
        after = rises if after is None else pc.or_(after, pc.and_(equal, rises))
        equal = pc.equal(x, y) if equal is None else pc.and_(equal, pc.equal(x, y))
    return pc.all(pc.or_(after, equal), min_count=0).as_py()


def run_of(parts: list[pa.RecordBatch]) -> Iterator[tuple]:
    """The entries of one archive's slice, a few unpacked at a time; a slice that does not arrive in order is put in order first."""
    whole = pa.Table.from_batches(parts).combine_chunks()
    whole = whole.to_batches()[0] if whole.num_rows else parts[0]
    if not in_order(whole):
        keys = [("url_key", "ascending"), ("captured", "ascending"), ("page_id", "ascending"), ("offset", "ascending")]
        whole = whole.take(pc.sort_indices(whole, sort_keys=keys, null_placement="at_start"))
    for i in range(0, whole.num_rows, AHEAD):
        yield from zip(*(c.to_pylist() for c in whole.slice(i, AHEAD).columns), strict=True)


def _merge(batches):
    slices: dict[str, list[pa.RecordBatch]] = {}
    for b in batches:
        name = b.column("archive")
        at = [0, *(pc.indices_nonzero(pc.not_equal(name.slice(1), name.slice(0, len(name) - 1))).to_numpy() + 1).tolist(), len(name)] if len(name) else []
        for i, j in itertools.pairwise(at):
            slices.setdefault(name[i].as_py(), []).append(b.slice(i, j - i))
    out = []
    for entry in LoserTree([run_of(slices[k]) for k in sorted(slices)], order):
        out.append(entry)
        if len(out) == 20_000:
            yield _batch(out)
            out = []
    yield _batch(out)


def write_archives(pages: DataFrame, least: int = 100, archive_bytes: int = 1_000_000) -> DataFrame:
    """The written table of archives: ``archive`` (name) and ``data`` (the bytes of a ``.warc.gz`` file).

    ``pages``: ``page_id``, ``url``, ``html``; others are ignored. Null html is an empty payload.
    """
    long_texts(pages.sparkSession)
    payload = F.coalesce(F.encode("html", "UTF-8"), F.lit("").cast("binary"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    index = cut(rows.where((F.octet_length("payload") >= least) & F.col("page_id").isNotNull()).select("page_id", "digest"))
    firsts = index.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).where("n > 1")
    revisits = cut(index.join(firsts, "digest").where("page_id <> refers_to").select("page_id", "digest", "refers_to").distinct())
    side = F.broadcast(revisits) if revisits.count() <= BROADCAST_REVISITS else revisits
    rows = rows.join(side, ["page_id", "digest"], "left")
    written = rows.select("page_id", "url", "payload", "digest", "refers_to").mapInArrow(_write(archive_bytes), "archive string, data binary")
    return cut(written, **LARGE_VALUES)


def capture_runs(archives: DataFrame) -> DataFrame:
    """The sorted run of index entries of each archive, read from its bytes."""
    return archives.mapInArrow(_read, INDEX)


def merge_runs(runs: DataFrame, entries: int = ENTRIES) -> DataFrame:
    """All runs in one order, by URL key, time and page id: over the partitions and inside each.

    ``runs`` is read twice, first to count it: ranges hold about ``entries`` entries each, so what a task holds does not grow with the input.
    """
    ranges = max(1, math.ceil(runs.count() / entries))
    return runs.repartitionByRange(ranges, "url_key", "captured", "page_id", "archive", "offset").mapInArrow(_merge, INDEX)


def captures(pages: DataFrame, least: int = 100, archive_bytes: int = 1_000_000) -> DataFrame:
    """Write the pages' archives, read them back and return the merged index, one entry per page row.

    Columns: ``url_key``, ``captured``, ``page_id``, ``url`` (as read), ``archive``, ``offset``, ``length``, ``payload_bytes``,
    ``payload_digest``, ``record_type``, ``refers_to``. Defined cases: null html is an empty payload; a null url has key "" and comes
    first; a null page id is always a response; rows with the same id and payload are all responses if that id is the
    smallest, else all revisits; an empty table gives an empty result.
    """
    return merge_runs(cut(capture_runs(write_archives(pages, least, archive_bytes))))
